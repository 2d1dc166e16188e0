"""Exact deduplication by counting quotient filters.

A 64-bit fingerprint splits into a block, a quotient and a remainder. Each task builds one filter for each block: under each quotient a run of
sorted remainders, the runs one after another with their lengths, and a counter for each remainder. Filters merge without loss, run by run, as sorted lists
merge, by adding the counters of equal remainders. Only fingerprints whose merged count is above one go on to byte verification, where
the normalised texts themselves are the grouping key.

Defined results: a null text counts as empty, so null and blank-only texts form groups like any other; a null id
sorts after all ids; of repeated rows with one id exactly one is kept; an empty table gives an empty result;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checked, stored, text_or_empty, unused

#: Fingerprints for each block, which one task merges; blocks at least; fingerprints that a task holds before it writes its filters.
BLOCK = 1 << 16
LEAST_BLOCKS = 8
HELD = 1 << 20
_U = np.uint64
_FIELDS = ("runs", "remainders", "counts", "large")


def block_bits(rows: int) -> int:
    """High bits of the fingerprint that name a block, so that a block has about BLOCK fingerprints."""
    return math.ceil(math.log2(max(LEAST_BLOCKS, rows / BLOCK)))


def encoded(prints: np.ndarray, counts: np.ndarray, bits: int) -> dict:
    """The counting quotient filter of sorted distinct fingerprints of one block, with about as many quotients as fingerprints: the length of each quotient's
    run, the remainders in as many bytes as they need, a byte for each counter, and the counters that a byte can't hold."""
    slots = max(0, len(prints) - 1).bit_length()
    kept = 64 - bits - slots
    quotient = ((prints >> _U(kept)) & _U((1 << slots) - 1)).astype(np.int64)
    remainder = prints & _U((1 << kept) - 1)
    runs = np.bincount(quotient, minlength=1 << slots)
    return {"slots": slots, "runs": runs.astype(np.uint8 if runs.max() < 256 else np.uint32).tobytes(),
            "remainders": remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-kept // 8)].tobytes(),
            "counts": np.minimum(counts, 255).astype(np.uint8).tobytes(), "large": counts[counts >= 255].astype(np.int64).tobytes()}


def decoded(block: int, fields: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that a filter holds, sorted."""
    slots = fields["slots"]
    kept = 64 - bits - slots
    runs = np.frombuffer(fields["runs"], np.uint8 if len(fields["runs"]) == 1 << slots else np.uint32)
    size = -(-kept // 8)
    wide = np.zeros((int(runs.sum()), 8), np.uint8)
    wide[:, :size] = np.frombuffer(fields["remainders"], np.uint8).reshape(-1, size)
    quotient = np.repeat(np.arange(1 << slots, dtype=_U), runs)
    prints = (_U(block) << _U(64 - bits)) | (quotient << _U(kept)) | wide.view("<u8").ravel().astype(_U)
    counts = np.frombuffer(fields["counts"], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(fields["large"], np.int64)
    return prints, counts


def merged(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of several filters as one: equal remainders of equal quotients add up."""
    prints, counts = (np.concatenate(x) for x in zip(*filters))
    order = np.argsort(prints, kind="stable")  # merges the sorted runs
    prints, counts = prints[order], counts[order]
    at = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[at], np.add.reduceat(counts, at)


def partition_filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counting quotient filters of a partition: one row for each block that occurs."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        block = (prints >> _U(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        rows = [encoded(prints[i:j], counts[i:j], bits) for i, j in zip(at, np.r_[at[1:], len(prints)])]
        return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array([r["slots"] for r in rows], pa.int64()), *(pa.array([r[f] for r in rows], pa.binary()) for f in _FIELDS)], ["block", "slots", *_FIELDS])

    for batch in batches:
        if batch.num_rows:
            held.append(np.asarray(batch.column(0)).view(_U))
            size += batch.num_rows
        if size >= HELD:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def merged_filter(rows: pa.Table, bits: int) -> pa.Table:
    """Merge of one block's filters; of its fingerprints, those with a count above one."""
    prints, counts = merged([decoded(r["block"], r, bits) for r in rows.to_pylist()])
    more = counts > 1
    return pa.table([pa.array(prints[more].view(np.int64)), pa.array(counts[more])], ["fp", "fp_count"])


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column fp) that occur more than once, by merging the partitions' filters."""
    bits = block_bits(rows)
    filters = prints.select("fp").mapInArrow(lambda x: partition_filters(x, bits), "block long, slots long, " + ", ".join(f"{f} binary" for f in _FIELDS))
    return filters.groupBy("block").applyInArrow(lambda x: merged_filter(x, bits), "fp long, fp_count long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    norm = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    source = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    rows = stored(source.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm"), 256).alias("sha")))
    suspects = stored(repeated_fingerprints(rows, rows.count()))
    suspect = checked(suspects)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    verified = (source.withColumn("fp", F.xxhash64("norm")).join(suspect, "fp", "left_semi")
                .groupBy("norm").agg(F.min(rank).alias("first"), F.count("*").alias("size"))
                .select(F.sha2(F.col("norm"), 256).alias("sha"), F.col("first.id").alias("keep"), "size"))
    verified = stored(verified)
    n = verified.count()
    of_groups = rows.join(suspect, "fp", "left_semi").join(checked(verified, n), "sha")
    first_rows = (of_groups.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("sha").agg(F.min("row").alias("keep_row")))
    groups = stored(verified.join(first_rows, "sha"))
    joined = rows.join(checked(groups, n), "sha", "left")
    single = F.col("size").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay."""
    sha = F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE, " "), 256)
    id_, of_sha, any_, n_ = (unused(docs, x) for x in ("id", "sha", "any", "n"))
    rows = exact_groups(docs, id_col, text_col).select(F.col(id_col).alias(id_), F.col("text_sha256").alias(of_sha), F.col("kept").alias("kept"))
    gone = stored(rows.groupBy(id_, of_sha).agg(F.max("kept").alias(any_), F.count("*").alias(n_)).where(~F.col(any_) | (F.col(n_) > 1)))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (sha == F.col(of_sha))
    n = gone.count()
    if not gone.where(F.col(any_)).head(1):
        return docs.join(checked(gone, n), same, "left_anti")
    marked = docs.join(checked(gone, n), same, "left")
    once = marked.where(F.col(n_).isNull()).select(docs.columns)
    again = marked.where(F.col(any_)).dropDuplicates([id_, of_sha]).select(docs.columns)
    return once.unionByName(again)
