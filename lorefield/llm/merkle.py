"""Merkle manifest of a dataset by butterfly exchange.

Leaves are hashes of rows. A sort by range numbers the leaves of each source without one task seeing a whole source; aligned blocks of FANOUT ** INNER
leaves hash their own subtree each. Then blocks exchange: in a round, the FANOUT neighbours whose numbers differ in one digit only send each
other the hash of their ancestor, and every one of them hashes the parent for itself. So after as many rounds as the tree has levels above the blocks, each block has
the siblings of its whole upper path and the subtree's root, and nothing is sent down. Where a source ends inside an aligned group, its last block also sends for
the partners that don't exist. Subroots of sources exchange the same way, one row for each source.

Defined results: a null field is hashed as `-`, and a null source is a source of its own that comes first; a null id comes first in its source and is not tampered with;
rows with one id go by their leaves, so repeated rows are exchangeable; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, stored

#: Nodes of a run, and levels of the tree that one block hashes itself.
FANOUT = 16
INNER = 3
#: Blocks whose upper proofs (about 64 * FANOUT bytes a level) may be broadcast.
PROOFS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves (source, id, leaf, ...) with place (from 0 by id and leaf, null ids first) and n (leaves) of their source. Sorted by range, so that a source of any size is numbered in parts."""
    parts = stored(leaves.repartitionByRange("source", "id", "leaf", "row").sortWithinPartitions("source", "id", "leaf", "row")
                   .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = stored(parts.groupBy("source", "part").agg(F.count("*").alias("here"), F.min("at").alias("first")))
    whole = Window.partitionBy("source")  # one row for each part of the sort
    earlier = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", earlier.alias("before"), F.sum("here").over(whole).alias("n")))
    same = (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))
    return parts.join(checked(offsets), same).withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("s", "p", "part", "at", "first", "before", "row")


def levels_of(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def tree(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and all levels above them, so many."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _inner(nodes: list[str], n: int, fanout: int, inner: int) -> list[list[str]]:
    """The levels that a block of a source of n leaves hashes itself."""
    return tree(nodes, inner if n > fanout**inner else levels_of(n, fanout), fanout)


def _block(rows: pa.Table, fanout: int, inner: int) -> pa.Table:
    """One row of a block: its leaves in order, packed, and its root."""
    rows = rows.sort_by("place")
    source, block, n = (rows[c][0].as_py() for c in ("source", "block", "n"))
    leaves = rows["leaf"].to_pylist()
    root = _inner(leaves, n, fanout, inner)[-1][0]
    packed = [pa.array([rows[c].combine_chunks().to_pylist()], pa.list_(t)) for c, t in (("id", pa.int64()), ("leaf", pa.string()), ("tampered", pa.string()))]
    return pa.table([pa.array([source], pa.string()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([root]), *packed], ["source", "block", "n", "hash", "ids", "leaves", "tampered"])


def exchanged(units: DataFrame, most: int) -> DataFrame:
    """units (tree, place from 0, count of the tree's units, hash) with hash now the root of their tree and path: for each level the siblings' hashes that come before and
    after the own one. most: the largest count."""
    at = units.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    for turn in range(levels_of(most, FANOUT)):
        step = FANOUT**turn
        digits = lambda df: df.withColumns({
            "group": F.floor(F.col("slot") / (step * FANOUT)), "digit": F.floor(F.col("slot") / step) % FANOUT, "low": F.col("slot") % step})
        # the last unit also sends for those that its own subtree lacks
        stands_for = F.when((F.col("place") == F.col("count") - 1) & (F.col("count") > step), F.floor(F.col("place") / step) * step + step - 1).otherwise(F.col("place"))
        sent = digits(at.withColumn("slot", F.explode(F.sequence(F.col("place"), stands_for))))
        partners = Window.partitionBy("tree", "group", "low").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # FANOUT rows at most
        all_ = F.collect_list("hash").over(partners)
        met = sent.withColumn("all", all_).where(F.col("slot") == F.col("place"))
        side = lambda first, n: F.array_join(F.slice("all", first, n), "")
        digit, more = F.col("digit").cast("int"), F.col("count") > step
        now = F.struct(side(F.lit(1), digit).alias("left"), side(digit + 2, F.greatest(F.size("all") - digit - 1, F.lit(0))).alias("right"))
        at = stored(met.withColumn("path", F.when(more, F.concat("path", F.array(now))).otherwise(F.col("path")))
                    .withColumn("hash", F.when(more, F.sha2(F.array_join("all", ""), 256)).otherwise(F.col("hash"))).select("tree", "place", "count", "hash", "path"))
    return at


def _proofs(batches: Iterator[pa.RecordBatch], fanout: int, inner: int) -> Iterator[pa.RecordBatch]:
    """From rows (n, ids, leaves, tampered, path, subroot, root), one for each block: the rows of its leaves."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        for k in range(batch.num_rows):  # a row is a whole block
            row = batch.slice(k, 1).to_pylist()[0]
            leaves, n = row["leaves"], len(row["leaves"])
            levels = _inner(leaves, row["n"], fanout, inner)[:-1]
            joined = [["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)] for level in levels]
            upper = "".join(p["left"] + p["right"] for p in row["path"])
            proofs, folded = [], []
            for i, tampered in enumerate(row["tampered"]):
                siblings, now = [], tampered
                for runs in joined:
                    run, cut = runs[i // fanout], 64 * (i % fanout)
                    siblings += [run[:cut], run[cut + 64 :]]
                    now, i = sha(run[:cut] + now + run[cut + 64 :]), i // fanout
                for p in row["path"]:
                    now = sha(p["left"] + now + p["right"])
                proofs.append(sha("".join(siblings) + upper))
                folded.append(now)
            same = lambda x: pa.array([x] * n, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(leaves, pa.string()), same(row["subroot"]), same(row["root"]), pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                                              pa.array(np.array(folded, object) == row["root"], pa.bool_())], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256, and the audit of a copy in which some texts changed: folded_root, verified."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    hashed = lambda changed: leaf_hash(*[changed if f == text_col else F.col(f) for f in fields])
    altered = F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 5 == 0, F.lit(False)) & F.coalesce(text.rlike("[A-Z]"), F.lit(False))
    own = docs.select(F.col(source_col).cast("string").alias("source"), id_.alias("id"), hashed(text).alias("leaf"),
                      F.when(altered, hashed(F.translate(text, _UPPER, _LOWER))).alias("changed"), F.monotonically_increasing_id().alias("row"))
    placed = numbered(stored(own.select("source", "id", "leaf", F.coalesce("changed", "leaf").alias("tampered"), "row")))
    fanout, inner = FANOUT, INNER
    size = fanout**inner
    packed = placed.withColumn("block", F.floor(F.col("place") / size)).select("source", "block", "n", "place", "id", "leaf", "tampered").groupBy("source", "block")
    blocks = stored(packed.applyInArrow(lambda rows: _block(rows, fanout, inner), "source string, block long, n long, hash string, ids array<long>, leaves array<string>, tampered array<string>"))
    units = blocks.select(F.col("source").alias("tree"), F.col("block").alias("place"), F.ceil(F.col("n") / size).alias("count"), "hash")
    count, most = blocks.agg(F.count("*"), F.coalesce(F.max("block") + 1, F.lit(0))).first()
    inside = stored(exchanged(units, most))
    subroots = stored(inside.where("place = 0").select(F.col("tree").alias("source"), "hash"))
    sources = subroots.count()
    ranked = ranked_first(subroots).select(F.lit(0).alias("tree"), F.col("rank").alias("place"), F.lit(sources).cast("long").alias("count"), "hash", "source")
    tops = stored(exchanged(ranked.drop("source"), sources)).select(F.col("place").alias("rank"), F.col("hash").alias("root"), F.col("path").alias("above"))
    named = stored(ranked.select("source", F.col("place").alias("rank")).join(checked(tops, sources, PROOFS), "rank").select(F.col("source").alias("of_source"), "root", "above"))
    proved = stored(inside.join(checked(named, sources, PROOFS), F.col("tree").eqNullSafe(F.col("of_source"))).select(
        "tree", F.col("place").alias("of_block"), F.col("hash").alias("subroot"), "root", F.concat("path", "above").alias("path")))
    same = F.col("source").eqNullSafe(F.col("tree")) & (F.col("block") == F.col("of_block"))
    rows = blocks.join(checked(proved, count, PROOFS), same).select("n", "ids", "leaves", "tampered", "path", "subroot", "root")
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(partial(_proofs, fanout=fanout, inner=inner), schema).withColumnRenamed("id", id_col)


def ranked_first(sources: DataFrame) -> DataFrame:
    """rank of each source, null first, by bytes: ranks inside sorted parts, plus the parts' offsets."""
    parts = stored(sources.repartitionByRange("source").sortWithinPartitions("source").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = parts.groupBy("part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    earlier = F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each part
    offsets = stored(counts.select("part", "first", earlier.alias("before")))
    return stored(parts.join(checked(offsets), "part").withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before"))

