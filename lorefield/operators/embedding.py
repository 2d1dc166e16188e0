"""Embedding chunks through a pluggable embedder, with a content-addressed cache; chunk snapshots; summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import with_checkpoints

Embedder = Callable[[list[str]], np.ndarray]


@lru_cache(1 << 17)
def _slot(word: str, width: int) -> int:
    """Twice a word's slot, plus one if it counts up there and not down."""
    h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return 2 * (h % width) + (h >> 63)


def hashing_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """Default embedder: words hashed to signed slots, scaled to length 1. Needs no model and is the same everywhere."""
    words = [text.lower().split() for text in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    slots = np.fromiter((_slot(word, width) for w in words for word in w), np.int64, len(owner))
    counts = np.bincount(owner * (2 * width) + slots, minlength=len(texts) * 2 * width).reshape(len(texts), width, 2)
    out = (counts[:, :, 1] - counts[:, :, 0]).astype(float)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def cache_key(text: Column, size: int, overlap: int) -> Column:
    """Digest of a chunk's text and of the settings that cut it, so that either change misses the cache."""
    return F.sha2(F.concat_ws("|", F.lit(f"{size}/{overlap}"), text), 256)


def write_cache(rows: DataFrame, path: str) -> None:
    """Adds rows (key, namespace, ...) to the vector cache."""
    append_chunks(rows.dropDuplicates(["key"]), path)


def split_by_cache(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose key the cache holds, and the others."""
    keys = cache.select("key").distinct()
    return chunks.join(keys, "key", "left_semi"), chunks.join(keys, "key", "left_anti")


def embedded(chunks: DataFrame, embedder: Embedder = hashing_embedder, batch: int = 500, max_chars: int | None = None) -> DataFrame:
    """chunks (with text) plus embedding; texts go to the embedder in batches. A text longer than the embedder's longest input, if it has one, goes there in pieces, and its
    vector is the mean of theirs, scaled to length 1. Other columns pass through as they are."""
    names = chunks.columns
    at = names.index("text")

    def vectors(texts: list[str]) -> np.ndarray:
        pieces = [[x[i : i + max_chars] for i in range(0, max(1, len(x)), max_chars)] if max_chars else [x] for x in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
        found = np.asarray(embedder([y for p in pieces for y in p]), float)
        if len(found) == len(texts):
            return found
        out = np.zeros((len(texts), found.shape[1]))
        np.add.at(out, owner, found)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, batch):
                rows = part.slice(i, batch)
                made = vectors([x or "" for x in rows.column(at).to_pylist()]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*names, "embedding"])

    return chunks.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in chunks.schema), T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def checked_schema(chunks: DataFrame, required: dict[str, str]) -> DataFrame:
    """chunks, if it has the required columns with their types; others may be there."""
    have = dict(chunks.dtypes)
    for name, kind in required.items():
        if have.get(name) != kind:
            raise ValueError(f"column {name} should be {kind} and is {have.get(name, 'missing')}")
    return chunks


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Appends to the chunk table, partitioned by namespace; the job's commit makes all rows visible or none."""
    chunks.write.mode("append").partitionBy("namespace").parquet(path)


def next_snapshot(chunks: DataFrame, gone: DataFrame, key: str, path: str) -> DataFrame:
    """A new snapshot of the chunk table without the rows whose key is gone; the caller switches to its path."""
    chunks.join(gone.select(key).distinct(), key, "left_anti").write.partitionBy("namespace").parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def first_sentences(text: str, n: int = 2) -> str:
    """Default summariser: the first sentences of a text."""
    import re

    return " ".join(re.split(r"(?<=[.!?])\s+", text.strip())[:n])


def summarized(docs: DataFrame, limit: int, summarizer: Callable[[str], str] = first_sentences, pieces: Callable[[Column], Column] | None = None, rounds: int = 8) -> DataFrame:
    """doc_id, summary, levels: texts within the limit stay (levels 0). A longer one is cut, at paragraphs unless pieces says otherwise, each piece is summarised and
    the summaries are joined in order; what is still over the limit is cut and summarised again, level by level, and what fits is summarised once more as a whole. A summariser
    that doesn't shorten ends after `rounds` levels. A null text has a null summary; doc_id names a text."""
    from ..functions.text import chunks

    cut = pieces or (lambda x: chunks(x, 10_000, 500, ("\n\n", "\n")))

    @F.pandas_udf("string")
    def short(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: summarizer(x or ""))

    with_checkpoints(docs.sparkSession)
    over = F.coalesce(F.length("text") > limit, F.lit(False))
    done = docs.where(~over).select("doc_id", F.col("text").alias("summary"), F.lit(0).alias("levels"))
    rest = docs.where(over).select("doc_id", "text")
    for level in range(1, rounds + 1):
        parts = rest.select("doc_id", F.posexplode_outer(cut(F.col("text"))).alias("n", "piece")).select("doc_id", F.struct("n", short("piece").alias("s")).alias("p"))
        joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "\n").alias("text")).checkpoint()
        last = over & F.lit(level < rounds)
        done = done.unionByName(joined.where(~last).select("doc_id", short("text").alias("summary"), F.lit(level).alias("levels")))
        rest = joined.where(last)
        if rest.isEmpty():
            break
    return done
