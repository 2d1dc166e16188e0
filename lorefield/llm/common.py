"""What the training-data operators share: reading, shared scratch tables, checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern: the six ASCII white-space characters, and a run of anything else (a word).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most this many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch while scratch tables are written: rows hold whole texts.
BATCH_BYTES = 4 << 20


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most about BATCH_BYTES inside; the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends, and not when the driver happens to collect garbage; the session's own setting comes back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lorefield-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def stored(df: DataFrame) -> DataFrame:
    """df written to a new table in the shared folder and read again: lineage is cut, any executor can be lost, and nothing needs the shuffle files that led to it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with bounded_batches(spark), shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast only if its counted rows stay within the limit; else the join shuffles
    and adaptive execution splits its hot keys. small should be a stored table of narrow rows."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= limit else small.hint("merge")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    name = f"lf__{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
