"""Structured Streaming jobs: answers put together from their pieces, windowed quotas, edits and resets, and the batch form of document sync; stateful.py has those with timers.

Each job takes a streaming DataFrame and gives one back; run_available drives it over all input that is there and returns the
written result. Late rows: jobs with a watermark keep one hour; rows behind it are dropped and show in the query's progress.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import with_checkpoints
from .stateful import LATE, rocks_state

#: Progress of the last queries that run_available has run.
PROGRESS: deque = deque(maxlen=100)


def table_stream(spark: SparkSession, sf_dir: str, name: str, at_once: bool = False) -> DataFrame:
    """A table's files as a stream, four a batch; or all in one batch, where a watermark must not pass rows of files that aren't in order of time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader if at_once else reader.option("maxFilesPerTrigger", 4)
    return reader.parquet(f"{sf_dir}/{name}[.]parquet")  # a pattern, as tables may be single files


def run_available(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over the input that is there; its result is a table in the shared folder. In update mode each batch writes a folder of its own, so that a batch that is
    run again replaces its rows, and the last row of each key holds."""
    spark = stream.sparkSession
    base = f"{with_checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        with rocks_state(spark):
            query = writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start()
            query.awaitTermination()
        PROGRESS.extend(query.recentProgress)
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    query = writer.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/rows/batch={n}")).start()
    query.awaitTermination()
    PROGRESS.extend(query.recentProgress)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
    values = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*").select(stream.columns)


ANSWER = "id long, answer string, pieces int, finished boolean, tokens_per_second double"
#: Milliseconds after its last piece for which an answer's state is kept.
KEPT_MS = 3_600_000


def _assembled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    text, pieces, done, first, last = state.get if state.exists else ("", 0, False, None, None)
    rows = pd.concat(list(parts)).sort_values("n")
    if not done:
        for piece, finish, at in zip(rows["piece"], rows["finish"], rows["at_ms"]):
            text, pieces = text + (piece or ""), pieces + 1
            first, last = int(at) if first is None else first, int(at)
            if finish:
                done = True
                speed = -(-len(text) // 4) / ((last - first) / 1000) if last > first else 0.0
                yield pd.DataFrame({"id": [key[0]], "answer": [text], "pieces": [pieces], "finished": [True], "tokens_per_second": [speed]})
                text = ""  # what follows is ignored
                break
    state.update((text, pieces, done, first, last))
    state.setTimeoutTimestamp(max(int(rows["at_ms"].max()) + KEPT_MS, state.getCurrentWatermarkMs() + 1))


def assembled_answers(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Answers from pieces (id, n, piece, finish, at_ms): one row when the first finish marker comes, with the tokens a second from its first piece to its last; pieces after it are
    ignored. An answer is forgotten once the watermark has passed its last piece by KEPT_MS."""
    timed = stream.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    return timed.groupBy("id").applyInPandasWithState(_assembled, ANSWER, "answer string, pieces int, finished boolean, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def assembled_batch(pieces: DataFrame) -> DataFrame:
    """Batch twin of assembled_answers."""
    first = pieces.where("finish").groupBy("id").agg(F.min("n").alias("last"))
    kept = pieces.join(first, "id").where("n <= last").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p"), ((F.max("at_ms") - F.min("at_ms")) / 1000).alias("seconds"))
    answer = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return kept.select("id", answer.alias("answer"), F.size("p").alias("pieces"), F.lit(True).alias("finished"), F.when(F.col("seconds") > 0, F.ceil(F.length(answer) / 4) / F.col("seconds")).otherwise(0.0).alias("tokens_per_second"))


def windowed_counts(stream: DataFrame) -> DataFrame:
    """Events (ts, user_id) of each user in day windows that slide by six hours, with a watermark."""
    w = F.window("ts", "24 hours", "6 hours")
    return stream.withWatermark("ts", LATE).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("used")).select(F.unix_seconds("w.start").alias("from_s"), "user_id", "used")


def synced(current: DataFrame, fetched: DataFrame, failures: int = 5) -> DataFrame:
    """doc_id, outcome of one sync run over watched documents: unchanged, changed, missing, or unwatched after so many failures in a row.
    current: doc_id, text, failed (failures before this run); fetched: doc_id, text."""
    now = fetched.select("doc_id", F.sha2("text", 256).alias("new"))
    both = current.select("doc_id", F.sha2("text", 256).alias("old"), "failed").join(now, "doc_id", "left")
    outcome = (F.when(F.col("new").isNull() & (F.col("failed") >= failures), "unwatched").when(F.col("new").isNull(), "missing")
               .when(F.col("new") == F.col("old"), "unchanged").otherwise("changed"))
    return both.select("doc_id", outcome.alias("outcome"))


def sync_run(chunks: DataFrame, watched: DataFrame, fetched: DataFrame, log: str, run: int) -> DataFrame:
    """One sync run: outcomes of the watched documents are appended to the log under the run's number, and the chunk table (doc_id, name, text) comes back with the new text in
    the rows of all documents whose file has changed, in whatever workspace. watched: doc_id, name, text, failed; fetched: doc_id, text."""
    outcome = synced(watched, fetched)
    outcome.write.mode("overwrite").parquet(f"{log}/run={run}")
    done = watched.sparkSession.read.schema(outcome.schema).parquet(f"{log}/run={run}")
    changed = done.where("outcome = 'changed'").join(watched.select("doc_id", "name"), "doc_id").join(fetched.select("doc_id", F.col("text").alias("new_text")), "doc_id").select("name", "new_text")
    return chunks.join(changed, "name", "left").select("doc_id", "name", F.coalesce("new_text", "text").alias("text"))


def _daily(stream: DataFrame, keys: tuple[str, ...], **of) -> DataFrame:
    """Aggregates of each key and day of a stream with at_ms, kept until the watermark has passed the day, and put together over the days when they are read."""
    timed = stream.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", LATE)
    days = timed.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(*[c.alias(n) for n, c in of.items()])
    return run_available(days.select(F.unix_seconds("w.start").alias("day"), *keys, *of), "update", ("day", *keys))


def last_resets(stream: DataFrame) -> DataFrame:
    """thread_id, reset_id: the last reset of each thread in a stream of resets (thread_id, reset_id, at_ms), run over what is there."""
    return _daily(stream, ("thread_id",), reset_id=F.max("reset_id")).groupBy("thread_id").agg(F.max("reset_id").alias("reset_id"))


def latest_values(stream: DataFrame) -> DataFrame:
    """id, value, edits: the latest of a stream of edits (id, seq, value, at_ms) of each chat, run over what is there."""
    days = _daily(stream, ("id",), seq=F.max("seq"), value=F.max_by("value", "seq"), edits=F.count("*"))
    return days.groupBy("id").agg(F.max_by("value", "seq").alias("value"), F.sum("edits").alias("edits"))
