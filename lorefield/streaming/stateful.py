"""Streaming jobs whose state has timers: debouncing in event order, and the sync job of watched documents.

Both keep their state with transformWithState in the RocksDB store, key by key, and act when the watermark passes a timer. So files may come out of order within
the watermark's delay, a restarted job goes on from its checkpoint, and state that has nothing left to wait for is deleted.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import with_checkpoints

#: Watermark delay of events (also in milliseconds), retry interval of a failed fetch, failures in a row after which a document is no longer watched.
LATE = "1 hour"
LATE_MS = 3_600_000
RETRY_MS = 3_600_000
#: How long after its time a row still counts for the sync job: its watermark follows the clock by so much, and timers are set as much earlier.
BEHIND_MS = 86_400_000
FAILURES = 5
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rocks_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which timers need."""
    return _setting(spark, _PROVIDER, _ROCKS)


class Debounce(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then decides them in the order of their times. A key has one timer for each batch, at the earliest event that it
    brings; when it expires, all events that the watermark has passed are decided. An event without a time has no previous one and passes at once."""

    def __init__(self, cooldown_ms: int) -> None:
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, event_id long")
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            timeless = part["at_ms"].isna()
            if timeless.any():
                yield part.loc[timeless, ["event_id", "event"]].assign(at_ms=pd.array([None] * int(timeless.sum()), "Int64"))
                part = part[~timeless]
            if len(part):
                times = part["at_ms"].astype("int64").tolist()
                self.waiting.appendList(list(zip(times, part["event_id"].tolist())))
                first = min(times) if first is None else min(first, *times)
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists() and not self.last.exists():
            return  # an earlier timer has decided all
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        kept, later = [], [x for x in waiting if x[0] > now]
        for at, id_ in waiting[: len(waiting) - len(later)]:
            if last is None or at - last >= self.cooldown:
                kept.append((id_, key[0], at))
            last = at
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(later[0][0])
        if last is not None and not later and last + self.cooldown <= now:
            self.last.clear()  # the next event passes anyway
        elif last is not None:
            self.last.update((last,))
            if last + self.cooldown > now:
                self.handle.registerTimer(last + self.cooldown)
        if kept:
            yield pd.DataFrame(kept, columns=["event_id", "event", "at_ms"])

    def close(self) -> None:
        pass


def debounced_in_order(stream: DataFrame, cooldown_ms: int, late: str = LATE) -> DataFrame:
    """Events (event_id, event, at_ms) a cooldown or more after the previous one of their key, by event time: each is decided once the watermark has passed it, in the order of time and id.
    Rows behind the watermark are dropped and counted in the query's progress."""
    timed = stream.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    return timed.groupBy("event").transformWithStateInPandas(Debounce(cooldown_ms), "event_id long, event string, at_ms long", "append", "eventTime")


def debounced_log(stream: DataFrame, end_ms: int | None, cooldown_ms: int) -> DataFrame:
    """Events of a log that has ended, whose latest is at end_ms, debounced to its end: one more row moves the watermark past it, so that nothing is held back. The row has no key, comes
    with the first batch and is never decided itself; the stream has to give all its rows in that batch."""
    if end_ms is not None:
        spark = stream.sparkSession
        folder = f"{with_checkpoints(spark)}/clock-{uuid.uuid4().hex}"
        clock = spark.range(1).select(*[F.lit(end_ms + cooldown_ms + LATE_MS + 1 if f.name == "at_ms" else -1 if f.name == "event_id" else None).cast(f.dataType).alias(f.name) for f in stream.schema])
        clock.write.parquet(folder)
        stream = stream.unionByName(spark.readStream.schema(clock.schema).parquet(folder))
    return debounced_in_order(stream, cooldown_ms)


LOG = "doc_id long, at_ms long, action string, failures long, digest string"
INPUT = "doc_id long, kind string, at_ms long, digest string, stale_ms long"


class SyncQueue(StatefulProcessor):
    """A watched document: its digest, refresh interval and failures in a row; the timer is its next due time."""

    def __init__(self, failures: int, retry_ms: int) -> None:
        self.most, self.retry = failures, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "digest string, stale_ms long, failures long, due long")

    def _due(self, digest: str | None, stale_ms: int, failures: int, due: int) -> None:
        self.queue.update((digest, stale_ms, failures, due))
        self.handle.registerTimer(due - BEHIND_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        order = {"unwatch": 0, "answer": 1, "watch": 2}
        came = sorted(((r.at_ms, order.get(r.kind, 3), r.kind, r.digest, r.stale_ms) for part in rows for r in part.itertuples()), key=lambda r: r[:2])
        for at, _, kind, digest, stale in came:
            if kind == "watch" and not self.queue.exists():
                self._due(digest, int(stale), 0, int(at + stale))
            elif kind == "unwatch" and self.queue.exists():
                self.queue.clear()
            elif kind == "answer" and self.queue.exists():
                old, stale, failures, _ = self.queue.get()
                if digest is None and failures >= self.most:
                    out.append((key[0], at, "unwatched", failures, None))
                    self.queue.clear()
                elif digest is None:
                    out.append((key[0], at, "failed", failures + 1, None))
                    self._due(old, stale, failures + 1, int(at + self.retry))
                else:
                    out.append((key[0], at, "unchanged" if digest == old else "changed", 0, digest))
                    self._due(digest, stale, 0, int(at + stale))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "at_ms", "action", "failures", "digest"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.queue.exists():
            _, _, failures, due = self.queue.get()
            if due == expiredTimerInfo.getExpiryTimeInMs() + BEHIND_MS:  # else an older timer of a queue that has moved on
                yield pd.DataFrame([(key[0], due, "fetch", failures, None)], columns=["doc_id", "at_ms", "action", "failures", "digest"])

    def close(self) -> None:
        pass


def sync_actions(stream: DataFrame, failures: int = FAILURES, retry_ms: int = RETRY_MS) -> DataFrame:
    """Log rows (doc_id, at_ms, action, failures, digest) from a stream of rows (doc_id, kind, at_ms, digest, stale_ms), where kind is watch, unwatch, answer (what a fetch has brought;
    no digest if it failed) or clock (any key; its time moves the watermark on). A due document asks for a fetch; an answer is logged as unchanged or changed, and the document is due again after
    its interval; a failed one is due after retry_ms, and unwatched if so many failures in a row were logged before."""
    timed = stream.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", f"{BEHIND_MS} milliseconds")
    return timed.groupBy("doc_id").transformWithStateInPandas(SyncQueue(failures, retry_ms), LOG, "append", "eventTime")


def sync_cycle(spark: SparkSession, folder: str, now_ms: int, fetch: Callable[[DataFrame], DataFrame], failures: int = FAILURES, retry_ms: int = RETRY_MS) -> None:
    """One scheduled run of the sync job in a shared folder: it takes what has come to folder/in since the last run, moves the clock to now_ms, appends to folder/log, and fetches what is due; the
    answers are the next run's input. fetch: from (doc_id, at_ms) to (doc_id, at_ms, digest), no digest where nothing came. Each batch's files have folders of their own, so that a batch that is run again after a lost
    executor or a restart replaces them."""
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("clock").alias("kind"), F.lit(now_ms).cast("long").alias("at_ms"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("stale_ms"))
    clock.write.mode("overwrite").parquet(f"{folder}/in/clock-{now_ms}")

    def one(batch: DataFrame, n: int) -> None:
        log = f"{folder}/log/batch={n}"
        batch.write.mode("overwrite").parquet(log)
        due = spark.read.schema(LOG).parquet(log).where("action = 'fetch'").select("doc_id", F.lit(now_ms).cast("long").alias("at_ms"))
        if due.head(1):
            answers = fetch(due).select("doc_id", F.lit("answer").alias("kind"), "at_ms", "digest", F.lit(None).cast("long").alias("stale_ms"))
            answers.write.mode("overwrite").parquet(f"{folder}/in/answers-{n}")

    stream = spark.readStream.schema(INPUT).parquet(f"{folder}/in/*")
    with rocks_state(spark):
        writer = sync_actions(stream, failures, retry_ms).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
        writer.foreachBatch(one).start().awaitTermination()


def sync_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG + ", batch long").parquet(f"{folder}/log").drop("batch")


ARRIVALS = "arrived long, late long, kept long"


def ingested(stream: DataFrame, path: str, keep: str = "1 day") -> DataFrame:
    """Documents of a stream (doc_id, namespace, text, and arrived, when they came, by default now) chunked, embedded and added to a chunk table, batch by batch. A document whose text has come within the time to
    keep is skipped: digests are state that ends with the watermark, so no batch reads what earlier ones wrote. Each batch has a folder of its own, so that one that is run again replaces its rows. Returns one row of counts
    of this run: documents that arrived, were behind the watermark, were kept."""
    from ..functions.text import chunks
    from ..operators import embedding

    spark = stream.sparkSession
    if "arrived" not in stream.columns:
        stream = stream.withColumn("arrived", F.current_timestamp())
    digest = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "namespace", "text"), 256).alias("digest")
    seen = stream.select("doc_id", "namespace", "text", "arrived", digest).withWatermark("arrived", keep)
    name = f"ingest-{uuid.uuid4().hex}"
    fresh = seen.observe(f"{name}-in", F.count("*").alias("n")).dropDuplicatesWithinWatermark(["digest"]).observe(f"{name}-out", F.count("*").alias("n"))

    def one(batch: DataFrame, n: int) -> None:
        cut = batch.select("doc_id", "namespace", "digest", F.posexplode(chunks(F.col("text"))).alias("chunk_index", "text"))
        embedding.embedded(cut).write.mode("overwrite").partitionBy("namespace").parquet(f"{path}/batch={n}")

    with _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):  # old digests leave with the next documents
        query = fresh.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").foreachBatch(one).start()
        query.awaitTermination()
    arrived = late = kept = 0
    for progress in query.recentProgress:
        seen_now = progress["observedMetrics"] or {}
        arrived += (seen_now.get(f"{name}-in") or {"n": 0})["n"]
        kept += (seen_now.get(f"{name}-out") or {"n": 0})["n"]
        late += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
    return spark.createDataFrame([(arrived, late, kept)], ARRIVALS)


def arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that come to a folder, with the time at which each came (arrived)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def at_ms(day: int, hour: int = 0) -> int:
    """Milliseconds of a day and hour of January 2024, UTC."""
    return int(datetime.datetime(2024, 1, day, hour, tzinfo=datetime.timezone.utc).timestamp() * 1000)
