"""Streaming jobs with timers: files out of order, restarts, replays and late files."""

import os
import random
import time
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from lorefield.plans import ORACLE_SQL, QUERIES
from lorefield.streaming import jobs, stateful


def run(stream, path):
    """Like a restart each time: the checkpoint and the rows stay in path."""
    with stateful.rocks_state(stream.sparkSession):
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/rows").start()
        query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows"), dropped


def test_debounce_of_files_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    minute = 60_000
    events = [(i, f"k{rng.randrange(4)}", stateful.at_ms(2) + rng.randrange(600) * minute) for i in range(400)]
    arrives = sorted(events, key=lambda e: e[2] + rng.randrange(50) * minute)  # up to 50 minutes out of order
    last = defaultdict(lambda: None)
    expected = set()
    for id_, key, at in sorted(events, key=lambda e: (e[2], e[0])):
        if last[key] is None or at - last[key] >= 5 * minute:
            expected.add((id_, key, at))
        last[key] = at
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, event string, at_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k in range(4):  # four runs, each goes on from the checkpoint
        spark.createDataFrame(arrives[k * 100 : k * 100 + 100], "event_id long, event string, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows, dropped = run(stateful.debounced_in_order(stream, 5 * minute), str(tmp_path))
        assert dropped == 0
    end = max(at for _, _, at in events)
    spark.createDataFrame([(9_000, "clock", end + 120 * minute)], "event_id long, event string, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows, _ = run(stateful.debounced_in_order(stream, 5 * minute), str(tmp_path))
    assert {tuple(r) for r in rows.where("event <> 'clock'").collect()} == expected and rows.count() == len(expected)
    spark.createDataFrame([(9_001, "k0", 0)], "event_id long, event string, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows, dropped = run(stateful.debounced_in_order(stream, 5 * minute), str(tmp_path))
    assert dropped == 1 and rows.where("event_id = 9001").count() == 0


def test_debounce_query_takes_the_whole_log(spark, tmp_path):
    """Events of the last hour, of files in any order, and without a time or a user: as the query's SQL has them."""
    rng, minute, start = random.Random(5), 60, 1_704_067_200
    times = [start + rng.randrange(3000) * minute for _ in range(300)] + [start + 3000 * minute, None, None]
    rows = [(i, at, None if i % 50 == 7 else rng.randrange(3), rng.choice("ab")) for i, at in enumerate(times)]
    rows.sort(key=lambda r: -(r[1] or 0))  # the latest files come first
    for k in range(0, len(rows), 30):
        frame = spark.createDataFrame(rows[k : k + 30], "event_id long, at long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("at"))
        frame.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = {tuple(r) for r in con.execute(ORACLE_SQL["stream_debounce"]).fetchall()}
    assert sum(r[2] is None for r in expected) == 2 and any(r[2] is not None and r[2] > (start + 2940 * minute) * 1000 for r in expected)
    got = QUERIES["stream_debounce"](spark, str(tmp_path)).select("event_id", "event", "at_ms").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_sync_job_over_restarts(spark, tmp_path):
    folder, hour, start = str(tmp_path), 3_600_000, stateful.at_ms(5)
    watch = [(1, "watch", start, "a", 10 * hour), (2, "watch", start, "b", 10 * hour), (3, "watch", start, "c", 30 * hour), (4, "watch", start, "d", 10 * hour)]
    spark.createDataFrame(watch, stateful.INPUT).write.parquet(f"{folder}/in/watch")
    content = {1: "a", 2: None, 3: "c2", 4: "d2"}
    asked = []

    def fetch(due):
        rows = [(r.doc_id, r.at_ms, content[r.doc_id]) for r in due.collect()]
        asked.append(sorted(r[0] for r in rows))
        return spark.createDataFrame(rows, "doc_id long, at_ms long, digest string")

    for now in (10, 11, 12, 13, 14, 20, 40):
        if now == 20:
            spark.createDataFrame([(3, "unwatch", start + 15 * hour, None, None)], stateful.INPUT).write.parquet(f"{folder}/in/unwatch")
        stateful.sync_cycle(spark, folder, start + now * hour, fetch, failures=2)
    got = sorted((r.doc_id, (r.at_ms - start) // hour, r.action, r.failures) for r in stateful.sync_log(spark, folder).collect())
    assert got == sorted([
        (1, 10, "fetch", 0), (2, 10, "fetch", 0), (4, 10, "fetch", 0),
        (1, 10, "unchanged", 0), (2, 10, "failed", 1), (4, 10, "changed", 0),
        (2, 11, "fetch", 1), (2, 11, "failed", 2), (2, 12, "fetch", 2), (2, 12, "unwatched", 2),
        (1, 20, "fetch", 0), (4, 20, "fetch", 0), (1, 20, "unchanged", 0), (4, 20, "unchanged", 0), (1, 30, "fetch", 0), (4, 30, "fetch", 0)])
    assert asked == [[1, 2, 4], [2], [2], [1, 4], [1, 4]]


def test_ingestion_skips_replays_and_counts_late_files(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/chunks"
    schema = "doc_id long, namespace string, text string"

    def drop(rows, age=0):
        before = set(os.listdir(source)) if os.path.isdir(source) else set()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for name in set(os.listdir(source)) - before:
            os.utime(f"{source}/{name}", (time.time() - age, time.time() - age))

    ingest = lambda: stateful.ingested(stateful.arrivals(spark, source, schema), path, keep="1 day").first()
    drop([(1, "n", "one text"), (2, "n", "two text"), (2, "n", "two text")])
    assert tuple(ingest()) == (3, 0, 2)
    drop([(1, "n", "one text"), (3, "m", "three text")])
    assert tuple(ingest()) == (2, 0, 1)
    drop([(4, "m", "four text"), (1, "n", "one text")], age=3 * 86_400)  # behind the watermark
    assert tuple(ingest()) == (2, 2, 0)
    drop([(1, "n", "one text, changed")])
    assert tuple(ingest()) == (1, 0, 1)
    rows = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()) == [(1, "one text"), (1, "one text, changed"), (2, "two text"), (3, "three text")]


def test_latest_values_and_resets_forget_old_days(spark, tmp_path):
    day = 86_400_000
    write = lambda rows: spark.createDataFrame(rows, "id long, seq long, value string, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = stateful.at_ms(2)
    write([(1, 1, "a", start), (1, 2, "b", start + 5), (2, 1, "x", start)])
    stream = spark.readStream.schema("id long, seq long, value string, at_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write([(1, 3, "c", start + 9), (3, 1, "y", start + 9 * day)])
    write([(1, 4, "d", start + 9 * day)])
    got = jobs.latest_values(stream)
    assert {(r.id, r.value, r.edits) for r in got.collect()} == {(1, "d", 4), (2, "x", 1), (3, "y", 1)}
    resets = jobs.last_resets(stream.select(F.col("id").alias("thread_id"), F.col("seq").alias("reset_id"), "at_ms"))
    assert {tuple(r) for r in resets.collect()} == {(1, 4), (2, 1), (3, 1)}
    assert any(s["numRowsRemoved"] > 0 for p in jobs.PROGRESS for s in p["stateOperators"])
