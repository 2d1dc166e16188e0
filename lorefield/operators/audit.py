"""Quotas, debouncing, duplicate calls, runs, and searches over names and files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 24 * 3600 * 1000


def quota(events: DataFrame, key: str, now_ms: int, limit: Column) -> DataFrame:
    """key, used, allowed: events of each key within the 24 hours before now_ms against a limit; null or non-positive limits let pass."""
    used = events.groupBy(key).agg(F.count_if((F.col("at_ms") >= now_ms - DAY_MS) & (F.col("at_ms") <= now_ms)).alias("used"))
    return used.withColumn("limit", limit).withColumn("allowed", F.col("limit").isNull() | (F.col("limit") <= 0) | (F.col("used") < F.col("limit")))


def debounced(events: DataFrame, key: str, cooldown_ms: int) -> DataFrame:
    """Events at least a cooldown after the previous one of their key; suppressed ones restart the clock as well."""
    w = Window.partitionBy(key).orderBy("at_ms", "event_id")
    gap = F.col("at_ms") - F.lag("at_ms").over(w)
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= cooldown_ms))


def signature(*cols: Column) -> Column:
    """SHA-256 of the JSON of a call's key and parameters."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def first_calls(events: DataFrame, *key: str) -> DataFrame:
    """Calls whose key wasn't seen before."""
    rest = [c for c in events.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct("at_ms", "event_id")).alias("first")
    return events.groupBy(*key).agg(first).select(*key, "first.*").select(events.columns)


def accepted_after_cooldown(events: DataFrame, key: str, cooldown_ms: int) -> DataFrame:
    """event_id, key, at_ms of accepted calls: a call is accepted a cooldown after the last accepted one of its key.

    Acceptance depends on earlier acceptance, so each key is folded in order. Time is first cut into stretches at gaps of a cooldown or more,
    after which any call is accepted; a stretch lies in one task, however many calls its key has, and a task folds its stretches in one pass over sorted batches.
    """
    w = Window.partitionBy("key").orderBy("at_ms", "event_id")
    fresh = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) >= cooldown_ms, F.lit(True))
    calls = events.select(F.col("event_id").cast("long").alias("event_id"), F.col(key).cast("string").alias("key"), F.col("at_ms").cast("long").alias("at_ms"))
    cut = calls.withColumn("fresh", fresh).withColumn("stretch", F.sum(F.col("fresh").cast("int")).over(w))
    placed = cut.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at_ms", "event_id", F.desc("fresh")).select("event_id", "key", "at_ms", "fresh")

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0  # each stretch begins with a fresh call
        for part in parts:
            kept = part.column(3).to_pylist()
            for i, at in enumerate(part.column(2).fill_null(0).to_pylist()):
                if kept[i] or at - last >= cooldown_ms:
                    kept[i], last = True, at
            yield part.select(["event_id", "key", "at_ms"]).filter(pa.array(kept, pa.bool_()))

    return placed.mapInArrow(fold, "event_id long, key string, at_ms long")


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Consecutive rows with one value as one run: key, run, value, size."""
    w = Window.partitionBy(key).orderBy(*order)
    started = rows.withColumn("new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    return started.withColumn("run", F.sum("new").over(w)).groupBy(key, "run", value).agg(F.count("*").alias("size"))


def failed_among_latest(log: DataFrame, key: str, order: str, latest: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("back", F.row_number().over(w)).where(F.col("back") <= latest).groupBy(key).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("runs"))


def fuzzy_names(names: DataFrame, term: str, column: str, distance: int = 3) -> DataFrame:
    """Names that hold the term or lie within an edit distance of it; terms under three characters find nothing."""
    if len(term) < 3:
        return names.limit(0)
    low = F.lower(column)
    return names.where(low.contains(term.lower()) | (F.levenshtein(low, F.lit(term.lower())) <= distance)).distinct()


def file_search(files: DataFrame, term: str) -> DataFrame:
    """Files (folder, name, pos) that a search shows: all of a folder whose name matches; else files whose names hold the term; a
    name within two edits counts only while no earlier file of the folder has matched."""
    hit = F.lower("name").contains(term)
    near = F.levenshtein(F.lower("name"), F.lit(term)) <= 2
    before = Window.partitionBy("folder").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((hit | near).cast("int")).over(before), F.lit(0))
    return files.withColumn("shown", F.lower("folder").contains(term) | hit | (near & (seen == 0))).where("shown").drop("shown")


def daily_quota(events: DataFrame, key: str, now_ms: int, limit: Column, admin: Column) -> DataFrame:
    """key, used, limit, allowed: events in the trailing day against a limit; admins and null limits pass."""
    used = events.groupBy(key).agg(F.count_if((F.col("at_ms") >= now_ms - DAY_MS) & (F.col("at_ms") <= now_ms)).alias("used"))
    return used.withColumn("limit", limit).withColumn("allowed", admin | F.col("limit").isNull() | (F.col("used") < F.col("limit")))


def embed_quota(chats: DataFrame, now_ms: int, per_day: Column, per_session: Column) -> DataFrame:
    """embed_id, session_id, of_embed, of_session, refused: chats (embed_id, session_id, at_ms) of the trailing day against the limits of the embed and of its sessions."""
    recent = F.count_if((F.col("at_ms") >= now_ms - DAY_MS) & (F.col("at_ms") <= now_ms))
    sessions = chats.groupBy("embed_id", "session_id").agg(recent.alias("of_session"))
    embeds = sessions.groupBy("embed_id").agg(F.sum("of_session").alias("of_embed"))
    full = lambda used, limit: (limit > 0) & (F.col(used) >= limit)
    refused = F.when(full("of_embed", per_day), "embed quota").when(full("of_session", per_session), "session quota")
    return sessions.join(embeds, "embed_id").select("embed_id", "session_id", "of_embed", "of_session", refused.alias("refused"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends events (event_id, event, metadata, user_id) to a log, their metadata (a struct) as JSON."""
    events.withColumn("metadata", F.to_json("metadata")).write.mode("append").parquet(path)


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


#: Milliseconds after which a watched document is stale, unless its queue says otherwise.
STALE_AFTER_MS = 7 * DAY_MS


def next_sync(last_ms: Column, stale_after_ms: Column) -> Column:
    return last_ms + F.coalesce(stale_after_ms, F.lit(STALE_AFTER_MS))


def run_summary(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """key, embedded, failed, failed_titles (sorted; null if none), errors (distinct, sorted), message: of rows (key, title, error) of an embedding run."""
    bad = F.col("error").isNotNull()
    titles, errors = F.array_sort(F.collect_list(F.when(bad, F.col("title")))), F.array_sort(F.collect_set("error"))
    out = rows.groupBy(key).agg(F.count_if(~bad).alias("embedded"), F.count_if(bad).alias("failed"), titles.alias("failed_titles"), errors.alias("errors"), *more)
    message = F.concat(F.col("failed").cast("string"), F.lit(" documents failed to add.\n\n"), F.array_join("errors", "\n\n"))
    return out.withColumn("failed_titles", F.when(F.col("failed") > 0, F.col("failed_titles"))).withColumn("message", F.when(F.col("failed") > 0, message))
