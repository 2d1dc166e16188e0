"""Queries of the streaming jobs, run over all input that is there; their SQL is that of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as t
from ..sources.shared import with_checkpoints
from ..streaming import jobs, stateful
from .registry import query


def _pieces(turns: DataFrame) -> DataFrame:
    """Answers of assistant turns as pieces of 40 characters, a tenth of a second apart; the last has the finish marker, and one more piece follows it."""
    n = F.greatest(F.ceil(F.length("text") / 40), F.lit(1)).cast("int")
    cut = turns.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", n.alias("total"))
    cut = cut.select("id", "text", "total", F.explode(F.sequence(F.lit(1), F.col("total") + 1)).alias("n"))
    piece = F.when(F.col("n") <= F.col("total"), F.substr("text", (F.col("n") - 1) * 40 + 1, F.lit(40))).otherwise("after the end")
    return cut.select("id", "n", piece.alias("piece"), (F.col("n") >= F.col("total")).alias("finish"), (1_704_067_200_000 + F.col("n") * 100).cast("long").alias("at_ms"))


_ANSWERS = "select conv_id * 1000 + turn as id, text as answer, greatest(ceil(length(text) / 40), 1)::integer as pieces, true as finished, case when length(text) > 40 then round(ceil(length(text) / 4) / ((ceil(length(text) / 40) - 1) / 10), 6) else 0 end as tokens_per_second from conversations where role = 'assistant'"


@query(_ANSWERS)
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1 STR2: whole answers put together from streamed pieces up to the first finish marker, with their tokens a second."""
    return jobs.run_available(jobs.assembled_answers(_pieces(jobs.table_stream(spark, sf_dir, "conversations")))).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


@query(_ANSWERS)
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1 STR2: the same by one aggregation."""
    return jobs.assembled_batch(_pieces(t.table(spark, sf_dir, "conversations"))).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


@query("select cast(floor(extract(epoch from w)) as bigint) as from_s, user_id, count(*) as used from (select user_id, unnest(generate_series(time_bucket(interval '6 hours', ts::timestamp) - interval '18 hours', time_bucket(interval '6 hours', ts::timestamp), interval '6 hours')) as w from events) group by 1, 2")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: events of each user in sliding day windows, with a watermark."""
    events = jobs.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return jobs.run_available(jobs.windowed_counts(events), "update", ("from_s", "user_id"))


@query(f"select event_id, event, at_ms from (select *, at_ms - lag(at_ms) over (partition by event order by at_ms, event_id) as gap from (select event_id, event || '-' || user_id as event, at_ms from {t.EVENTS_SQL})) where gap is null or gap >= 3600000")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: all events of the log debounced by event time; its files need not be in order."""
    at_ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms")
    events = jobs.table_stream(spark, sf_dir, "events", at_once=True).select("event_id", F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("event"), at_ms)
    end = t.table(spark, sf_dir, "events").agg(F.max(at_ms)).first()[0]
    return jobs.run_available(stateful.debounced_log(events, end, 3_600_000))


_FETCHED = """(select doc_id, case when doc_id % 6 = 0 then null when doc_id % 5 = 0 then md5(text || '!') else md5(text) end as first,
 case when doc_id % 4 = 0 then null else md5(text || '!!') end as second, md5(text) as old from documents where doc_id % 3 = 0)"""
_DAY, _HOUR = 86_400_000, 3_600_000


@query(f"""with f as (select *, {stateful.at_ms(2)} as t from {_FETCHED})
 select doc_id, t + {_DAY} as at_ms, 'fetch' as action, 0 as failures from f
 union all select doc_id, t + {_DAY}, case when first is null then 'failed' when first = old then 'unchanged' else 'changed' end, case when first is null then 1 else 0 end from f
 union all select doc_id, t + {_DAY + _HOUR}, 'fetch', 1 from f where first is null
 union all select doc_id, t + {_DAY + _HOUR}, case when second is null then 'unwatched' else 'changed' end, case when second is null then 1 else 0 end from f where first is null""")
def sync_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5: the log of three runs of the sync job, each from the checkpoint of the one before, over the watched document of each file (the first of three): due documents are fetched, unchanged and
    changed ones wait for their next day, failed ones are due an hour later and are unwatched when they fail again (with one failure allowed)."""
    folder, start = f"{with_checkpoints(spark)}/sync-{uuid.uuid4().hex}", stateful.at_ms(2)
    watched = t.documents(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", "text")
    queues = watched.select("doc_id", F.lit("watch").alias("kind"), F.lit(start).alias("at_ms"), F.md5("text").alias("digest"), F.lit(_DAY).cast("long").alias("stale_ms"))
    queues.write.parquet(f"{folder}/in/watch")
    first = F.when(F.col("doc_id") % 6 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    second = F.when(F.col("doc_id") % 4 != 0, F.md5(F.concat("text", F.lit("!!"))))

    def fetch(due: DataFrame) -> DataFrame:
        return due.join(watched, "doc_id").select("doc_id", "at_ms", F.when(F.col("at_ms") == start + _DAY, first).otherwise(second).alias("digest"))

    for now in (start + _DAY, start + _DAY + _HOUR, start + _DAY + 2 * _HOUR):
        stateful.sync_cycle(spark, folder, now, fetch, failures=1)
    return stateful.sync_log(spark, folder).select("doc_id", "at_ms", "action", "failures")


_OUTCOME = "case when doc_id % 6 = 0 then case when doc_id % 4 = 0 then 'unwatched' else 'missing' end when doc_id % 5 = 0 then 'changed' else 'unchanged' end"


def _sync(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents with their file's name, the watched one of each file (the first of three), and what a fetch of those brings."""
    docs = t.documents(spark, sf_dir).select("doc_id", F.expr("doc_id div 3").alias("name"), "text")
    watched = docs.where("doc_id % 3 = 0").withColumn("failed", F.when(F.col("doc_id") % 4 == 0, 5).otherwise(0))
    fetched = watched.where("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return docs, watched, fetched


@query(f"select doc_id, {_OUTCOME} as outcome from documents where doc_id % 3 = 0")
def document_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5: the outcomes of one sync run over the watched document of each file, as its log has them."""
    docs, watched, fetched = _sync(spark, sf_dir)
    log = f"{with_checkpoints(spark)}/runs-{uuid.uuid4().hex}"
    jobs.sync_run(docs, watched, fetched, log, 1)
    return spark.read.parquet(log).select("doc_id", "outcome")


@query("""with w as (select doc_id // 3 as name, text || '!' as new_text from documents where doc_id % 3 = 0 and doc_id % 6 <> 0 and doc_id % 5 = 0)
 select doc_id, md5(coalesce(new_text, text)) as body, new_text is not null as replaced from documents left join w on name = doc_id // 3""")
def synced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5: after a sync run the copies of changed files have the new text in all workspaces, others stay."""
    docs, watched, fetched = _sync(spark, sf_dir)
    log = f"{with_checkpoints(spark)}/runs-{uuid.uuid4().hex}"
    after = jobs.sync_run(docs, watched, fetched, log, 1)
    old = docs.select("doc_id", F.col("text").alias("old"))
    return after.join(old, "doc_id").select("doc_id", F.md5("text").alias("body"), (~F.col("text").eqNullSafe(F.col("old"))).alias("replaced"))


def _at() -> Column:
    """The time of a turn."""
    return (1_704_067_200_000 + (F.col("conv_id") * 1000 + F.col("turn")) * 60_000).alias("at_ms")


@query("select conv_id as thread_id, max(conv_id * 1000 + turn) as reset_id from conversations where turn % 4 = 2 group by conv_id")
def stream_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9: the last reset of each thread from a stream of resets; after_reset applies them to a history."""
    resets = jobs.table_stream(spark, sf_dir, "conversations").where("turn % 4 = 2").select(F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("reset_id"), _at())
    return jobs.last_resets(resets)


@query("select conv_id as id, arg_max(role || length(text), turn) as value, count(*) as edits from conversations group by conv_id")
def stream_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10: the latest edit of each chat from a stream of edits."""
    edits = jobs.table_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.concat("role", F.length("text").cast("string")).alias("value"), _at())
    return jobs.latest_values(edits)


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder to which all documents come, and every second one once more; the chunk table that the job makes of them, and its counts."""
    base = f"{with_checkpoints(spark)}/ingest-{uuid.uuid4().hex}"
    docs = t.documents(spark, sf_dir).select("doc_id", "namespace", "text")
    docs.write.parquet(f"{base}/in")
    docs.where("doc_id % 2 = 0").write.mode("append").parquet(f"{base}/in")
    counts = stateful.ingested(stateful.arrivals(spark, f"{base}/in", "doc_id long, namespace string, text string"), f"{base}/chunks")
    return f"{base}/chunks", counts


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8 SNK1 SNK2: documents that come to a folder, some twice, become rows of the chunk table once."""
    return spark.read.parquet(_ingested(spark, sf_dir)[0]).groupBy("namespace").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"))


@query("select source as namespace, doc_id, 1 as copies, true as begins from (select *, row_number() over (partition by doc_id, source, text) as n from documents) where n = 1 and length(trim(text)) > 0")
def stream_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8 SNK1: each document's first chunk, with which its text begins, is in the chunk table once, though half of the documents came twice."""
    first = spark.read.parquet(_ingested(spark, sf_dir)[0]).where("chunk_index = 0")
    copies = first.groupBy("namespace", "doc_id").agg(F.count("*").cast("int").alias("copies"), F.min("text").alias("chunk"))
    whole = t.documents(spark, sf_dir).select("doc_id", F.trim("text").alias("whole"))
    return copies.join(whole, "doc_id").select("namespace", "doc_id", "copies", F.startswith("whole", "chunk").alias("begins"))


@query("select count(*) + count(*) filter (doc_id % 2 = 0) as arrived, 0 as late, (select count(*) from (select distinct doc_id, source, text from documents)) as kept from documents")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8: how many documents came to the folder, were late, and were kept."""
    return _ingested(spark, sf_dir)[1]
