"""The supplied tables, and the views on them that stand for documents, chats, chunks, users and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records: documents with title, published, namespace and chunk source."""
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", F.concat(F.lit("doc-"), doc).alias("title"), F.lit("2024-01-01").alias("published"), F.col("source").alias("namespace"),
        F.concat(F.when(F.col("doc_id") % 4 == 0, "link://https://").when(F.col("doc_id") % 4 == 1, "confluence://").when(F.col("doc_id") % 4 == 2, "youtube://").otherwise(""),
                 F.lit("host.example.com/"), doc, F.when(F.col("doc_id") % 4 == 1, "?payload=x").otherwise("")).alias("chunk_source"))


DOCUMENTS_SQL = """(select doc_id, text, lang, source, 'doc-' || doc_id as title, '2024-01-01' as published, source as namespace,
  (case doc_id % 4 when 0 then 'link://https://' when 1 then 'confluence://' when 2 then 'youtube://' else '' end) || 'host.example.com/' || doc_id ||
  (case when doc_id % 4 = 1 then '?payload=x' else '' end) as chunk_source from documents)"""


def sources_of(chat_id: Column) -> Column:
    """Three cited sources of a chat; every fourth chat's third one has no score, as pinned ones have."""
    def one(k: int) -> Column:
        n = (chat_id * 3 + k) % 50
        score = F.lit(None).cast("double") if k == 3 else F.lit(1.0 / (k + 1))
        if k == 3:
            score = F.when(chat_id % 4 != 0, F.lit(0.25))
        return F.struct(F.concat(F.lit("s"), n.cast("string")).alias("id"), F.concat(F.lit("doc-"), (n % 20).cast("string")).alias("title"),
                        F.concat(F.lit("chunk "), n.cast("string")).alias("text"), score.alias("score"))
    return F.array(*[one(k) for k in (1, 2, 3)])


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows: each user turn with the assistant turn that follows it at once; a null answer where none does."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    c, i = F.col("conv_id"), F.col("conv_id") * 1000 + F.col("turn")
    return turns.where("role = 'user'").select(
        i.alias("id"), c.alias("thread_id"), F.col("turn"), F.col("text").alias("prompt"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
        (c % 25).alias("workspace_id"), F.when(c % 7 != 0, c % 150 + 1).alias("user_id"), F.when(c % 11 == 0, F.concat(F.lit("api-"), (c % 3).cast("string"))).alias("api_session_id"),
        (F.col("turn") % 5 != 4).alias("include"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("feedback"), (F.lit(1704067200) + i * 60).cast("long").alias("created_s"),
        sources_of(i).alias("sources"))


CHATS_SQL = """(select conv_id * 1000 + turn as id, conv_id as thread_id, turn, text as prompt, case when next_role = 'assistant' then next_text end as answer,
  conv_id % 25 as workspace_id, case when conv_id % 7 <> 0 then conv_id % 150 + 1 end as user_id, case when conv_id % 11 = 0 then 'api-' || (conv_id % 3) end as api_session_id,
  turn % 5 <> 4 as include, case (conv_id * 1000 + turn) % 3 when 0 then true when 1 then false end as feedback, 1704067200 + (conv_id * 1000 + turn) * 60 as created_s
  from (select *, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)) where role = 'user')"""

SOURCES_SQL = f"""(select c.*, k, 's' || ((id * 3 + k) % 50) as source_id, 'doc-' || ((id * 3 + k) % 50 % 20) as title, 'chunk ' || ((id * 3 + k) % 50) as chunk,
  case k when 1 then 0.5 when 2 then 1.0 / 3 else case when id % 4 <> 0 then 0.25 end end as score from {CHATS_SQL} c, (select unnest([1, 2, 3]) as k))"""


def response_json(chat: DataFrame) -> DataFrame:
    """chat with its response as the JSON text in which chats are stored."""
    attachment = F.struct(F.lit("image/png").alias("mime"), F.lit("i.png").alias("name"), F.lit("QUJD").alias("contentString"))
    body = F.struct(F.col("answer").alias("text"), F.lit("chat").alias("type"), "sources", F.when(F.col("id") % 10 == 1, F.array(attachment)).otherwise(F.array().cast("array<struct<mime:string,name:string,contentString:string>>")).alias("attachments"))
    return chat.withColumn("response", F.to_json(body))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records: embeddings with their label as namespace."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("namespace"), "embedding")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.col("props").alias("metadata"), "user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms"), "value")


EVENTS_SQL = "(select event_id, event_type as event, props as metadata, user_id, epoch_us(ts) // 1000 as at_ms, value from events)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment"), "c_nationkey")


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces; one in six is missing, so that joins meet deleted ones."""
    return table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").cast("long").alias("workspace_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.col("n_regionkey").cast("long").alias("region"))


WORKSPACES_SQL = "(select cast(n_nationkey as bigint) as workspace_id, n_name as name, lower(n_name) as slug, cast(n_regionkey as bigint) as region from nation where n_nationkey % 6 <> 5)"
