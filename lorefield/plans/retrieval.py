"""Queries of vector search, context assembly and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import pieces
from ..operators import context, search
from ..sources import tables as t
from .registry import query

_DOT = "list_sum(list_transform(range(1, 65), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double)))"
_PAIRS = f"(select b.vec_id as question_id, a.vec_id as id, a.label as namespace, list_cosine_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d from embeddings a, embeddings b where b.vec_id % 100 = 0)"
_TOP4 = f"(select *, row_number() over (partition by question_id order by d, id) as rank from {_PAIRS} qualify rank <= 4)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chunks(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("question_id"), "embedding", "namespace")


@query(f"select question_id, id, round(1 - d, 6) as score, rank from {_TOP4} where 1 - d >= 0.25")
def vector_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON16 TOP1 FLT3 PRJ3 SCL37 SCL38: four nearest chunks of each question (every hundredth vector), threshold after the limit."""
    hits = search.nearest(t.chunks(spark, sf_dir), _questions(spark, sf_dir), 4).withColumn("score", V.similarity(F.col("distance")))
    return search.within_threshold(hits).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""with lead as (select label, arg_min(embedding, vec_id) as q, min(vec_id) as lead_id from embeddings group by label)
 select vec_id as id, lead_id, round(case when d >= 1 then 1 when d < 0 then 1 - abs(d) else 1 - d end, 6) as score from (select vec_id, lead_id, list_cosine_distance(cast(embedding as double[]), cast(q as double[])) as d from embeddings join lead using (label))""")
def similarity_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL37 SCL38: every chunk's similarity to the first one of its namespace by column functions, in the older rule."""
    chunks = t.chunks(spark, sf_dir)
    leads = chunks.groupBy("namespace").agg(F.min("id").alias("lead_id"), F.min_by("embedding", "id").alias("q"))
    d = V.cosine_distance(F.col("embedding"), F.col("q"))
    return chunks.join(leads, "namespace").select("id", "lead_id", F.round(V.similarity(d, compat=True), 6).alias("score"))


@query("select vec_id as id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as old_norm, 1.0::double as new_norm from embeddings")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL39: vectors scaled to length 1."""
    c = t.chunks(spark, sf_dir)
    return c.select("id", F.round(V.norm(F.col("embedding")), 6).alias("old_norm"), V.normalized(F.col("embedding")).alias("v")).select("id", "old_norm", F.round(V.norm(F.col("v")), 6).alias("new_norm"))


@query("select cast(label as bigint) as namespace, count(*) as vectors, min(vec_id) as first_id, max(vec_id) as last_id, sum(count(*)) over ()::bigint as total from embeddings group by label")
def vector_count_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 AGG2 AGG3: vectors in all and by namespace, with their range."""
    g = t.chunks(spark, sf_dir).groupBy("namespace").agg(F.count("*").alias("vectors"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    total = g.agg(F.sum("vectors").alias("total"))  # one row
    return g.join(F.broadcast(total), F.lit(True))


_RERANKED = """with n as (select label, greatest(10, least(50, ceil(count(*) / 10)))::bigint as most from embeddings group by label),
 v as (select b.vec_id as question_id, a.vec_id as id, a.label, list_cosine_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d from embeddings a join embeddings b on a.label = b.label and b.vec_id % 100 = 0),
 c as (select * from (select v.*, row_number() over (partition by question_id order by d, id) as rank, most from v join n using (label)) where rank <= most),
 w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as ws, text as head from documents),
 q as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(head), '\\s+'), lambda x: x <> '')) as ws from w),
 s as (select c.*, case when len(q.ws) > 0 then len(list_intersect(q.ws, w.ws)) / len(q.ws) else 0 end as rerank from c join w on w.doc_id = c.id join q on q.doc_id = c.question_id),
 r as (select *, row_number() over (partition by question_id order by rerank desc, rank, id) as place from s)
 select question_id, id, place, d, case when rerank <> 0 then rerank else 1 - d end as score from r where place <= 4 and 1 - d >= 0.25 and id % 7 <> 0"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are every hundredth vector with the text of its document; pinned are the documents with ids divisible by seven."""
    docs, asked = t.documents(spark, sf_dir), _questions(spark, sf_dir)
    texts = docs.select(F.col("doc_id").alias("id"), "text", "title", "published", "chunk_source", "source")
    question = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    found = search.candidates(t.chunks(spark, sf_dir), asked).join(texts, "id").join(question, "question_id").withColumn("similarity", V.similarity(F.col("distance")))
    return search.without_pinned(search.reranked(found), docs.where("doc_id % 7 = 0"))


@query(f"select question_id, id, place, round(score, 6) as score from ({_RERANKED})")
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2 UDF2 JON16: nearest candidates of the question's namespace scored again by word overlap, cut to four, then held against the threshold by similarity, pinned ones left out."""
    return _reranked(spark, sf_dir).select("question_id", "id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query(f"""select question_id, id, md5(text) as text_md5, '{{"url":"file://' || doc_id || '","title":"doc-' || doc_id || '","author":"unknown","docSource":"' || source || '","chunkSource":"' || chunk_source || '","published":"2024-01-01","wordCount":' || len(string_split(text, ' ')) || ',"tokenCount":' ||
 (case when length(text) >= 5120 then ceil(length(text) / 8) else ceil(length(text) / 4) end)::bigint || '}}' as metadata, round(d, 6) as distance, round(score, 6) as score from ({_RERANKED}) r join {t.DOCUMENTS_SQL} on doc_id = id""")
def search_api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4: rows of the search interface: id, text, metadata, distance and score."""
    name = F.col("id").cast("string")
    found = search.api_rows(_reranked(spark, sf_dir).withColumns({"url": F.concat(F.lit("file://"), name), "docAuthor": F.lit("unknown"), "docSource": F.col("source"), "chunkSource": F.col("chunk_source"),
                                                                  "wordCount": pieces(F.col("text")), "token_count_estimate": context.token_estimate(F.col("text"))}))
    return found.select("question_id", "id", F.md5("text").alias("text_md5"), F.to_json("metadata").alias("metadata"), F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_PINNED = f"(select title, published from {t.DOCUMENTS_SQL} where doc_id % 7 = 0)"


@query(f"""with top as (select *, row_number() over (partition by source order by doc_id) as rank from {t.DOCUMENTS_SQL} qualify rank <= 8)
 select source, doc_id, rank from top where title || published not in (select title || published from {_PINNED})""")
def pinned_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON10 SCL40 FLT7: pinned sources leave the top eight after the limit."""
    docs = t.documents(spark, sf_dir)
    top = docs.select("source", "doc_id", "title", "published").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rank <= 8")
    return search.without_pinned(top, docs.where("doc_id % 7 = 0")).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""select doc_id as id, score, length(body)::bigint as chars from (select doc_id, title || published as key, case when doc_id % 3 < 2 then 1.0 / (1 + doc_id % 5) end as score, case when doc_id % 4 > 0 then text end as body from {t.DOCUMENTS_SQL})
 where score is not null and body is not null and key not in (select title || published from {_PINNED}) and id % 11 <> 0""")
def usable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7 SCL40: sources with a score and a text that are neither pinned nor seen."""
    docs = t.documents(spark, sf_dir)
    i = F.col("doc_id")
    sources = docs.select(i.alias("id"), "title", "published", F.when(i % 3 < 2, 1.0 / (1 + i % 5)).alias("score"), F.when(i % 4 > 0, F.col("text")).alias("text"))
    found = search.usable(sources, docs.where("doc_id % 7 = 0"), docs.where("doc_id % 11 = 0").select(i.alias("id")))
    return found.select("id", "score", F.length("text").cast("long").alias("chars"))


@query(f"""select namespace, doc_id, before from (select namespace, doc_id, coalesce(sum(tokens) over (partition by namespace order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
 from (select namespace, doc_id, case when length(text) >= 5120 then ceil(length(text) / 8) else ceil(length(text) / 4) end as tokens from {t.DOCUMENTS_SQL} where text is not null)) where before < 3000""")
def pinned_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2: pinned documents of each namespace while the tokens before them stay under the budget."""
    return context.pinned_within(t.documents(spark, sf_dir), 3000).select("namespace", "doc_id", "before")


@query(f"""with hits as (select workspace_id as question_id, source_id, chunk, 0 as prio, 0 as age, min(id * 10 + k) as pos from {t.SOURCES_SQL} where k = 1 and id % 100 = 0 group by all),
 old as (select workspace_id as question_id, source_id, chunk, 1 as prio, -id as age, k as pos from {t.SOURCES_SQL} where score is not null and include),
 allof as (select * from (select question_id, source_id, chunk, prio, age, pos, row_number() over (partition by question_id, source_id order by prio, age, pos) as n from (select * from hits union all select * from old)) where n = 1)
 select question_id, source_id, row_number() over (partition by question_id order by prio, age, pos) as rank from allof qualify rank <= 6""")
def fill_source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3 SET1: search hits (of every hundredth chat) first, then sources of earlier chats newest first, each once, up to six."""
    old = t.chats(spark, sf_dir).select("id", "workspace_id", "thread_id", "include", F.posexplode("sources").alias("k", "s"))
    hits = old.where("k = 0 and id % 100 = 0").groupBy(F.col("workspace_id").alias("question_id"), F.col("s.id").alias("source_id")).agg(F.min(F.col("id") * 10 + F.col("k") + 1).alias("pos"))
    earlier = old.where("s.score is not null and include").select(F.col("workspace_id").alias("question_id"), F.col("s.id").alias("source_id"), (-F.col("id")).alias("age"), F.col("k").cast("long").alias("pos"))
    return context.filled_window(hits, earlier, 6).select("question_id", "source_id", F.col("rank").cast("long").alias("rank"))


@query("select conv_id, count(*) as messages, (3 * count(*) + sum(ceil(length(text) / 4)) + 5)::bigint as tokens, (3 * count(*) + sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) + 5)::bigint as by_words from conversations group by conv_id")
def history_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17 SCL3 UDF3: token estimates of message lists, by the default estimate and by another tokeniser."""
    turns = t.table(spark, sf_dir, "conversations")
    by_words = lambda text: F.size(F.filter(F.split(text, " ", -1), lambda x: x != ""))
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), context.message_tokens("text").alias("tokens"), context.message_tokens("text", by_words).alias("by_words"))


_UNION = f"""(select workspace_id, 0 as prio, doc_id as pos, 'doc-' || doc_id as title from (select doc_id, doc_id % 25 as workspace_id from documents where doc_id % 40 = 0)
 union all select doc_id % 25, 1, doc_id, 'file-' || doc_id from documents where doc_id % 60 = 1
 union all select question_id % 25, 2, question_id * 10 + place, 'chunk-' || id from ({_RERANKED})
 union all select workspace_id, 3, -id * 10 + k, title from {t.SOURCES_SQL} where score is not null and include and turn = 0)"""


@query(f"select workspace_id, row_number() over (partition by workspace_id order by prio, pos) - 1 as place, prio::bigint as prio, title from {_UNION}")
def context_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: pinned documents, attached files, search hits and earlier sources of each workspace in one order; duplicates stay."""
    docs, workspace = t.documents(spark, sf_dir), (F.col("doc_id") % 25).alias("workspace_id")
    pinned = docs.where("doc_id % 40 = 0").select(workspace, F.col("doc_id").alias("pos"), "title")
    attached = docs.where("doc_id % 60 = 1").select(workspace, F.col("doc_id").alias("pos"), F.concat(F.lit("file-"), "doc_id").alias("title"))
    hits = _reranked(spark, sf_dir).select((F.col("question_id") % 25).alias("workspace_id"), (F.col("question_id") * 10 + F.col("place")).alias("pos"), F.concat(F.lit("chunk-"), "id").alias("title"))
    earlier = t.chats(spark, sf_dir).where("turn = 0 and include").select("workspace_id", "id", F.posexplode("sources").alias("k", "s")).where("s.score is not null").select(
        "workspace_id", (-F.col("id") * 10 + F.col("k") + 1).alias("pos"), F.col("s.title").alias("title"))
    return context.union_in_order("workspace_id", "pos", pinned, attached, hits, earlier).select("workspace_id", F.col("place").cast("long").alias("place"), F.col("prio").cast("long").alias("prio"), "title")


@query(f"""with h as (select thread_id, id, prompt, answer, max(id) over (partition by thread_id) as last from {t.CHATS_SQL} where answer is not null)
 select thread_id, (2 * count(*))::bigint as messages, md5(string_agg(case when id < last then 'user:' || prompt || chr(10) || 'assistant:' || answer end, chr(10) order by id)) as history, 'Be brief.' || chr(10) || 'Context:' || chr(10) || '    [CONTEXT 0]:' || chr(10) || 'note ' || thread_id || chr(10) || '[END CONTEXT 0]' || chr(10) || chr(10) as system,
 arg_max(prompt, id) as prompt from h group by thread_id""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11 PRJ8: system prompt with context, history and the user's prompt as one message list."""
    chats = t.chats(spark, sf_dir).where("answer is not null")
    turn = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    lists = chats.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("id", turn.alias("m")))).alias("chats"))  # one conversation's turns
    parts = lists.select("thread_id", F.element_at("chats", -1)["m"][0]["content"].alias("prompt"), F.flatten(F.transform(F.slice("chats", F.lit(1), F.size("chats") - 1), lambda x: x["m"])).alias("history"))
    note = F.array(F.concat(F.lit("note "), F.col("thread_id").cast("string")))
    made = parts.select("thread_id", context.prompt_messages(F.lit("Be brief."), note, F.col("history"), F.col("prompt")).alias("m"))
    text = F.array_join(F.transform(F.slice("m", F.lit(2), F.size("m") - 2), lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return made.select("thread_id", F.size("m").cast("long").alias("messages"), F.md5(F.nullif(text, F.lit(""))).alias("history"), F.get("m", 0)["content"].alias("system"), F.element_at("m", -1)["content"].alias("prompt"))


@query("""select p_partkey as id, w, floor(w * 0.15)::bigint as history, floor(w * 0.15)::bigint as system, floor(w * 0.7)::bigint as user_share, floor(w * 0.15 * 0.25)::bigint as system_prompt, floor(w * 0.15 * 0.75)::bigint as system_context,
 case when u > floor(w * 0.7) then floor(w * 0.7 * 0.8)::bigint else u end as user_kept, (w - 600)::bigint as before_reply from (select p_partkey, (1000 + p_size * 100)::bigint as w, (p_retailprice * 2)::bigint as u from part)""")
def budget_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL55: shares of a context window, what an oversize prompt is cut to, and the parts of the system share."""
    part = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1000 + F.col("p_size") * 100).cast("long").alias("w"), F.round(F.col("p_retailprice") * 2).cast("long").alias("u"))
    return part.select("id", "w", *[c.alias(k) for k, c in context.budget(F.col("w"), F.col("u")).items()])


def _cut_sql(text: str) -> str:
    n = f"ceil(length({text}) / 4)::bigint"
    half = f"round(({n} - 136) / 2.0)::bigint"
    return f"case when {n} < 136 then {text} else left({text}, 4 * greatest({n} // 2 - {half}, 0)) || E'\\n\\n--prompt truncated for brevity--\\n\\n' || substr({text}, 4 * ({n} // 2 + {half}) + 1) end"


@query(f"""with recursive c as (select thread_id, id, prompt, answer, row_number() over (partition by thread_id order by id desc) as back, {_cut_sql("prompt")} as p2, {_cut_sql("answer")} as a2 from {t.CHATS_SQL} where answer is not null),
 s as (select *, (ceil(length(prompt) / 4) + ceil(length(answer) / 4))::bigint as whole, (11 + ceil(length(p2) / 4) + ceil(length(a2) / 4))::bigint as cut from c),
 f as (select distinct thread_id, 0::bigint as back, 0::bigint as used, false as over, false as kept, 0::bigint as tokens from s
  union all select thread_id, back, used + case when kept then tokens else 0 end, over, kept, tokens from (
   select s.thread_id, s.back, f.used, f.used + whole >= 300 and s.back > 3 as over, f.used + whole < 300 or (s.back <= 3 and f.used + cut <= 300) as kept, case when f.used + whole < 300 then whole else cut end as tokens
   from f join s on s.thread_id = f.thread_id and s.back = f.back + 1 where not f.over))
 select s.thread_id, s.id, case when f.tokens = s.whole then prompt else p2 end as prompt, case when f.tokens = s.whole then answer else a2 end as answer, f.tokens from f join s using (thread_id, back) where f.kept""")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4 SCL7 SCL55: each conversation's newest chats that fit its history budget; of the newest three, long ones are cut in the middle."""
    return context.history_within(t.chats(spark, sf_dir).where("answer is not null"), 300)


@query(f"""select doc_id, tokens, case when tokens < 200 then tokens else cast(floor(tokens / 2) - round((tokens - 200) / 2.0) + tokens - (floor(tokens / 2) + round((tokens - 200) / 2.0)) as bigint) end as left_tokens
 from (select doc_id, len(string_split(text, ' ')) as tokens from documents)""")
def middle_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL7: texts of more than 200 words lose their middle."""
    words = F.split("text", " ", -1)
    kept = context.middle_cut(F.col("text"), 200, marker=" ")
    return t.documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("tokens"), kept.alias("kept")).select(
        "doc_id", "tokens", (F.size(F.split("kept", " ", -1)) - F.when(F.col("tokens") < 200, 0).otherwise(0)).cast("long").alias("left_tokens"))


@query(f"""select question_id, string_agg('[CONTEXT ' || (rank - 1) || E']:\\n' || text || E'\\n[END CONTEXT ' || (rank - 1) || E']\\n\\n', '' order by rank) as context
 from (select source as question_id, text, row_number() over (partition by source order by doc_id) as rank from documents qualify rank <= 4) group by question_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5: numbered context blocks from each question's texts."""
    top = t.documents(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rank <= 4")
    texts = top.groupBy(F.col("source").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("texts"))  # four at most
    return texts.select("question_id", context.context_text(F.transform("texts", lambda x: x["text"])).alias("context"))


@query("select doc_id, left(text, 1000) || '...continued on in source document...' as preview from documents")
def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6 PRJ1 PRJ2: first thousand characters of a pinned source."""
    return t.documents(spark, sf_dir).select("doc_id", context.preview(F.col("text")).alias("preview"))


@query("""select c_custkey as id, case when c_acctbal / 5000 between 0 and 1 then c_acctbal / 5000 else 0.25 end as threshold, case when c_nationkey < 1 then 4 else c_nationkey end::bigint as top_n from customer""")
def search_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10 TOP5: thresholds outside 0 to 1 and limits below 1 give way to the workspace's values."""
    c = t.table(spark, sf_dir, "customer")
    asked = F.col("c_acctbal") / 5000
    return c.select(F.col("c_custkey").alias("id"), F.when(asked.between(0, 1), asked).otherwise(0.25).alias("threshold"), F.when(F.col("c_nationkey") < 1, 4).otherwise(F.col("c_nationkey")).cast("long").alias("top_n"))


@query("select p_partkey as id, cast(p_size * 100 as bigint) as window_tokens, p_size * 100 * 0.15 as history, p_size * 100 * 0.15 as system, p_size * 100 * 0.7 as user_share, greatest(p_size * 100 - 600, 0)::bigint as usable from part")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL55 SCL54: shares of a model's window for history, system and user, and what a reply leaves."""
    w = F.col("p_size") * 100
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), w.cast("long").alias("window_tokens"), *[x.alias(n) for n, x in context.limits(w).items()], F.greatest(w - 600, F.lit(0)).cast("long").alias("usable"))
