"""Queries of conversations: history, exports, citations, edits and joins with their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chats as ops
from ..sources import tables as t
from .registry import query

_VISIBLE = "thread_id % 2 = 0 and api_session_id is null and include"


@query(f"""select workspace_id, user_id, api_session_id, id from (select *, row_number() over (partition by workspace_id, user_id, thread_id, api_session_id order by id desc) as n
 from {t.CHATS_SQL} where include) where n <= 2""")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1 FLT2: the newest two chats of each workspace, user, thread and session; null keys are keys."""
    return ops.recent(t.chats(spark, sf_dir), 2).select("workspace_id", "user_id", "api_session_id", "id")


@query(f"select id, prompt from {t.CHATS_SQL} where {_VISIBLE}")
def visible_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 FLT2: chats of default threads that count."""
    return t.chats(spark, sf_dir).where((F.col("thread_id") % 2 == 0) & F.col("api_session_id").isNull() & F.col("include")).select("id", "prompt")


@query(f"""select id, coalesce(w.name, 'deleted workspace') as workspace, case when c.api_session_id is not null then 'API' else coalesce(u.c_name, 'unknown user') end as username
 from {t.CHATS_SQL} c left join {t.WORKSPACES_SQL} w using (workspace_id) left join customer u on u.c_custkey = c.user_id""")
def chat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON1: chats with the names of their workspaces and users, and what stands for missing ones."""
    return ops.with_names(t.chats(spark, sf_dir), t.workspaces(spark, sf_dir), t.users(spark, sf_dir)).select("id", "workspace", "username")


@query(f"""select id * 2 + r as seq, case r when 0 then 'user' else 'assistant' end as role, case r when 0 then prompt else answer end as content, created_s as sent_s,
 case r when 1 then feedback end as feedback from {t.CHATS_SQL}, (select unnest([0, 1]) as r) where answer is not null""")
def chat_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7 SCL28 SCL44: two rows for each stored chat whose response has a text."""
    return ops.history_rows(t.response_json(t.chats(spark, sf_dir))).select("seq", "role", "content", "sent_s", "feedback")


@query(f"""select thread_id, string_agg('user: ' || prompt || chr(10) || 'assistant: ' || answer, chr(10) order by id) as messages from {t.CHATS_SQL} where answer is not null group by thread_id""")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ8 PRJ11: each thread's messages in order."""
    folded = ops.message_list(t.response_json(t.chats(spark, sf_dir)), "thread_id")
    return folded.select("thread_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


@query(f"""select id, case when feedback is null then '--' when feedback then 'GOOD' else 'BAD' end as rating from {t.CHATS_SQL}""")
def chat_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: label of a chat's feedback."""
    return t.chats(spark, sf_dir).select("id", ops.rating(F.col("feedback")).alias("rating"))


@query(f"""select id, '"' || id || '","' || coalesce(w.name, 'deleted workspace') || '","' || replace(replace(prompt, '"', '""'), chr(10), ' ') || '","' || coalesce(replace(replace(answer, '"', '""'), chr(10), ' '), '') || '","' || created_s || '"' as line
 from {t.CHATS_SQL} c left join {t.WORKSPACES_SQL} w using (workspace_id)""")
def chat_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6 SCL15: lines of the CSV export, every cell quoted."""
    named = ops.with_names(t.response_json(t.chats(spark, sf_dir)), t.workspaces(spark, sf_dir), t.users(spark, sf_dir))
    return ops.csv_lines(named.select("id", "workspace", "prompt", ops.response_text().alias("response"), F.col("created_s").alias("sent_at")))


@query(f"""select id, prompt, answer as response, case when id % 10 = 1 then 'data:image/png;base64,QUJD' else '' end as attachments from {t.CHATS_SQL} where answer is not null""")
def chat_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7 SCL33: rows of the JSON export with attachments as data URLs."""
    parsed = ops.parsed(t.response_json(t.chats(spark, sf_dir))).where("body.text is not null")
    return parsed.select("id", "prompt", F.col("body.text").alias("response"), F.array_join(F.transform("body.attachments", lambda a: ops.data_url(a["contentString"], a["mime"])), ",").alias("attachments"))


@query(f"""select id, 'Given the following' || chr(10) || 'Context:' || chr(10) || '    [CONTEXT 0]:' || chr(10) || 'chunk ' || ((id * 3 + 1) % 50) || chr(10) || '[END CONTEXT 0]' || chr(10) || chr(10) as instruction, prompt as input, answer as output
 from {t.CHATS_SQL} where answer is not null""")
def chat_export_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: instruction, input and output of each chat, with its first source as context."""
    parsed = ops.parsed(t.response_json(t.chats(spark, sf_dir))).where("body.text is not null")
    return parsed.select("id", ops.instruction(F.lit("Given the following"), F.transform(F.slice("body.sources", 1, 1), lambda s: s["text"])).alias("instruction"), F.col("prompt").alias("input"), F.col("body.text").alias("output"))


@query(f"""select workspace_id, 1 + 2 * count(*) as messages, 'system:' || string_agg(',user:' || md5(prompt) || ',assistant:' || md5(answer), '' order by id) as line from {t.CHATS_SQL} where answer is not null group by workspace_id""")
def chat_export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9 AGG11 UDF5: one conversation for each workspace, led by one system message."""
    lines = ops.message_list(t.response_json(t.chats(spark, sf_dir)), "workspace_id", system="")
    return lines.select("workspace_id", F.size("messages").cast("long").alias("messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.when(m["role"] != "system", F.md5(m["content"])).otherwise(""))), ",").alias("line"))


@query(f"""select id, title, count(*) as refs, string_agg(chunk, '|' order by k) as chunks from {t.SOURCES_SQL} group by id, title""")
def citation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: a chat's sources by title, with their chunks and number."""
    return ops.citations(t.chats(spark, sf_dir)).select("id", "title", "refs", F.array_join(F.transform("chunks", lambda c: c["text"]), "|").alias("chunks"))


@query(f"select id, answer as response from {t.CHATS_SQL}")
def sources_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ9: responses without their sources."""
    hidden = ops.without_sources(t.response_json(t.chats(spark, sf_dir)))
    return hidden.where(~F.col("response").contains('"sources"')).select("id", F.get_json_object("response", "$.text").alias("response"))


@query(f"""with p as (select thread_id, max(id) as top_id from {t.CHATS_SQL} where turn <= 3 group by thread_id), k as (select c.* from {t.CHATS_SQL} c join p using (thread_id) where id <= top_id and include),
 n as (select thread_id, left(arg_max(answer, id), 22) || case when length(arg_max(answer, id)) > 22 then '…' else '' end as name from k group by thread_id)
 select 1000000 + thread_id as thread_id, name, id, md5(prompt) as prompt, md5(answer) as answer from k join n using (thread_id)""")
def thread_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9 SCL26: chats up to a pivot copied to a new thread, named after the last answer."""
    chats = t.chats(spark, sf_dir)
    pivots = chats.where("turn <= 3").groupBy("thread_id").agg(F.max("id").alias("pivot"))
    return ops.forked(chats, pivots).select((F.col("thread_id") + 1_000_000).alias("thread_id"), "name", "id", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"))


@query(f"select thread_id, any_value(left(prompt, 22) || case when length(prompt) > 22 then '…' else '' end) as name from {t.CHATS_SQL} group by thread_id having count(*) = 1")
def thread_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10 SCL26: threads with exactly one chat take their name from it."""
    return ops.first_names(t.chats(spark, sf_dir))


@query(f"select id from {t.CHATS_SQL} where not (thread_id % 3 = 0 and turn >= 3)")
def edited_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: chats from an edited turn on are deleted from its thread."""
    chats = t.chats(spark, sf_dir)
    edits = chats.where("thread_id % 3 = 0").select("thread_id", (F.col("thread_id") * 1000 + 3).alias("start")).distinct()
    return ops.without_tail(chats, edits).select("id")


@query(f"select id, prompt from {t.CHATS_SQL} order by id limit 20 offset 40")
def chat_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP3 TOP4 TOP5: one page of chats by id."""
    return ops.page(t.chats(spark, sf_dir), "id", 40, 20).select("id", "prompt")


@query(f"""select workspace_id, count(*) filter (include and api_session_id is null) as visible, count(distinct thread_id) as threads, count(*) as chats from {t.CHATS_SQL} group by workspace_id""")
def workspace_chat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5 AGG19: threads and visible chats of each workspace."""
    return t.chats(spark, sf_dir).groupBy("workspace_id").agg(F.count_if(F.col("include") & F.col("api_session_id").isNull()).alias("visible"), F.count_distinct("thread_id").alias("threads"), F.count("*").alias("chats"))


@query("""select conv_id, turn, prev as old_prompt, text as new_prompt from (select *, lag(text) over (partition by conv_id order by turn) as prev from conversations) where prev is not null and prev <> text""")
def prompt_change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: a change is logged where the old prompt is set and differs from the new one."""
    return ops.changes(t.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "old_prompt", "new_prompt")


@query("""with f as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as prev from conversations)
 select conv_id, turn, text as answer from f where role = 'assistant' and prev = 'user'""")
def agent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ16: replies that follow a user's message become chat rows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.table(spark, sf_dir, "conversations").withColumn("prev", F.lag("role").over(w)).where("role = 'assistant' and prev = 'user'").select("conv_id", "turn", F.col("text").alias("answer"))


@query(f"""with r as (select thread_id, max(id) as reset_id from {t.CHATS_SQL} where turn % 4 = 2 group by thread_id) select c.id from {t.CHATS_SQL} c left join r using (thread_id) where r.reset_id is null or c.id > r.reset_id""")
def history_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9: after a reset only later chats of the thread count; batch form."""
    chats = t.chats(spark, sf_dir)
    return ops.after_reset(chats, chats.where("turn % 4 = 2").select("thread_id", F.col("id").alias("reset_id"))).select("id")


@query(f"""select id, arg_max(value, seq) as value, count(*) as edits from (select id, unnest([1, 2, 3]) as seq, unnest(['a' || id, 'b' || (id % 7), 'c' || (id % 5)]) as value from {t.CHATS_SQL}) group by id""")
def latest_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10: of a log of edits the latest of each chat holds; batch form."""
    n = F.col("id").cast("string")
    log = t.chats(spark, sf_dir).select("id", F.posexplode(F.array(F.concat(F.lit("a"), n), F.concat(F.lit("b"), (F.col("id") % 7).cast("string")), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))).alias("seq", "value"))
    return ops.latest(log, "id", "seq", "value")


@query(f"""select conv_id, any_value(n) as messages, md5(string_agg(case when turn < last then role || ':' || text end, chr(10) order by turn)) as history, any_value(last_text) as prompt from (select *, count(*) over (partition by conv_id) as n, max(turn) over (partition by conv_id) as last, arg_max(text, turn) over (partition by conv_id) as last_text, arg_max(role, turn) over (partition by conv_id) as last_role from conversations)
 where last_role = 'user' group by conv_id having count(*) > 1""")
def message_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL35: a message list whose last one is the user's splits into history and prompt."""
    lists = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))  # one conversation's turns
    split = lists.where((F.element_at("m", -1)["role"] == "user") & (F.size("m") > 1))
    history = F.array_join(F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return split.select("conv_id", F.size("m").cast("long").alias("messages"), F.md5(history).alias("history"), F.element_at("m", -1)["text"].alias("prompt"))


@query(f"""select id, case when id % 2 = 0 then prompt || chr(10) || 'see image' else prompt end as text, case when id % 2 = 0 then 'uploaded_image_0' end as name, case when id % 2 = 0 then (case when id % 3 = 0 then 'image/jpeg' else 'image/png' end) end as mime from {t.CHATS_SQL}""")
def multimodal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL30 SCL31 SCL32 PRJ12: texts and images of messages made of parts."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"))
    none = F.lit(None).cast("string")
    url = F.when(F.col("id") % 3 == 0, "data:image/jpeg;base64,QUJD").otherwise("not-a-data-url")
    parts = F.when(F.col("id") % 2 == 0, F.array(part("text", F.col("prompt"), none), part("image_url", none, url), part("text", F.lit("see image"), none))).otherwise(F.array(part("text", F.col("prompt"), none)))
    rows = t.chats(spark, sf_dir).select("id", parts.alias("parts"))
    images = ops.attachments(F.col("parts"))
    return rows.select("id", ops.text_content(F.col("parts")).alias("text"), F.get(images, 0)["name"].alias("name"), F.get(images, 0)["mime"].alias("mime"))


def _messages_sql(with_images: str) -> str:
    return f"""select id, 'user' as role, case when id % 10 = 1 then {with_images} else json_object('role', 'user', 'content', prompt) end::varchar as message from {t.CHATS_SQL} where answer is not null
 union all select id, 'assistant', json_object('role', 'assistant', 'content', answer)::varchar from {t.CHATS_SQL} where answer is not null"""


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with an answer; every tenth has two images."""
    image = lambda name, data: F.struct(F.lit("image/png").alias("mime"), F.lit(name).alias("name"), F.concat(F.lit("data:image/png;base64,"), data).alias("contentString"))
    two = F.array(image("a.png", F.lit("QUJD")), image("b.png", F.col("id").cast("string")))
    return t.chats(spark, sf_dir).where("answer is not null").withColumn("attachments", F.when(F.col("id") % 10 == 1, two))


@query(_messages_sql("json_object('role', 'user', 'content', json_array(json_object('type', 'text', 'text', prompt), json_object('type', 'image_url', 'image_url', json_object('url', 'data:image/png;base64,QUJD')), json_object('type', 'image_url', 'image_url', json_object('url', 'data:image/png;base64,' || id))))"))
def history_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: history messages with the images of user turns as parts of their content."""
    return ops.history_messages(_attached(spark, sf_dir))


@query(_messages_sql("json_object('role', 'user', 'content', prompt, 'images', json_array('QUJD', id::varchar))"))
def history_images_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: the same with the images beside the content."""
    return ops.history_messages(_attached(spark, sf_dir), spread=True)
