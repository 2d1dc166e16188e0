"""Chat rows: histories, exports, citations, and changes to threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESPONSE = ("text string, type string, sources array<struct<id:string,title:string,text:string,score:double>>, "
            "attachments array<struct<mime:string,name:string,contentString:string>>")


def recent(chats: DataFrame, n: int = 20) -> DataFrame:
    """The newest n visible chats of each workspace, user, thread and session, with their place from the newest (back)."""
    w = Window.partitionBy("workspace_id", "user_id", "thread_id", "api_session_id").orderBy(F.desc("id"))
    return chats.where("include").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def with_names(chats: DataFrame, workspaces: DataFrame, users: DataFrame) -> DataFrame:
    """Chats with workspace and username; left joins on small dimensions, which Spark broadcasts by their size."""
    joined = chats.join(workspaces.select("workspace_id", F.col("name").alias("ws_name")), "workspace_id", "left").join(users.select("user_id", F.col("username").alias("u_name")), "user_id", "left")
    return joined.withColumn("workspace", F.coalesce("ws_name", F.lit("deleted workspace"))).withColumn(
        "username", F.when(F.col("api_session_id").isNotNull(), "API").otherwise(F.coalesce("u_name", F.lit("unknown user"))))


def parsed(chats: DataFrame) -> DataFrame:
    return chats.withColumn("body", F.from_json("response", RESPONSE))


def response_text() -> Column:
    return F.get_json_object("response", "$.text")


def history_rows(chats: DataFrame) -> DataFrame:
    """A user row and an assistant row for each chat whose response has a text; seq orders them."""
    both = F.array(F.struct(F.lit(0).alias("r"), F.lit("user").alias("role"), F.col("prompt").alias("content"), F.lit(None).cast("boolean").alias("feedback")),
                   F.struct(F.lit(1).alias("r"), F.lit("assistant").alias("role"), F.col("body.text").alias("content"), F.col("feedback")))
    rows = parsed(chats).where("body.text is not null").select("id", "created_s", F.inline(both))
    return rows.select((F.col("id") * 2 + F.col("r")).alias("seq"), "role", "content", F.col("created_s").alias("sent_s"), "feedback")


def message_list(chats: DataFrame, key: str, system: str | None = None) -> DataFrame:
    """key, messages: each key's chats by id as alternating user and assistant messages, after one system message if given.
    A list is one conversation or one export line, which has to be whole in a row."""
    answered = parsed(chats).where("body.text is not null")
    folded = answered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "prompt", F.col("body.text").alias("answer")))).alias("pairs"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.flatten(F.transform("pairs", lambda p: F.array(message("user", p["prompt"]), message("assistant", p["answer"]))))
    if system is not None:
        messages = F.concat(F.array(message("system", F.lit(system))), messages)
    return folded.select(key, messages.alias("messages"))


def rating(feedback: Column) -> Column:
    return F.when(feedback.isNull(), "--").when(feedback, "GOOD").otherwise("BAD")


def csv_cell(value: Column) -> Column:
    """A quoted cell: quotes doubled, line ends as spaces, null as an empty cell."""
    return F.concat(F.lit('"'), F.coalesce(F.replace(F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" ")), F.lit("")), F.lit('"'))


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.concat_ws(",", *[csv_cell(F.col(c)) for c in rows.columns]).alias("line"))


def data_url(content: Column, mime: Column) -> Column:
    return F.when(content.startswith("data:"), content).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), content))


def instruction(system: Column, contexts: Column) -> Column:
    block = lambda x, i: F.concat(F.lit("[CONTEXT "), i.cast("string"), F.lit("]:\n"), x, F.lit("\n[END CONTEXT "), i.cast("string"), F.lit("]\n\n"))
    return F.concat(system, F.when(F.size(contexts) > 0, F.concat(F.lit("\nContext:\n    "), F.array_join(F.transform(contexts, block), ""))).otherwise(""))


def citations(chats: DataFrame) -> DataFrame:
    """id, title, refs, chunks (in order of citation) of each chat's sources. All within the chat's own row."""
    titles = chats.select("id", "sources", F.explode(F.array_distinct(F.transform("sources", lambda s: s["title"]))).alias("title"))
    mine = F.filter(F.transform("sources", lambda s, k: F.struct(k.alias("k"), s["text"].alias("text"), s["title"].alias("t"))), lambda x: x["t"].eqNullSafe(F.col("title")))
    return titles.select("id", "title", F.size(mine).cast("long").alias("refs"), F.transform(mine, lambda x: F.struct(x["k"].alias("k"), x["text"].alias("text"))).alias("chunks"))


def without_sources(chats: DataFrame) -> DataFrame:
    return parsed(chats).withColumn("response", F.to_json(F.col("body").dropFields("sources"))).drop("body")


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def forked(chats: DataFrame, pivots: DataFrame) -> DataFrame:
    """thread_id, name, and the copied columns of each visible chat up to its thread's pivot; the name is from the last of them that has an answer."""
    kept = chats.join(pivots, "thread_id").where("id <= pivot and include")
    last = F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("id")))
    names = kept.groupBy("thread_id").agg(shortened(last, 22).alias("name"))
    return kept.join(names, "thread_id").select("thread_id", "name", "id", "prompt", "answer")


def first_names(chats: DataFrame) -> DataFrame:
    one = chats.groupBy("thread_id").agg(F.count("*").alias("n"), F.min("prompt").alias("prompt")).where("n = 1")
    return one.select("thread_id", shortened(F.col("prompt"), 22).alias("name"))


def without_tail(chats: DataFrame, edits: DataFrame) -> DataFrame:
    """Chats without those from an edit's start on in its thread."""
    at = edits.groupBy("thread_id").agg(F.min("start").alias("start"))
    return chats.join(at, "thread_id", "left").where(F.col("start").isNull() | (F.col("id") < F.col("start"))).drop("start")


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(max(1, limit))


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("old_prompt", F.lag(value).over(w)).where(F.col("old_prompt").isNotNull() & (F.col("old_prompt") != F.col(value))).withColumnRenamed(value, "new_prompt")


def after_reset(chats: DataFrame, resets: DataFrame) -> DataFrame:
    last = resets.groupBy("thread_id").agg(F.max("reset_id").alias("reset_id"))
    return chats.join(last, "thread_id", "left").where("reset_id is null or id > reset_id")


def latest(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("edits"))


def text_content(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def mime_of(url: Column) -> Column:
    found = F.regexp_extract(url, "^data:([^;]+);base64,", 1)
    return F.when(found != "", found).otherwise("image/png")


def attachments(parts: Column) -> Column:
    images = F.filter(parts, lambda p: p["type"] == "image_url")
    return F.transform(images, lambda p, i: F.struct(F.concat(F.lit("uploaded_image_"), i.cast("string")).alias("name"), mime_of(p["url"]).alias("mime"), p["url"].alias("content")))


def history_messages(chats: DataFrame, spread: bool = False) -> DataFrame:
    """id, role, message: the two messages of each chat (id, prompt, answer, attachments) as JSON, images of the user's turn with it. As a property, content is a list of a text part and image parts;
    spread, content stays text and the images' bytes lie beside it. A turn without attachments has its text as content in both shapes."""
    shape = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    if spread:
        with_images = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"), F.transform("attachments", lambda a: F.regexp_replace(a["contentString"], "(?s)^.*base64,", "")).alias("images"))
    else:
        part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
        none = F.lit(None).cast("string")
        parts = F.concat(F.array(part("text", F.col("prompt"), none)), F.transform("attachments", lambda a: part("image_url", none, a["contentString"])))
        with_images = F.struct(F.lit("user").alias("role"), parts.alias("content"))
    user = F.when(F.coalesce(F.size("attachments"), F.lit(0)) > 0, F.to_json(with_images)).otherwise(F.to_json(shape))
    assistant = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    turns = F.array(F.struct(F.lit("user").alias("role"), user.alias("message")), F.struct(F.lit("assistant").alias("role"), assistant.alias("message")))
    return chats.select("id", F.inline(turns))
