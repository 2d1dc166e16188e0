"""Queries of quotas, audit logs, memberships, roll-ups, searches and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, context, membership
from ..sources import tables as t
from ..sources.shared import with_checkpoints
from .registry import query

_NOW = 1706500000000


@query(f"select user_id, used, case user_id % 3 when 0 then null when 1 then 5 else 0 end::bigint as \"limit\", (user_id % 5 = 2 or user_id % 3 = 0 or used < case user_id % 3 when 1 then 5 else 0 end) as allowed from (select user_id, count(*) filter (at_ms >= {_NOW} - 86400000 and at_ms <= {_NOW}) as used from {t.EVENTS_SQL} group by user_id)")
def quota_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: each user's events in the trailing day against a daily limit; admins and null limits pass."""
    limit = F.when(F.col("user_id") % 3 == 1, F.lit(5)).when(F.col("user_id") % 3 == 2, F.lit(0)).cast("long")
    return audit.daily_quota(t.event_log(spark, sf_dir), "user_id", _NOW, limit, F.col("user_id") % 5 == 2)


@query(f"""with e as (select *, user_id % 20 as embed_id, user_id % 20 * 1000 + user_id as session_id from {t.EVENTS_SQL} where at_ms between {_NOW} - 86400000 and {_NOW}),
 c as (select *, case embed_id % 4 when 0 then null when 1 then 40 when 2 then 15 else -1 end as per_day, case embed_id % 3 when 0 then 3 when 1 then 0 end as per_session from (select distinct user_id % 20 as embed_id, user_id % 20 * 1000 + user_id as session_id from events)),
 d as (select embed_id, count(*) as n from e group by 1), s as (select embed_id, session_id, count(*) as n from e group by 1, 2)
 select c.embed_id, c.session_id, coalesce(d.n, 0)::bigint as of_embed, coalesce(s.n, 0)::bigint as of_session, case when per_day > 0 and coalesce(d.n, 0) >= per_day then 'embed quota' when per_session > 0 and coalesce(s.n, 0) >= per_session then 'session quota' end as refused from c left join d using (embed_id) left join s using (embed_id, session_id)""")
def embed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9: chats of each embed and of each of its sessions in the trailing day against two limits; limits that aren't positive are ignored."""
    embed = F.col("user_id") % 20
    chats = t.event_log(spark, sf_dir).select(embed.alias("embed_id"), (embed * 1000 + F.col("user_id")).alias("session_id"), "at_ms")
    per_day = F.when(F.col("embed_id") % 4 == 1, 40).when(F.col("embed_id") % 4 == 2, 15).when(F.col("embed_id") % 4 == 3, -1)
    per_session = F.when(F.col("embed_id") % 3 == 0, 3).when(F.col("embed_id") % 3 == 1, 0)
    return audit.embed_quota(chats, _NOW, per_day, per_session)


@query(f"select event_id, event, gap from (select *, at_ms - lag(at_ms) over (partition by event, user_id order by at_ms, event_id) as gap from (select event_id, event || '-' || user_id as event, user_id, at_ms from {t.EVENTS_SQL})) where gap is null or gap >= 3600000")
def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: events an hour or more after the previous one of their kind and user."""
    events = t.event_log(spark, sf_dir).withColumn("event", F.concat_ws("-", "event", "user_id"))
    return audit.debounced(events, "event", 3_600_000).select("event_id", "event", "gap")


@query(f"""select event_id, sig from (select event_id, sha256('{{"event":"' || event || '","metadata":"' || replace(metadata, '"', '\\"') || '"}}') as sig, row_number() over (partition by event, metadata order by at_ms, event_id) as n from {t.EVENTS_SQL}) where n = 1""")
def dedupe_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8 SCL42: the first call of each signature."""
    calls = t.event_log(spark, sf_dir).withColumn("sig", audit.signature(F.col("event"), F.col("metadata")))
    return audit.first_calls(calls, "sig").select("event_id", "sig")


@query()
def calls_after_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: calls accepted a day after the last accepted one of their kind and user. No SQL: the fold is recursive; a test holds it against brute force."""
    events = t.event_log(spark, sf_dir).withColumn("event", F.concat_ws("-", "event", "user_id"))
    return audit.accepted_after_cooldown(events, "event", 86_400_000)


@query(f"""select user_id, run::bigint as run, event, count(*) as size from (select *, sum(new) over (partition by user_id order by at_ms, event_id) as run from (select *, case when lag(event) over (partition by user_id order by at_ms, event_id) = event then 0 else 1 end as new from {t.EVENTS_SQL})) group by user_id, run, event""")
def status_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5: consecutive events of one kind as runs."""
    return audit.runs(t.event_log(spark, sf_dir), "user_id", ["at_ms", "event_id"], "event")


@query(f"""select user_id, count(*) filter (status = 'failed') as failed, count(*) as runs from (select user_id, case when value > 50 then 'failed' else 'success' end as status, row_number() over (partition by user_id order by event_id desc) as n from {t.EVENTS_SQL}) where n <= 5 group by user_id""")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: failures among the latest five runs."""
    log = t.event_log(spark, sf_dir).withColumn("status", F.when(F.col("value") > 50, "failed").otherwise("success"))
    return audit.failed_among_latest(log, "user_id", "event_id")


@query(f"select event_id, event, coalesce(c_name, 'unknown user') as username from {t.EVENTS_SQL} left join customer on c_custkey = user_id and c_custkey % 5 <> 0")
def event_user_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON2: events with the names of their users."""
    users = t.users(spark, sf_dir).where("user_id % 5 <> 0").select("user_id", "username")
    return t.event_log(spark, sf_dir).join(users, "user_id", "left").select("event_id", "event", F.coalesce("username", F.lit("unknown user")).alias("username"))


@query("select event_id, 'viewed_' || event_type as event, '{\"page\":' || event_id % 7 || ',\"note\":\"a \\\"b\\\"\"}' as metadata, user_id from events union all select event_id + 1000000000, 'left', '{\"page\":0}', null from events where event_id % 9 = 0")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: events appended with their metadata as JSON, in two writes of one log."""
    path = f"{with_checkpoints(spark)}/log-{uuid.uuid4().hex}"
    events = t.event_log(spark, sf_dir)
    audit.append_events(events.select("event_id", F.concat(F.lit("viewed_"), "event").alias("event"), F.struct((F.col("event_id") % 7).alias("page"), F.lit('a "b"').alias("note")).alias("metadata"), "user_id"), path)
    audit.append_events(events.where("event_id % 9 = 0").select((F.col("event_id") + 1_000_000_000).alias("event_id"), F.lit("left").alias("event"), F.struct(F.lit(0).alias("page")).alias("metadata"), F.lit(None).cast("long").alias("user_id")), path)
    return spark.read.parquet(path).select("event_id", "event", "metadata", "user_id")


@query(f"with p as (select event_id, event from {t.EVENTS_SQL} order by at_ms desc, event_id limit 10 offset 30) select event_id, event, total, total > (3 + 1) * 10 as has_pages from p, (select count(*) as total from events)")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18 TOP4: one page of the log, its total, and whether more follow."""
    log = t.event_log(spark, sf_dir)
    total = log.agg(F.count("*").alias("total"))  # one row
    return log.orderBy(F.desc("at_ms"), "event_id").offset(30).limit(10).select("event_id", "event").join(F.broadcast(total), F.lit(True)).withColumn("has_pages", F.col("total") > 40)


@query(f"select event, count(*) as events, count(distinct user_id) as users, sum(cast(value as decimal(18, 6)))::double as total, round(sum(cast(value as decimal(18, 6)))::double / count(*), 4) as mean, median(value) as middle from {t.EVENTS_SQL} group by event")
def model_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: distinct users, sums, means and exact medians by kind."""
    value = F.col("value").cast("decimal(18,6)")
    return t.event_log(spark, sf_dir).groupBy("event").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.sum(value).cast("double").alias("total"), F.round(F.sum(value).cast("double") / F.count("*"), 4).alias("mean"), F.median("value").alias("middle"))


@query(f"""with c as (select id % 3 as model, ceil(length(prompt) / 4)::bigint as asked, ceil(length(answer) / 4)::bigint as given, (id % 9) * 0.5 as seconds from {t.CHATS_SQL} where answer is not null)
 select model, count(*) as chats, sum(asked + given)::bigint as total_tokens, round(sum(seconds), 3)::double as seconds, round(avg(case when seconds > 0 then given / seconds else 0 end), 4) as tokens_per_second from c group by model""")
def chat_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16 STR2: total tokens, duration and tokens a second of answers, by model."""
    chats = t.chats(spark, sf_dir).where("answer is not null").select((F.col("id") % 3).alias("model"), context.estimate(F.col("prompt")).alias("asked"), context.estimate(F.col("answer")).alias("given"), ((F.col("id") % 9) * 0.5).alias("seconds"))
    return chats.withColumn("speed", audit.tokens_per_second(F.col("given"), F.col("seconds"))).groupBy("model").agg(
        F.count("*").alias("chats"), F.sum(F.col("asked") + F.col("given")).cast("long").alias("total_tokens"), F.round(F.sum("seconds"), 3).cast("double").alias("seconds"), F.round(F.avg("speed"), 4).alias("tokens_per_second"))


@query("select distinct name, kind from (select c_name as name, 'customer' as kind from customer union all select p_name, 'part' from part union all select n_name, 'nation' from nation) where contains(lower(name), 'nation_1') or levenshtein(lower(name), 'nation_1') <= 3")
def fuzzy_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5 SCL21 SET5: names that hold a term or come near it."""
    one = lambda table, column, kind: t.table(spark, sf_dir, table).select(F.col(column).alias("name"), F.lit(kind).alias("kind"))
    names = one("customer", "c_name", "customer").unionByName(one("part", "p_name", "part")).unionByName(one("nation", "n_name", "nation"))
    return audit.fuzzy_names(names, "Nation_1", "name")


@query(f"""select doc_id, source from (select *, coalesce(max(case when hit or near then 1 else 0 end) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as seen
 from (select doc_id, source, contains(title, 'doc-7') as hit, levenshtein(title, 'doc-7') <= 2 as near from {t.DOCUMENTS_SQL})) where contains(source, 'doc-7') or hit or (near and seen = 0)""")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6: folders and files that a search shows."""
    files = t.documents(spark, sf_dir).select("doc_id", "source", F.col("source").alias("folder"), F.col("title").alias("name"), F.col("doc_id").alias("pos"))
    return audit.file_search(files, "doc-7").select("doc_id", "source")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON11: files that no record knows."""
    return membership.missing_from(t.documents(spark, sf_dir).select("doc_id"), t.table(spark, sf_dir, "labels"), "doc_id")


@query("select source as folder, (row_number() over (partition by source order by doc_id) - 1) // 500 as batch, doc_id from documents where doc_id not in (select doc_id from labels)")
def orphan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7: each folder's orphan files in batches of 500, as a scheduled clean-up deletes them."""
    orphans = membership.missing_from(t.documents(spark, sf_dir).select(F.col("source").alias("folder"), "doc_id"), t.table(spark, sf_dir, "labels"), "doc_id")
    return membership.in_batches(orphans, "folder", "doc_id", 500)


@query("select source as target, count(*) filter (doc_id not in (select doc_id from labels)) as moved, count(*) as total, count(*) filter (doc_id not in (select doc_id from labels)) || '/' || count(*) || ' files moved. Unembed the others first.' as message from documents where lang <> 'fr' group by source")
def files_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON12: of the files that are to move to a folder, those that no workspace has embedded do; with a message."""
    asked = t.documents(spark, sf_dir).where("lang <> 'fr'").select(F.col("source").alias("target"), "doc_id")
    return membership.moved(asked, t.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "target")


@query(f"select workspace_id, name from {t.WORKSPACES_SQL} where workspace_id in (select c_nationkey from customer where c_custkey % 40 = 7)")
def membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON7: workspaces that one user belongs to."""
    members = t.users(spark, sf_dir).select(F.col("c_nationkey").cast("long").alias("workspace_id"), (F.col("user_id") % 40).alias("user_id"))
    return membership.visible_to(t.workspaces(spark, sf_dir), members, 7, "default").select("workspace_id", "name")


@query(f"select w.name, count(c_custkey) as members, coalesce(min(c_custkey), -1) as first_member, md5(coalesce(string_agg(c_custkey::varchar, ',' order by c_custkey), '')) as ids from {t.WORKSPACES_SQL} w left join customer on c_nationkey = w.workspace_id and c_mktsegment = 'BUILDING' group by w.name")
def workspace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON8 JON9: members of each workspace, those without any included."""
    users = t.users(spark, sf_dir).where("segment = 'BUILDING'").select(F.col("c_nationkey").cast("long").alias("workspace_id"), "user_id")
    return t.workspaces(spark, sf_dir).join(users, "workspace_id", "left").groupBy("name").agg(
        F.count("user_id").alias("members"), F.coalesce(F.min("user_id"), F.lit(-1)).alias("first_member"), F.md5(F.array_join(F.array_sort(F.collect_list("user_id")), ",")).alias("ids"))


@query(f"select w.workspace_id, w.name, count(o_orderkey) as docs, coalesce(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18, 2)) end), 0)::double as tokens from {t.WORKSPACES_SQL} w left join customer on c_nationkey = w.workspace_id left join orders on o_custkey = c_custkey group by all")
def workspace_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4 AGG6 AGG7 JON4: documents and token totals of each workspace, zeros included."""
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))
    users = t.users(spark, sf_dir).select("user_id", F.col("c_nationkey").cast("long").alias("workspace_id"))
    by_user = orders.groupBy("user_id").agg(F.count("*").alias("docs"), F.sum("price").alias("tokens"))  # before the join, so that it carries one row for each user
    by_ws = users.join(by_user, "user_id").groupBy("workspace_id").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return t.workspaces(spark, sf_dir).join(by_ws, "workspace_id", "left").select("workspace_id", "name", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"))


@query(f"""select c.id, e.region, w.name as workspace from {t.CHATS_SQL} c join {t.WORKSPACES_SQL} w using (workspace_id) join (select cast(r_regionkey as bigint) as region_id, r_name as region from region where r_regionkey < 3) e on e.region_id = w.region""")
def embed_chat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON3: chats with their configuration and its workspace; inner joins on small dimensions."""
    configs = t.table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("region"), F.col("r_name").alias("r_name"))
    joined = t.chats(spark, sf_dir).join(t.workspaces(spark, sf_dir), "workspace_id").join(configs, "region")
    return joined.select("id", F.col("r_name").alias("region"), F.col("name").alias("workspace"))


@query("""select p.conv_id, p.turn, coalesce(c_name, 'unknown') as editor from conversations p left join customer on c_custkey = p.conv_id % 200 where p.role = 'system' order by p.turn desc""")
def prompt_history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON5: prompt changes with their editors, newest first."""
    prompts = t.table(spark, sf_dir, "conversations").where("role = 'system'").withColumn("user_id", F.col("conv_id") % 200)
    return prompts.join(t.users(spark, sf_dir).select("user_id", "username"), "user_id", "left").orderBy(F.desc("turn")).select("conv_id", "turn", F.coalesce("username", F.lit("unknown")).alias("editor"))


@query(f"select d.doc_id, w.name, (d.doc_id * 7919 % 1209600000 + 1704067200000 + case when d.doc_id % 3 = 0 then 86400000 else 604800000 end)::bigint as next_ms from {t.DOCUMENTS_SQL} d join {t.WORKSPACES_SQL} w on w.workspace_id = d.doc_id % 25 where d.doc_id * 7919 % 1209600000 + 1704067200000 + case when d.doc_id % 3 = 0 then 86400000 else 604800000 end <= {_NOW} - 1000000000 and d.doc_id % 4 <= 2")
def stale_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON6 FLT4 SCL45: watched documents whose next sync (the last one plus their stale-after time, seven days unless given) is due, with their workspaces."""
    last = F.col("doc_id") * 7919 % 1_209_600_000 + 1_704_067_200_000
    queues = t.documents(spark, sf_dir).where(F.col("chunk_source").rlike("^(link|confluence|youtube)://")).select(
        "doc_id", (F.col("doc_id") % 25).alias("workspace_id"), audit.next_sync(last, F.when(F.col("doc_id") % 3 == 0, F.lit(86_400_000))).cast("long").alias("next_ms"))
    return queues.where(F.col("next_ms") <= _NOW - 1_000_000_000).join(t.workspaces(spark, sf_dir), "workspace_id").select("doc_id", "name", "next_ms")


@query("select name, min(doc_id) as queue_doc, count(*) as copies, count(*) filter (doc_id % 2 = 0) as asked from (select doc_id, 'file-' || doc_id // 3 as name from documents) group by name having count(*) filter (doc_id % 2 = 0 and doc_id % 5 > 0) > 0")
def watch_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6: watching a document makes one queue for its file name; all copies of the file carry the flag."""
    docs = t.documents(spark, sf_dir).select("doc_id", F.concat(F.lit("file-"), F.expr("doc_id div 3")).alias("name"))
    flagged = membership.watched(docs, docs.where("doc_id % 2 = 0"), docs.where("doc_id % 5 = 0"))
    return flagged.where("watched").groupBy("name").agg(F.min("doc_id").alias("queue_doc"), F.count("*").alias("copies"), F.count_if(F.col("doc_id") % 2 == 0).alias("asked"))


@query("""with pins as (select doc_id, (doc_id * k) % 25 as workspace_id, doc_id * 10 + k as pin_id, k <= 2 as pinned, k >= 2 as watched from documents, (select unnest([1, 2, 3]) as k) where doc_id % 3 = 0)
 select d.doc_id, (select string_agg(x::varchar, ',' order by x) from (select distinct workspace_id as x from pins p where p.doc_id = d.doc_id and pinned)) as pinned_in, (select arg_max(workspace_id, pin_id) from pins p where p.doc_id = d.doc_id and watched) as watched_in from documents d""")
def pinned_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON14: documents with the workspaces that pin and watch them."""
    docs = t.documents(spark, sf_dir).select("doc_id")
    pins = docs.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k"))
    pins = pins.select("doc_id", (F.col("doc_id") * F.col("k") % 25).alias("workspace_id"), (F.col("doc_id") * 10 + F.col("k")).alias("pin_id"), (F.col("k") <= 2).alias("pinned"), (F.col("k") >= 2).alias("watched"))
    return membership.with_pins(docs, pins).select("doc_id", F.array_join("pinned_in", ",").alias("pinned_in"), "watched_in")


@query("select doc_id as id, doc_id // 3 as name, count(*) over (partition by doc_id // 3) - 1 as others, min(doc_id) over (partition by doc_id // 3) as first_id from documents qualify count(*) over (partition by doc_id // 3) > 1")
def same_file_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON15: rows whose file other rows have as well, with the number of the others and the first of them all."""
    docs = t.documents(spark, sf_dir).select(F.expr("doc_id div 3").alias("name"), F.col("doc_id").alias("id"))
    return membership.same_file_elsewhere(docs)


@query(f"select doc_id, w.workspace_id from (select doc_id, unnest(['nation_3', 'nation_12', 'moon']) as slug from documents) d join {t.WORKSPACES_SQL} w on w.slug = d.slug")
def upload_to_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON18: documents go to the workspaces that a list of slugs names."""
    asked = t.documents(spark, sf_dir).select("doc_id", F.explode(F.transform(F.split(F.lit("Nation_3 , NATION_12,moon"), ","), lambda s: F.lower(F.trim(s)))).alias("slug"))
    return asked.join(t.workspaces(spark, sf_dir), "slug").select("doc_id", "workspace_id")


@query("select vec_id as id from embeddings where label not in (2, 5) and vec_id % 7 <> 3")
def chunks_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON13 JON20: chunks without those of purged documents and namespaces."""
    chunks = t.chunks(spark, sf_dir)
    purged = chunks.where("id % 7 = 3").select("id")
    return chunks.join(purged, "id", "left_anti").where(~F.col("namespace").isin(2, 5)).select("id")


@query("""with gone as (select doc_id from documents where source = 'src3' or doc_id % 50 = 7)
 select 'documents' as store, doc_id as id from documents where doc_id not in (select doc_id from gone) union all select 'chunks', vec_id from embeddings where vec_id not in (select doc_id from gone) union all select 'cache', doc_id from labels where doc_id not in (select doc_id from gone)""")
def purged_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON19: a folder and single documents purged from documents, chunks and cache."""
    docs = t.documents(spark, sf_dir)
    stores = {"documents": docs.select("doc_id"), "chunks": t.chunks(spark, sf_dir).select(F.col("id").alias("doc_id")), "cache": t.table(spark, sf_dir, "labels").select("doc_id")}
    return membership.purged(stores, docs.where("source = 'src3' or doc_id % 50 = 7").select("doc_id"), "doc_id").select("store", F.col("doc_id").alias("id"))


@query("select cast(c_nationkey as bigint) as workspace_id, c_custkey as user_id from customer where c_nationkey <> 3 union all select 3, c_custkey from customer where c_custkey % 100 = 1")
def members_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON21: the member list of one workspace is replaced."""
    members = t.users(spark, sf_dir).select(F.col("c_nationkey").cast("long").alias("workspace_id"), "user_id")
    return membership.replaced_members(members, 3, members.where("user_id % 100 = 1"))


@query("select d.doc_id, d.thread_id, n_chars from (select doc_id, case when doc_id % 3 > 0 then doc_id % 3 end as thread_id from documents where doc_id % 2 = 0) d join (select doc_id, n_chars from documents where doc_id % 5 > 0) c using (doc_id) where d.thread_id is not distinct from null")
def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON22: files of a thread, null-safe, with their stored content; those without content are dropped."""
    docs = t.table(spark, sf_dir, "documents")
    files = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).alias("thread_id"))
    return files.where(F.col("thread_id").eqNullSafe(F.lit(None))).join(docs.where("doc_id % 5 > 0").select("doc_id", "n_chars"), "doc_id").select("doc_id", "thread_id", "n_chars")


@query("select workspace_id, doc_id, tokens, sum(tokens) over (partition by workspace_id order by doc_id)::bigint as so_far, count(*) over (partition by workspace_id) as files, sum(tokens) over (partition by workspace_id)::bigint as total from (select doc_id % 25 as workspace_id, doc_id, case when doc_id % 8 > 0 then ceil(n_chars / 4)::bigint else 0 end as tokens from documents)")
def attachment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: attached files of each workspace with the running and the whole sum of their token estimates; no estimate counts 0."""
    files = t.table(spark, sf_dir, "documents").select((F.col("doc_id") % 25).alias("workspace_id"), "doc_id", F.when(F.col("doc_id") % 8 > 0, F.ceil(F.col("n_chars") / 4)).alias("tokens"))
    return membership.with_totals(files, "workspace_id", "doc_id", "tokens")


@query("""select source as workspace, count(*) filter (n_chars >= 500) as embedded, count(*) filter (n_chars < 500) as failed, md5(string_agg(case when n_chars < 500 then 'doc-' || doc_id end, ',' order by 'doc-' || doc_id)) as failed_titles,
 coalesce((select string_agg(x, ',' order by x) from (select distinct case when e.n_chars < 100 then 'empty' else 'too short' end as x from documents e where e.source = d.source and e.n_chars < 500)), '') as errors,
 case when count(*) filter (n_chars < 500) > 0 then count(*) filter (n_chars < 500) || ' documents failed to add.' || chr(10) || chr(10) || coalesce((select string_agg(x, chr(10) || chr(10) order by x) from (select distinct case when e.n_chars < 100 then 'empty' else 'too short' end as x from documents e where e.source = d.source and e.n_chars < 500)), '') end as message,
 sum(n_chars)::bigint as chars from documents d group by source""")
def embed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14 SRC18: what an embedding run took, what failed, the distinct errors and the message; no failures, no titles and no message."""
    runs = t.table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.concat(F.lit("doc-"), "doc_id").alias("title"), F.when(F.col("n_chars") < 100, "empty").when(F.col("n_chars") < 500, "too short").alias("error"), "n_chars")
    return audit.run_summary(runs, "workspace", F.sum("n_chars").alias("chars")).select("workspace", "embedded", "failed", F.md5(F.array_join("failed_titles", ",")).alias("failed_titles"), F.array_join("errors", ",").alias("errors"), "message", "chars")


@query("""with u as (select s_suppkey as key, case s_suppkey % 4 when 0 then 'remove' when 1 then 'update' else 'add' end as action, case when s_suppkey % 4 = 1 then s_suppkey + s_suppkey % 3 * 10000 + case when s_suppkey % 5 = 0 then 1 else 0 end else s_suppkey end as new_key, 'new' || s_suppkey as value from supplier where s_suppkey % 7 <> 3),
 e as (select s_suppkey as key, s_name as value from supplier where s_suppkey % 3 = 0),
 j as (select u.*, e.value as old, t.key is not null as taken from u left join e using (key) left join e t on t.key = u.new_key and u.new_key <> u.key),
 ok as (select * from j where action = 'remove' and old is not null or action = 'update' and old is not null and not taken or action = 'add' and old is null)
 select key, value from e where key not in (select key from ok) union all select new_key, value from ok where action <> 'remove'""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: add, update (with a new name) and remove actions merged into existing rows by their rules."""
    s, k = t.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    action = F.when(k % 4 == 0, "remove").when(k % 4 == 1, "update").otherwise("add")
    new_key = F.when(k % 4 == 1, k + k % 3 * 10000 + F.when(k % 5 == 0, 1).otherwise(0)).otherwise(k)
    updates = s.where("s_suppkey % 7 <> 3").select(k.alias("key"), action.alias("action"), new_key.alias("new_key"), F.concat(F.lit("new"), k).alias("value"))
    return membership.merged(s.where("s_suppkey % 3 = 0").select(k.alias("key"), F.col("s_name").alias("value")), updates)


@query("select p_partkey as id, greatest(0, least(1, p_retailprice / 1500)) as threshold, greatest(1, p_size - 10)::bigint as top_n, case when p_size % 2 = 0 then 20 else p_size end::bigint as history from part")
def settings_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT9 SCL52: settings within their bounds, defaults for what isn't a number."""
    p = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1500).cast("string").alias("t"), (F.col("p_size") - 10).cast("string").alias("n"), F.when(F.col("p_size") % 2 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("h"))
    a, b, c = membership.clamped("t", "n", "h")
    return p.select("id", a.alias("threshold"), b.alias("top_n"), c.alias("history"))


@query(f"select coalesce(thread_id, 0) as thread_id, count(*) as chats from (select case when thread_id % 5 > 0 then thread_id end as thread_id from {t.CHATS_SQL} union all select 0) group by 1")
def thread_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: the default thread joins the list; null ids are its id."""
    chats = t.chats(spark, sf_dir).select(F.when(F.col("thread_id") % 5 > 0, F.col("thread_id")).alias("thread_id"))
    return chats.unionByName(spark.sql("select cast(0 as bigint) as thread_id")).groupBy(F.coalesce("thread_id", F.lit(0)).alias("thread_id")).agg(F.count("*").alias("chats"))


@query("select n_name as key, 'system' as kind, n_regionkey::bigint as value, null::varchar as note from nation where n_nationkey % 4 > 0 union all select r_name, 'user', null, r_name from region where r_regionkey < 3")
def variables_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3 SET6: built-in and user variables in one table with the union of their columns; built-ins that need a user are left out where there is none."""
    built_in = t.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit("system").alias("kind"), F.col("n_regionkey").cast("long").alias("value"), (F.col("n_nationkey") % 4 == 0).alias("needs_user"))
    own = t.table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_name").alias("key"), F.lit("user").alias("kind"), F.col("r_name").alias("note"))
    return membership.all_variables(built_in, own, user=False)


@query("select source, arg_min(doc_id, score * 100000 + doc_id) as doc_id from (select source, doc_id, case lang when 'en' then 0 when 'de' then 1 else 9999 end + case when doc_id % 2 = 1 then 0.5 else 0 end as score from documents) group by source")
def caption_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP6: each source's best track by language preference; generated ones give way to written ones."""
    score = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(9999) + F.when(F.col("doc_id") % 2 == 1, 0.5).otherwise(0)
    return t.table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(score, "doc_id")).alias("doc_id"))


@query("select n_name as name, row_number() over (order by case n_name when 'NATION_7' then 0 when 'NATION_4' then 1 else 2 end, n_nationkey) as place from nation")
def preferred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP7 TOP8: preferred names lead, later preferences first; the others keep their order. A fixed small table."""
    order = Window.orderBy(F.when(F.col("n_name") == "NATION_7", 0).when(F.col("n_name") == "NATION_4", 1).otherwise(2), "n_nationkey")
    return t.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.row_number().over(order).cast("long").alias("place"))


@query("select l_orderkey as archive, l_linenumber as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as place from lineitem")
def running_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: running number of each message in its archive."""
    rows = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("line"), F.struct("l_linenumber", "l_partkey").alias("at"))
    return membership.running_place(rows, "archive", "at").select("archive", "line", F.col("place").cast("long").alias("place"))
