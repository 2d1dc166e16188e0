"""Golden cases and properties of operators that SQL doesn't cover."""

import time

import pytest
from pyspark.sql import functions as F

from lorefield.functions import text
from lorefield.functions.text import chunk_header, split_text, valid_url
from lorefield.operators import audit, context, embedding, loaders, search, snapshots
from lorefield.streaming import jobs, stateful

SENTENCE = "This is a test text to be split into chunks"  # fixed value: 43 characters with published chunk counts


def test_split_counts():
    text = SENTENCE * 2
    assert len(split_text(text, 20, 0)) == 5 and len(split_text(text, 30, 20)) == 6
    with pytest.raises(ValueError):
        split_text(text, 20, 21)


@pytest.mark.parametrize("size, overlap", [(50, 0), (100, 20), (1000, 20)])
def test_split_keeps_sizes_and_words(size, overlap):
    text = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(i % 40)) for i in range(60))
    found = split_text(text, size, overlap)
    assert all(len(x) <= size for x in found) and set(" ".join(found).split()) == set(text.split())


def test_header_leaves_out_missing_parts(spark):
    row = spark.range(1).select(chunk_header(F.lit("t"), F.lit(None).cast("string"), F.lit("link://https://x.y")).alias("a"), chunk_header(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("file")).alias("b")).first()
    assert row.a == "<document_metadata>\nsourceDocument: t\nsource: https://x.y\n</document_metadata>\n\n" and row.b == ""


def test_urls(spark):
    rows = {"https://a.b": True, "ftp://a.b": False, "http://10.0.0.1/x": False, "http://127.0.0.1:3": True, "http://127.0.0.2": False, "a.b": False}
    frame = spark.createDataFrame([(u,) for u in rows], "u string")
    assert {r.u: r.v for r in frame.select("u", valid_url(F.col("u")).alias("v")).collect()} == rows


def test_history_keeps_its_budget(spark):
    chats = spark.createDataFrame([(t, t * 100 + i, "p" * (40 * i + 4), "a" * 400) for t in range(5) for i in range(12)], "thread_id long, id long, prompt string, answer string")
    used = context.history_within(chats, 300).groupBy("thread_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("c")).collect()
    assert len(used) == 5 and all(r.n <= 300 and r.c >= 1 for r in used)


def _middle_out(text, target):
    """The loop's own cut, group by group of four characters."""
    groups = [text[i : i + 4] for i in range(0, len(text), 4)]
    if len(groups) < target:
        return text
    middle, half = len(groups) // 2, (len(groups) - target + 1) // 2
    return "".join(groups[: max(0, middle - half)]) + context.TRUNCATED + "".join(groups[middle + half :])


def test_quarter_cut_is_the_loops(spark):
    texts = ["x" * n + "é😀" * (n % 7) for n in range(0, 700, 13)]
    frame = spark.createDataFrame([(x,) for x in texts], "t string")
    for target in (1, 30, 136):
        assert [r.c for r in frame.select(context.quarter_cut(F.col("t"), target).alias("c")).collect()] == [_middle_out(x, target) for x in texts]


def test_history_behind_long_chats(spark):
    """Long chats among the newest three are cut or left out, and the older ones that fit stay."""
    sizes = {1: [4000, 40, 40, 40, 40], 2: [40, 4000, 40, 40, 40, 40], 3: [400, 4000, 4000, 40, 40], 4: [40, 40, 40, 600, 600, 40], 5: [40] * 60, 6: [9000] * 3 + [1196, 4], 7: [100, 100, 100, 4000, 40]}  # newest first
    chats = [(t, 100 - i, "p" * (n // 2), "a" * (n // 2)) for t, ns in sizes.items() for i, n in enumerate(ns)]
    whole = {}
    for t, ns in sizes.items():
        used, kept = 0, []
        for i, n in enumerate(ns):
            p, cost = "p" * (n // 2), 2 * -(-(n // 2) // 4)
            if used + cost >= 300:
                if i > 2:
                    break
                p = _middle_out(p, 136)
                cost = 11 + -(-len(p) // 4) + -(-len(_middle_out("a" * (n // 2), 136)) // 4)
                if used + cost > 300:
                    continue
            used += cost
            kept.append(100 - i)
        whole[t] = kept
    got = {t: [] for t in sizes}
    for r in context.history_within(spark.createDataFrame(chats, "thread_id long, id long, prompt string, answer string"), 300).collect():
        got[r.thread_id].append(r.id)
    assert {t: sorted(ids, reverse=True) for t, ids in got.items()} == whole
    assert 96 in got[2] or 96 in got[3]


def test_mail_archive(spark, tmp_path):
    (tmp_path / "box.mbox").write_text("From a@b Mon\nFrom: A <a@b>\nSubject: Hello\n\nFirst body\n\nFrom c@d Tue\nFrom: C <c@d>\n\nSecond body\nmore\n\nFrom e@f Wed\nSubject: none\n\n\n")
    got = [(r.n, r.title, r.author, r.text) for r in loaders.mail_messages(spark, str(tmp_path)).orderBy("n").collect()]
    assert got == [(1, "Hello", "A <a@b>", "First body"), (2, "msg_2-box.mbox", "C <c@d>", "Second body\nmore")]


def test_text_and_document_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("some text")
    (tmp_path / "t/b.txt").write_text("")
    assert [(r.title, r.text) for r in loaders.text_documents(spark, f"{tmp_path}/t").collect()] == [("a.txt", "some text")]
    (tmp_path / "d/one").mkdir(parents=True)
    full = ",".join(f'"{c}":"x"' for c in loaders.REQUIRED[:8]) + ',"wordCount":1,"token_count_estimate":2,"pageContent":"p"'
    (tmp_path / "d/one/a.json").write_text("{" + full + "}")
    (tmp_path / "d/one/b.json").write_text('{"id":"x"}')
    got = loaders.listed_documents(spark, f"{tmp_path}/d").collect()
    assert [(r.id, r.folder) for r in got] == [("x", "one")] and "pageContent" not in got[0]


def test_second_run_embeds_nothing(spark):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string").withColumn("key", embedding.cache_key(F.col("text"), 1000, 20))
    done = embedding.embedded(chunks)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in done.collect())
    hit, miss = embedding.split_by_cache(chunks, done.select("key"))
    assert hit.count() == 20 and miss.count() == 0


def test_snapshots(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"n{i % 3}") for i in range(12)], "id long, namespace string")
    embedding.append_chunks(chunks, f"{tmp_path}/one")
    kept = embedding.next_snapshot(spark.read.parquet(f"{tmp_path}/one"), chunks.where("id < 4"), "id", f"{tmp_path}/two")
    assert sorted(r.id for r in kept.collect()) == list(range(4, 12))
    with pytest.raises(ValueError):
        embedding.checked_schema(chunks, {"id": "string"})


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    rows = [(i, n, f"{i}.{n} ", n == 4, 1000 * n + i) for i in range(6) for n in range(1, 7)]
    for n in range(1, 7):
        spark.createDataFrame([r for r in rows if r[1] == n], "id long, n int, piece string, finish boolean, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, n int, piece string, finish boolean, at_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.run_available(jobs.assembled_answers(stream)).collect()
    assert sorted(got) == sorted(jobs.assembled_batch(spark.createDataFrame(rows, "id long, n int, piece string, finish boolean, at_ms long")).collect())


def test_answers_are_forgotten_after_a_while(spark, tmp_path):
    """A piece that comes hours after the others starts an answer anew, as the state has expired; within the hour it is ignored."""
    hour = 3_600_000
    batches = [[(1, 1, "a", True, 0), (2, 1, "b", True, 0)], [(1, 2, "late", True, hour // 2)], [(3, 1, "c", True, 9 * hour)], [(4, 1, "d", True, 9 * hour + 1)], [(2, 2, "again", True, 10 * hour)]]
    for rows in batches:
        time.sleep(1.1)  # files are taken in the order of their times
        rows = [(*r[:4], 10**12 + r[4]) for r in rows]
        spark.createDataFrame(rows, "id long, n int, piece string, finish boolean, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, n int, piece string, finish boolean, at_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted((r.id, r.answer) for r in jobs.run_available(jobs.assembled_answers(stream)).collect()) == [(1, "a"), (2, "again"), (2, "b"), (3, "c"), (4, "d")]


def test_cooldown_depends_on_accepted_calls(spark):
    events = spark.createDataFrame([(i, "k", at) for i, at in enumerate((0, 40, 90, 120, 210, 230, 1000))], "event_id long, event string, at_ms long")
    assert sorted(r.at_ms for r in audit.accepted_after_cooldown(events, "event", 100).collect()) == [0, 120, 230, 1000]


def test_cooldown_over_a_whole_table(spark):
    """The folded stretches against a plain loop over each key."""
    events = [(i, f"e{i * 7 % 13}", (i * 7919) % 100_000) for i in range(3000)]
    expected, last = set(), {}
    for i, key, at in sorted(events, key=lambda e: (e[2], e[0])):
        if key not in last or at - last[key] >= 400:
            last[key] = at
            expected.add(i)
    frame = spark.createDataFrame(events, "event_id long, event string, at_ms long")
    assert {r.event_id for r in audit.accepted_after_cooldown(frame, "event", 400).collect()} == expected


def test_rerank_falls_back_to_the_similarity(spark):
    rows = [(1, "a b", i, t, s, r) for i, t, s, r in ((10, "a b", 0.9, 1), (11, "a", 0.2, 2), (12, "none", 0.8, 3), (13, "b", 0.7, 4), (14, "none", 0.6, 5))]
    found = search.reranked(spark.createDataFrame(rows, "question_id long, question string, id long, text string, similarity double, rank int"), 4).orderBy("place").collect()
    assert [(r.id, r.score) for r in found] == [(10, 1.0), (13, 0.5), (12, 0.8)]  # 11 is in the top four by its new score, but below the threshold by its similarity


def test_nearest_keeps_to_a_group_and_to_ties(spark):
    rows = [(i, [1.0, float(i % 3)], i % 2) for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>, namespace long")
    found = search.nearest(chunks, chunks.where("id = 1").select(F.col("id").alias("question_id"), "embedding", "namespace"), 3, within="namespace").orderBy("rank").collect()
    assert [r.id for r in found] == [1, 7, 13]
    assert search.candidates(chunks, chunks.where("id = 1").select(F.col("id").alias("question_id"), "embedding", "namespace")).count() == 10


def test_long_texts_reach_the_embedder_in_pieces(spark):
    docs = spark.createDataFrame([(2**60 + 1, "alpha " * 50 + "omega " * 50), (None, "x")], "id long, text string")
    got = {r.id: r.embedding for r in embedding.embedded(docs, max_chars=300).collect()}
    whole = embedding.hashing_embedder(["alpha " * 50, "omega " * 50]).sum(0)
    assert set(got) == {2**60 + 1, None} and max(abs(a - b) for a, b in zip(got[2**60 + 1], whole / (whole @ whole) ** 0.5)) < 1e-6


def test_ingestion_is_the_same_when_a_batch_runs_again(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "chunks")
    one = lambda rows: spark.createDataFrame(rows, "doc_id long, namespace string, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("doc_id long, namespace string, text string").parquet(str(source))
    one([(1, "a", "first text"), (2, "a", "second text")])
    stateful.ingested(stream(), path)
    one([(1, "a", "first text"), (3, "b", "third text")])  # the first document comes again
    stateful.ingested(stream(), path)
    rows = lambda: sorted((r.doc_id, r.text, r.batch) for r in spark.read.parquet(path).collect())
    assert rows() == [(1, "first text", 0), (2, "second text", 0), (3, "third text", 1)]
    commits = tmp_path / "chunks-state" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()  # as if the job had failed after its last batch
    stateful.ingested(stream(), path)
    assert rows() == [(1, "first text", 0), (2, "second text", 0), (3, "third text", 1)]


def test_text_functions_take_any_characters(spark):
    from lorefield.functions import text as T

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    presets = {"/price": r"costs $5 \ now", "/a.b": "dotted"}
    assert one(T.commands_expanded(F.lit("/price"), presets)) == r"costs $5 \ now"
    assert one(T.commands_expanded(F.lit("/axb"), presets)) == "/axb" and one(T.commands_expanded(F.lit("/a.b"), presets)) == "dotted"
    values = {"user.name": F.lit("{thread} $1"), "thread": F.lit("7"), "user.none": F.lit(None).cast("string")}
    assert one(T.expanded(F.lit("a {user.name} {thread} {user.none} {workspace.plan.x} {other} { {"), values)) == "a {thread} $1 7 [User none] [Workspace plan] {other} { {"
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1_048_575: "1.0 MiB", 1_048_576: "1.0 MiB", 3 * 10**15: "2.7 PiB", -2048: "-2.0 KiB"}
    assert {n: one(T.file_size(F.lit(n).cast("long"))) for n in sizes} == sizes
    short = {0: "0", 7: "7", 999: "999", 1000: "1K", 1234: "1.2K", 9960: "10K", 12_345: "12K", 999_499: "999K", 999_950: "1M", 1_048_575: "1M", 1_500_000_000: "1.5B", 3 * 10**15: "3000T", 3 * 10**16: "30,000T", -1500: "-1.5K"}
    assert {n: one(T.compact(F.lit(n).cast("long"))) for n in short} == short


def test_site_walk_in_order_of_discovery(spark):
    from lorefield.operators import loaders
    from lorefield.sources.shared import with_checkpoints

    with_checkpoints(spark)
    site = "https://a.org/docs/"
    html = {"index": ["b", "/docs/c#x", "c", "/other", "https://b.org/docs/z", "//a.org/docs/d"], "b": ["index", "e", "c"], "c": ["f"], "d": ["g"], "e": ["h"], "f": ["h", "i"]}
    pages = spark.createDataFrame([(site + k, "".join(f'<a href="{x}">x</a>' for x in v)) for k, v in html.items()], "url string, html string")
    walk = lambda *a: [(r.link.removeprefix(site), r.depth) for r in loaders.site_discovered(pages, site + "index", *a).orderBy("place").collect()]
    first = [("index", 0), ("b", 1), ("c", 1), ("d", 1)]
    assert walk() == first and walk(0, 20) == first[:1] and walk(2, 3) == first[:3]
    assert walk(2, 20) == [*first, ("e", 2), ("f", 2), ("g", 2)]
    assert walk(9, 20) == [*first, ("e", 2), ("f", 2), ("g", 2), ("h", 3), ("i", 3)] and walk(9, 8) == walk(9, 20)[:8]


def test_summaries_of_a_long_text_by_levels(spark):
    """A text of 1 MB against a plain loop; one whose summaries don't shrink ends."""
    def head(x):
        return " ".join(x.split()[:200])

    def loop(text, limit):
        level = 0
        while len(text) > limit:
            level += 1
            text = "\n".join(head(x) for x in split_text(text, 10_000, 500, ("\n\n", "\n")))
        return (head(text) if level else text), level

    long = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(30 + i % 50)) for i in range(2600))
    assert len(long) > 1_000_000
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, ""), (5, " " * 4000)], "doc_id long, text string")
    got = {r.doc_id: (r.summary, r.levels) for r in embedding.summarized(docs, 3000, head).collect()}
    assert got == {1: loop(long, 3000), 2: ("short", 0), 3: (None, 0), 4: ("", 0), 5: ("", 1)} and got[1][1] > 1
    stuck = embedding.summarized(docs.where("doc_id = 1"), 3000, lambda x: x, rounds=2).first()
    assert stuck.levels == 2 and len(stuck.summary) > 3000
    assert embedding.summarized(docs.limit(0), 3000).count() == 0


def test_versions_change_together(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.tables() == {}
    a, b = spark.range(10).toDF("x"), spark.range(5).toDF("y")
    assert store.commit({"a": a, "b": b}) == 1
    with pytest.raises(Exception):  # the second table's write fails
        store.commit({"a": a.where("x > 3"), "b": b.select(F.when(F.col("y") > 2, F.raise_error(F.lit("no"))).otherwise(F.col("y")).alias("y"))})
    assert store.version() == 1 and store.read("a").count() == 10 and store.read("b").count() == 5
    assert store.commit({"a": store.read("a").where("x > 3")}) == 2 and store.read("a").count() == 6 and store.read("b").count() == 5
    with pytest.raises(RuntimeError):
        store.commit({"a": a}, base=1)
    assert store.rollback(1) == 3 and store.read("a").count() == 10 and store.read("a", 2).count() == 6
    store.commit({"a": store.read("a").limit(0)})
    assert store.read("a").count() == 0 and store.read("a").columns == ["x"]


def test_wiki_bodies():
    code = '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[ a<b\n\n\n\n  c ]]></ac:plain-text-body></ac:structured-macro>'
    assert loaders.wiki_text(f"<p>x</p>{code}<p>y</p>") == "x\n```py\na<b\n\n  c\n```\ny"
    nested = f'<ac:structured-macro ac:name="expand"><ac:structured-macro ac:name="info"><p>i</p>{code}</ac:structured-macro><p>j</p></ac:structured-macro>'
    assert loaders.wiki_text(nested) == "i\n```py\na<b\n\n  c\n```\nj"
    assert loaders.wiki_text('<ac:structured-macro ac:name="toc" /><p>t</p>') == "t"
    assert loaders.wiki_text("<p>a</p><![CDATA[1 < 2]]></ac:structured-macro>") == "a\n1 < 2"
    assert loaders.wiki_text(None) == "" and loaders.wiki_text('<ac:structured-macro ac:name="code">') == ""


def test_chunk_table_function(spark):
    text.register_chunks(spark, "chunks_here")
    spark.createDataFrame([(1, SENTENCE * 2), (2, None), (3, "")], "id long, t string").createOrReplaceTempView("chunked")
    for size, overlap, n in ((20, 0, 5), (30, 20, 6)):  # published counts
        got = spark.sql(f"select id, c.* from chunked, lateral chunks_here(t, {size}, {overlap}) c").collect()
        assert [(r.id, r.chunk_index) for r in got] == [(1, i) for i in range(n)] and [r.chunk for r in got] == split_text(SENTENCE * 2, size, overlap)
