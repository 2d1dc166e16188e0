"""Queries against their SQL in DuckDB on small tables of edge cases, which the supplied ones don't hold at the smallest size."""

import duckdb
from pyspark.sql import functions as F

from lorefield.operators import audit, embedding, search
from lorefield.plans import ORACLE_SQL, QUERIES


def agrees(spark, folder, name, table, rows, schema):
    """The sorted rows of a query over one table, after comparing them with those of its SQL."""
    path = f"{folder}/{table}.parquet"
    spark.createDataFrame(rows, schema).write.parquet(path)
    got = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall(), key=str)
    return found


def test_number_formats_by_the_size_before_rounding(spark, tmp_path):
    """Sizes around 1,024 KiB and beyond 1,024 MiB: the unit goes by the bytes, and MiB is the largest."""
    prices = [511.5, 512.0, 524_262.0, 524_264.9, 524_287.5, 524_288.0, 600_000_000.0]
    rows = [(7 * (i + 1), price) for i, price in enumerate(prices)]
    found = agrees(spark, tmp_path, "number_formats", "orders", rows, "o_orderkey long, o_totalprice double")
    assert {r[2] for r in found} >= {"1023 B", "1.0 KiB", "1024.0 KiB", "1.0 MiB", "1144.4 MiB"}


def test_history_of_chats_that_a_cut_leaves_as_dear(spark, tmp_path):
    """An answer of 155 tokens costs as much cut as whole and fits its budget to the token; then its whole text stays. A null prompt is left out, and ends the history from the fourth chat on."""
    threads = {1: [(100, 80), (400, 620)], 2: [(100, 80), (400, 624)], 3: [(100, 80), (620, 400)], 4: [(40, 40), (None, 40), (40, 40), (40, 40), (40, 40)], 5: [(40, 40)] * 3 + [(None, 40), (40, 40)]}
    rows = []
    for thread, chats in threads.items():  # newest first
        for i, (prompt, answer) in enumerate(reversed(chats)):
            rows += [(thread, 2 * i, "user", None if prompt is None else "p" * prompt), (thread, 2 * i + 1, "assistant", "a" * answer)]
    found = agrees(spark, tmp_path, "history_budget", "conversations", rows, "conv_id long, turn long, role string, text string")
    assert [(len(r[2]), len(r[3]), r[4]) for r in found if r[0] == 1] == [(400, 620, 255), (100, 80, 45)]
    assert [sum(r[0] == thread for r in found) for thread in threads] == [2, 1, 2, 4, 3]


def test_vault_of_blank_notes(spark, tmp_path):
    """Blank notes are loaded, and so are null ones outside every ninth file; a note has as many characters as it has code points."""
    texts = ["some note", "", "  ", " \n\t", None, "é😀", "x" * 5000, " "]
    rows = [(i, texts[i % 8], f"src{i % 20}") for i in range(200)] + [(None, "no id", "src1"), (-9, "a", "src1"), (-4, "b", "src1"), (400, "a", None), (401, "a", "src31"), (402, " ", "x/src3")]
    schema = "doc_id long, text string, source string"
    found = agrees(spark, tmp_path, "vault_load_summary", "documents", [(*r, "en") for r in rows], f"{schema}, lang string")
    assert {r[0] for r in found} == {"skipped", "loaded"}


def test_cooldown_of_many_stretches(spark):
    """Calls of many keys, with ties, null keys and null times, against a plain loop; Python isn't called for each stretch, of which there are some 8,000."""
    rows = [(i, None if i % 41 == 0 else f"k{i * 7919 % 1999}", None if i % 997 == 5 else i * i * 31 % 50_000) for i in range(20_000)] + [(3, "k1", 77)] * 3
    accepted, last = [], {}
    for i, key, at in sorted(rows, key=lambda e: (e[2] is not None, e[2] or 0, e[0])):
        if at is None or last.get(key) is None or at - last[key] >= 5_000:
            accepted.append((i, key, at))
            last[key] = at
    got = audit.accepted_after_cooldown(spark.createDataFrame(rows, "event_id long, event string, at_ms long"), "event", 5_000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(accepted, key=str)
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def _texts():
    words = [f"w{i}" for i in range(30)]
    texts = {}
    for k in range(6):
        own = words[k : k + 8]
        texts[100 * k + 50] = " ".join(reversed(own))  # earlier than the question, with its vector
        texts[100 * k + 51] = " ".join(own * 2)  # parallel to it
        texts[100 * k + 100] = " ".join(own)
        texts[100 * k + 120] = " ".join(own)  # after the question
    texts[49] = texts[200]  # the first equal one
    return texts | {1000: "", 1100: "five words are too few", 1200: "  ", 1300: " a b c d e f g h ", 1250: "a b c d e f g h"}


def test_memory_finds_itself_before_its_anagrams(spark, tmp_path):
    rows = [(i, text, "en", "s", len(text)) for i, text in _texts().items()]
    found = agrees(spark, tmp_path, "memory_search", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r[:2] for r in found] == [(1000100, 1000100), (1000200, 1000049), (1000300, 1000300), (1000400, 1000400), (1000500, 1000500), (1000600, 1000600), (1001300, 1001300)]


def test_nearest_of_held_and_other_questions(spark, tmp_path):
    """Questions by held texts, by held vectors, by neither and by vectors of zeros, against all distances; with few questions a block, the vectors aren't made anew for each."""
    made = spark.sparkContext.accumulator(0)

    def embedder(texts):
        made.add(len(texts))
        return embedding.hashing_embedder(texts)

    texts = list(_texts().items()) + [(2000 + i, f"other w{i} x{i * i % 17}") for i in range(60)]
    chunks = spark.createDataFrame(texts, "id long, text string").withColumn("key", F.col("text"))
    embedding.embedded(chunks, embedder).write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    ask = [(1, texts[2][1]), (2, "w7 w6 w5 w4 w3 w2 w1 w0"), (3, "other w3 x8 x9"), (4, "w0 other"), (5, ""), (6, "w3 x5"), (7, texts[2][1])]
    asked = embedding.embedded(spark.createDataFrame(ask, "question_id long, text string").withColumn("key", F.col("text")))
    got = {r.question_id: (r.id, round(r.distance, 6)) for r in search.nearest_held(held, asked, f"{tmp_path}/found").collect()}
    ids, vectors = [i for i, _ in texts], embedding.hashing_embedder([x for _, x in texts]).astype("float32").astype(float)
    for q, text in ask:
        v = embedding.hashing_embedder([text])[0]
        distance = 1 - vectors @ v
        if text in dict(texts).values():
            assert got[q] == (min(i for i, x in texts if x == text), 0)
        else:
            near = [i for i, d in zip(ids, distance) if d < distance.min() + 1e-6]
            assert got[q][0] in near and abs(got[q][1] - distance.min()) < 1e-5
    assert made.value == len(texts) and got[2][0] == 50
