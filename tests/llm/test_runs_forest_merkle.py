"""Periodic runs, the LSH forest and the Merkle manifest against brute force; trips of texts in the Jaccard join; clashing names and empty tables in all operators and stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, WORD, corpus, reached, sets_of

from lorefield.llm import cotraining, forest, html_extract, jaccard_join, line_dedup, merkle, mixing, packing, quality_rules, runs, sharding, surrogates
from lorefield.llm.common import stored
from lorefield.llm.exact_dedup import exact_dedup, exact_groups


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- runs ----

def runs_expected(words, least):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("points", [runs.POINTS, 40])
def test_runs_are_those_of_brute_force(points, monkeypatch):
    monkeypatch.setattr(runs, "POINTS", points)
    rng = random.Random(1)
    some = 0
    for _ in range(400):
        n, letters = rng.choice([0, 1, 2, 5, 11, 12, 13, 14, 30, 60, 150, 300]), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.choice([0, 0, 1, 3]) if n > 4 else 0):
            s, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(s + p, min(n, s + rng.randint(1, n))):
                words[i] = words[i - p]
        for least in (12, 2):
            got = [tuple(r) for r in runs.runs_of(np.array(words, np.int64), least).tolist()]
            assert got == runs_expected(words, least)
            some += len(got)
    assert some > 500


def test_extensions_over_samples():
    rng = np.random.default_rng(4)
    for words in (np.zeros(700, np.int64), np.tile(rng.integers(0, 3, 57), 12), np.r_[np.tile([1, 2], 200), 3, np.tile([1, 2], 200)]):
        extension = runs.Extensions(words)
        i, j = np.array([(a, b) for a in range(0, len(words), 11) for b in range(a + 1, len(words), 17)]).T
        expected = [next((k for k in range(len(words) - b) if words[a + k] != words[b + k]), len(words) - b) for a, b in zip(i.tolist(), j.tolist())]
        assert extension(i, j).tolist() == expected and extension.ranks is not None


def test_a_long_periodic_text_takes_little_time():
    words = np.tile(np.arange(700), 60)
    assert runs.runs_of(words).tolist() == [[0, 42000, 700]]


def planted(id_, words):
    h = zlib.crc32(str(id_).encode()) if id_ is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + math.floor((n - a) / (3 + g % 8))
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_collapse_runs(spark, docs, rows, empty):
    more = [(1000 + k, " ".join(["x y z"] * (k % 30) + [f"w{k}"] + ["é"] * (k % 17))) for k in range(150)]
    frame = docs.select("doc_id", "text", "size", F.lit(1).alias("start"), F.lit(2).alias("n_runs")).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    expected, some = Counter(), 0
    for id_, text in [r[:2] for r in rows] + more:
        words = planted(id_, WORD.findall(text or ""))
        found = runs_expected(words, 12) if len(words) < 2000 else [tuple(r) for r in runs.runs_of(np.unique(words, return_inverse=True)[1])]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected[(id_, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))] += 1
        some += bool(found)
    assert some > 60
    assert Counter(map(tuple, runs.collapse_runs(frame, plant=True, digest=True).collect())) == expected
    texts = {r.doc_id: r.text for r in runs.collapse_runs(frame).collect()}
    assert texts[1020] == "x y z w20 é é é" and texts[1000] == "w0"
    assert runs.collapse_runs(empty).count() == 0


# ---- LSH forest ----

def variants(rng, count=30):
    texts = []
    for k, n in enumerate((8, 12, 40, 200)):
        base = now = [f"b{k}x{i}" for i in range(n)]
        for _ in range(count):  # a chain: neighbours are alike, ends are not
            now = now[:]
            now[rng.randrange(len(now))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(now))
        for _ in range(count):  # copies of one text, with few or many changes
            copy = base[:]
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(60)}"
            texts.append(" ".join(copy))
    shared = " ".join(f"p{i}" for i in range(60))
    return texts + [shared + " " + " ".join(f"o{k}x{i}" for i in range(5 + k % 9)) for k in range(40)]


@pytest.mark.parametrize("width, percent", [(5, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, width, percent):
    sets = sets_of([r[1] for r in rows], width)
    component = [c if s else r[0] for r, s, c in zip(rows, sets, reached([r[0] for r in rows], sets, percent))]
    expected = Counter((r[0], len(s), c, c == r[0]) for r, s, c in zip(rows, sets, component))
    assert Counter(map(tuple, forest.near_duplicates(docs, width, percent).collect())) == expected
    assert forest.near_duplicates(empty).count() == 0 and forest.without_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded, part", [(2048, 2048), (8, 4)])  # with crowded regions, and groups in several parts
def test_near_duplicates_of_many_variants(spark, crowded, part, monkeypatch):
    monkeypatch.setattr(forest, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "PART", part)
    texts = variants(random.Random(8))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    expected = reached(list(range(len(texts))), sets_of(texts, 5), 85)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(frame, 5, 85).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    assert {r.doc_id for r in forest.without_near_duplicates(frame, 5, 85).collect()} == set(expected)


def test_pairs_of_crowded_regions_meet(spark, monkeypatch):
    """All texts agree in one order down to its last value and in no other, so that the pairs that link meet in a crowded region or not at all."""
    def crowd(batches, **how):
        from lorefield.llm import forest

        for batch in forest._sketched(batches, **how):
            nodes, sketches = batch.column("node").to_pylist(), batch.column("sketch").to_pylist()
            regions = [[7] + [node ^ k for k in range(1, forest.ORDERS)] for node in nodes]
            columns = [*batch.columns[:5], pa.array(regions, pa.list_(pa.int64())), pa.array([bytes(forest.DEPTH) + s[forest.DEPTH :] for s in sketches], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    monkeypatch.setattr(forest, "CROWDED", 8)
    monkeypatch.setattr(forest, "_sketched", crowd)
    rng, texts = random.Random(4), []
    for k in range(100):
        a = [f"o{k}x{i}" for i in range(100)]
        b = [f"n{k}a", *a[1:]]
        b[20 + rng.randrange(40)], b[-1] = f"n{k}b", f"n{k}c"
        texts += [" ".join(a), " ".join(b)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(frame, 5, 85).collect()}
    assert [i for i in range(len(texts)) if got[i] != i - i % 2] == []


def test_pairs_at_the_limit_meet():
    """Of pairs with a similarity of just the limit, all share a region of the first depth and look alike."""
    rng = np.random.default_rng(6)
    for percent in (80, 85):
        depth, least, missed, unlike = forest.first_depth(percent), forest.least_equal(percent), 0, 0
        for _ in range(1500):
            n = int(rng.integers(20, 400))
            both = -(-percent * n // 100)
            items = rng.integers(0, 2**64, n, np.uint64)
            cut = both + (n - both) // 2
            a, b = np.unique(items[:cut]), np.unique(np.r_[items[:both], items[cut:]])
            x, y = forest.minima(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
            same = (x == y).reshape(forest.ORDERS, forest.DEPTH)
            missed += not same[:, :depth].all(1).any()
            unlike += int((x.astype(np.uint8) == y.astype(np.uint8)).sum()) < least
        assert missed == 0 and unlike == 0


def test_each_text_travels_once(spark, monkeypatch):
    """Texts that differ from one base in 12 of 400 words share many signatures, but link with none: few groups, and one for each in the forest."""
    rng = random.Random(3)
    base, texts = [f"b{i}" for i in range(400)], []
    for _ in range(600):
        copy = base[:]
        for at in rng.sample(range(400), 12):
            copy[at] = f"n{rng.randrange(10**7)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    trips = []
    for module in (jaccard_join, forest):
        monkeypatch.setattr(module, "decided", lambda texts, rows, nodes, groups, *a, f=jaccard_join.decided: (trips.append(groups.agg(F.sum(F.size("at"))).first()[0] or 0), f(texts, rows, nodes, groups, *a))[1])
    assert jaccard_join.jaccard_components(frame, 4, 85).where("doc_id <> component_id").count() == 0 and trips[0] <= 3 * len(texts)
    forest.near_duplicates(frame, 5, 85).count()
    assert trips[1] <= 1.1 * len(texts)


# ---- Merkle manifest ----

def manifest_expected(rows, fanout):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if t else t
    sources = defaultdict(list)
    for id_, text, lang, source, n_chars, *_ in rows:
        leaf = lambda t: sha("".join(map(field, (id_, source, lang, n_chars, t))))
        bad = id_ is not None and zlib.crc32(str(id_).encode()) % 5 == 0
        sources[source].append((id_ is not None, id_ or 0, leaf(text), leaf(lower(text)) if bad else leaf(text), id_))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(sources[s])]) for s in order]
    upper = levels([t[-1][0] for t in trees])
    out = Counter()
    for k, s in enumerate(order):
        for i, (_, _, leaf, tampered, id_) in enumerate(sorted(sources[s])):
            siblings, now = "", tampered
            for tree, at in ((trees[k], i), (upper, k)):
                for level in tree[:-1]:
                    first = at // fanout * fanout
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + fanout])
                    siblings, now, at = siblings + left + right, sha(left + now + right), at // fanout
            root = upper[-1][0]
            out[(id_, leaf, trees[k][-1][0], root, sha(siblings), now, now == root)] += 1
    return out


@pytest.mark.parametrize("fanout, inner", [(16, 3), (16, 1), (2, 1), (3, 2), (2, 3)])  # several rounds of exchange, and ends inside aligned groups
def test_manifest(docs, rows, fanout, inner, monkeypatch):
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "INNER", inner)
    got = Counter(tuple(r) for r in merkle.manifest(docs).collect())
    assert got == manifest_expected(rows, fanout)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, empty, rows):
    assert merkle.manifest(empty).count() == 0
    for some in (rows[:1], rows[60:62], [rows[5]] * 40):
        assert Counter(map(tuple, merkle.manifest(spark.createDataFrame(some, SCHEMA)).collect())) == manifest_expected(some, 16)


@pytest.mark.parametrize("n, fanout", [(1, 2), (2, 2), (7, 2), (33, 4), (65, 4), (16, 16), (18, 16)])
def test_exchange_gives_each_unit_its_path(spark, n, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    units = spark.createDataFrame([("t", i, n, h) for i, h in enumerate(hashes)] + [("u", 0, 1, "only")], "tree string, place long, count long, hash string")
    got = {(r.tree, r.place): r for r in merkle.exchanged(units, n).collect()}
    assert len(got) == n + 1 and got["u", 0].hash == "only" and not got["u", 0].path
    root = merkle.tree(hashes, merkle.levels_of(n, fanout), fanout)[-1][0]
    for i, h in enumerate(hashes):
        for step in got["t", i].path:
            h = hashlib.sha256((step.left + h + step.right).encode()).hexdigest()
        assert h == root == got["t", i].hash


# ---- mixing with long documents ----

@pytest.mark.parametrize("count, block", [(50, 4096), (500, 4096), (500, 64)])
def test_mix_is_near_the_target_with_a_document_of_a_fifth_of_its_source(spark, count, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(5)
    sizes = {s: [rng.randint(20, 300) for _ in range(count)] for s in "abcd"}
    for s in "ac":
        sizes[s][7] = sum(sizes[s]) // 4
    data = [(1000 * k + i, s, "w " * n) for k, s in enumerate("abcd") for i, n in enumerate(sizes[s])]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in "abcd":
        assert abs(taken[s] - target[s]) <= max(0.005 * target[s], min(sizes[s]))


# ---- clashing names and empty tables ----

def internal_names():
    """Every name that the operators give to columns of their own, at least those with the library's prefix."""
    found = set()
    for module in (cotraining, forest, html_extract, jaccard_join, line_dedup, merkle, mixing, packing, quality_rules, runs, sharding, surrogates):
        found |= set(re.findall(r'alias\("(\w+)"\)|withColumn\("(\w+)"', open(module.__file__).read()))
    return sorted({x for pair in found for x in pair if x} | {f"lf__{x}" for x in ("id", "print", "sha", "any", "n", "source", "size", "copies", "rows", "nth", "place", "row", "text", "share")} - {"doc_id", "text", "lang", "source", "n_chars"})


def test_any_other_column_may_be_there(spark, rows):
    names = [n for n in internal_names() if n not in ("doc_id", "text", "lang", "source", "n_chars")]
    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wide = stored(plain.select("*", *[F.lit(f"x{k}").alias(n) for k, n in enumerate(names)]))
    plain = stored(plain)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    key = lambda df, of: Counter(str([r[c] for c in of]) for r in df.collect())
    for f in (exact_groups, forest.near_duplicates, jaccard_join.jaccard_components, merkle.manifest, mixing.mix, packing.pack, runs.collapse_runs, sharding.shard_by_size,
              lambda d: line_dedup.line_dedup(d.select("doc_id", "text", *d.columns[5:])).select("doc_id", "n_lines", "n_dropped"), lambda d: quality_rules.quality_rules(d, labels)):
        of = f(plain).columns
        assert key(f(wide), of) == key(f(plain), of)
    for f in (exact_dedup, forest.without_near_duplicates, jaccard_join.one_of_each, mixing.mixed_documents):
        assert f(wide).columns == wide.columns and key(f(wide), plain.columns) == key(f(plain), plain.columns)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
