"""Quality classification by co-training.

Two views of a document train two logistic models: the text view (byte shares, word and line statistics, and hashed words and word pairs of the whole
text) and the metadata view (language, source, recorded length). A round is one pass over all documents outside the labelled sample: tasks score both views,
and every document that a view is sure of, by its calibrated chances, is a pseudo-label for the other. Tasks send only sums over these documents (the slope of
the other view's loss, by class), with which both models take a step together with the labelled rows. Pseudo-labels weigh GIVEN each, and a class's
together at most SHARE of its labelled rows, whatever their number. Platt scaling on held-out labels calibrates each view, a second logistic model on the held-out
logits combines them, and the cutoff keeps all but a small share of the held-out good documents. All documents are then scored.

Fitting takes at most `max_labels` labelled documents to the driver, those with the smallest id hashes, one row for each id (the smallest). Of several
labels of one id the worst counts.

Defined results: a null text has the features of an empty one; null or missing metadata is a value of its own; without labels
of both classes nothing is learnt: p_text, p_meta and score are null and every document is kept; repeated rows score alike;
an empty table gives an empty result; columns named p_text, p_meta, score or kept are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, stored
from .hashing import bytes_of, mixed, slices, word_hashes

#: Bound of the labelled fitting sample, and the share of held-out good documents that the cutoff may reject.
MAX_LABELS = 16_000
REJECTED_GOOD = 0.003
#: Ridge of both views' models; rows that a step of fitting takes at once.
RIDGE = 10.0
FITTED = 1024
#: Rounds; the chance from which a view is sure; weight of a pseudo-label, and of all of a class as a share of its labelled rows.
ROUNDS = 4
SURE = 0.95
GIVEN, SHARE = 0.3, 0.1
#: Standardised features end here.
FARTHEST = 20.0
META = ("lang", "source", "n_chars")
_SLOTS = 48
#: Buckets of hashed words and of hashed word pairs in the text view.
WORDS, PAIRS = 256, 128
SCORES = ("p_text", "p_meta", "score", "kept")


def _statistics(b: bytes) -> np.ndarray:
    """Byte shares (ASCII one by one, the rest together) and word and line statistics of a whole text."""
    words, n = b.split(), max(1, len(b))
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    lines = [x for x in b.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    k = max(1, len(words))
    stats = [np.log1p(len(words)), sizes.mean(), sizes.std(), min(int(sizes.max()), 100), len(set(words)) / k, np.log1p(len(lines)),
             1 - len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)), float(b[:1].isupper()), float(b.rstrip()[-1:] in (b".", b"!", b"?")),
             count[65:91].sum() / max(1, count[65:91].sum() + count[97:123].sum()), np.sqrt(count[33:48].sum() / n), np.sqrt(count[58:65].sum() / n), np.sqrt(count[123:127].sum() / n)]
    return np.r_[np.sqrt(count[:128] / n), count[128:].sum() / n, stats]


def text_features(texts: pa.Array) -> np.ndarray:
    """The text view, one row for each text; null is empty."""
    out = [np.zeros((0, 143 + WORDS + PAIRS), np.float32)]
    for i, j in slices(texts):
        data, starts = bytes_of(texts.slice(i, j - i))
        hashes, row = word_hashes(data, starts)
        pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[row[:-1] == row[1:]] if len(hashes) else hashes
        shares = []
        for h, r, n in ((hashes, row, WORDS), (pairs, row[:-1][row[:-1] == row[1:]], PAIRS)):
            count = np.bincount(r * n + (h % np.uint64(n)).astype(np.int64), minlength=(j - i) * n).reshape(j - i, n)
            shares.append(np.sqrt(count / np.maximum(1, count.sum(1, keepdims=True))))
        stats = np.stack([_statistics(data[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])])
        out.append(np.minimum(np.c_[stats, *shares], 60_000).astype(np.float16).astype(np.float32))  # half precision is what the sample travels in
    return np.concatenate(out)


def meta_features(values: tuple) -> np.ndarray:
    """Hashed indicators of each metadata value; numbers by their power of two."""
    out = np.zeros(_SLOTS * len(values), np.float32)
    for i, v in enumerate(values):
        missing = v is None or v != v
        word = "none" if missing else f"2^{int(np.log2(max(1.0, float(v))))}" if isinstance(v, (int, float, np.number)) else str(v)
        out[i * _SLOTS + zlib.crc32(word.encode()) % _SLOTS] = 1
    return out


def derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of a ridge logistic regression at weights w; the last is the intercept."""
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    slope, bend = pull * w, np.diag(pull + 1e-9)
    for i in range(0, len(x), FITTED):  # in blocks, so that memory stays small
        x1 = np.c_[x[i : i + FITTED], np.ones(len(x[i : i + FITTED]))].astype(float)
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope += x1.T @ (p - y[i : i + FITTED])
        bend += (x1.T * (p * (1 - p))) @ x1
    return slope, bend


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(25):
        slope, bend = derivatives(x, y, w, ridge)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def standard(text: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((text - mean) / scale, -FARTHEST, FARTHEST)


@dataclass
class CoTrained:
    """Both views' models, their calibrations, the combination and the cutoff."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    platt_text: np.ndarray
    platt_meta: np.ndarray
    joint: np.ndarray
    cutoff: float = 0.5

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = _logit(_logit(standard(text, self.mean, self.scale), self.text)[:, None], self.platt_text)
        b = _logit(_logit(meta, self.meta)[:, None], self.platt_meta)
        return _p(a), _p(b), _p(_logit(np.c_[a, b], self.joint))


@dataclass
class Views:
    """What a round sends to the tasks: the text view's scale, and both views' models with the calibrations that say what they are sure of."""

    mean: np.ndarray
    scale: np.ndarray
    models: list[np.ndarray]
    sure_of: list[np.ndarray]
    sure: float

    def pulls(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Text view, label 0; text view, label 1; metadata view, label 0; metadata view, label 1: the summed slope of that view's loss over the
        documents which the other view gives that label, each followed by their number; one after the other."""
        views = [standard(text, self.mean, self.scale), meta]
        z = [_logit(x, w) for x, w in zip(views, self.models)]
        p = [_p(_logit(a[:, None], w)) for a, w in zip(z, self.sure_of)]
        out = []
        for v in (0, 1):
            for label in (0, 1):
                at = p[1 - v] >= self.sure if label else p[1 - v] <= 1 - self.sure
                out += [np.c_[views[v][at], np.ones(at.sum())].T.astype(float) @ (_p(z[v][at]) - label), [at.sum()]]
        return np.concatenate(out)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, exchange: Callable[[Views], np.ndarray], rounds: int = ROUNDS) -> CoTrained | None:
    """y: 0 or 1, of the labelled rows. exchange gives the sum of `Views.pulls` over all other documents. A quarter of the rows is held out for calibration,
    another for the cutoff. None if a class is missing."""
    part = np.random.default_rng(5).permutation(len(y)) % 4
    train, tune, hold = part > 1, part == 0, part == 1
    if any(len(set(y[m])) < 2 for m in (train, tune)):
        return None
    mean, scale = text[train].mean(0), text[train].std(0) + 1e-3
    views = [standard(text, mean, scale), meta]
    models = [fit(x[train], y[train], RIDGE) for x in views]
    for _ in range(rounds):
        sure_of = [fit(_logit(x[tune], w)[:, None], y[tune], 0.01) for x, w in zip(views, models)]  # calibrated, so that a weak view gives few labels
        sums = exchange(Views(mean, scale, models, sure_of, SURE))
        at, models = 0, list(models)
        for v in (0, 1):
            w, given = models[v], 0.0
            slope, bend = derivatives(views[v][train], y[train], w, RIDGE)
            for label in (0, 1):
                pull, n = sums[at : at + len(w)], sums[at + len(w)]
                at += len(w) + 1
                if n:
                    weight = min(GIVEN, SHARE * (y[train] == label).sum() / n)
                    slope, given = slope + weight * pull, given + weight * n
            models[v] = w - np.linalg.solve(bend * (1 + given / train.sum()), slope)
    a, b = (_logit(views[v][tune], models[v]) for v in (0, 1))
    platt = [fit(z[:, None], y[tune], 0.01) for z in (a, b)]
    joint = fit(np.c_[_logit(a[:, None], platt[0]), _logit(b[:, None], platt[1])], y[tune], 0.1)
    model = CoTrained(mean, scale, models[0], models[1], *platt, joint)
    good = model.scores(text[hold & (y == 1)], meta[hold & (y == 1)])[2]
    if len(good):
        model.cutoff = float(min(0.5, np.quantile(good, REJECTED_GOOD)))
    return model


def _matrices(texts: pa.Array, metas: pa.Array, n_meta: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of the feature table."""
    if not len(texts):
        return np.zeros((0, 143 + WORDS + PAIRS), np.float32), np.zeros((0, n_meta), np.float32)
    text = np.frombuffer(b"".join(texts.to_pylist()), np.float16).reshape(len(texts), -1).astype(np.float32)
    if not n_meta:
        return text, np.zeros((len(texts), 0), np.float32)
    return text, np.unpackbits(np.frombuffer(b"".join(metas.to_pylist()), np.uint8).reshape(len(texts), -1), axis=1, count=n_meta).astype(np.float32)


def exchanged(pool: DataFrame, views: Views, n_meta: int) -> np.ndarray:
    """The sum of `Views.pulls` over the pool (text, meta), of which each task sends its own sum."""
    held = pool.sparkSession.sparkContext.broadcast(views)
    size = 2 * sum(len(w) + 1 for w in views.models)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(0, batch.num_rows, FITTED):
                part = batch.slice(i, FITTED)
                total += held.value.pulls(*_matrices(part.column(0), part.column(1), n_meta))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["k", "x"])

    out = np.zeros(size)
    sums = pool.select("text", "meta").mapInArrow(summed, "k long, x double").groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,12)")).alias("x"))  # exact in any order
    for r in sums.collect():  # size rows at most, some 1,300
        out[r.k] = float(r.x)
    held.destroy()
    return out


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META,
           max_labels: int = MAX_LABELS) -> CoTrained | None:
    """The classifier from a bounded sample of labelled documents (ids with the smallest hashes) and all others."""
    meta_cols = tuple(c for c in meta_cols if c in docs.columns)
    n_meta = _SLOTS * len(meta_cols)
    marked = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    unit = F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = stored(marked.where(unit < 1.5 * (max_labels + 100) / max(1, marked.count())).orderBy(unit, "_id").limit(max_labels))
    if sample.select("_y").distinct().count() < 2:
        removed(sample)
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_features(batch.column(2))
            metas = zip(*(batch.column(3 + i).to_pylist() for i in range(len(meta_cols)))) if meta_cols else [()] * batch.num_rows
            meta = [np.packbits(meta_features(v) > 0).tobytes() for v in metas]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array([x.tobytes() for x in text.astype(np.float16)], pa.binary()), pa.array(meta, pa.binary())], ["id", "y", "text", "meta"])

    # the sample has at most max_labels narrow rows
    table = stored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(meta_cols)])
                   .join(F.broadcast(sample), "_id", "left").select("_id", "_y", "_text", *[f"_m{i}" for i in range(len(meta_cols))])
                   .mapInArrow(features, "id long, y long, text binary, meta binary"))
    own = table.where("y is not null").groupBy("id").agg(F.min(F.struct("text", "meta", "y")).alias("row")).select("id", "row.*").toArrow().combine_chunks()
    model = None
    if len(own):
        own = own.take(pc.sort_indices(own, [("id", "ascending")]))
        text, meta = _matrices(own["text"], own["meta"], n_meta)
        y = own["y"].to_numpy().astype(int)
        del own
        pool = table.where("y is null")
        model = co_train(text, meta, y, lambda views: exchanged(pool, views, n_meta))
    removed(table, sample)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META,
                  carry_text: bool = True, **bounds) -> DataFrame:
    """docs (without the text if carry_text is false) with p_text, p_meta, score (calibrated chance of good quality) and kept."""
    model = fitted(docs, labels, id_col, text_col, meta_cols, **bounds)
    metas = tuple(c for c in meta_cols if c in docs.columns)
    names = [c for c in docs.columns if c not in SCORES]
    out = [c for c in names if carry_text or c != text_col]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in out] + [T.StructField(c, T.DoubleType()) for c in SCORES[:3]] + [T.StructField("kept", T.BooleanType())])
    if model is None:
        return docs.select(*out, *[F.lit(None).cast("double").alias(c) for c in SCORES[:3]], F.lit(True).alias("kept"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_features(batch.column(names.index(text_col)))
            values = [batch.column(names.index(c)).to_pylist() for c in metas]
            meta = np.stack([meta_features(v) for v in zip(*values)]) if metas and batch.num_rows else np.zeros((batch.num_rows, _SLOTS * len(metas)), np.float32)
            a, b, both = held.value.scores(text, meta)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in out), *(pa.array(x, pa.float64()) for x in (a, b, both)), pa.array(both >= held.value.cutoff)], [*out, *SCORES])

    return docs.select(names).mapInArrow(scored, schema)
