"""Periodic runs of words by longest common extensions, which a difference cover answers.

A run of period q and at least 2 * q words holds two neighbouring points of the grid 0, q, 2 * q, ...; so for every period, each grid point i whose word
equals that at i + q asks how far the text agrees with itself q words on, forwards and backwards (a harmonic grid: n * ln(n) points for n words, nearly all of
which the first word settles). An extension compares words one by one up to the next pair of synchronised samples: positions whose remainders modulo PERIOD lie in a
difference cover, which for any two positions come at most PERIOD - 1 words later. Only the suffixes at samples are sorted (by doubling, over PERIOD words at
once), and only in texts where an extension gets that far; the longest common prefix of two of them is a range minimum from a sparse table.

Defined results: a null text or one without words has no runs, and its collapsed text is empty; a null id has no planted period; equal stretches count
once, with their smallest period; repeated rows give a row each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import slices

#: A perfect difference cover: each number modulo PERIOD is the difference of two members.
PERIOD = 13
COVER = np.array([0, 1, 3, 9])
#: Words of a run at least, and grid points that are looked at together.
LEAST = 12
POINTS = 1 << 20


def _synchronised() -> np.ndarray:
    """For two remainders, the fewest words after which both positions are samples."""
    step = np.arange(PERIOD)
    sampled = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[step[sampled[i + step] & sampled[j + step]][0] for j in range(PERIOD)] for i in range(PERIOD)])


_SYNC = _synchronised()
_PLACE = np.searchsorted(COVER, np.arange(PERIOD))


class Extensions:
    """Longest common extensions of the suffixes of words, given as small numbers."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.padded = np.r_[words, np.full(2 * PERIOD, -1, words.dtype)]
        self.ranks: np.ndarray | None = None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes and, over the sorted ones, minima of the common prefixes of neighbours (in groups of PERIOD words)."""
        cells = self.n // PERIOD + 1
        at = (np.arange(cells)[:, None] * PERIOD + COVER).ravel()
        padded = np.r_[self.padded, np.full(2 * PERIOD, -1, self.padded.dtype)]
        groups = np.lib.stride_tricks.sliding_window_view(padded, PERIOD)[at]
        rank = np.unique(groups, axis=0, return_inverse=True)[1].ravel().astype(np.int64)
        levels, step = [rank], len(COVER)  # the next sample of the same remainder is len(COVER) places on
        while step < len(at) and rank.max() < len(at) - 1:
            after = np.r_[rank[step:] + 1, np.zeros(step, np.int64)]
            rank = np.unique(rank * (len(at) + 2) + after, return_inverse=True)[1].ravel().astype(np.int64)
            levels.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.ranks = np.empty(len(at), np.int64)
        self.ranks[order] = np.arange(len(at))
        common = np.zeros(len(at), np.int64)  # of a suffix and the one sorted before it
        a, b = order[1:].copy(), order[:-1].copy()
        for k in reversed(range(len(levels))):
            inside = (a < len(at)) & (b < len(at))
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common[1:][same] += 1 << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(at):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in which the suffixes at i and j (i < j <= n) agree."""
        out = np.zeros(len(i), np.int64)
        sync = _SYNC[i % PERIOD, j % PERIOD]
        live = np.arange(len(i))
        for step in range(PERIOD):  # word by word to the next samples
            live = live[(sync[live] > step) & (self.padded[i[live] + step] == self.padded[j[live] + step])]
            if not len(live):
                break
            out[live] += 1
        far = np.flatnonzero((out == sync) & (j + sync < self.n))
        if len(far):
            out[far] += self._sampled(i[far] + sync[far], j[far] + sync[far])
        return out

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.ranks is None:
            first = self._rest(i, j, PERIOD)  # words that differ at once need no order of suffixes
            if (first < PERIOD).all():
                return first
            self._sort()
        a, b = (self.ranks[x // PERIOD * len(COVER) + _PLACE[x % PERIOD]] for x in (i, j))
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        groups = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at, table = np.flatnonzero(level == k), self.minima[k]
            groups[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        words = groups * PERIOD
        return words + self._rest(i + words, j + words, PERIOD)

    def _rest(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        out, live = np.zeros(len(i), np.int64), np.flatnonzero(j < self.n)
        for step in range(most):
            live = live[j[live] + step < self.n]
            live = live[self.padded[i[live] + step] == self.padded[j[live] + step]]
            if not len(live):
                break
            out[live] += 1
        return out


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, length, period of every run, by start, then period."""
    n = len(words)
    found = [np.empty((0, 3), np.int64)]
    forward, backward = Extensions(words), Extensions(words[::-1].copy())
    q = 1
    while q <= n // 2:  # periods together, as many as have POINTS grid points
        last = q + 1
        points = (n - 1) // q
        while last <= n // 2 and points + (n - 1) // last <= POINTS:
            points += (n - 1) // last
            last += 1
        periods = np.arange(q, last)
        counts = (n - 1) // periods
        period = np.repeat(periods, counts)
        i = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        same = words[i] == words[i + period]
        i, period = i[same], period[same]
        q = last
        if not len(i):
            continue
        after = forward(i, i + period)
        far = after > least - 2 * period  # the first grid point of a run has fewer than period words of it before
        i, period, after = i[far], period[far], after[far]
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        before[inner] = backward(n - i[inner] - period[inner], n - i[inner])
        length = before + period + after
        keep = length >= np.maximum(least, 2 * period)
        found.append(np.unique(np.c_[i - before, length, period][keep], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period: the first of a stretch has its smallest period
    first = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.empty(0, bool)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(words: list, id_: int | None) -> list:
    """words, for a tenth of the ids with one period from some word on."""
    if id_ is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(id_).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _summary(text: str | None, id_: int | None, least: int, change) -> tuple:
    words = change((text or "").encode().split(), id_)  # bytes split at exactly the six ASCII white-space characters
    numbers: dict[bytes, int] = {}
    runs = runs_of(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), least)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(dropped)[:-1] == 0
    collapsed = b" ".join(w for w, k in zip(words, keep.tolist()) if k) if len(runs) else b" ".join(words)
    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    milli = 1000 * best[1] // best[2] if len(runs) else None
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), collapsed.decode())


def _collapsed(batches: Iterator[pa.RecordBatch], least: int, plant: bool, digest: bool) -> Iterator[pa.RecordBatch]:
    change = planted if plant else lambda words, _: words
    types = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in batches:
        for i, j in slices(batch.column(1)):
            rows = [_summary(text, id_, least, change) for id_, text in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist())]
            if digest:
                rows = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))],
                                             ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256" if digest else "text"])


def collapse_runs(docs: DataFrame, least: int = LEAST, plant: bool = False, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, and the text in which of each run only the first period
    is left, words joined by a space (with digest its hash, collapsed_sha256). plant: a tenth of the ids get a period first."""
    schema = f"id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, {'collapsed_sha256' if digest else 'text'} string"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = stored(rows.mapInArrow(partial(_collapsed, least=least, plant=plant, digest=digest), schema))
    return out.withColumnRenamed("id", id_col)
