"""PartEnum signatures of hashed sets: two levels of partitions of the hash domain, with subsets of the second enumerated.

Sets fall into size bands; a pair that links lies in one band or in two neighbouring ones, and is looked for under the band of its larger
set. In a band, linking sets differ in at most k elements. The domain has `first` partitions of `second` parts each. At most k / (TOLERATED + 1) of the
first-level partitions hold more than TOLERATED differences; in each other one, at least second - TOLERATED parts agree. So a signature is the content of
second - TOLERATED parts of one first-level partition, and all those subsets are enumerated. Bands of short sets have three parts, so that a
signature covers more elements and a passage that two short texts share makes fewer false candidates; long ones have two, which gives fewer signatures.

Subsets without any element give no signature, or all small sets would share it. There are `spare` first-level partitions more than needed: while at
most so many of a set's are weak (have an empty subset), one of the agreeing ones isn't weak. A set with more weak ones adds the signatures of further
divisions of the domain, and those of its empty subsets in the last. So no linking pair is missed: in the first division where either set has few enough weak
partitions, both have all signatures, and a filled subset agrees.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

from .hashing import mixed

_U = np.uint64
_A, _C, _D = (_U(x) for x in (0x9E3779B97F4A7C15, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: Differences that a first-level partition tolerates; divisions of the domain; largest size of sets with three parts a partition.
TOLERATED = 1
DIVISIONS = 6
SHORT = 160


class Bands:
    """Size bands for links of at least percent / 100, and the partitions of each."""

    def __init__(self, percent: int) -> None:
        self.percent, self.starts, self.ends = percent, [1], []
        self.shapes: list[tuple[int, int, int]] = []

    def reach(self, n: int) -> None:
        """Makes all bands up to the one after n's."""
        while len(self.ends) < 2 or self.ends[-2] < n:
            self.ends.append(self.starts[-1] * 100 // self.percent)
            self.starts.append(self.ends[-1] + 1)
            self.shapes.append(self._shape(len(self.ends) - 1))

    def differ(self, band: int) -> int:
        return 2 * self.ends[band] * (100 - self.percent) // (100 + self.percent)

    def _shape(self, band: int) -> tuple[int, int, int]:
        """First-level partitions, parts of each, and spare partitions, about as many as the band's smallest sets have weak ones; no
        partitions where only equal sets link."""
        k = self.differ(band)
        if k == 0:
            return 0, 2, 0
        second, needed, spare = 3 if self.ends[band] <= SHORT else 2, k // (TOLERATED + 1) + 1, 0
        if k >= 8:
            for _ in range(3):
                q = math.exp(-self.percent * self.starts[band] / 100 / ((needed + spare) * second))
                weak = (needed + spare) * sum(math.comb(second, j) * q**j * (1 - q) ** (second - j) for j in range(second - TOLERATED, second + 1))
                spare = math.ceil(weak + 2 * math.sqrt(weak))
        return needed + spare, second, spare


def signatures(items: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sorted sets, the set (row of offsets) of each, and whether it stands for the set's own band or for the
    next, in which larger partners lie."""
    sizes = np.diff(offsets)
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    if len(items):
        bands.reach(int(sizes.max()))
        shape = np.array(bands.shapes)
        own = np.searchsorted(np.array(bands.ends), sizes)
        for further in (0, 1):
            band = own + further
            for second in (2, 3):
                rows = np.flatnonzero((sizes > 0) & (shape[band, 0] > 0) & (shape[band, 1] == second))
                for division in range(DIVISIONS):
                    if not len(rows):
                        break
                    rows = _division(items, offsets, rows, band[rows], shape[band[rows]], second, division, lambda s, r: out.append((s, r, further == 0)))
    if not out:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate([s for s, _, _ in out]), np.concatenate([r for _, r, _ in out]), np.concatenate([np.full(len(s), o) for s, _, o in out])


def _division(items: np.ndarray, offsets: np.ndarray, rows: np.ndarray, band: np.ndarray, shape: np.ndarray, second: int, division: int, put) -> np.ndarray:
    """Puts the signatures of some sets in one division of the domain; returns the rows that have too many weak partitions."""
    sizes, first, spare = offsets[rows + 1] - offsets[rows], shape[:, 0], shape[:, 2]
    set_ = np.repeat(np.arange(len(rows)), sizes)
    ends = np.r_[0, np.cumsum(sizes)]
    x = items[offsets[rows][set_] + np.arange(ends[-1]) - ends[set_]]
    if division:
        x = mixed(x + _U(division))
        for i, j in zip(ends[:-1], ends[1:]):
            x[i:j].sort()
    part = ((x >> _U(32)) * (first * second).astype(_U)[set_]) >> _U(32)
    levels = np.r_[0, np.cumsum(first)]
    cell = (levels[set_] * second + part.astype(np.int64))
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    key = (band.astype(_U) * _U(DIVISIONS) + _U(division + 1)) * _D
    content, filled = np.zeros(levels[-1] * second, _U), np.zeros(levels[-1] * second, bool)
    content[cell[at]] = mixed(np.add.reduceat(mixed(x ^ _A), at) + part[at] * _C + key[set_[at]])
    filled[cell[at]] = True
    subsets = np.array(list(combinations(range(second), second - TOLERATED)))
    owner = np.repeat(np.arange(len(rows)), first)
    place = (np.arange(levels[-1]) - levels[owner]).astype(_U)
    salt = (place[:, None] * _U(len(subsets)) + np.arange(1, len(subsets) + 1, dtype=_U)[None]) * _C + key[owner][:, None]
    found = mixed(content.reshape(-1, second)[:, subsets].sum(2, dtype=_U) + salt)
    some = filled.reshape(-1, second)[:, subsets].any(2)
    owners = np.repeat(rows[owner], len(subsets)).reshape(some.shape)
    put(found[some], owners[some])
    more = np.bincount(owner[(~some).any(1)], minlength=len(rows)) > spare
    if division == DIVISIONS - 1:
        last = ~some & more[owner][:, None]
        put(found[last], owners[last])
    return rows[more]
