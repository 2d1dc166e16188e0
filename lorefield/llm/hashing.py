"""Hashes of words and word shingles of whole texts, for all texts of an Arrow array at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_A, _B, _C = (_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of text that are hashed at once; a longer word or text is hashed as a whole.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins; null is empty. The last offset is the end."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n, at = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes each, one row at least."""
    ends = bytes_of(texts)[1]
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the text (a row of starts, which has the end as its last) that it lies in. Words are runs of other
    bytes than ASCII white space; A-Z count as lower case."""
    hashes, rows = [np.empty(0, _U)], [np.empty(0, np.int64)]
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + PIECE)
        if b < n and not _SPACE[data[b]]:  # up to the next white space, or the next text
            rest = _SPACE[data[b : b + PIECE]]
            while not rest.any() and b + len(rest) < n:
                rest = _SPACE[data[b : b + 2 * len(rest)]]
            b = b + int(rest.argmax()) if rest.any() else n
        part, filled = _LOWER[data[a:b]], ~_SPACE[data[a:b]]
        first = filled.copy()
        first[1:] &= ~filled[:-1]
        begin = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        first[begin] = filled[begin]
        at = np.flatnonzero(filled)
        if len(at):
            own = first[at]
            word = np.cumsum(own) - 1
            begins = np.flatnonzero(own)
            place = (at - at[begins][word]).astype(_U)
            h = np.add.reduceat(mixed((part[at] | place << _U(8)) * _A + _C), begins)
            hashes.append(mixed(h + np.diff(np.r_[begins, len(at)]).astype(_U) * _B))
            rows.append(np.searchsorted(starts, at[begins] + a, "right") - 1)
        a = b
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, one text after another, and where each text's begin.
    A text with fewer words than width has one shingle: the whole sequence."""
    data, starts = bytes_of(texts)
    n = len(starts) - 1
    hashes, rows = word_hashes(data, starts)
    words = np.bincount(rows, minlength=n)
    begins = np.r_[0, np.cumsum(words)]
    sizes = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    ends = np.r_[0, np.cumsum(sizes)]
    x = np.full(ends[-1], width, _U)
    row = np.repeat(np.arange(n), sizes)
    at = begins[row] + np.arange(ends[-1]) - ends[row]
    short = words[row] < width
    x[short] = words[row][short].astype(_U)
    for i in range(width):
        has = i < words[row]
        y = (x + hashes[np.minimum(at + i, max(0, len(hashes) - 1))]) * _A if len(hashes) else x
        y ^= y >> _U(29)
        x = np.where(has, y, x)
    x = mixed(x)
    for i in np.flatnonzero(sizes > 1):
        x[ends[i] : ends[i + 1]].sort()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=n))].astype(np.int64)


def lines_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The \\n-split lines of texts: row, begin, end, begin and end of the key (white space at both ends set aside), and hash of the key (A-Z as lower case);
    a key without bytes has hash 0. An empty text is one empty line."""
    n, cuts = len(starts) - 1, np.flatnonzero(data == 10)
    counts = np.bincount(np.searchsorted(starts[:-1], cuts, "right") - 1, minlength=n)[:n] + 1 if n else np.empty(0, np.int64)
    firsts = np.r_[0, np.cumsum(counts)].astype(np.int64)
    row = np.repeat(np.arange(n), counts)
    inner = np.ones(len(row), bool)
    inner[firsts[:-1]] = False
    begin, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    begin[firsts[:-1]], begin[inner] = starts[:-1], cuts + 1
    last = np.ones(len(row), bool)
    last[firsts[1:] - 1] = False
    end[firsts[1:] - 1], end[last] = starts[1:], cuts
    filled = np.flatnonzero(~_SPACE[data])
    i, j = np.searchsorted(filled, begin), np.searchsorted(filled, end)
    some = i < j
    key_begin, key_end = begin.copy(), begin.copy()
    key_begin[some], key_end[some] = filled[i[some]], filled[j[some] - 1] + 1
    hashes = np.zeros(len(row), _U)
    at = np.flatnonzero(some)
    ends = np.cumsum(key_end[at] - key_begin[at])
    a = 0
    while a < len(at):  # about PIECE bytes at once, one line at least
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        sizes = key_end[at[a:b]] - key_begin[at[a:b]]
        begins = np.r_[0, np.cumsum(sizes)]
        place = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
        bytes_ = _LOWER[data[np.repeat(key_begin[at[a:b]], sizes) + place]]
        h = np.add.reduceat(mixed((bytes_ | place.astype(_U) << _U(8)) * _A + _C), begins[:-1])
        hashes[at[a:b]] = mixed(h + sizes.astype(_U) * _B) | _U(1)
        a = b
    return row, begin, end, key_begin, key_end, hashes
