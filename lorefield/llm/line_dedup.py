"""Line deduplication by two Bloom filters.

Each task keeps two filters over the line hashes of its documents: one for hashes seen in a document, one for hashes
seen in a second. Filters merge segment by segment: twice = twice1 | twice2 | (once1 & once2), so no repeat is missed. Lines that the merged twice
filter doesn't hold are unique and never shuffle; the suspected rest is counted exactly by its text.

The filters have BITS_A_LINE bits for each line of the input, in as many segments as keep one small. Tasks send the positions of their set bits, so none
holds a whole filter. The merged twice filter holds repeats only; tasks fold it to BITS_A_REPEAT bits for each of its positions, at most to MAX_BROADCAST bytes in all, and
it is sent to the tasks. Where a corpus has more repeated lines than that, the filter is fuller and more lines go to the exact count; results stay the same.

Defined results: a null or empty text is one empty line; the key of a line is stripped of ASCII white space and
lower-cased in A-Z; a key counts once for each row that holds it, so repeated rows count as several documents;
an empty table gives an empty result; other columns pass through whatever their names and nulls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, stored, unused
from .hashing import bytes_of, lines_of, mixed, slices

#: Bits of the filters for each line, bits set for each hash, positions that a segment has about.
BITS_A_LINE = 16
PROBES = 2
SEGMENT = 1 << 19
#: The folded twice filter: bits for each position, and its largest size in bytes.
BITS_A_REPEAT = 16
MAX_BROADCAST = 64 << 20
#: Tasks that fold the merged segments, and bits of the slices that they send.
FOLDERS = 64
SLICE = 1 << 20
#: Confirmed lines up to this many bytes are broadcast; beyond it they are joined by text hash.
BROADCAST_BYTES = 32 << 20
_U = np.uint64


def line_key(line: str) -> str:
    """The key of one line."""
    return line.encode("utf-8", "surrogatepass").strip(b" \t\n\x0b\x0c\r").lower().decode("utf-8", "surrogatepass")


def _key(data: np.ndarray, begin: int, end: int) -> str:
    return data[begin:end].tobytes().lower().decode("utf-8", "replace")


def _power(n: float) -> int:
    """Exponent of the next power of two, 16 at least."""
    return max(16, int(np.ceil(np.log2(max(1.0, n)))))


def _probes(hashes: np.ndarray, power: int) -> np.ndarray:
    """Bit positions of each hash, one row for each probe."""
    return np.stack([mixed(hashes + _U(i)) >> _U(64 - power) for i in range(PROBES)])


def _distinct_lines(part: pa.Array, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, row, begin, end, hash of the distinct keys of each text."""
    data, starts = bytes_of(part)
    row, _, _, begin, end, h = lines_of(data, starts)
    use = np.flatnonzero(h > 0)
    if shortest > 1:
        size = np.array([len(_key(data, begin[i], end[i])) for i in use], int)
        use = use[size >= shortest]
    order = use[np.lexsort((h[use], row[use]))]
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = order[new]
    return data, row[at], begin[at], end[at], h[at]


def task_filters(batches: Iterator[pa.RecordBatch], power: int, segments: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """The two filters of a task, as positions (in a segment) of the bits that are set: one row for each segment."""
    held = []
    for batch in batches:
        for i, j in slices(batch.column(0)):
            held.append(_distinct_lines(batch.column(0).slice(i, j - i), shortest)[4])
        if sum(map(len, held)) > 4 * SEGMENT:  # a task with very many lines sends several filters
            yield from _sent(held, power, segments)
            held = []
    if held:
        yield from _sent(held, power, segments)


def _sent(held: list[np.ndarray], power: int, segments: int) -> Iterator[pa.RecordBatch]:
    each, n = np.unique(np.concatenate(held), return_counts=True)
    once = np.unique(_probes(each, power))
    twice = np.unique(_probes(each[n > 1], power))
    width = _U((1 << power) // segments)
    cut = np.arange(segments + 1, dtype=_U) * width
    a, b = np.searchsorted(once, cut), np.searchsorted(twice, cut)
    used = np.flatnonzero(a[1:] > a[:-1])
    pack = lambda x, at: [(x[at[s] : at[s + 1]] - cut[s]).astype(np.uint32).tobytes() for s in used]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(pack(once, a), pa.binary()), pa.array(pack(twice, b), pa.binary())], ["segment", "once", "twice"])


def merge_segment(rows: pd.DataFrame) -> pd.DataFrame:
    """A segment's merged twice filter: positions that a task has twice or two tasks have once."""
    found, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows["once"]]), return_counts=True)
    twice = np.unique(np.concatenate([found[n > 1], *(np.frombuffer(x, np.uint32) for x in rows["twice"])]))
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "twice": [twice.tobytes()], "n": [len(twice)]})


def folded_slices(parts: Iterator[pd.DataFrame], width: int, folded: int) -> Iterator[pd.DataFrame]:
    """A task's segments folded into one filter of 2 ** folded bits, sent as the slices that have a bit."""
    bits = np.zeros((1 << folded) // 8, np.uint8)
    for part in parts:
        for segment, twice in zip(part["segment"], part["twice"]):
            at = (np.frombuffer(twice, np.uint32).astype(_U) + _U(int(segment) * width)) & _U((1 << folded) - 1)
            np.bitwise_or.at(bits, at >> _U(3), np.left_shift(np.uint8(1), (at & _U(7)).astype(np.uint8)))
    for i in range(0, len(bits), SLICE // 8):
        if (piece := bits[i : i + SLICE // 8]).any():
            yield pd.DataFrame({"slice": [i // (SLICE // 8)], "bits": [piece.tobytes()]})


def merge_slice(rows: pd.DataFrame) -> pd.DataFrame:
    """A slice's bits over all tasks, FOLDERS rows at most."""
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [bits.tobytes()]})


def twice_filter(texts: DataFrame, shortest: int) -> tuple[np.ndarray, int, int]:
    """The folded twice filter of all rows, its power of two, and that of the filters it comes from."""
    lines = texts.agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0))).first()[0]
    power = _power(BITS_A_LINE * lines)
    segments = 1 << max(0, power - 32, int(np.ceil(np.log2(max(1, PROBES * lines / SEGMENT)))))
    merged = stored(texts.mapInArrow(lambda x: task_filters(x, power, segments, shortest), "segment long, once binary, twice binary")
                    .groupBy("segment").applyInPandas(merge_segment, "segment long, twice binary, n long"))
    repeats = merged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    folded = min(power, _power(BITS_A_REPEAT * repeats), int(np.log2(MAX_BROADCAST * 8)))
    bits = np.zeros((1 << folded) // 8, np.uint8)
    slices_of = merged.coalesce(FOLDERS).mapInPandas(lambda x: folded_slices(x, (1 << power) // segments, folded), "slice long, bits binary")
    for row in slices_of.groupBy("slice").applyInPandas(merge_slice, "slice long, bits binary").toLocalIterator():  # MAX_BROADCAST bytes at most
        piece = np.frombuffer(row["bits"], np.uint8)
        bits[row["slice"] * (SLICE // 8) :][: len(piece)] = piece
    removed(merged)
    return bits, folded, power


def holds(bits: np.ndarray, folded: int, power: int, hashes: np.ndarray) -> np.ndarray:
    at = _probes(hashes, power) & _U((1 << folded) - 1)
    return ((bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1).all(axis=0)


def suspected_lines(texts: DataFrame, shortest: int) -> DataFrame:
    """line, once for each row that holds it: the keys that the twice filter holds."""
    held = texts.sparkSession.sparkContext.broadcast(twice_filter(texts, shortest))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(0)):
                data, _, begin, end, h = _distinct_lines(batch.column(0).slice(i, j - i), shortest)
                at = np.flatnonzero(holds(*held.value, h)) if len(h) else []
                yield pa.RecordBatch.from_arrays([pa.array([_key(data, begin[k], end[k]) for k in at], pa.string())], ["line"])

    return texts.mapInArrow(suspects, "line string")


def common_lines(texts: DataFrame, min_docs: int, shortest: int) -> DataFrame:
    """Keys (line), found in at least min_docs rows, with that number (docs). Counts are exact."""
    return suspected_lines(texts, shortest).groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)


class _Cutter:
    """Cuts lines from texts: by the hashes of the keys to drop, and then by the keys themselves."""

    def __init__(self, firsts: dict[str, str | None]) -> None:
        self.firsts = firsts
        data, starts = bytes_of(pa.array(list(firsts), pa.string()))
        self.hashes = np.unique(lines_of(data, starts)[5]) if firsts else np.empty(0, _U)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts, their lines, and how many of those went."""
        data, starts = bytes_of(texts)
        row, begin, end, key_begin, key_end, h = lines_of(data, starts)
        n = np.bincount(row, minlength=len(texts))
        hit = np.flatnonzero(np.isin(h, self.hashes)) if len(self.hashes) else np.empty(0, int)
        drop, seen, shas = np.zeros(len(row), bool), set(), {}
        for i in hit:
            key = _key(data, key_begin[i], key_end[i])
            if key in self.firsts:
                drop[i] = True
                if self.firsts[key] is not None and (row[i], key) not in seen:  # the first occurrence in the first text stays
                    r = row[i]
                    shas[r] = shas.get(r) or hashlib.sha256(data[starts[r] : starts[r + 1]].tobytes()).hexdigest()
                    drop[i] = self.firsts[key] != shas[r]
                    seen.add((row[i], key))
        gone = np.bincount(row[drop], minlength=len(texts))
        kept = pc.fill_null(texts, "")
        if len(hit):
            first, out = np.r_[0, np.cumsum(n)], kept.to_pylist()
            for r in np.flatnonzero(gone):
                at = np.arange(first[r], first[r + 1])
                out[r] = b"\n".join(data[begin[i] : end[i]].tobytes() for i in at[~drop[at]]).decode("utf-8", "replace")
            kept = pa.array(out, texts.type)
        return kept, n, gone


def line_dedup(docs: DataFrame, min_docs: int = 10, shortest: int = 1, text_col: str = "text", id_col: str = "doc_id",
               keep: str = "none") -> DataFrame:
    """docs with text_col cut to the lines that stay, and n_lines, n_dropped (columns of those names are replaced).

    Lines whose key has at least `shortest` code points and occurs in at least min_docs rows go. keep="none" drops all
    of them; keep="first" leaves each key's first occurrence: the first such line in the row with the smallest id.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    common = stored(common_lines(texts, min_docs, shortest))
    if keep == "first":
        common = stored(_first_rows(docs, common, text_col, id_col))
    size = common.agg(F.coalesce(F.sum(F.octet_length("line") + 100), F.lit(0))).first()[0]
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")])
    firsts = lambda rows: {r["line"]: r["first_sha"] if keep == "first" else None for r in rows}
    at = names.index(text_col)

    def rebuilt(part: pa.RecordBatch, kept: pa.Array, n: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        columns = [kept if i == at else part.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    if size <= BROADCAST_BYTES:
        held = docs.sparkSession.sparkContext.broadcast(firsts(common.toLocalIterator()))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cutter = _Cutter(held.value)
            for batch in batches:
                for i, j in slices(batch.column(at)):
                    part = batch.slice(i, j - i)
                    yield rebuilt(part, *cutter.cut(part.column(at)))

        return docs.select(names).mapInArrow(cut, schema)
    sha, mine = (unused(docs, x) for x in ("sha", "mine"))
    of_text = F.sha2(F.col(text_col), 256)
    entry = F.struct("line", *(["first_sha"] if keep == "first" else []))
    own = (_lines_with(docs.where(F.col(text_col).isNotNull()).select(of_text.alias("sha"), F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), shortest)
           .select("sha", "line").distinct().join(common, "line").groupBy("sha").agg(F.collect_list(entry).alias(mine)))  # at most the lines of one text
    joined = docs.select(names).withColumn(sha, of_text).join(own.withColumnRenamed("sha", sha), sha, "left").select(*names, mine)

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                yield rebuilt(part, *_Cutter(firsts(part.column(len(names))[0].as_py() or [])).cut(part.column(at)))

    return joined.mapInArrow(cut_joined, schema)


def _lines_with(rows: DataFrame, shortest: int) -> DataFrame:
    """id, sha, line for each row (sha, id, text) and each distinct key of its text."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                data, row, begin, end, _ = _distinct_lines(part.column(2), shortest)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(0).take(at), pa.array([_key(data, a, b) for a, b in zip(begin, end)], pa.string())], ["id", "sha", "line"])

    return rows.mapInArrow(listed, "id long, sha string, line string")


def _first_rows(docs: DataFrame, common: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """common with first_sha: the hash of the text in the row with the smallest id that holds the key. Rows that
    repeat that text hold it as well."""
    held = docs.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("sha"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "sha")
    return (_lines_with(held, 1).join(common, "line")
            .groupBy("line").agg(F.min(rank).alias("first")).select("line", F.col("first.sha").alias("first_sha")))
