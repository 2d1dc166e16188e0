"""MinHash near-duplicates by an LSH forest, with an exact check of whole texts.

Each text's set of word shingles gets ORDERS * DEPTH minimum hashes. Each slice of DEPTH of them is a key of one sorted order. Texts that agree in the first few values of an order lie
side by side in it: a region. The depth at which regions begin is the largest at which a linking pair shares one in some order but for MISSED; a region of
more than CROWDED texts is cut at greater depth. In a region neighbours by longest common prefix come first, then all that no neighbour has united;
two are alike if the share of equal values among all ORDERS * DEPTH could belong to a linking pair. A crowded region is first united around some leaders, to which its texts are
compared wherever they lie, and those that are near none go on to the next depth. Not all pairs of a crowded region meet in that way; so if its texts end in more than one
group, they also meet by the exact signatures of jaccard_join, which miss no pair.

Texts that are alike, directly or by way of others, form a candidate group. Each group's texts are sent once, to the group's pivot, and all pairs of the group are decided there exactly
(jaccard_join.decided). So results are exact but for pairs that no order brings together.

Defined results: a null text or one without words has an empty set and links with nothing; with fewer words than a shingle the whole sequence is the only shingle; a null id gets the smallest id
of its component, null if there is none; repeated rows share their component, and each is kept if its id is the component's; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, removed, stored, unused
from .components import components
from .hashing import mixed, shingle_sets, slices
from .jaccard_join import REMEMBERED, dealt, decided, grouped, nodes_of, sharing, signed_texts, texts_of, with_texts

#: Sorted orders, values of each, and how many values deeper a crowded region is cut.
ORDERS = 16
DEPTH = 8
DEEPER = 2
#: Chance that a pair at the limit of similarity shares no region; texts of a region that one task compares; leaders of a crowded one; standard deviations by which the
#: estimate of a linking pair may fall short.
MISSED = 2e-5
CROWDED = 2048
LEADERS = 8
DEVIATIONS = 5.5
_U = np.uint64
_VALUES = ORDERS * DEPTH
_ODD = mixed(np.arange(1, _VALUES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_MASK = mixed(np.arange(1, _VALUES + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
#: Shingles whose values are made at once.
AT_ONCE = 4096


def first_depth(percent: int) -> int:
    """Values that texts of a region have in common at least."""
    depth = DEPTH
    while depth > 1 and (1 - (percent / 100) ** depth) ** ORDERS > MISSED:
        depth -= 1
    return depth


def least_equal(percent: int) -> int:
    """Equal values of a linking pair at least."""
    share = percent / 100
    return math.floor(_VALUES * share - DEVIATIONS * math.sqrt(_VALUES * share * (1 - share)))


def minima(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minimum hashes of each set (a row of offsets), 32 bits each; those of an empty set are the largest number."""
    out = np.full((len(offsets) - 1, _VALUES), 0xFFFFFFFF, np.uint32)
    set_ = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a in range(0, len(items), AT_ONCE):
        x, rows = items[a : a + AT_ONCE], set_[a : a + AT_ONCE]
        values = (((x[:, None] ^ _MASK) * _ODD) >> _U(32)).astype(np.uint32)
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[at]] = np.minimum(out[rows[at]], np.minimum.reduceat(values, at, axis=0))
    return out


def _sketched(batches: Iterator[pa.RecordBatch], width: int, depth: int, seed: int) -> Iterator[pa.RecordBatch]:
    """id, print, n, node, proof of each text; and, unless the task has just seen its set, the region of each order and a byte of each value."""
    seen: set[int] = set()
    order = np.arange(1, ORDERS + 1, dtype=_U)
    for batch in batches:
        for i, j in slices(batch.column(1)):
            part = batch.slice(i, j - i)
            items, offsets = shingle_sets(part.column(1), width)
            nodes, proofs, fresh = np.empty(j - i, _U), np.empty(j - i, _U), np.zeros(j - i, bool)
            for k in range(j - i):
                h = xxhash.xxh3_128_intdigest(items[offsets[k] : offsets[k + 1]].tobytes(), seed)
                nodes[k], proofs[k] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
                if h not in seen and offsets[k + 1] > offsets[k]:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    fresh[k] = True
            values = minima(items, offsets)
            key = np.broadcast_to(order, (j - i, ORDERS)).copy()
            for k in range(depth):
                key = mixed((key ^ values.reshape(-1, ORDERS, DEPTH)[:, :, k]) * _ODD[k])
            regions, sketches = key.view(np.int64).tolist(), values.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(offsets)), pa.array(nodes.view(np.int64)), pa.array(proofs.view(np.int64)),
                 pa.array([r if f else None for r, f in zip(regions, fresh)], pa.list_(pa.int64())), pa.array([s.tobytes() if f else None for s, f in zip(sketches, fresh)], pa.binary())],
                ["id", "print", "n", "node", "proof", "regions", "sketch"])


def alike_groups(sketches: np.ndarray, least: int) -> np.ndarray:
    """A label for each of sketches, sorted by their order's values: the same for those that are alike, directly or by way of others."""
    label = np.r_[0, np.cumsum((sketches[1:] == sketches[:-1]).sum(1) < least)]  # neighbours first
    sizes = np.bincount(label)
    if len(sizes) == 1:
        return label
    for x in np.flatnonzero(label != sizes.argmax()):  # those outside the largest run, against all
        near = np.unique(label[(sketches == sketches[x]).sum(1) >= least])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
    return label


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From rows (region, order, node, sketch), sorted by region and the order's values: a, b of texts that are alike."""
    held: list[tuple] = []

    def links() -> list[tuple[int, int]]:
        rows = list(dict(held).items())
        if len(rows) < 2:
            return []
        label = alike_groups(np.frombuffer(b"".join(s for _, s in rows), np.uint8).reshape(-1, _VALUES), least)
        first: dict[int, int] = {}
        return [(first[g], node) for (node, _), g in zip(rows, label.tolist()) if first.setdefault(g, node) != node]

    now = None
    for batch in batches:
        out = []
        for region, node, sketch in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
            if region != now:
                out += links()
                now, held = region, []
            held.append((node, sketch))
        yield _pairs(out)
    yield _pairs(links())


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _near_leaders(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From rows (region, order, node, sketch, leaders, their sketches): a, b for each leader that is alike; region, order, node if none is."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for batch in batches:
        out = []
        for region, order, node, sketch, leaders in zip(*(batch.column(c).to_pylist() for c in range(5))):
            mine = np.frombuffer(sketch, np.uint8)
            near = [x["leader"] for x in leaders if (np.frombuffer(x["sketch"], np.uint8) == mine).sum() >= least]
            out += [(x, node, None, None, None) for x in near if x != node]
            if not near:
                out.append((None, None, region, order, node))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["a", "b", "region", "order", "node"])


def candidates(signed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """a, b: links that unite texts that are alike in some region, all of those in regions that aren't crowded; and region, node of the crowded regions of the first depth, in which
    some that are alike may not have met."""
    depth, least = first_depth(percent), least_equal(percent)
    sketches = stored(signed.where("regions is not null").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("regions").alias("regions")))
    placed = sketches.select("node", F.posexplode("regions").alias("order", "region"))
    links: list[DataFrame] = []
    first: DataFrame | None = None
    while True:
        counted = placed.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
        shared = stored(placed.join(counted, "region"))
        within = shared.where(F.lit(True) if depth >= DEPTH else F.col("n") <= CROWDED)
        # at the last depth a crowded region is dealt in parts; apart() finds what doesn't meet
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CROWDED))
        own = F.substring("sketch", F.col("order") * DEPTH + 1, F.lit(DEPTH))
        rows = within.withColumn("of", F.when(F.col("n") > CROWDED, F.xxhash64("region", part)).otherwise(F.col("region"))).join(sketches.select("node", "sketch"), "node")
        sorted_ = rows.select("of", "node", "sketch", own.alias("own")).repartition("of").sortWithinPartitions("of", "own", "node")
        links.append(stored(sorted_.select("of", "node", "sketch").mapInArrow(partial(_alike, least=least), "a long, b long").distinct()))
        crowded = shared.where(F.col("n") > CROWDED)
        some = bool(crowded.head(1))
        if some and first is None:
            first = stored(crowded.select("region", "node"))
        if depth >= DEPTH or not some:
            removed(shared)
            break
        # LEADERS texts of each crowded region, by partial aggregates
        chosen = crowded.groupBy("region", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("salt")).agg(F.min("node").alias("leader"))
        leaders = stored(chosen.join(sketches.select(F.col("node").alias("leader"), "sketch"), "leader").groupBy("region").agg(F.collect_list(F.struct("leader", "sketch")).alias("leaders")))
        beside = crowded.join(sketches.select("node", "sketch"), "node").join(checked(leaders, limit=CROWDED), "region")
        near = stored(beside.select("region", F.col("order").cast("long").alias("order"), "node", "sketch", "leaders").mapInArrow(
            partial(_near_leaders, least=least), "a long, b long, region long, order int, node long"))
        links.append(near.where("a is not null").select("a", "b"))
        step = min(DEEPER, DEPTH - depth)
        next_ = F.substring("sketch", F.col("order") * DEPTH + depth + 1, F.lit(step))
        placed = near.where("a is null").join(sketches.select("node", "sketch"), "node").select("node", "order", F.xxhash64("region", next_).alias("region"))
        removed(shared, leaders)
        depth += step
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out, first


def apart(crowded: DataFrame, united: DataFrame) -> DataFrame:
    """node: the texts of crowded regions (region, node) that united (node, root) doesn't bring into one group."""
    placed = stored(crowded.join(united, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root")))
    split = placed.groupBy("region").agg((F.min("root") < F.max("root")).alias("split")).where("split").select("region")
    out = stored(placed.join(split, "region").select("node").distinct())
    removed(crowded, placed)
    return out


def _placed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """id, print (hash of the text), n (shingles), component of each row of docs."""
    texts = texts_of(docs, id_col, text_col)
    signed = stored(texts.mapInArrow(partial(_sketched, width=width, depth=first_depth(percent), seed=seed),
                                     "id long, print long, n long, node long, proof long, regions array<long>, sketch binary"))
    rows = stored(signed.select("id", "print", "n", "node", "proof"))
    nodes = nodes_of(rows)
    if nodes is None:  # unequal sets with one hash: hash all anew
        return _placed(docs, width, percent, id_col, text_col, seed + 1)
    links, crowded = candidates(signed, percent)
    united = stored(components(links))
    removed(signed)
    members = stored(united.where("node <> root").select(F.col("root").alias("pivot"), "node"))
    rest = None if crowded is None else apart(crowded, united)
    if rest is not None and rest.head(1):  # texts of crowded regions that are in several groups meet by exact signatures
        chosen = stored(nodes.join(rest, "node").select("one.of_id", "one.of_print"))
        more = signed_texts(with_texts(texts, chosen).select("id", "text", "print"), width, percent, seed)
        met = sharing(more)
        groups = grouped(stored(members.unionByName(met).distinct()))
        removed(rest, chosen, more, met)
    else:
        groups = dealt(members)
    removed(united, members)
    return decided(texts, rows, nodes, groups, width, percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links of at least percent / 100 reach), kept."""
    kept = F.col("id").eqNullSafe(F.col("component"))
    return _placed(docs, width, percent, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns stay, and rows without an id."""
    of_id, of_print = unused(docs, "id"), unused(docs, "print")
    gone = stored(_placed(docs, width, percent, id_col, text_col).where("id <> component").select(F.col("id").alias(of_id), F.col("print").alias(of_print)).distinct())
    same = (F.col(id_col) == F.col(of_id)) & F.xxhash64(text_col).eqNullSafe(F.col(of_print))
    return docs.join(checked(gone), same, "left_anti")
