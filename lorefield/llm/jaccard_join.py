"""N-gram Jaccard join by PartEnum signatures (partenum.py), with an exact check of all that share one.

Texts with equal sets are one node. The nodes under a signature are a bucket; a bucket in which no node has its own band can hold no pair that
other buckets don't, and is left out. Each bucket has a pivot, the node that shares most signatures of all. Every linking pair lies in a bucket, so both are
members of its pivot's group. Groups that have most members in common become one, so that a text goes to few. A member's exact difference from its pivot is taken from both whole texts (which shuffle in fewer bytes than
their hashes). Whether two members link follows from their differences: directly from the sizes for the pivot itself, and for others through
the differences that they share. A group of up to PART members is done by one task as its texts arrive; a larger one is dealt in parts, each with the pivot's text, and
its members meet PART others in each of DEALS deals, which unite most of what links, and members that are still apart meet by the differences that a linking pair must share,
rare ones first. So a group of thousands of near copies takes work in proportion to its size, not to its pairs.

A signature that very many nodes share doesn't meet in one task: a batch of texts sends two of its nodes on, which show that the
signature is shared, and the others join those signatures afterwards, where adaptive execution splits hot keys.

Defined results: a null text or one without words has an empty set and links with nothing; with fewer words than a
shingle the whole sequence is the only shingle; a null id gets the smallest id of its component, null if there is none;
repeated rows share their component; an empty table gives an empty result; other columns are ignored.
Shingles are compared by 64-bit hashes, sets by 128 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, removed, stored, unused
from .components import components
from .hashing import shingle_sets, slices
from .partenum import Bands, signatures

#: Set hashes that a task remembers; nodes of a batch that a signature sends on.
REMEMBERED = 100_000
SENT = 2
#: Parts of the signatures (a power of 2) that are shuffled one after the other, so that their shuffle files, which are larger than the texts, aren't there together.
ROUNDS = 4
#: Members of a group that one task compares with each other, differing elements that it holds for that, and elements that it compares at once.
PART = 2048
HELD = 4_000_000
COMPARED = 2048
#: Deals of a large group in parts. A difference is common if one in so many members of a part has it.
DEALS = 2
COMMON = 64
_U = np.uint64


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(rows, kind="stable")
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch], width: int, percent: int, seed: int) -> Iterator[pa.RecordBatch]:
    """id, print, n, node, proof (more bits of the set's hash) of each text, and its signatures (with a last bit of 1 if they stand for its own band), apart from those
    that SENT texts before it in the batch have already. A set that the task has just seen has no signatures again."""
    bands, seen = Bands(percent), {}
    for batch in batches:
        for i, j in slices(batch.column(1)):
            part = batch.slice(i, j - i)
            items, offsets = shingle_sets(part.column(1), width)
            nodes, proofs, fresh = np.empty(j - i, _U), np.empty(j - i, _U), np.zeros(j - i, bool)
            for k in range(j - i):
                h = xxhash.xxh3_128_intdigest(items[offsets[k] : offsets[k + 1]].tobytes(), seed)
                nodes[k], proofs[k] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
                if h not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[h] = fresh[k] = True
            found, rows, own = signatures(items, offsets, bands)
            use = fresh[rows]
            found, rows, own = found[use], rows[use], own[use]
            found &= ~_U(1)
            order = np.argsort(found, kind="stable")  # those for a set's own band come first
            same = np.zeros(len(found), bool)
            same[SENT:] = found[order][SENT:] == found[order][:-SENT]
            more = np.zeros(len(found), bool)
            more[order] = same
            found |= own.astype(_U)
            lists = [_lists(found[m], rows[m], j - i) for m in (~more, more)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(offsets)), pa.array(nodes.view(np.int64)), pa.array(proofs.view(np.int64)), *lists],
                                             ["id", "print", "n", "node", "proof", "sigs", "more"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, node), sorted, those of an own band first: sig (without the last bit), node of the signatures with one of an own band and at least two nodes."""
    sig = first = last = None
    owned = told = False
    for batch in batches:
        s, n = (np.asarray(batch.column(i)) for i in (0, 1))
        s, w = s & ~1, (s & 1) > 0
        if not len(s):
            continue
        starts = np.r_[True, s[1:] != s[:-1]]
        new = starts | np.r_[True, n[1:] != n[:-1]]
        goes_on = sig is not None and s[0] == sig
        if goes_on:
            new[0] = n[0] != last
        at = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        has, count, begin = w[at].copy(), np.add.reduceat(new.astype(np.int64), at), n[at].copy()
        if goes_on:
            has[0], begin[0] = owned, first
            count[0] += 1
        keep = new & (has & (count > 1))[run]
        s_out, n_out = s[keep], n[keep]
        if goes_on and has[0] and count[0] > 1 and not told:
            s_out, n_out = np.r_[sig, s_out], np.r_[first, n_out]
        if len(s_out):
            yield pa.RecordBatch.from_arrays([pa.array(s_out, pa.int64()), pa.array(n_out, pa.int64())], ["sig", "node"])
        told = bool(count[-1] > 1) or (told and goes_on and len(at) == 1)
        sig, first, last, owned = s[-1], begin[-1], n[-1], bool(has[-1])


class _Group:
    """A part of a pivot's group as it arrives."""

    def __init__(self, key: tuple, items: np.ndarray, percent: int) -> None:
        self.key, self.items, self.k, self.q = key, items, 100 + percent, 100 - percent
        self.nodes: list[int] = []
        self.sizes: list[int] = []
        self.ds: list[np.ndarray] = []
        self.held, self.large, self.sent = 0, False, 0

    def add(self, node: int, items: np.ndarray) -> bool:
        """Takes a member; whether it links with the pivot. d: first what the pivot lacks, then what it has, each by hash."""
        self.nodes.append(node)
        self.sizes.append(len(items))
        self.ds.append(np.r_[np.setdiff1d(items, self.items, True), np.setdiff1d(self.items, items, True)])
        return self.k * len(self.ds[-1]) <= self.q * (len(items) + len(self.items))

    def linked(self, direct: list[bool]) -> np.ndarray:
        """Whether two members link of which one isn't linked with the pivot: b and c differ in |d_b| + |d_c| - 2 |d_b & d_c| elements."""
        counts = np.array([len(d) for d in self.ds])
        g = self.k * counts - self.q * np.array(self.sizes)
        elements, element = np.unique(np.concatenate(self.ds), return_inverse=True)
        times = np.bincount(element, minlength=len(elements))
        place = np.cumsum(times > 1) - 1  # of the elements that several members have
        owner = np.repeat(np.arange(len(counts)), counts)[times[element] > 1]
        column = place[element[times[element] > 1]]
        shared = np.zeros((len(counts), len(counts)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COMPARED):
            i, j = np.searchsorted(column, (first, first + COMPARED))
            has = np.zeros((len(counts), COMPARED), np.float32)
            has[owner[i:j], column[i:j] - first] = 1
            shared += has @ has.T
        linked = g[:, None] + g[None] <= 2 * self.k * shared
        linked[np.ix_(direct, direct)] = False  # those are linked by way of the pivot
        np.fill_diagonal(linked, False)
        return linked

    def links(self, direct: list[bool]) -> list[tuple[int, int]]:
        """As many of these links as unite what all of them do."""
        if len(self.nodes) < 2 or all(direct):
            return []
        linked, out = self.linked(direct), []
        seen = np.array(direct)
        found = np.flatnonzero(seen)
        while True:
            while len(found):  # members that link with those just found
                new = np.flatnonzero(linked[found].any(0) & ~seen)
                by = found[linked[found][:, new].argmax(0)]
                out += [(self.nodes[b], self.nodes[c]) for b, c in zip(by, new)]
                seen[new] = True
                found = new
            if seen.all():
                return out
            found = np.flatnonzero(~seen)[:1]
            seen[found] = True

    def rows(self, direct: list[bool]) -> list[tuple]:
        return [(self.key[0], node, size, d) for node, size, d in zip(self.nodes, self.sizes, direct)]


def _compared(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From rows (pivot, part, member, large, node, text), sorted, each part's pivot first: links a, b; and for members of groups in several parts also pivot, node,
    size, direct (linked with the pivot), d. So does a group whose differences are more than a task should hold."""
    group: _Group | None = None
    direct: list[bool] = []
    for batch in batches:
        links, rows, ds = [], [], []
        for i, j in slices(batch.column(5)):
            part = batch.slice(i, j - i)
            items, offsets = shingle_sets(part.column(5), width)
            for k, (pivot, place, member, large, node) in enumerate(zip(*(part.column(c).to_pylist() for c in range(5)))):
                mine = items[offsets[k] : offsets[k + 1]]
                if not member:
                    if group is None or group.key != (pivot, place):  # else a repeated row
                        links += group.links(direct) if group and not group.large else []
                        group, direct = _Group((pivot, place), mine, percent), []
                elif not group.nodes or group.nodes[-1] != node:
                    direct.append(group.add(node, mine))
                    if direct[-1]:
                        links.append((pivot, node))
                    group.held += len(group.ds[-1])
                    group.large |= large or group.held > HELD
                    if group.large:  # its members go on; only the last stays, against repeated rows
                        rows += group.rows(direct)[group.sent :]
                        ds += group.ds[group.sent :]
                        for held in (group.nodes, group.sizes, group.ds, direct):
                            del held[:-1]
                        group.sent = 1
        yield _found(links, rows, ds)
    if group and not group.large:
        yield _found(group.links(direct), [], [])


def _found(links: list[tuple], rows: list[tuple], ds: list[np.ndarray]) -> pa.RecordBatch:
    none = [None] * len(links)
    columns = [pa.array([x[i] for x in links] + [None] * len(rows), pa.int64()) for i in (0, 1)]
    columns += [pa.array(none + [r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
    lists = pa.array(none + [d.view(np.int64) for d in ds], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*columns, lists], ["a", "b", "pivot", "node", "size", "direct", "d"])


def _met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows (pivot, deal, part, node, size, direct, d), sorted: links a, b that unite what all links among the members of a part do, and of the first deal also pivot, e, times: common
    differences of a part. Of a part that is more than a task should hold, members meet as far as they are held together."""
    group: _Group | None = None
    direct: list[bool] = []

    def done() -> pa.RecordBatch:
        links, common, times = group.links(direct), np.empty(0, np.int64), np.empty(0, np.int64)
        if not group.key[1]:
            common, times = np.unique(np.concatenate(group.ds), return_counts=True)
            common, times = (x[times >= max(2, len(group.nodes) / COMMON)] for x in (common, times))
        none, nones = [None] * len(links), [None] * len(common)
        columns = [[x[0] for x in links] + nones, [x[1] for x in links] + nones, none + [group.key[0]] * len(common), none + common.tolist(), none + times.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "pivot", "e", "times"])

    for batch in batches:
        lists = batch.column(6)
        values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
        for n, (pivot, deal, part, node, size, near) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
            if group is None or group.key != (pivot, deal, part) or len(group.nodes) >= PART or group.held > HELD:
                if group:
                    yield done()
                group, direct = _Group((pivot, deal, part), np.empty(0, _U), percent), []
            group.nodes.append(node)
            group.sizes.append(size)
            group.ds.append(values[offsets[n] : offsets[n + 1]].copy())
            group.held += len(group.ds[-1])
            direct.append(near)
    if group:
        yield done()


def _linked_members(members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """A stored table of links a, b that unite what links do and those among the members (pivot, node, size, d, direct) of the same large group of which at least one isn't linked with the pivot itself.

    Members b and c differ in |d_b| + |d_c| - 2 |d_b & d_c| elements, so with g = (100 + percent) |d| - (100 - percent) size they link
    if and only if g_b + g_c <= 2 (100 + percent) |d_b & d_c|. If neither is linked with the pivot, or one of them, they share differences: those pairs are met by
    their prefixes, with the overlap that a pair needs at least, where common elements come last and of the others those that the pivot lacks first; a pair is met only
    where enough elements follow in both, and only if nothing has united its members before. So pairs don't grow with the copies that deals unite.
    """
    k, q = 100 + percent, 100 - percent
    members = members.withColumn("n_d", F.size("d")).withColumn("g", k * F.col("n_d") - q * F.col("size"))
    bounds = stored(members.groupBy("pivot").agg(F.min("g").alias("least"), F.min(F.when(~F.col("direct"), F.col("g"))).alias("least_out"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("least_out is not null"))
    whole = members.join(checked(bounds), "pivot")
    deals = whole.withColumn("deal", F.explode(F.array(*[F.lit(i) for i in range(DEALS)]))).withColumn("part", F.pmod(F.xxhash64("node", "deal"), F.col("parts")).cast("int"))
    dealt_out = deals.select("pivot", "deal", "part", "node", "size", "direct", "d").repartition("pivot", "deal", "part").sortWithinPartitions("pivot", "deal", "part", "node")
    met = stored(dealt_out.mapInArrow(lambda x: _met(x, percent), "a long, b long, pivot long, e long, times long"))
    near = stored(components(links.unionByName(met.where("a is not null").select("a", "b"))))
    often = met.where("a is null").groupBy("pivot", "e").agg(F.sum("times").alias("n"))
    common = stored(often.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("all")).select("pivot", F.col("all.e").alias("common")))  # COMMON times a member's differences at most, about
    n_common = common.agg(F.sum(F.size("common"))).first()[0] or 0
    seldom_first = F.when(F.col("common").isNull(), F.col("d")).otherwise(F.concat(F.array_except("d", "common"), F.array_intersect("common", "d")))
    open_ = stored(whole.join(checked(common, n_common), "pivot", "left").join(checked(near), "node", "left").select(
        "pivot", "node", "direct", "g", "size", "n_d", "least", "least_out", F.coalesce("root", "node").alias("root"), seldom_first.alias("d")))
    partner = F.when(F.col("direct"), F.col("least_out")).otherwise(F.col("least"))
    need = F.greatest(F.ceil((F.col("g") + partner) / (2 * k)), F.ceil((F.col("g") - q * F.col("size") * 100 / percent) / k), F.lit(1)).cast("int")
    prefix = F.slice("d", F.lit(1), F.greatest(F.col("n_d") - need + 1, F.lit(0)))
    prefixed = open_.select("pivot", "node", "root", "direct", "g", "n_d", F.posexplode(prefix).alias("pos", "e"))
    side = lambda n: prefixed.select("pivot", "e", *[F.col(c).alias(n if c == "node" else f"{n}_{c}") for c in ("node", "root", "direct", "g", "n_d", "pos")])
    fits = F.expr(f"a_g + b_g <= {2 * k} * least(a_n_d - a_pos, b_n_d - b_pos)")
    found = side("a").where("not a_direct").join(side("b"), ["pivot", "e"]).where((F.col("a_root") != F.col("b_root")) & (F.col("b_direct") | (F.col("a") < F.col("b"))) & fits)
    pairs = stored(found.select("pivot", "a", "b").distinct())
    of = lambda n: open_.select("pivot", F.col("node").alias(n), F.col("g").alias(f"g_{n}"), F.col("d").alias(f"d_{n}"))
    linked = F.col("g_a") + F.col("g_b") <= 2 * k * F.size(F.array_intersect("d_a", "d_b"))
    more = pairs.join(of("a"), ["pivot", "a"]).join(of("b"), ["pivot", "b"]).where(linked).select("a", "b")
    out = stored(near.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    removed(bounds, met, near, common, open_, pairs)
    return out


def _united(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members (pivot, node) under fewer pivots: a pivot at least half of whose members also belong to the same larger group joins that one with all its members, and
    so on up. Every two nodes that had a pivot in common still have one, and a text that shares many signatures with its copies goes to one group instead of one for each pivot."""
    sized = members.join(sizes, "pivot")
    tops = sized.groupBy("node").agg(F.max(F.struct("n", "pivot")).alias("top")).select("node", F.col("top.pivot").alias("top"))
    shared = members.join(tops, "node").where("pivot <> top").groupBy("pivot", "top").agg(F.count("*").alias("both"))
    joins = shared.groupBy("pivot").agg(F.max(F.struct("both", "top")).alias("most")).join(sizes, "pivot").where("2 * most.both >= n")
    roots = stored(components(joins.select(F.col("pivot").alias("a"), F.col("most.top").alias("b"))).select(F.col("node").alias("pivot"), "root"))
    moved = members.join(roots, "pivot", "left").select(F.coalesce("root", "pivot").alias("pivot"), "node")
    united = stored(moved.unionByName(roots.select(F.col("root").alias("pivot"), F.col("pivot").alias("node"))).where("pivot <> node").distinct())
    removed(roots)
    return united


def dealt(members: DataFrame) -> DataFrame:
    """node, at: the groups that a node's text goes to, from members (pivot, node): pivot, part, member (or the pivot itself), large (in several parts)."""
    sizes = stored(members.groupBy("pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    placed = members.join(sizes, "pivot").select("node", F.struct("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), (F.col("parts") > 1).alias("large")).alias("at"))
    leads = sizes.select("pivot", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        F.col("pivot").alias("node"), F.struct("pivot", "part", F.lit(False).alias("member"), (F.col("parts") > 1).alias("large")).alias("at"))
    out = stored(placed.unionByName(leads).groupBy("node").agg(F.collect_list("at").alias("at")))  # at most a node's signatures, and the parts of its own group
    removed(sizes)
    return out


def sharing(signed: DataFrame) -> DataFrame:
    """pivot, node: for each node that shares a signature, the pivots in whose groups it meets all that it may link with."""
    parts = []
    for part in range(ROUNDS):
        mine = signed.select(F.explode("sigs").alias("sig"), "node").where(F.shiftright("sig", 1).bitwiseAND(ROUNDS - 1) == part)
        dealt_out = mine.repartition(F.shiftright("sig", 1)).sortWithinPartitions(F.desc("sig"), "node")
        parts.append(stored(dealt_out.mapInArrow(_shared, "sig long, node long")))
    shared = reduce(DataFrame.unionByName, parts)
    if signed.where(F.size("more") > 0).head(1):
        found = stored(shared.select("sig").distinct())
        parts.append(stored(signed.select(F.explode("more").alias("sig"), "node").withColumn("sig", F.col("sig").bitwiseAND(~1)).join(found, "sig", "left_semi")))
        removed(found)
        shared = shared.unionByName(parts[-1])
    counts = stored(shared.groupBy("node").agg(F.count("*").alias("n")))
    pivots = stored(shared.join(counts, "node").groupBy("sig").agg(F.max(F.struct("n", "node")).alias("most")).select("sig", F.col("most.node").alias("pivot")))
    members = stored(shared.join(pivots, "sig").where("node <> pivot").select("pivot", "node").distinct())
    removed(*parts, counts, pivots)
    return members


def grouped(members: DataFrame) -> DataFrame:
    """node, at: the groups that a node's text goes to, from stored members (pivot, node), which are removed."""
    sizes = stored(members.groupBy("pivot").agg(F.count("*").alias("n")))
    united = _united(members, sizes)
    out = dealt(united)
    removed(members, sizes, united)
    return out


def nodes_of(rows: DataFrame) -> DataFrame | None:
    """From rows (id, print, n, node, proof): node, its smallest id, copies, and one row of docs that has its text. None if unequal sets have one hash."""
    # by partial aggregates before the shuffle, as very many rows may be one node
    one = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("of_id"), F.col("print").alias("of_print"))).alias("one")
    nodes = stored(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("proof").alias("proof"), F.max("proof").alias("proof2"), one))
    return None if nodes.where("proof <> proof2").head(1) else nodes


def with_texts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Stored rows (of_id, of_print and more) with the row of texts that each names."""
    return texts.join(checked(chosen), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print")))


def decided(texts: DataFrame, rows: DataFrame, nodes: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """id, print, n, component of each of rows: all pairs within each of the groups (node, at) are decided on the whole texts, which are read again."""
    chosen = stored(nodes.select("node", "one.of_id", "one.of_print").join(groups, "node"))
    sent = with_texts(texts, chosen).select("node", "text", F.explode("at").alias("at")).select("at.pivot", "at.part", "at.member", "at.large", "node", "text")
    dealt_out = sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member", "node")
    found = stored(dealt_out.mapInArrow(lambda x: _compared(x, width, percent), "a long, b long, pivot long, node long, size long, direct boolean, d array<long>"))
    removed(groups, chosen)
    links, large = found.where("a is not null").select("a", "b"), found.where("a is null").drop("a", "b")
    united = [_linked_members(large, links, percent)] if large.head(1) else []
    roots = stored(components(*united or [links]))
    tops = stored(roots.join(nodes, "node").groupBy("root").agg(F.min("least").alias("least")))
    linked = roots.join(checked(tops), "root").select("node", "least")
    copies = nodes.where("copies > 1").join(roots.select("node"), "node", "left_anti").select("node", "least")
    classes = stored(linked.unionByName(copies))
    removed(found, roots, tops, nodes, *united)
    placed = rows.join(checked(classes), "node", "left")
    alone = F.col("least").isNull() | (F.col("n") == 0)
    return placed.select("id", "print", "n", F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component"))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))


def signed_texts(texts: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """A stored table of texts with their signatures."""
    return stored(texts.mapInArrow(lambda x: _signed(x, width, percent, seed), "id long, print long, n long, node long, proof long, sigs array<long>, more array<long>"))


def _placed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """id, print (hash of the text), n (shingles), component of each row of docs."""
    texts = texts_of(docs, id_col, text_col)
    signed = signed_texts(texts, width, percent, seed)
    groups = grouped(sharing(signed))
    rows = stored(signed.select("id", "print", "n", "node", "proof"))
    removed(signed)
    nodes = nodes_of(rows)
    if nodes is None:  # hash all anew
        return _placed(docs, width, percent, id_col, text_col, seed + 1)
    return decided(texts, rows, nodes, groups, width, percent)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id: the smallest id that links of at least percent / 100 reach."""
    return _placed(docs, width, percent, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns stay. Rows without an id stay, and of rows that repeat an id those
    that have the smallest of their component."""
    of_id, of_print = unused(docs, "id"), unused(docs, "print")
    gone = stored(_placed(docs, width, percent, id_col, text_col).where("id <> component").select(F.col("id").alias(of_id), F.col("print").alias(of_print)).distinct())
    same = (F.col(id_col) == F.col(of_id)) & F.xxhash64(text_col).eqNullSafe(F.col(of_print))
    return docs.join(checked(gone), same, "left_anti")
