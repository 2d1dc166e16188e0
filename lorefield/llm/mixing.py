"""Mixing sources to target weights by the cube method.

Every document has an expected number of copies, its source's target size over the source's size. The whole part is
taken outright; the fraction is an inclusion probability. The flight phase moves the probabilities of three documents
at a time along the null space of the two balancing constraints (documents and words), until one of them
reaches 0 or 1; sums stay as they were. Blocks of a source fly apart from each other and leave at most two undecided
documents each, beside a few that they keep, drawn by hash; those fly again in later rounds, until a source has one block. In that block LANDING documents don't fly; together with
the two at most that flight leaves they are the landing problem: of all their outcomes, that nearest to the words expected of them is taken (the nearest
in documents on ties). Documents of more than LONG times their source's mean fly and land before the others; what their outcome has more or less than the words expected of them
then moves the probabilities of all others of the source alike. So a source misses its target by less than a short document, whatever long ones it has, unless they leave too few others.

Defined results: a null or wordless text has size 0 and is taken 0 words' worth; a null source is a source of its own
and comes last; documents fly from long to short, in hash order among equals, so that reruns agree and repeated rows are exchangeable; a null id is a value like
any other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, stored, unused, word_count

#: Documents for each block of a flight round, and the most that a document may be taken.
BLOCK = 4096
MOST = 3
#: Documents of a source that are kept for the landing; all blocks of an earlier round keep about four times as many, one each at least.
LANDING = 13
#: Times the mean size of its source from which a document is long.
LONG = 4
_EDGE = 1e-9


def ranked_sources(sources: DataFrame) -> DataFrame:
    """rank of each source by code point, null last, without one task holding all: ranks inside sorted parts, plus
    the parts' offsets."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last())
                   .select("*", F.spark_partition_id().alias("part")))
    offsets = parts.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = offsets.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (parts.withColumn("_place", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "part")
            .withColumn("rank", F.col("offset") + F.col("_place")).drop("part", "offset", "_place"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, docs, source_size, target. Weights repeat over the sources in order; targets share all words by weight,
    stop at `most` times their source's size, and the excess is shared again by weight until none is above."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked_sources(sources).withColumn("weight", weight))
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = total or 0, Fraction(0)
    if total:
        level, full = Fraction(total, all_weight), -1
        while True:  # the level rises; each step fills at least one more source
            capped = F.col("weight") * F.lit(float(level)) > most * F.col("source_size")
            n, size, weight_left = ranked.agg(F.count_if(capped), F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
            if n == full or not weight_left:
                break
            level, full = Fraction(total - (size or 0), weight_left), n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (most * F.col("source_size")).cast("double")))


def _draw(*key) -> float:
    return xxhash.xxh3_64_intdigest(repr(key).encode()) / 2.0**64


def flight(rows: Iterator[tuple], done, seed: tuple) -> list[list]:
    """Flies through rows (probability, size, *rest) in order, calling done(row, 0 or 1) as they are decided; returns those left,
    at most two. Exact in expectation: each move keeps every probability's mean."""
    held: list[list] = []
    step = 0
    for row in rows:
        held.append(list(row))
        while len(held) == 3:
            (p0, s0), (p1, s1), (p2, s2) = ((r[0], r[1]) for r in held)
            u = (s2 - s1, s0 - s2, s1 - s0)  # null vector of (1, 1, 1) and (s0, s1, s2)
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p) / x if x > 0 else p / -x) for p, x in zip((p0, p1, p2), u) if x)
            down = min((p / x if x > 0 else (1 - p) / -x) for p, x in zip((p0, p1, p2), u) if x)
            step += 1
            move = up if _draw(seed, step) * (up + down) < down else -down
            left = []
            for r, x in zip(held, u):
                r[0] += move * x
                if r[0] < _EDGE or r[0] > 1 - _EDGE:
                    done(r, int(r[0] > 0.5))
                else:
                    left.append(r)
            held = left
    return held


def land(held: list[list], done, seed: tuple) -> None:
    """Decides a few rows at once: the outcome nearest to their expected words, then documents, then by hash. A row that is sure to go or to stay does so."""
    if not held:
        return
    p, sizes = np.array([r[0] for r in held]), np.array([r[1] for r in held], float)
    outcomes = np.array(list(itertools.product((0, 1), repeat=len(held))))
    off = np.abs(outcomes @ sizes - p @ sizes)
    near = np.flatnonzero(off <= off.min() + 1e-6)
    docs = np.abs(outcomes[near].sum(1) - p.sum())
    near = near[docs <= docs.min() + 1e-6]
    for row, copy in zip(held, outcomes[near[int(_draw(seed) * len(near))]]):
        done(row, int(copy))


def fly_blocks(batches: Iterator[pa.RecordBatch], turn: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source and block; a block is done when the next begins, so memory doesn't grow with it."""
    names = ["id", "source", "size", "whole", "p", "last"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    out: list[tuple] = []

    def done(r, copy: int) -> None:
        out.append((r[2], r[3], r[1], r[4] + copy, 0.0, True))

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def made() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for now, block in itertools.groupby(rows(), key=lambda r: r[:3]):
        final, kept, held = now[2] == 1, [], []  # kept: the rows with the smallest draws, for the landing or for the next round
        keep = LANDING if final else -(-4 * LANDING // now[2])

        def mine() -> Iterator[tuple]:
            for n, (_, _, _, id_, size, whole, p, place) in enumerate(block):
                row = (p, size, id_, now[0], whole)
                if len(kept) < keep:
                    heapq.heappush(kept, (-place, n, row))
                else:
                    yield heapq.heappushpop(kept, (-place, n, row))[2]

        pending = mine()
        while slice_ := list(itertools.islice(pending, 20_000)):  # in slices, so that decided rows can leave
            held = flight((*held, *slice_), done, (turn, *now[:2], len(slice_), slice_[0][2]))
            if len(out) >= 20_000:
                yield made()
        held = [*held, *(list(x[2]) for x in sorted(kept))]
        if final:
            land(held, done, ("land", turn, *now[:2]))
        else:
            out.extend((r[2], r[3], r[1], r[4], r[0], False) for r in held)
    if out:
        yield made()


def flown(flying: DataFrame, name: str) -> list[DataFrame]:
    """id, source, size, copies of rows (id, source, size, whole, p), decided in rounds of blocks."""
    decided: list[DataFrame] = []
    turn, same = 0, F.col("d.source").eqNullSafe(F.col("s.source"))
    while True:
        counts = stored(flying.groupBy("source").agg(F.count("*").alias("docs")))
        largest = counts.agg(F.max("docs")).first()[0] or 0
        blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("long")
        block = F.pmod(F.xxhash64(F.lit(turn), "id", "size"), F.col("blocks"))
        dealt = flying.alias("d").join(checked(counts).alias("s"), same).select("id", "d.source", "size", "whole", "p", blocks.alias("blocks"))
        dealt = dealt.withColumn("block", block).withColumn("place", F.xxhash64(F.lit(f"place{turn}"), "id", "size"))
        dealt = dealt.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "place", "id")
        out = stored(dealt.select("source", "block", "blocks", "id", "size", "whole", "p", "place").mapInArrow(
            partial(fly_blocks, turn=f"{name}{turn}"), "id long, source string, size long, whole long, p double, last boolean"))
        decided.append(out.where("last").select("id", "source", "size", F.col("whole").alias("copies")))
        if largest <= BLOCK:
            return decided
        turn += 1
        flying = out.where("not last").drop("last")  # blocks left two at most, and what they kept


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies (0 to most), taken (copies * size)."""
    sized = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    targets = stored(source_targets(sized, weights, most))
    few = checked(targets)
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    planned = sized.alias("d").join(few.alias("s"), same).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    # a rate within rounding of a whole number is that number
    whole = F.floor(F.col("rate") + _EDGE)
    planned = planned.select("id", "d.source", "size", (F.col("size") * F.col("docs") > LONG * F.col("source_size")).alias("long"), whole.cast("long").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"))
    sure = planned.where(F.col("p") <= _EDGE).select("id", "source", "size", F.col("whole").alias("copies"))
    flying = stored(planned.where(F.col("p") > _EDGE))
    long, others = flying.where("long").drop("long"), flying.where(~F.col("long")).drop("long")
    decided = [sure]
    if long.head(1):
        decided += flown(long, "long")
        taken = reduce(DataFrame.unionByName, decided[1:]).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        expected = long.groupBy("source").agg(F.sum((F.col("whole") + F.col("p")) * F.col("size")).alias("expected"))
        rest = others.groupBy("source").agg(F.sum("size").alias("rest"))
        over = taken.alias("d").join(expected.alias("s"), same).select("d.source", (F.col("expected") - F.col("taken")).alias("missing"))
        moved = stored(over.alias("d").join(rest.alias("s"), same).select("d.source", F.coalesce(F.try_divide("missing", "rest"), F.lit(0.0)).alias("more")))
        p = F.least(F.greatest(F.col("p") + F.coalesce("more", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        others = stored(others.alias("d").join(checked(moved).alias("s"), same, "left").select("id", "d.source", "size", "whole", p.alias("p")))
    decided += flown(others, "others")
    rows = reduce(DataFrame.unionByName, decided)
    return rows.alias("d").join(few.alias("s"), same).select(
        F.col("id").alias(id_col), "size", F.col("d.source").alias("source"), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as mix takes it, 0 included. Rows that agree in id, source and size share their
    copies as evenly as whole numbers allow."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    of_id, of_source, of_size, copies, rows, nth, place = (unused(docs, x) for x in ("id", "source", "size", "copies", "rows", "nth", "place"))
    mixed = mix(docs, **options)
    plan = stored(mixed.groupBy(F.col(id_col).alias(of_id), F.col("source").alias(of_source), F.col("size").alias(of_size)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)))
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & F.col(source_col).eqNullSafe(F.col(of_source)) & (word_count(F.col(text_col)) == F.col(of_size))
    joined = docs.join(checked(plan), same).where(F.col(copies) > 0)
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    one = joined.where(F.col(rows) == 1).withColumn(nth, times(F.col(copies))).select(docs.columns)
    if not plan.where(F.col(rows) > 1).head(1):
        return one
    window = Window.partitionBy(of_id, of_source, of_size).orderBy(F.xxhash64(text_col))
    several = joined.where(F.col(rows) > 1).withColumn(place, F.row_number().over(window) - 1)
    share = F.floor(F.col(copies) / F.col(rows)) + (F.col(place) < F.col(copies) % F.col(rows)).cast("long")
    return one.unionByName(several.where(share > 0).withColumn(nth, times(share)).select(docs.columns))
