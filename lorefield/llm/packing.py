"""Variable-capacity best-fit packing into bins of several permitted lengths.

Texts become pieces of at most the largest length (tokens are words here, or counts from a column). Blocks of pieces,
dealt by hash, pack apart from each other, longest piece first. A piece goes into the open bin that it fills best: the one with the least room that
still holds it. Where none does, a bin is opened: each permitted length that holds the piece is filled on trial with the pieces that are left, and the length whose filled
tokens cost least is opened, with this piece alone; the bins stay open for all later pieces. At the end each bin shrinks to the smallest length that holds its contents.

Defined results: a null or wordless text gives one row with 0 tokens and no bin; a null id is packed like any other;
repeated rows are packed each, and a block that they overfill is divided by row; ties go by id and piece, null last; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, stored, word_count

#: Permitted lengths, and the fixed cost of a bin in tokens. Pieces for each block.
LENGTHS = (256, 512, 1024, 2048)
BIN_COST = 16
BLOCK = 20_000


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST) -> list[tuple[int, int, int]]:
    """(bin, capacity, start) for each of sizes, none of which is above the largest length."""
    left: dict[int, list[int]] = {}
    for i in reversed(range(len(sizes))):
        left.setdefault(sizes[i], []).append(i)
    kinds = sorted(left)
    lengths = tuple(sorted(lengths))
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(sizes)
    used: list[int] = []  # of each bin
    rooms: list[int] = []  # the different rooms of open bins, sorted
    open_: dict[int, list[int]] = {}  # bins by their room

    def trial(length: int, first: int) -> float:
        """Cost of a filled token if a bin of this length takes the first piece and then always the largest that fits."""
        room, k = length - first, len(kinds)
        while room:
            k = bisect.bisect_right(kinds, room, 0, k) - 1
            if k < 0:
                break
            room -= kinds[k] * min(room // kinds[k], len(left[kinds[k]]) - (kinds[k] == first))
        return (length + bin_cost) / (length - room)

    def leave(bin_: int, room: int) -> None:
        if room:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append(bin_)

    while kinds:
        size = kinds[-1]
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_ = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: (trial(c, size), -c))
            bin_ = len(used)
            used.append(0)
        i = left[size].pop()
        if not left[size]:
            del left[size]
            kinds.pop()
        out[i] = (bin_, 0, used[bin_])
        used[bin_] += size
        leave(bin_, room - size)
    capacity = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return [(b, capacity[b], start) for b, _, start in out] if sizes else []


def pieces_of(docs: DataFrame, largest: int, id_col: str, text_col: str, tokens_col: str | None) -> DataFrame:
    """id, tokens, piece, start (in the text), length: whole texts, cut at each multiple of the largest length."""
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else word_count(F.col(text_col))
    counted = docs.select(F.col(id_col).cast("long").alias("id"), tokens.alias("tokens"))
    n = F.greatest(F.ceil(F.col("tokens") / largest), F.lit(1)).cast("long")
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("piece") * largest
    return cut.withColumn("start", start).withColumn("length", F.least(F.col("tokens") - start, F.lit(largest)))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST, id_col: str = "doc_id",
         text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start and length in the text, bin, capacity, offset (in the bin)."""
    pieces = stored(pieces_of(docs, max(lengths), id_col, text_col, tokens_col).withColumn("row", F.monotonically_increasing_id()))
    filled = pieces.where("length > 0")
    blocks = max(1, -(-filled.count() // BLOCK))
    dealt = filled.withColumn("block", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(blocks)))
    # only equal rows make a block much larger than others
    over = stored(dealt.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK))
    if n := over.count():
        parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK)
        dealt = dealt.join(checked(over, n), "block", "left").withColumn("block", F.col("block") + blocks * F.pmod(F.xxhash64("row"), parts))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        at, block = best_fit(rows["length"].to_pylist(), lengths, bin_cost), rows["block"][0].as_py()
        return pa.table([rows["id"], rows["piece"], rows["start"], rows["length"], pa.array([f"{block}-{b}" for b, _, _ in at]), pa.array([c for _, c, _ in at], pa.int64()), pa.array([s for _, _, s in at], pa.int64())],
                        ["id", "piece", "start", "length", "bin", "capacity", "offset"])

    schema = "id long, piece long, start long, length long, bin string, capacity long, offset long"
    binned = dealt.select("id", "piece", "start", "length", "block").groupBy("block").applyInArrow(packed, schema)
    empty = pieces.where("length <= 0").selectExpr("id", "piece", "start", "cast(0 as long) length", "cast(null as string) bin", "cast(null as long) capacity", "cast(null as long) offset")
    return binned.unionByName(empty).withColumnRenamed("id", id_col)
