"""Sharding by sampled splitters, with DataFrame functions only.

Keys are text hashes, so equal texts lie side by side. A sample in which a record's chance is proportional to its
size gives the splitters: its quantiles cut the key space into ranges of about equal size. Exact range sizes follow
from one aggregate: ranges are subdivided by a hash of the key into cells, so that equal texts stay together, and a cell that is overfull, as one
with a hot text is, further by a hash of the id. Cells, in order, then fill the shards one after another up to equal sizes.

Defined results: a null text has size 1; a null id hashes like any other value; repeated rows are separate records;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, stored

#: Ranges for each shard, cells of a range and parts of an overfull cell, the share of a shard above which a cell is overfull (1 / OVERFULL), keys in the sample,
#: records that one task numbers.
RANGES = 32
PARTS = 256
OVERFULL = 32
SAMPLE = 20_000
NUMBERED = 50_000


def _unit(*cols: str) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.pmod(F.xxhash64(F.lit("sample"), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def splitters(records: DataFrame, total: int, ranges: int) -> list[int]:
    """At most ranges - 1 boundaries: quantiles of a sample of about SAMPLE keys, drawn by size."""
    drawn = records.where(_unit("id", "key") * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(SAMPLE)))
    at = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile_approx("key", at, F.lit(10_000))).first()[0]
    return sorted(set(found or []))


def shard_by_size(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each record's shard (0 to shards - 1, sizes near equal) and slot (gapless from 0 in its shard)."""
    text = F.col(text_col)
    records = stored(docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("crc"), F.xxhash64(text).alias("key")))
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * RANGES
    cuts = splitters(records, total, ranges)
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.array().cast("array<long>")
    ranged = records.withColumn("range", F.size(F.filter(bounds, lambda x: x <= F.col("key"))))
    hashed = lambda c: F.pmod(F.xxhash64(F.lit("part"), c), F.lit(PARTS)).cast("int")
    ranged = ranged.withColumn("cell", hashed("key")).withColumn("part", hashed("id"))
    share = max(total, 1) / shards
    # at most ranges * PARTS cells, and at most shards * OVERFULL of them overfull, whatever the input
    cells = stored(ranged.groupBy("range", "cell").agg(F.sum("size").alias("size")).withColumn("overfull", F.col("size") > share / OVERFULL))
    hot = cells.where("overfull").select("range", "cell")
    parts = ranged.join(F.broadcast(hot), ["range", "cell"]).groupBy("range", "cell", "part").agg(F.sum("size").alias("size"))
    units = stored(cells.where("not overfull").select("range", "cell", F.lit(-1).alias("part"), "size").unionByName(parts))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("range_size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    starts = units.groupBy("range").agg(F.sum("size").alias("range_size")).select("range", earlier.alias("start"))
    middle = F.col("start") + F.coalesce(F.sum("size").over(before("range").orderBy("cell", "part")), F.lit(0)) + F.col("size") / 2
    placed = stored(units.join(F.broadcast(starts), "range").select("range", "cell", F.col("part").alias("of_part"), F.least(F.floor(middle / share), F.lit(shards - 1)).cast("int").alias("shard")))
    piles = max(1, -(-n // (shards * NUMBERED)))
    sharded = stored(ranged.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["range", "cell"], "left")
                     .withColumn("of_part", F.when(F.col("hot"), F.col("part")).otherwise(F.lit(-1))).join(F.broadcast(placed), ["range", "cell", "of_part"])
                     .withColumn("pile", F.pmod(F.xxhash64(F.lit("pile"), "id", "key"), F.lit(piles)).cast("int"))
                     .select("id", "size", "crc", "key", "shard", "pile"))
    counts = sharded.groupBy("shard", "pile").agg(F.count("*").alias("rows"))
    previous = Window.partitionBy("shard").orderBy("pile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("shard", "pile", F.coalesce(F.sum("rows").over(previous), F.lit(0)).alias("offset")))
    order = Window.partitionBy("shard", "pile").orderBy("key", F.col("id").asc_nulls_last(), "size")
    return (sharded.withColumn("place", F.row_number().over(order) - 1)
            .join(checked(offsets, shards * piles), ["shard", "pile"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
