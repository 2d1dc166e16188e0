"""Connected components of a link table: tasks unite the links they hold, and alternating large-star and small-star steps unite their results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored

#: Links that one task unites at most, about.
UNITED = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: each node of a task's links with the smallest node that those links lead to, if it is another one."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    rows = [(x, y) for x in list(top) if x != (y := find(x))]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], ["u", "v"])


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b) with another one. Minima are tables of their own before they
    are joined, so that adaptive execution can split the rows of a node with very many links."""
    links = stored(links.select("a", "b"))
    tasks = max(1, -(-links.count() // UNITED))
    edges = stored(links.repartition(tasks).mapInArrow(_forest, "u long, v long").distinct())
    removed(links)
    print_of = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    now = print_of(edges) if tasks > 1 else None  # one task's result is the result
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = stored(_mins(both))
        large = stored(both.join(mins, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small_mins = stored(_mins(large))
        small = large.join(small_mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, stored(small.unionByName(small_mins.select("u", F.col("m").alias("v"))).distinct())
        removed(before, mins, large, small_mins)
        if (then := print_of(edges)) == now:
            break
        now = then
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
