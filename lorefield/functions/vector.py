"""Vector distance and similarity as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column, compat: bool = False) -> Column:
    """1 - distance. compat gives the older rule: null is 0, a distance of 1 or more counts as similarity 1, below 0 as 1 - |d|."""
    if not compat:
        return 1 - distance
    return F.when(distance.isNull(), F.lit(0.0)).when(distance >= 1, F.lit(1.0)).when(distance < 0, 1 - F.abs(distance)).otherwise(1 - distance)


def normalized(a: Column) -> Column:
    """a scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
