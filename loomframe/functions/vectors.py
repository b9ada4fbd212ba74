"""Vector arithmetic in column expressions (RET-13..15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of unequal length or null; 0 where one has no length."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def quality(vec: Column, dim: int, tolerance: float = 0.01) -> Column:
    """RET-14: dimension, unit norm and not zero."""
    n = norm(vec)
    return F.struct((F.size(vec) == dim).alias("dimension"), (F.abs(n - 1) <= tolerance).alias("unit"), (n > 0).alias("nonzero"))


def consistent(single: Column, batch: Column, least: float = 0.99) -> Column:
    """RET-14: whether a vector made alone and one made in a batch agree."""
    return F.coalesce(cosine(single, batch) >= least, F.lit(False))
