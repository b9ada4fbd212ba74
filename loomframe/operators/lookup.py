"""Point, range and page lookups (FLT-01..14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.ordered import row_numbers


def by_id(df: DataFrame, key: str, value) -> DataFrame:  # noqa: ANN001
    return df.where(F.col(key) == value)


def exists(df: DataFrame, key: str, value) -> bool:  # noqa: ANN001
    return not by_id(df, key, value).isEmpty()


def by_field(df: DataFrame, field: str, value, order: list, n: int | None = None) -> DataFrame:  # noqa: ANN001
    out = df.where(F.col(field) == value)
    return out if n is None else out.orderBy(*order).limit(n)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """FLT-03: pages count from 1, up to 1000; sizes up to 100."""
    number, size = min(max(number, 1), 1000), min(max(size, 1), 100)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def search(df: DataFrame, column: str, part: str, order: list, n: int = 20) -> DataFrame:
    """FLT-04, 05: case-insensitive substring, wildcards taken literally."""
    return df.where(F.contains(F.lower(column), F.lit(part.lower()))).orderBy(*order).limit(n)


def same_name(df: DataFrame, column: str, name: str) -> DataFrame:
    """FLT-06."""
    return df.where(F.lower(column) == name.lower())


def in_year(df: DataFrame, column: str, year: int, order: list, n: int = 100) -> DataFrame:
    """FLT-07: a range, so that it reaches the scan."""
    return df.where(F.col(column).between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))).orderBy(*order).limit(n)


def top(df: DataFrame, condition: Column, order: list, n: int = 50) -> DataFrame:
    """FLT-08, 12."""
    return df.where(condition).orderBy(*order).limit(n)


def children(df: DataFrame, parent: str, value, order: list, role: Column | None = None, n: int | None = None) -> DataFrame:  # noqa: ANN001
    """FLT-09."""
    out = df.where(F.col(parent) == value)
    out = out if role is None else out.where(role)
    return out.orderBy(*order) if n is None else out.orderBy(*order).limit(n)


def keys(df: DataFrame, key: str) -> DataFrame:
    """FLT-10: a distinct set that stays distributed."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def id_map(df: DataFrame, name: str, key: str, lower: bool = False) -> DataFrame:
    """FLT-11: natural key to surrogate; null keys are left out, the smallest id wins."""
    n = F.lower(name) if lower else F.col(name)
    return df.where(F.col(name).isNotNull()).groupBy(n.alias("name")).agg(F.min(key).alias(key))


def get_or_create(existing: DataFrame, wanted: DataFrame, name: str, key: str) -> DataFrame:
    """FLT-13: (name, key, created): known names keep their ids, others follow the greatest one in order."""
    names = wanted.select(name).where(F.col(name).isNotNull()).distinct()
    known = existing.groupBy(name).agg(F.min(key).alias(key))
    old = names.join(known, name).withColumn("created", F.lit(False))
    start = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_max"))
    new = row_numbers(names.join(known, name, "left_anti"), [name], "_rn").join(F.broadcast(start))
    return old.select(name, F.col(key).cast("long").alias(key), "created").unionByName(new.select(name, (F.col("_rn") + F.col("_max")).cast("long").alias(key), F.lit(True).alias("created")))


def distinct_on(df: DataFrame, key: str, priority: Column, tie: list) -> DataFrame:
    """WIN-05: the first row of each key by priority."""
    w = Window.partitionBy(key).orderBy(priority, *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
