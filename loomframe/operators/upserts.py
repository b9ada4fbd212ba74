"""Set-oriented writes: upserts, inserts, replacement, deletion (SNK-03..08, JOI-09..11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-03: new rows replace old ones of the same key. Null keys never match."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_subset(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """SNK-04: existing rows take only `columns` from new ones (a null there keeps the old value); others are inserted."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = old.join(n, keys, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh.select(*[c if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c]).alias(c) for c in old.columns]))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-05."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """SNK-06: all rows of the parents in `new` are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-07."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_from(df: DataFrame, staging: DataFrame, keys: list[str], column: str) -> DataFrame:
    """SNK-08: one column from a staging table where it has a value. The planner broadcasts a small staging side."""
    s = staging.select(*keys, F.col(column).alias("_new"))
    return df.join(s, keys, "left").select(*[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in df.columns])


def fill(old: Column, new: Column) -> Column:
    """JOI-09: a missing or empty text takes the new one."""
    return F.when(F.coalesce(old, F.lit("")) == "", new).otherwise(old)


def fill_amount(old: Column, new: Column) -> Column:
    """JOI-10: an unknown or zero amount takes a positive one."""
    return F.when((F.coalesce(old, F.lit(0)) == 0) & (new > 0), new).otherwise(old)


def write_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted and updated rows of an upsert, counted before it."""
    known = old.select(*keys).distinct().withColumn("_k", F.lit(True))
    return new.join(known, keys, "left").agg(F.count_if(F.col("_k").isNull()).alias("inserted"), F.count_if(F.col("_k").isNotNull()).alias("updated"))
