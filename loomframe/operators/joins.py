"""Joins of the film model (JOI-01..16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.upserts import fill


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-03, 05: rows without a partner."""
    return df.join(other.select(*keys), keys, "left_anti")


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """JOI-04 with SQL's null rules: one null on the right empties the result, a null on the left never passes."""
    has_null = other.agg(F.max(F.col(other_key).isNull()).alias("_null"), F.count("*").alias("_n"))
    out = df.join(other.select(F.col(other_key).alias(key)).where(F.col(key).isNotNull()), key, "left_anti").join(F.broadcast(has_null))
    return out.where((F.col("_n") == 0) | (~F.coalesce("_null", F.lit(False)) & F.col(key).isNotNull())).drop("_null", "_n")


def within(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-06."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def last_of(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of each usable key the row delivered last; 0 and '' are no keys."""
    text = F.col(key).cast("string")
    rows = df.where(text.isNotNull() & ~text.isin("", "0"))
    cols = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(position)).alias("_r")).select(key, "_r.*")


def two_key_match(left: DataFrame, right: DataFrame, first: str, second: str, position: str, values: list[str]) -> DataFrame:
    """JOI-07: the right row of the first key, else that of the second, as one struct `match` of `values`."""
    pick = F.struct(*values)
    a = last_of(right, first, position).select(F.col(first).alias("_k1"), pick.alias("_m1"))
    b = last_of(right, second, position).select(F.col(second).alias("_k2"), pick.alias("_m2"))
    out = left.join(a, left[first] == a["_k1"], "left").join(b, left[second] == b["_k2"], "left")
    return out.withColumn("match", F.coalesce("_m1", "_m2")).drop("_k1", "_k2", "_m1", "_m2")


def enrich_fold(base: DataFrame, rt: DataFrame, imdb: DataFrame, kaggle: DataFrame, spark_rows: DataFrame) -> DataFrame:
    """JOI-08, 09: four sources matched by the base row's own ids, filled in turn, with provenance.

    Sources: (tmdb_id, imdb_id, pos, ...) with tomatometer_score / imdb_rating / overview, kaggle_rating / spark_rating.
    """
    out = base
    plan = [("rotten_tomatoes", rt, ["tomatometer_score"]), ("imdb", imdb, ["imdb_id", "imdb_rating"]), ("kaggle", kaggle, ["overview", "kaggle_rating"]), ("spark", spark_rows, ["spark_rating"])]
    for name, src, values in plan:
        src = src.withColumns({"_" + v: F.col(v) for v in values})
        out = two_key_match(out, src, "tmdb_id", "imdb_id", "pos", ["_" + v for v in values]).withColumnRenamed("match", name)
    seen = [F.when(F.col(n).isNotNull(), F.lit(n)) for n, _, _ in plan]
    keep = [c for c in base.columns if c not in ("imdb_id", "overview")]
    return out.select(
        *keep, fill(F.col("imdb_id"), F.col("imdb._imdb_id")).alias("imdb_id"), fill(F.col("overview"), F.col("kaggle._overview")).alias("overview"),
        F.col("rotten_tomatoes._tomatometer_score").alias("tomatometer_score"), F.col("imdb._imdb_rating").alias("imdb_rating"), F.col("kaggle._kaggle_rating").alias("kaggle_rating"), F.col("spark._spark_rating").alias("spark_rating"),
        F.array_compact(F.array(F.lit("tmdb"), *seen)).alias("sources"),
    ).withColumn("enrichment_count", F.size("sources") - 1)


def full_ranks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-12: two ranked lists side by side: (keys, rank_a, rank_b)."""
    return a.select(*keys, F.col("rank").alias("rank_a")).join(b.select(*keys, F.col("rank").alias("rank_b")), keys, "full")


def with_children(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """JOI-13: each kind of child gathered to an ordered array before it is joined, so rows never multiply.

    children: name -> (rows, column, order). A parent's child list is the result itself, one row each.
    """
    out = parent
    for name, (rows, column, order) in children.items():
        got = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v")))), lambda s: s["_v"]).alias(name))
        out = out.join(got, key, "left").withColumn(name, F.coalesce(name, F.expr("array()")))
    return out


def near_years(a: Column, b: Column, by: int = 1) -> Column:
    """JOI-15: at most `by` apart; unknown years fit."""
    return F.coalesce(F.abs(a - b) <= by, F.lit(True))


def first_partner(left: DataFrame, right: DataFrame, key: str, on: str, order: list) -> DataFrame:
    """One partner of each left row."""
    w = Window.partitionBy(key).orderBy(*order)
    return left.join(right, on).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
