"""Aggregates of the film model (AGG-01..21, SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.numbers import mean


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """AGG-01, 02, 11."""
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("n"))


def collection_stats(df: DataFrame, rating: str, by: str) -> DataFrame:
    """AGG-03: one row per group and a total row (group null), in one pass."""
    return df.rollup(by).agg(F.grouping(by).alias("is_total"), F.count("*").alias("n"), mean(rating, 2).alias("avg_rating")).select(F.col(by).alias("grp"), F.col("is_total").cast("int").alias("is_total"), "n", "avg_rating")


def score_stats(df: DataFrame, critics: str, audience: str, certified: Column) -> DataFrame:
    """AGG-04."""
    return df.agg(F.count("*").alias("total"), mean(critics, 1).alias("avg_critics"), mean(audience, 1).alias("avg_audience"), F.count(critics).alias("with_critics"), F.count_if(certified).alias("certified"))


def histogram(df: DataFrame, value: Column, bins: list[tuple[float, float]]) -> DataFrame:
    """AGG-05: closed bins [lo, hi], empty ones kept; one scan."""
    hit = df.agg(*[F.count_if(value.between(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bins)])
    cells = F.array(*[F.struct(F.lit(f"{lo:g}-{hi:g}").alias("bin"), F.col(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(bins)])
    return hit.select(F.explode(cells).alias("c")).select("c.bin", "c.n")


def top_by_children(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str, n: int = 50) -> DataFrame:
    """AGG-06: children are counted before the join."""
    c = child.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("n"))
    return parent.join(c, key).select(name, "n").orderBy(F.desc("n"), name).limit(n)


def having(df: DataFrame, by: str, least: int) -> DataFrame:
    """AGG-07."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def status_totals(df: DataFrame, status: str, values: list[str], amount: str) -> DataFrame:
    """AGG-08, 09, 21: totals and counts of each status in one row; an empty sum is 0."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values], F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("amount"))


def text_stats(df: DataFrame, by: str, text: str) -> DataFrame:
    """AGG-10."""
    return df.groupBy(by).agg(F.count("*").alias("n"), mean(F.length(text), 0).alias("avg_length"))


def ordered_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """AGG-14."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"))


def roles(df: DataFrame, key: str, role: str, order: list[str], name: str, kinds: list[str]) -> DataFrame:
    """AGG-15, 16: an ordered array per role in one pass; empty where none."""
    one = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col(role) == k, F.struct(*order, F.col(name).alias("_v"))))), lambda s: s["_v"]).alias(k)
    return df.groupBy(key).agg(*[one(k) for k in kinds])


def coverage(df: DataFrame, condition: Column) -> DataFrame:
    """AGG-17, 18: share in percent, 0 of nothing."""
    n = F.count("*")
    return df.agg(n.alias("total"), F.count_if(condition).alias("covered"), F.when(n > 0, F.round(100.0 * F.count_if(condition) / n, 2).cast("double")).otherwise(0.0).alias("pct"))


def success_rate(failed: Column, total: Column, empty: float = 0.0) -> Column:
    """AGG-18: share in percent of what did not fail; of nothing it is `empty` (loaders take 100, pipelines 0)."""
    return F.when(total > 0, F.round(100.0 * (1 - failed / total), 2).cast("double")).otherwise(F.lit(empty))


LOADED = ["inserted", "updated", "skipped", "errors"]


def partial_stats(rows: DataFrame, outcome: str, by: list[str]) -> DataFrame:
    """AGG-19, partial: counts of each outcome and the error messages, per batch."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(outcome) == k).alias(k) for k in LOADED])


def merge_stats(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-19, final: sums of partial counts; merging merged ones gives the same as counting all rows at once."""
    n = sum((F.col(k) for k in LOADED[1:]), F.col(LOADED[0]))
    return parts.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in LOADED]).withColumn("total", n).withColumn("success_rate", success_rate(F.col("errors"), F.col("total"), 100.0))


def latency_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """AGG-20: exact percentiles; for unbounded groups see latency_sketch."""
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), mean(value, 2).alias("mean"), F.round(F.median(value), 2).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.percentile(value, F.lit(0.95)), 2).alias("p95")
    )


def latency_sketch(df: DataFrame, by: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """The same with mergeable quantile sketches."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx(value, 0.5, accuracy).alias("median"), F.percentile_approx(value, 0.95, accuracy).alias("p95"))


def index_percentile(df: DataFrame, by: list[str], value: str, p: int, digits: int = 1) -> DataFrame:
    """EVA-05: the value at place floor(n * p / 100), the last at most.

    Counts per distinct value come first, so a group is as many rows as it has values.
    """
    from pyspark.sql import Window

    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    run = c.withColumn("_n", F.sum("_c").over(w)).withColumn("_upto", F.sum("_c").over(w.orderBy(value)))
    at = F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    return run.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*by, F.col("_n").alias("n"), F.round(F.col(value).cast("double"), digits).alias(f"p{p}"))


def overlaps(a: Column, b: Column) -> Column:
    """SET-02."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """EVA-10: two empty lists are alike."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(1.0)


def last_items(arr: Column, n: int) -> Column:
    """TOP-03: the last n, also of shorter arrays."""
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))
