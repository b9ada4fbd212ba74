"""Rates, increases, quantiles and alerts over events, for batch and streaming inputs (STR-03..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.ordered import with_neighbours


def rate(events: DataFrame, ts: str, by: list[str], width: str = "5 minutes", slide: str | None = None, seconds: int = 300) -> DataFrame:
    """STR-03: events per second in each window; no extrapolation to window edges. Works on streams (set a watermark)."""
    w = F.window(ts, width, slide or width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n", F.round(F.col("n") / seconds, 6).alias("rate"))


def increase(samples: DataFrame, ts: str, key: str, value: str, tie: str, width: str = "1 hour") -> DataFrame:
    """STR-04: sum of the rises of a counter per window; a fall is a reset and counts from 0.

    The sample before comes from a range sort over (key, time), not from one window per key.
    """
    s = with_neighbours(samples, [key, ts, tie], F.struct(F.col(key).alias("k"), F.col(value).alias("v")), "_prev", "_next")
    rise = F.when(F.col("_prev.k").eqNullSafe(F.col(key)), F.when(F.col(value) >= F.col("_prev.v"), F.col(value) - F.col("_prev.v")).otherwise(F.col(value))).otherwise(0.0)
    return s.withColumn("_rise", rise).groupBy(F.window(ts, width).alias("w"), key).agg(F.round(F.sum("_rise"), 4).alias("increase")).select(F.col("w.start").alias("start"), key, "increase")


def observe(events: DataFrame, value: str, by: list[str], bounds: list[float]) -> DataFrame:
    """STR-08: cumulative counts per upper bound, the last one infinite (null)."""
    n = events.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    cells = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return n.select(*by, F.explode(cells).alias("c")).select(*by, "c.le", "c.n")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """STR-05: linear interpolation inside the bucket that holds the q-th observation; beyond the last bound, that bound."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("le"))
    b = buckets.withColumn("_lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_total", F.max("n").over(Window.partitionBy(*by)))
    want = F.col("_total") * q
    hit = b.where((F.col("n") >= want) & ((F.col("_below") < want) | ((want == 0) & (F.col("_below") == 0) & (F.col("n") > 0))))
    value = F.when(F.col("le").isNull(), F.col("_lo")).otherwise(F.col("_lo") + (F.col("le") - F.col("_lo")) * (want - F.col("_below")) / (F.col("n") - F.col("_below")))
    return hit.groupBy(*by).agg(F.round(F.min(value), 4).alias("value"))


def ratio(events: DataFrame, ts: str, part: Column, width: str = "1 hour") -> DataFrame:
    """STR-06: share in percent of the events that meet `part`, both sums in one window."""
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count_if(part).alias("part"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "part", "n", F.round(100.0 * F.col("part") / F.col("n"), 4).cast("double").alias("pct"))


def held_for(windows: DataFrame, start: str, value: str, above: float, width_s: int, for_s: int) -> DataFrame:
    """STR-07: spans of adjacent windows above a threshold that last at least for_s seconds (gaps and islands).

    One row per window comes in, so the order by window is short.
    """
    hot = windows.where(F.col(value) > above).withColumn("_s", F.unix_timestamp(F.col(start)))
    w = Window.partitionBy(F.lit(0)).orderBy("_s")
    isl = hot.withColumn("_g", F.col("_s") - F.row_number().over(w) * width_s)
    return isl.groupBy("_g").agg(F.min("_s").alias("from_s"), (F.max("_s") + width_s).alias("to_s"), F.count("*").alias("windows"), F.round(F.max(value), 4).alias("peak")).where(F.col("to_s") - F.col("from_s") >= for_s).drop("_g")


def request_record(df: DataFrame, method: str, path: str, status: str, duration: str) -> DataFrame:
    """STR-09: log rows with ids in the path replaced by a placeholder."""
    route = F.regexp_replace(F.regexp_replace(F.col(path), r"/[0-9a-f]{8}-[0-9a-f-]{27}", "/{id}"), r"/\d+", "/{id}")
    return df.select(F.upper(method).alias("method"), route.alias("route"), F.col(status).cast("int").alias("status"), F.col(duration).cast("double").alias("duration"))
