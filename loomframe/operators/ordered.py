"""Total orders without one-task windows: positions, percent ranks, tiles, neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import global_rank

BLOCK = 10_000


def row_numbers(df: DataFrame, order: list, out: str = "rn") -> DataFrame:
    """row_number() over (order by ...) for any number of rows; `order` must tell all rows apart to be repeatable."""
    return global_rank(df, order, out).withColumn(out, F.col(out) + 1)


def percent_rank_and_tile(df: DataFrame, value: str, order: list, tiles: int = 4, digits: int = 3) -> DataFrame:
    """percent_rank by `value` (ties share the first position) and ntile by the full order."""
    pos = global_rank(df, order, "_pos")
    first = pos.groupBy(value).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    total = pos.agg(F.count("*").alias("_total"))
    met = pos.join(F.broadcast(total)).join(first.withColumnRenamed(value, "_v"), F.col(value).eqNullSafe(F.col("_v")), "left")
    share = F.when(F.col("_total") > 1, F.col("_first") / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    small, extra = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    edge = extra * (small + 1)
    tile = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1))).otherwise(extra + F.floor((F.col("_pos") - edge) / F.greatest(small, F.lit(1))))
    return met.withColumn("percentile", F.round(share, digits)).withColumn("quartile", (tile + 1).cast("int")).drop("_pos", "_first", "_n", "_total", "_v")


def with_neighbours(df: DataFrame, order: list, value: Column, prev: str, following: str) -> DataFrame:
    """lag and lead of `value` in a total order: blocks of positions, each with a halo of one row on both sides."""
    pos = global_rank(df.withColumn("_val", value), order, "_pos").withColumn("_block", F.floor(F.col("_pos") / BLOCK))
    edge = F.col("_pos") % BLOCK
    left = pos.where(edge == 0).withColumn("_block", F.col("_block") - 1)
    right = pos.where(edge == BLOCK - 1).withColumn("_block", F.col("_block") + 1)
    every = pos.withColumn("_own", F.lit(True)).unionByName(left.withColumn("_own", F.lit(False))).unionByName(right.withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_block").orderBy("_pos")
    seen = every.withColumn(prev, F.lag("_val").over(w)).withColumn(following, F.lead("_val").over(w))
    return seen.where("_own").drop("_own", "_block", "_pos", "_val")
