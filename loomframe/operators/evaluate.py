"""Evaluation of retrieval and classification (EVA-01..12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.numbers import mean
from loomframe.operators.aggregates import jaccard, overlaps


def hit_at_k(found: Column, expected: Column) -> Column:
    """EVA-01: undefined where nothing is expected."""
    return F.when(F.size(expected) > 0, overlaps(found, expected))


def accuracy(df: DataFrame, label: str, predicted: str, confidence: str) -> DataFrame:
    """EVA-02, 03: per label and over all (label null)."""
    ok = (F.col(label) == F.col(predicted)).cast("int")
    return df.rollup(label).agg(F.count("*").alias("n"), mean(ok, 4).alias("recall"), mean(confidence, 4).alias("confidence"))


def empty_answers(df: DataFrame, intent: str, sources: str, error: str) -> DataFrame:
    """EVA-04."""
    return df.agg(F.count_if((F.col(intent) == "needs_database") & (F.size(sources) == 0) & F.col(error).isNull()).alias("n"))


def fate(fused: Column, vector: Column, lexeme: Column, k: int = 5) -> Column:
    """EVA-06 on the best ranks of a query's expected ids."""
    return F.when(fused <= k, "OK").when(fused.isNotNull(), "RANKING").when(vector.isNotNull() | lexeme.isNotNull(), "POOL_CUT").otherwise("UNREACHABLE")


def loss_stage(in_pool: Column, final_rank: Column, rerank: Column, floor: Column, k: int = 5) -> Column:
    """EVA-09: how far an expected id came."""
    return F.when(~F.coalesce(in_pool, F.lit(False)), "RETRIEVAL").when(F.coalesce(final_rank > k, F.lit(True)), "FUSION").when(F.coalesce(rerank, F.lit(-1e9)) < floor, "RERANK").otherwise("HIT")


STAGES = ["RETRIEVAL", "FUSION", "RERANK", "HIT"]


def furthest(df: DataFrame, by: str, stage: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage))
    return df.groupBy(by).agg(F.max_by(stage, place).alias("stage"))


def grid_sweep(probes: DataFrame, expected: DataFrame, params: DataFrame, k: int = 5) -> DataFrame:
    """EVA-07: hits of each parameter set over probes computed once.

    probes: (query, key, rank_a, rank_b, rerank); params: (weight, rrf_k, floor), a short list that is
    broadcast; expected: (query, key).
    """
    part = lambda r, w: F.coalesce(w / (F.col("rrf_k") + F.col(r)), F.lit(0.0))
    s = probes.join(F.broadcast(params)).withColumn("score", F.round(part("rank_a", F.col("weight")) + part("rank_b", 1 - F.col("weight")), 12))
    w = Window.partitionBy("weight", "rrf_k", "floor", "query").orderBy(F.desc("score"), "key")
    top = s.withColumn("place", F.row_number().over(w)).where((F.col("place") <= k) & (F.col("rerank") >= F.col("floor")))
    hit = top.join(expected.distinct(), ["query", "key"], "left_semi").select("weight", "rrf_k", "floor", "query").distinct()
    got = hit.groupBy("weight", "rrf_k", "floor").agg(F.count("*").alias("hits"))
    return params.join(got, ["weight", "rrf_k", "floor"], "left").select("weight", "rrf_k", "floor", F.coalesce("hits", F.lit(0)).alias("hits"))


def best_params(sweep: DataFrame) -> DataFrame:
    """EVA-08: most hits, then the strictest floor, then the most central weight and k."""
    order = F.struct("hits", "floor", -F.abs(F.col("weight") - 0.5), -F.abs(F.col("rrf_k") - 60))
    return sweep.agg(F.max_by(F.struct("weight", "rrf_k", "floor", "hits"), order).alias("b")).select("b.*")


def ab_report(df: DataFrame, model: str, top1: str, latency: str) -> DataFrame:
    """EVA-11."""
    return df.groupBy(model).agg(mean(top1, 4).alias("mean_top1"), F.round(F.median(top1), 4).alias("median_top1"), F.round(F.percentile(latency, F.lit(0.5)), 2).alias("p50"), F.round(F.percentile(latency, F.lit(0.95)), 2).alias("p95"))


def mean_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """EVA-10, 11."""
    return df.agg(F.round(F.avg(jaccard(F.col(a), F.col(b))), 4).alias("overlap"))


def suites(cases: DataFrame, suite: str, status: str, seconds: str) -> DataFrame:
    """EVA-12: one row per suite; passed only if every case did."""
    return cases.groupBy(suite).agg(F.count("*").alias("tests"), F.count_if(F.col(status) == "failed").alias("failed"), F.round(F.sum(seconds), 3).alias("seconds"), F.bool_and(F.col(status) != "failed").alias("passed"))
