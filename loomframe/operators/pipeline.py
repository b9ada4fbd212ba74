"""Chains of operators (ORC-01..06): steps are functions of DataFrames, run in a fixed order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.cleaning import film_score, validate
from loomframe.operators.dedup import deduplicate
from loomframe.operators.joins import enrich_fold

AUDIT = "run_id string, step string, status string, started timestamp, ended timestamp, rows long, error string"


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[], DataFrame | None]]], run_id: str, skip: set[str] = frozenset()) -> DataFrame:
    """ORC-01, 06: steps in order, skipped ones marked, the first failure ends the run; one audit row each."""
    rows = []
    for name, step in steps:
        began = datetime.now(UTC)
        if name in skip:
            rows.append((run_id, name, "skipped", began, began, None, None))
            continue
        try:
            out = step()
            rows.append((run_id, name, "success", began, datetime.now(UTC), out.count() if out is not None else None, None))
        except Exception as e:  # noqa: BLE001  any failure ends the run
            rows.append((run_id, name, "failed", began, datetime.now(UTC), None, str(e)[:500]))
            break
    return spark.createDataFrame(rows, AUDIT)


def aggregate_films(base: DataFrame, rt: DataFrame, imdb: DataFrame, kaggle: DataFrame, spark_rows: DataFrame, dedupe: bool = True) -> DataFrame:
    """ORC-03: merge, remove duplicates in input order (`pos`), score."""
    merged = enrich_fold(base, rt, imdb, kaggle, spark_rows)
    if dedupe:
        kept = deduplicate(merged.select("pos", "tmdb_id", "imdb_id", "title", F.year("release_date").alias("year"))).where(F.col("reason") == "")
        merged = merged.join(kept.select("pos"), "pos", "left_semi")
    return merged.withColumn("aggregated_score", film_score(F.col("vote_average"), F.col("tomatometer_score").cast("double"), F.col("imdb_rating"), F.col("kaggle_rating")))


def validated(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """ORC-04: (valid, invalid with the names of broken rules)."""
    checked = df.withColumn("errors", validate(rules))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def staged_run(raw: DataFrame, keep, analytics: dict[str, Callable[[DataFrame], DataFrame]], normalise: Callable[[DataFrame], DataFrame], export: Callable[[DataFrame], int] | None) -> dict:  # noqa: ANN001
    """ORC-02: extract and count, analytics, normalise, export; a failing stage ends the run and is counted.

    Each stage reads the same view of the source; `export` gives the rows it wrote, None skips it.
    """
    out: dict = {"total_rows": 0, "filtered": 0, "normalized": 0, "exported": 0, "errors": 0, "analytics": {}}
    try:
        n = raw.agg(F.count("*").alias("all"), F.count_if(keep).alias("kept")).first()
        out |= {"total_rows": n["all"], "filtered": n["kept"]}
        view = raw.where(keep)
        out["analytics"] = {name: run(view).count() for name, run in analytics.items()}
        ready = normalise(view)
        out["normalized"] = ready.count()
        if export is not None:
            out["exported"] = export(ready)
    except Exception as e:  # noqa: BLE001  any failure ends the run
        out |= {"errors": 1, "error": str(e)[:500]}
    return out


def retained(df: DataFrame, ts: str, before, name: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """ORC-06: rows from `before` on (and those without a time), and a log row of how many were older."""
    old = F.coalesce(F.col(ts) < before, F.lit(False))
    log = df.where(old).agg(F.lit(name).alias("table_name"), F.count("*").alias("deleted"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
    return df.where(~old), log


def bundle(raw: DataFrame, film: str, children: dict[str, str]) -> dict[str, DataFrame]:
    """ORC-05: one table of films and one exploded table per child array, references first; no row loop."""
    out = {name: raw.select(film, F.explode(column).alias("item")).select(film, "item.*") for name, column in children.items()}
    return {**{f"ref_{n}": d.drop(film).distinct() for n, d in out.items()}, "films": raw.drop(*children.values()), **out}
