"""Data-quality queries of the core: orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.references import Reference, first_seen, gather, orphan_report, orphans
from loomframe.session import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = gather([
        Reference("film_languages", table(spark, d, "film_languages"), "link_id", "film_id", "loaded_at", "id"),
        Reference("rt_scores", table(spark, d, "rt_scores"), "id", "film_id", "scraped_at", "id"),
        Reference("rag_documents", table(spark, d, "rag_documents"), "id", "source_id", "created_at", "tmdb_id"),
    ])
    return refs, first_seen(table(spark, d, "films"), {"id": "id", "tmdb_id": "tmdb_id"}, "created_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs, seen = _inputs(spark, d)
    return orphans(refs, seen).select("src_table", "row_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    refs, seen = _inputs(spark, d)
    gone = table(spark, d, "film_purges")
    both = gone.select(F.lit("id").alias("target"), F.col("film_id").alias("key")).unionByName(gone.select(F.lit("tmdb_id").alias("target"), F.col("tmdb_id").alias("key")))
    return orphan_report(refs, seen, both)


_REFS = """
WITH refs AS (
  SELECT 'film_languages' AS src_table, CAST(link_id AS VARCHAR) AS row_id, 'id' AS target, film_id AS key, loaded_at AS t FROM film_languages
  UNION ALL SELECT 'rt_scores', CAST(id AS VARCHAR), 'id', film_id, scraped_at FROM rt_scores
  UNION ALL SELECT 'rag_documents', id, 'tmdb_id', source_id, created_at FROM rag_documents),
seen AS (
  SELECT 'id' AS target, id AS key, min(created_at) AS seen FROM films GROUP BY id
  UNION ALL SELECT 'tmdb_id', tmdb_id, min(created_at) FROM films GROUP BY tmdb_id),
dead AS (SELECT DISTINCT 'id' AS target, film_id AS key FROM film_purges UNION SELECT DISTINCT 'tmdb_id', tmdb_id FROM film_purges),
met AS (
  SELECT r.src_table, r.row_id, strftime(r.t, '%Y-%m') AS period, s.seen, d.key AS gone,
         (s.seen IS NULL OR r.t IS NULL OR s.seen > r.t) AS orphan
  FROM refs r LEFT JOIN seen s ON r.target = s.target AND r.key = s.key
  LEFT JOIN dead d ON r.target = d.target AND r.key = d.key
  WHERE r.key IS NOT NULL)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p3_found": _REFS + "SELECT src_table, row_id FROM met WHERE orphan",
    "p3_report": _REFS + """
SELECT src_table, period, count(*) AS refs, count(*) FILTER (WHERE orphan) AS orphans,
       count(*) FILTER (WHERE orphan AND seen IS NULL AND gone IS NULL) AS missing,
       count(*) FILTER (WHERE orphan AND seen IS NULL AND gone IS NOT NULL) AS purged,
       count(*) FILTER (WHERE orphan AND seen IS NOT NULL) AS late
FROM met GROUP BY src_table, period""",
}
