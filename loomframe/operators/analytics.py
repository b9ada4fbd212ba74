"""Film analytics over one film view: filters, ranks, trends, groups, export (SQL-01..11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.numbers import NUDGE, mean
from loomframe.operators.ordered import percent_rank_and_tile, row_numbers, with_neighbours


def latest(df: DataFrame, key: str = "id", by: tuple[str, ...] = ("updated_at", "vote_count")) -> DataFrame:
    """The newest delivery of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in by])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def film_view(films: DataFrame) -> DataFrame:
    """The columns the analytics read; genres joined to one text, dates lenient."""
    return latest(films).select(
        "id", "title", F.col("release_date").try_cast("date").alias("release_date"), "vote_average", "vote_count", "popularity", "overview",
        F.array_join("genres", ", ").alias("genre_names"), "original_language", "budget", "revenue", "runtime",
    )


def decade(date: Column) -> Column:
    return (F.year(date) - F.year(date) % 10).cast("long")


def filtered(v: DataFrame, min_votes: int = 100, min_rating: float = 5.0) -> DataFrame:
    """SQL-01: two thresholds; nulls fail both."""
    return v.where((F.col("vote_count") >= min_votes) & (F.col("vote_average") >= min_rating)).select(
        "id", "title", F.year("release_date").alias("release_year"), F.col("vote_average").alias("rating"), F.col("vote_count").alias("votes"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"), "original_language"
    )


def ranked_by_year(v: DataFrame, min_votes: int = 100) -> DataFrame:
    """SQL-02 / WIN-01: position within the year by rating, votes and id."""
    w = Window.partitionBy("release_year").orderBy(F.desc_nulls_last("rating"), F.desc_nulls_last("votes"), "id")
    s = v.where((F.col("vote_count") >= min_votes) & F.col("release_date").isNotNull()).select("id", "title", F.year("release_date").alias("release_year"), F.col("vote_average").alias("rating"), F.col("vote_count").alias("votes"))
    return s.withColumn("year_rank", F.row_number().over(w))


def rating_percentiles(v: DataFrame, min_votes: int = 50) -> DataFrame:
    """SQL-03 / WIN-03: percent rank and quartile over all rows, by a range sort."""
    s = v.where((F.col("vote_count") >= min_votes) & F.col("vote_average").isNotNull()).select("id", "title", F.col("vote_average").alias("rating"), F.col("vote_count").alias("votes"))
    return percent_rank_and_tile(s, "rating", ["rating", "id"])


def popularity_trend(v: DataFrame, min_votes: int = 100) -> DataFrame:
    """SQL-04 / WIN-04: popularity of the films released just before and after."""
    s = v.where((F.col("vote_count") >= min_votes) & F.col("release_date").isNotNull()).select("id", "title", "release_date", "popularity")
    t = with_neighbours(s, ["release_date", "id"], F.col("popularity"), "prev_popularity", "next_popularity")
    return t.select("id", "title", F.year("release_date").alias("release_year"), "popularity", "prev_popularity", "next_popularity", F.round(F.col("popularity") - F.col("prev_popularity"), 6).alias("popularity_change"))


def stats_by_decade(v: DataFrame, min_votes: int = 50, least: int = 10) -> DataFrame:
    """SQL-05: one row per decade with enough films."""
    s = v.where(F.col("release_date").isNotNull() & (F.col("vote_count") >= min_votes)).groupBy(decade(F.col("release_date")).alias("decade"))
    return s.agg(
        F.count("*").alias("movie_count"), mean("vote_average", 2).alias("avg_rating"), mean("vote_count", 0).alias("avg_votes"), mean("popularity", 2).alias("avg_popularity"),
        F.min("vote_average").alias("min_rating"), F.max("vote_average").alias("max_rating"),
    ).where(F.col("movie_count") >= least)


def stats_by_language(v: DataFrame, min_votes: int = 100, least: int = 5, high: float = 7.0) -> DataFrame:
    """SQL-06: conditional count and its share per language."""
    n = F.count_if(F.col("vote_average") >= high)
    return v.where(F.col("vote_count") >= min_votes).groupBy("original_language").agg(
        F.count("*").alias("movie_count"), mean("vote_average", 2).alias("avg_rating"), n.alias("high_rated_count"), F.round(n * 100.0 / F.count("*"), 1).cast("double").alias("high_rated_pct")
    ).where(F.col("movie_count") >= least)


def top_with_context(v: DataFrame, min_votes: int = 100, n: int = 10) -> DataFrame:
    """SQL-07: the best n of each decade beside the decade's mean, in one pass of two windows."""
    s = v.where(F.col("release_date").isNotNull() & (F.col("vote_count") >= min_votes)).select("id", "title", decade(F.col("release_date")).alias("decade"), F.col("vote_average").alias("rating"), F.col("vote_count").alias("votes"))
    level = s.groupBy("decade").agg(F.avg("rating").alias("_mean"))
    best = s.withColumn("decade_rank", F.row_number().over(Window.partitionBy("decade").orderBy(F.desc_nulls_last("rating"), "id"))).where(F.col("decade_rank") <= n)
    return best.join(level, "decade").select("id", "title", "decade", "rating", "votes", "decade_rank", F.round(F.col("_mean") + NUDGE, 2).alias("decade_avg"), F.round(F.col("rating") - F.col("_mean") + NUDGE, 2).alias("vs_decade_avg"))


def genre_groups(v: DataFrame, min_votes: int = 50, least: int = 5, n: int = 20) -> DataFrame:
    """SQL-08: the n most frequent genre texts with their number of genres."""
    g = v.where((F.coalesce(F.col("genre_names"), F.lit("")) != "") & (F.col("vote_count") >= min_votes)).groupBy("genre_names").agg(F.count("*").alias("movie_count"), mean("vote_average", 2).alias("avg_rating"))
    return g.where(F.col("movie_count") >= least).withColumn("genre_count", F.size(F.split("genre_names", ", "))).orderBy(F.desc("movie_count"), "genre_names").limit(n)


def monthly_pattern(v: DataFrame, min_votes: int = 50) -> DataFrame:
    """SQL-09: groups by month number and English name."""
    s = v.where(F.col("release_date").isNotNull() & (F.col("vote_count") >= min_votes))
    return s.groupBy(F.month("release_date").alias("release_month"), F.date_format("release_date", "MMMM").alias("month_name")).agg(F.count("*").alias("movie_count"), mean("vote_average", 2).alias("avg_rating"), mean("popularity", 2).alias("avg_popularity"))


def rating_category(rating: Column) -> Column:
    """FUN-13: label by thresholds; an unknown rating is the last."""
    return F.when(rating >= 7.5, "excellent").when(rating >= 6.0, "good").when(rating >= 4.0, "average").otherwise("poor")


def export_enriched(v: DataFrame, min_votes: int = 50) -> DataFrame:
    """SQL-10 / WIN-02: cleaned export with a rank over all rows, by a range sort."""
    z = lambda c, x: F.coalesce(F.col(c), F.lit(x)).alias(c)
    s = v.where(F.col("vote_count") >= min_votes).select(
        F.col("id").alias("kaggle_id"), "title", F.col("release_date").cast("string").alias("release_date"), F.year("release_date").alias("release_year"), decade(F.col("release_date")).alias("decade"),
        F.coalesce("vote_average", F.lit(0.0)).alias("rating"), F.col("vote_count").alias("votes"), z("popularity", 0.0), "original_language", z("runtime", 0), "overview", "genre_names", z("budget", 0), z("revenue", 0),
        rating_category(F.col("vote_average")).alias("rating_category"),
    )
    return row_numbers(s, [F.desc("rating"), F.desc("votes"), "kaggle_id"], "global_rank")


def count_filtered(v: DataFrame, min_votes: int = 50) -> DataFrame:
    """SQL-11: how many rows an export would have; no sort is planned."""
    return v.where(F.col("vote_count") >= min_votes).agg(F.count("*").alias("n"))
