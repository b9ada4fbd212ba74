"""Queries over titles and ratings with joins and subqueries (REL-01..11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.numbers import mean


def titles_and_ratings(imdb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two relations behind the templates: titles by id, and the rating with most votes of each id."""
    t = imdb.groupBy("imdb_id").agg(F.max_by(F.struct("title", "year", "runtime", "genres"), F.struct("imdb_votes", "title")).alias("t"))
    t = t.select(F.col("imdb_id").alias("title_id"), F.lit("movie").alias("type"), F.col("t.title").alias("primary_title"), F.col("t.year").alias("premiered"), F.col("t.runtime").alias("runtime_minutes"), F.col("t.genres").alias("genres"))
    r = imdb.groupBy("imdb_id").agg(F.max_by(F.struct("imdb_rating", "imdb_votes"), F.struct("imdb_votes", "title")).alias("r"))
    return t, r.select(F.col("imdb_id").alias("title_id"), F.col("r.imdb_rating").alias("rating"), F.col("r.imdb_votes").alias("votes"))


def _joined(t: DataFrame, r: DataFrame, genre: str, votes: int) -> DataFrame:
    """Filters reach both sides before the join; the genre test ignores case."""
    return t.where((F.col("type") == "movie") & F.col("genres").ilike(f"%{genre}%")).join(r.where(F.col("votes") >= votes), "title_id")


COLS = ["imdb_id", "title", "year", "runtime", "genres", "rating", "votes"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("title_id").alias("imdb_id"), F.col("primary_title").alias("title"), F.col("premiered").alias("year"), F.col("runtime_minutes").alias("runtime"), "genres", "rating", "votes")


def with_ratings(t: DataFrame, r: DataFrame, min_votes: int = 1000, min_rating: float = 0.0, genre: str = "Horror") -> DataFrame:
    """REL-01."""
    return _shown(_joined(t, r, genre, min_votes).where(F.col("rating") >= min_rating))


def top_rated(t: DataFrame, r: DataFrame, min_votes: int = 1000, n: int = 100, genre: str = "Horror") -> DataFrame:
    """REL-02: take-ordered, ties by votes and id."""
    return _shown(_joined(t, r, genre, min_votes)).orderBy(F.desc_nulls_last("rating"), F.desc("votes"), "imdb_id").limit(n)


def by_decade(t: DataFrame, r: DataFrame, start: int, min_votes: int = 500, genre: str = "Horror") -> DataFrame:
    """REL-03: years start..start+9."""
    return _shown(_joined(t, r, genre, min_votes).where(F.col("premiered").between(start, start + 9)))


def statistics(t: DataFrame, r: DataFrame, min_votes: int = 1000, genre: str = "Horror") -> DataFrame:
    """REL-04: one row, also over nothing."""
    return _joined(t, r, genre, min_votes).agg(
        F.count("*").alias("total_movies"), mean("rating", 2).alias("avg_rating"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"), mean("votes", 0).alias("avg_votes"),
        F.min("premiered").alias("earliest_year"), F.max("premiered").alias("latest_year"), mean("runtime_minutes", 0).alias("avg_runtime"),
    )


def count_by_decade(t: DataFrame, r: DataFrame, min_votes: int = 500, genre: str = "Horror") -> DataFrame:
    """REL-05."""
    y = F.col("premiered").cast("long")
    return _joined(t, r, genre, min_votes).where(F.col("premiered").isNotNull()).groupBy((y - y % 10).alias("decade")).agg(F.count("*").alias("movie_count"), mean("rating", 2).alias("avg_rating"))


def count_by_genres(t: DataFrame, r: DataFrame, min_votes: int = 1000, least: int = 10, genre: str = "Horror") -> DataFrame:
    """REL-06."""
    return _joined(t, r, genre, min_votes).groupBy("genres").agg(F.count("*").alias("movie_count"), mean("rating", 2).alias("avg_rating")).where(F.col("movie_count") >= least)


def above_average(t: DataFrame, r: DataFrame, min_votes: int = 1000, genre: str = "Horror") -> DataFrame:
    """REL-07: one scalar (a single row) is broadcast."""
    j = _joined(t, r, genre, min_votes)
    level = j.agg(F.avg("rating").alias("_mean"))
    return j.join(F.broadcast(level), F.col("rating") > F.col("_mean")).select(F.col("title_id").alias("imdb_id"), F.col("primary_title").alias("title"), F.col("premiered").alias("year"), "rating", "votes")


def top_people(t: DataFrame, r: DataFrame, crew: DataFrame, people: DataFrame, role: str = "director", least: int = 3, min_votes: int = 1000, n: int = 50, genre: str = "Horror") -> DataFrame:
    """REL-08: four-way join; someone credited twice on one title counts twice."""
    j = _joined(t, r, genre, min_votes).join(crew.where(F.col("category") == role), "title_id").join(people, "name_id")
    g = j.groupBy("name_id", "name").agg(F.count("*").alias("film_count"), mean("rating", 2).alias("avg_rating")).where(F.col("film_count") >= least)
    return g.orderBy(F.desc("film_count"), F.desc_nulls_last("avg_rating"), "name").limit(n).select("name", "film_count", "avg_rating")


def for_enrichment(t: DataFrame, r: DataFrame, ids: DataFrame) -> DataFrame:
    """REL-09: ids as a DataFrame; an empty one gives nothing."""
    return _shown(t.join(ids.select(F.col(ids.columns[0]).alias("title_id")).distinct(), "title_id", "left_semi").join(r, "title_id"))


def distinct_ids(t: DataFrame, r: DataFrame, min_votes: int = 100, genre: str = "Horror") -> DataFrame:
    """REL-10."""
    return _joined(t, r, genre, min_votes).select(F.col("title_id").alias("imdb_id")).distinct()


def bundle(t: DataFrame, r: DataFrame, min_votes: int = 1000) -> DataFrame:
    """REL-11: total, first of the top ten, and films of the eighties in one row each."""
    stat = statistics(t, r, min_votes).select(F.lit("total").alias("item"), F.col("total_movies").cast("string").alias("value"))
    best = top_rated(t, r, min_votes, 10).select(F.lit("top").alias("item"), F.col("imdb_id").alias("value"))
    return stat.unionByName(best).unionByName(by_decade(t, r, 1980, min_votes).agg(F.count("*").cast("string").alias("value")).select(F.lit("eighties").alias("item"), "value"))


def contains(c: Column, part: str) -> Column:
    """Case-insensitive substring test that takes % and _ literally."""
    return F.contains(F.lower(c), F.lit(part.lower()))
