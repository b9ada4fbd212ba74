"""Raw records of each source to stored ones, behind their validity gates (FUN-25..27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import cleaning as c
from loomframe.operators.analytics import rating_category


def renamed(items: Column, kind: str) -> Column:
    """FUN-25: genres, keywords and companies with the id under the kind's name; an empty name is null. Null gives none."""
    one = lambda x: F.struct(x["id"].alias(f"tmdb_{kind}_id"), c.clean_string(x["name"]).alias("name"))
    with_country = lambda x: F.struct(x["id"].alias(f"tmdb_{kind}_id"), c.clean_string(x["name"]).alias("name"), x["origin_country"].alias("origin_country"))
    return F.coalesce(F.transform(items, with_country if kind == "company" else one), F.array())


def languages(items: Column) -> Column:
    """FUN-25: the English name of a language comes before its own."""
    return F.coalesce(F.transform(items, lambda x: F.struct(x["iso_639_1"].alias("iso_639_1"), F.coalesce(F.nullif(x["english_name"], F.lit("")), x["name"]).alias("name"))), F.array())


def film_records(raw: DataFrame, source: str = "tmdb_discover") -> DataFrame:
    """FUN-26: defaults, cleaning and French fields; rows without an id are left out.

    `raw` may hold `translations` and regional `alternative_titles` (arrays of structs); without them the
    French fields are null and empty.
    """
    has = set(raw.columns)
    col = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    or_ = lambda name, kind, default: F.coalesce(col(name, kind), F.lit(default).cast(kind)).alias(name)
    french = lambda f: c.french(F.col("translations"), f) if "translations" in has else F.lit(None).cast("string")
    other = c.regional_titles(F.col("alternative_titles")) if "alternative_titles" in has else F.array().cast("array<string>")
    return raw.where(F.col("id").isNotNull()).select(
        F.col("id").alias("tmdb_id"), col("imdb_id", "string").alias("imdb_id"), c.clean_string(F.col("title")).alias("title"), col("original_title", "string").alias("original_title"),
        c.iso_date(col("release_date", "string").cast("string")).alias("release_date"), col("tagline", "string").alias("tagline"), c.clean_string(col("overview", "string")).alias("overview"),
        or_("popularity", "double", 0.0), or_("vote_average", "double", 0.0), or_("vote_count", "int", 0), c.in_range(col("runtime", "int"), 1, 1000).alias("runtime"), col("original_language", "string").alias("original_language"),
        or_("status", "string", "Unknown"), or_("adult", "boolean", False), or_("budget", "long", 0), or_("revenue", "long", 0), F.lit(source).alias("source"),
        french("title").alias("title_fr"), french("overview").alias("overview_fr"), other.alias("alternative_titles"),
    )


def gated(df: DataFrame, ok: Column, counts=None) -> DataFrame:  # noqa: ANN001
    """Rows that pass; an Observation counts both kinds in the same pass."""
    ok = F.coalesce(ok, F.lit(False))
    seen = df if counts is None else df.observe(counts, F.count_if(ok).alias("normalized"), F.count_if(~ok).alias("skipped"))
    return seen.where(ok)


def csv_records(raw: DataFrame, counts=None) -> DataFrame:  # noqa: ANN001
    """FUN-27, csv exports: an id other than 0 and a title are needed."""
    ok = (F.col("id") != 0) & c.clean_string(F.col("title")).isNotNull()
    return gated(raw, ok, counts).select(
        F.col("id").alias("tmdb_id"), c.clean_string(F.col("title")).alias("title"), c.clean_language(F.col("original_language")).alias("original_language"), c.clean_text(F.col("overview")).alias("overview"),
        c.date_or_year(F.col("release_date").cast("string")).alias("release_date"), c.safe_float(F.col("popularity"), default=0.0).alias("popularity"), c.safe_int(F.col("vote_count")).alias("vote_count"),
        c.safe_int(F.col("budget")).alias("budget"), c.safe_positive(F.col("runtime")).alias("runtime"), F.coalesce(F.nullif("status", F.lit("")), F.lit("Released")).alias("status"), F.lit("kaggle").alias("source"),
    )


def enriched_records(raw: DataFrame, counts=None) -> DataFrame:  # noqa: ANN001
    """FUN-27, enriched rows: a positive id, a title, a rating and votes are needed; a rating label given stays."""
    ok = (F.col("kaggle_id") > 0) & c.clean_string(F.col("title")).isNotNull() & F.col("rating").isNotNull() & F.col("votes").isNotNull()
    return gated(raw, ok, counts).select(
        "kaggle_id", c.clean_string(F.col("title")).alias("title"), F.col("release_year").cast("int").alias("release_year"), F.round("rating", 2).alias("rating"), c.safe_int(F.col("votes")).alias("votes"),
        c.in_range(F.col("runtime"), 1, 600).alias("runtime"), c.clean_string(F.col("overview")).alias("overview"), F.coalesce(F.nullif("rating_category", F.lit("")), rating_category(F.col("rating"))).alias("rating_category"), F.lit("spark").alias("source"),
    )


def imdb_ratings(raw: DataFrame, counts=None) -> DataFrame:  # noqa: ANN001
    """FUN-27, imdb rows: a well-formed id, a rating and votes are needed."""
    ok = c.valid_imdb(F.col("imdb_id"), strict=False) & F.col("imdb_rating").isNotNull() & F.col("imdb_votes").isNotNull()
    return gated(raw, ok, counts).select("imdb_id", F.round("imdb_rating", 1).alias("imdb_rating"), c.safe_int(F.col("imdb_votes")).alias("imdb_votes"), c.in_range(F.col("runtime"), 1, 600).alias("runtime"))


def rt_scores(raw: DataFrame, counts=None) -> DataFrame:  # noqa: ANN001
    """FUN-27, scraped scores: one of the two scores is needed."""
    ok = F.col("tomatometer_score").isNotNull() | F.col("audience_score").isNotNull()
    return gated(raw, ok, counts).select(
        "rec_id", c.in_range(F.col("tomatometer_score"), 0, 100).alias("tomatometer_score"), c.state(F.col("tomatometer_state")).alias("tomatometer_state"), F.coalesce("critics_count", F.lit(0)).alias("critics_count"),
        c.in_range(F.col("audience_score"), 0, 100).alias("audience_score"), F.coalesce("audience_count", F.lit(0)).alias("audience_count"), c.consensus(F.col("critics_consensus")).alias("critics_consensus"), "rt_url",
    )
