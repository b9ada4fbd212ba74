"""Building retrieval documents from film records (FUN-29..32, 34, 42, 43)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.cleaning import content_hash, strip


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _list(label: str, arr: Column, n: int | None = None) -> Column:
    items = arr if n is None else F.slice(arr, 1, n)
    return F.when(F.size(F.coalesce(arr, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))


def double_title() -> Column:
    """The title, with the French one where it differs."""
    fr = (F.coalesce("title_fr", F.lit("")) != "") & (F.col("title_fr") != F.col("title"))
    return F.when(fr, F.concat_ws(" / ", "title", "title_fr")).otherwise(F.coalesce("title", F.lit("")))


def title_line() -> Column:
    year = F.coalesce(F.substring(F.col("release_date").cast("string"), 1, 4), F.lit(""))
    return F.concat(double_title(), F.lit(" ("), year, F.lit(") - Genres: "), F.array_join(F.coalesce("genres", F.array().cast("array<string>")), ", "))


def header() -> Column:
    """FUN-30: title line, then the lines that have content, with their limits."""
    director = F.when(F.coalesce("director", F.lit("")) != "", F.concat(F.lit("Director: "), "director"))
    return F.concat_ws("\n", title_line(), _list("Alternative titles: ", F.col("alternative_titles"), 5), _list("Keywords: ", F.col("keywords"), 15), director, _list("Cast: ", F.col("cast"), 5))


def embed_text(body: Column) -> Column:
    return F.concat_ws("\n", title_line(), F.when(F.coalesce(body, F.lit("")) != "", body), _list("Keywords: ", F.col("keywords"), 15))


def combined_text() -> Column:
    """FUN-29: one text of all parts, joined by spaces."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    other = F.when((F.coalesce("overview_fr", F.lit("")) != "") & ~F.col("overview_fr").eqNullSafe(F.col("overview")), F.col("overview_fr"))
    director = F.when(F.coalesce("director", F.lit("")) != "", F.concat(F.lit("Director: "), "director"))
    return F.concat_ws(" ", double_title(), some("critics_consensus"), some("overview"), other, some("tagline"), director, _list("Cast: ", F.col("cast"), 5), _list("Keywords: ", F.col("keywords"), 15), _list("Alternative titles: ", F.col("alternative_titles"), 5))


METADATA = ["title", "title_fr", "alternative_titles", "genres", "keywords", "director", "runtime", "vote_average"]


def metadata() -> Column:
    """FUN-32: what the retriever filters on and shows, as JSON."""
    return F.to_json(F.struct(*[F.col(c) for c in METADATA], F.substring(F.col("release_date").cast("string"), 1, 4).alias("year")))


def short_film(runtime: Column) -> Column:
    """FLT-15: 0 < runtime < 40; unknown runtimes are kept."""
    return (F.coalesce(runtime, F.lit(0)) > 0) & (F.coalesce(runtime, F.lit(0)) < 40)


def film_documents(films: DataFrame) -> DataFrame:
    """FUN-31: overview and consensus documents of each film; a metadata one only where it has neither; none of short films."""
    o, ofr, con, tag = (strip(F.col(c)) for c in ("overview", "overview_fr", "critics_consensus", "tagline"))
    two = F.concat_ws("\n", o, F.when(~_blank(ofr) & (ofr != o), ofr))
    over = F.when(~_blank(F.col("overview")), F.struct(F.lit("film_overview").alias("source_type"), F.concat_ws("\n", header(), two, F.when(~_blank(tag), F.concat(F.lit("Tagline: "), tag))).alias("content"), embed_text(two).alias("embed_text")))
    says = F.concat(F.lit("Critique: "), con)
    crit = F.when(~_blank(F.col("critics_consensus")), F.struct(F.lit("critics_consensus").alias("source_type"), F.concat_ws("\n", header(), says).alias("content"), embed_text(says).alias("embed_text")))
    bare = F.when(over.isNull() & crit.isNull(), F.struct(F.lit("film_metadata").alias("source_type"), header().alias("content"), embed_text(F.lit(None).cast("string")).alias("embed_text")))
    docs = films.where(F.col("tmdb_id").isNotNull() & ~short_film(F.col("runtime"))).select(F.col("tmdb_id").alias("source_id"), metadata().alias("metadata"), F.explode(F.array_compact(F.array(over, crit, bare))).alias("d"))
    return docs.select("source_id", "d.source_type", "d.content", "d.embed_text", "metadata", content_hash(F.col("d.content")).alias("content_hash"))


def change_plan(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """FUN-34: each stored or rebuilt document as unchanged, changed, new or orphan, by content hash."""
    a = old.select(*keys, F.col("content_hash").alias("_old"))
    b = new.select(*keys, F.col("content_hash").alias("_new"))
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "orphan").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def prompt_context(docs: DataFrame, by: list[str]) -> DataFrame:
    """FUN-42: ranked documents of each query as one numbered context; unknown year and rating are left out."""
    year = F.get_json_object("metadata", "$.year")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.get_json_object("metadata", "$.title"), F.lit("")), F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""), F.lit("\n"), F.col("content"))
    return docs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def response_sources(similarity: Column, rerank: Column) -> Column:
    """FUN-43."""
    return F.struct(F.round(similarity, 4).alias("similarity"), F.round(rerank, 4).alias("rerank"))
