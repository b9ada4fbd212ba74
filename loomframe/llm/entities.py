"""Matching films across tables that share no key.

Records of films, imdb and rt become (key, source, title words, sequel, year, runtime). A join of
equal names and sorted neighbourhoods over three composite keys give candidates; weighted field similarities give a
confidence; film and imdb records are assigned one to one with the greatest total confidence.
One film may be scraped more than once, so each rt record takes its best film, and pairs of imdb
and rt follow from their common film, or directly where no film has either.

Defined cases: records without a usable title take part by their ids only; repeated rows are one
record (the latest film row, the row with most votes); null keys are no records; two films of
one title and no other evidence are told apart by nothing, then the smaller key wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm import matching as m
from loomframe.session import cut

WINDOW = 10
LEAST = 0.65
ROMANS = ''.join(f' {r} ' for r in m.ROMAN)
YEARS = 1  # difference in years that still is the same film


def film_records(films: DataFrame) -> DataFrame:
    cols = ["title", "original_title", "title_fr", "alternative_titles", "release_date", "runtime", "tmdb_id", "imdb_id"]
    one = films.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("updated_at", "vote_count")).alias("f")).select("id", "f.*")
    titles = F.array_compact(F.concat(F.array("title", "original_title", "title_fr"), F.coalesce("alternative_titles", F.array())))
    return one.select(
        F.concat(F.lit("film:"), F.col("id")).alias("key"), F.lit("film").alias("src"), F.array_distinct(titles).alias("titles"), F.year("release_date").alias("year"),
        F.when(F.col("runtime") > 0, F.col("runtime")).alias("runtime"), F.col("tmdb_id").cast("long").alias("tmdb"), _imdb("imdb_id").alias("imdb"),
    )


def _imdb(c: str):  # noqa: ANN202
    n = F.regexp_extract(F.col(c), r"(\d{5,})", 1)
    return F.when(F.regexp_replace(n, "^0+", "") != "", F.regexp_replace(n, "^0+", ""))


def imdb_records(imdb: DataFrame) -> DataFrame:
    one = imdb.where(F.col("imdb_id").isNotNull()).groupBy("imdb_id").agg(F.max_by(F.struct("title", "year", "runtime", "tmdb_id"), F.struct(F.coalesce("imdb_votes", F.lit(-1)), "title")).alias("f")).select("imdb_id", "f.*")
    return one.select(
        F.concat(F.lit("imdb:"), F.col("imdb_id")).alias("key"), F.lit("imdb").alias("src"), F.array_compact(F.array("title")).alias("titles"), F.col("year").cast("int").alias("year"),
        F.when(F.col("runtime") > 0, F.col("runtime")).alias("runtime"), F.col("tmdb_id").cast("long").alias("tmdb"), _imdb("imdb_id").alias("imdb"),
    )


def rt_records(rt: DataFrame) -> DataFrame:
    """Title and, where it ends with one, year from the many shapes of rt_url."""
    slug = F.lower(F.regexp_extract(F.regexp_replace("rt_url", "%20", " "), r"/m/([^/?#]+)", 1))
    slug = F.regexp_replace(F.regexp_replace(slug, r"^\d{4,}-", ""), r"[_\-+]+", " ")
    year = F.regexp_extract(slug, r" ((?:19|20)\d\d)$", 1)
    title = F.regexp_replace(slug, r" (?:19|20)\d\d$", "")
    return rt.where(F.col("rec_id").isNotNull()).select(
        F.concat(F.lit("rt:"), F.col("rec_id")).alias("key"), F.lit("rt").alias("src"), F.when(F.coalesce(title, F.lit("")) != "", F.array(title)).otherwise(F.array().cast("array<string>")).alias("titles"),
        F.when(year != "", year.cast("int")).alias("year"), F.lit(None).cast("int").alias("runtime"), F.col("tmdb_id").cast("long").alias("tmdb"), F.lit(None).cast("string").alias("imdb"),
    )


def candidates(records: DataFrame) -> DataFrame:
    """Scored pairs (x, y, conf) of records of different sources, x < y.

    Records that look the same are compared once, by their smallest key. Equal names meet by an exact join, near ones in windows.
    """
    words = records.select("key", "src", "year", "runtime", F.explode("titles").alias("title")).select("key", "src", "year", "runtime", m.title_words(F.col("title")).alias("words")).where(F.size("words") > 0)
    words = cut(words.withColumn("part", m.sequel(F.col("words"))))
    names = m.with_names(words.select("key", "words"))
    facts = words.groupBy("key").agg(F.first("src").alias("src"), F.max("part").alias("part"), F.first("year", True).alias("year"), F.first("runtime", True).alias("runtime"), F.array_sort(F.collect_set("words")).alias("titles"))
    facts = cut(facts)
    members = cut(m.alike(facts, ["src", "part", "year", "runtime", "titles"]))
    entry = names.join(facts.join(members.select(F.col("rep").alias("key")).distinct(), "key"), "key")
    tail = F.concat_ws("|", F.col("part").cast("string"), F.lpad(F.coalesce(F.col("year"), F.lit(0)).cast("string"), 4, "0"))
    # what only depends on a record is worked out before pairs multiply it
    entry = entry.withColumn("rest", m.other_words(F.col("titles"), F.col("name"), ROMANS)).withColumn("same", m.same_words(F.col("rest")))
    entry = entry.select(F.struct("key", "src", "name", "part", "year", "runtime", "rest", "same").alias("rec"), F.explode(m.sort_keys(F.col("name"), tail)).alias("k")).select("k.kind", "k.sort", "rec")
    entry = cut(entry)
    pairs = m.near_names(entry, WINDOW).unionByName(m.equal_names(entry.where(F.col("kind") == 1), YEARS)).where((F.col("x.src") != F.col("y.src")) & (F.col("x.part") == F.col("y.part")))
    dy, dr = F.abs(F.col("x.year") - F.col("y.year")), F.abs(F.col("x.runtime") - F.col("y.runtime"))
    pairs = pairs.withColumn("d", m.edits(F.col("x.name"), F.col("y.name"))).where(F.col("d").isNotNull() & (dy.isNull() | (dy <= YEARS)))
    best = F.array_max(F.flatten(F.transform("x.rest", lambda p: F.transform(F.col("y.rest"), lambda q: m.agreement(p, q)))))
    best = F.when(F.arrays_overlap("x.same", "y.same"), 1.0).otherwise(best)
    near = 1 - F.col("d") / F.greatest(F.length("x.name"), F.length("y.name"))
    years = F.when(dy == 0, 1.0).when(dy == 1, 0.85)
    runs = F.when(dr <= 2, 1.0).when(dr <= 5, 0.7).when(dr.isNotNull(), 0.2)
    pairs = pairs.withColumn("rest", best).withColumn("dy", dy).withColumn("dr", dr).withColumn("conf", m.weighted([(0.5, near), (0.15, F.col("rest")), (0.2, years), (0.15, runs)]))
    # a wrong letter is taken for a typing error unless the other words or, where known, year and runtime speak
    # against it; where the words may be translations, or three letters are wrong, more must agree
    year, run = F.col("dy").isNotNull(), F.coalesce(F.col("dr") <= 2, F.lit(False))
    bare = (F.col("x.src") == "rt") | (F.col("y.src") == "rt")  # has no runtime, and mostly no year
    known = year | run | F.col("dr").isNull()
    agree, open_ = F.coalesce(F.col("rest") > 0, F.lit(False)), F.col("rest").isNull()
    typo = (F.col("d") <= 2) & ((agree & known) | (open_ & (((F.col("d") == 1) & (year | run | bare)) | (year & run))))
    far = (F.col("d") == 3) & year & run & agree
    kept = pairs.where((F.col("conf") >= LEAST) & ((F.col("d") == 0) | typo | far))
    a, b = F.least("x.key", "y.key"), F.greatest("x.key", "y.key")
    kept = kept.groupBy(a.alias("a"), b.alias("b")).agg(F.max("conf").alias("conf"))
    of = lambda rep, key: members.select(F.col("rep").alias(rep), F.col("key").alias(key))
    return kept.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y", "conf")


def _best(pairs: DataFrame, by: str, other: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("conf"), other)
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def match_films(films: DataFrame, imdb: DataFrame, rt: DataFrame) -> DataFrame:
    """(key_a, key_b, confidence) of records of two tables that describe one film."""
    f, i, r = film_records(films), imdb_records(imdb), rt_records(rt)
    every = cut(f.unionByName(i).unionByName(r))
    scored = candidates(every)
    ids = every.select("key", "src", "tmdb", "imdb")
    x, y = ids.where(F.col("src") == "film"), ids.where(F.col("src") != "film")
    linked = x.where(F.col("tmdb").isNotNull()).select(F.col("key").alias("x"), "tmdb").join(y.where(F.col("tmdb").isNotNull()).select(F.col("key").alias("y"), "tmdb"), "tmdb").select("x", "y")
    named = x.where(F.col("imdb").isNotNull()).select(F.col("key").alias("x"), "imdb").join(y.where(F.col("imdb").isNotNull()).select(F.col("key").alias("y"), "imdb"), "imdb").select("x", "y")
    known = linked.unionByName(named).distinct().withColumn("conf", F.lit(1.0))
    both = cut(scored.unionByName(known).groupBy("x", "y").agg(F.max("conf").alias("conf")))
    is_ = lambda c, s: F.col(c).startswith(s + ":")
    pair = m.assign(both.where(is_("x", "film") & is_("y", "imdb")).select(F.col("x").alias("l"), F.col("y").alias("r"), "conf"))
    pair = cut(pair)
    scraped = cut(_best(both.where(is_("x", "film") & is_("y", "rt")), "y", "x"))
    via = pair.join(scraped.select(F.col("x").alias("l"), "y", F.col("conf").alias("c2")), "l").select(F.col("r").alias("x"), "y", F.least("conf", "c2").alias("conf"))
    loose = both.where(is_("x", "imdb") & is_("y", "rt")).join(pair.select(F.col("r").alias("x")), "x", "left_anti").join(scraped.select("y"), "y", "left_anti").select("x", "y", "conf")
    out = pair.select(F.col("l").alias("x"), F.col("r").alias("y"), "conf").unionByName(scraped.select("x", "y", "conf")).unionByName(via).unionByName(_best(loose, "y", "x"))
    return out.groupBy(F.col("x").alias("key_a"), F.col("y").alias("key_b")).agg(F.max("conf").alias("confidence"))
