"""FLT, JOI, AGG, WIN, TOP, SET, DED, SNK, FUN queries over the film tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.numbers import mean
from loomframe.functions import cleaning as c
from loomframe.functions import documents as doc
from loomframe.operators import aggregates as g
from loomframe.operators import dedup, joins, lookup, upserts
from loomframe.operators.analytics import latest
from loomframe.session import table

V = "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vote_count DESC NULLS LAST) AS _rn FROM films) WHERE _rn = 1)\n"
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def films(spark, d) -> DataFrame:  # noqa: ANN001
    return latest(table(spark, d, "films"))


def _pop() -> list:
    return [F.desc_nulls_last("popularity"), "id"]


@query("flt01_by_id", V + "SELECT id, title FROM f WHERE id = 343")
def _(s, d):
    return lookup.by_id(films(s, d), "id", 343).select("id", "title")


@query("flt02_by_field", V + "SELECT id, title FROM f WHERE original_language = 'fr' ORDER BY id LIMIT 25")
def _(s, d):
    return lookup.by_field(films(s, d), "original_language", "fr", ["id"], 25).select("id", "title")


@query("flt03_page", V + "SELECT id, title FROM f ORDER BY popularity DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def _(s, d):
    return lookup.page(films(s, d).select("id", "title", "popularity"), _pop(), 3, 20).select("id", "title")


@query("flt03_pages", V + "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM f")
def _(s, d):
    return lookup.pages(films(s, d), 20)


@query("flt04_title_search", V + "SELECT id, title FROM f WHERE contains(lower(title), 'widow') ORDER BY popularity DESC NULLS LAST, id LIMIT 20")
def _(s, d):
    return lookup.search(films(s, d), "title", "Widow", _pop()).select("id", "title")


@query("flt05_person_search", "SELECT DISTINCT director FROM aggregated_films WHERE contains(lower(director), 'stenra') OR contains(lower(director), 'udra') ORDER BY director LIMIT 40")
def _(s, d):
    a = table(s, d, "aggregated_films").select("director").distinct()
    return a.where(F.contains(F.lower("director"), F.lit("stenra")) | F.contains(F.lower("director"), F.lit("udra"))).orderBy("director").limit(40)


@query("flt06_same_name", "SELECT id, name FROM spoken_languages WHERE lower(name) = 'english'")
def _(s, d):
    return lookup.same_name(table(s, d, "spoken_languages"), "name", "ENGLISH").select("id", "name")


@query("flt07_in_year", V + "SELECT id, CAST(release_date AS VARCHAR) AS day FROM f WHERE release_date BETWEEN DATE '2004-01-01' AND DATE '2004-12-31' ORDER BY popularity DESC NULLS LAST, id LIMIT 100")
def _(s, d):
    return lookup.in_year(films(s, d), "release_date", 2004, _pop()).select("id", F.col("release_date").cast("string").alias("day"))


@query("flt08_top_rated", V + "SELECT id, vote_average FROM f WHERE vote_count >= 20 ORDER BY vote_average DESC NULLS LAST, id LIMIT 50")
def _(s, d):
    return lookup.top(films(s, d), F.col("vote_count") >= 20, [F.desc_nulls_last("vote_average"), "id"]).select("id", "vote_average")


@query("flt09_children", "SELECT link_id, language_id FROM film_languages WHERE film_id = 268 ORDER BY link_id LIMIT 10")
def _(s, d):
    return lookup.children(table(s, d, "film_languages"), "film_id", 268, ["link_id"], n=10).select("link_id", "language_id")


@query("flt10_keys", "SELECT DISTINCT film_id FROM rt_scores WHERE film_id IS NOT NULL")
def _(s, d):
    return lookup.keys(table(s, d, "rt_scores"), "film_id")


@query("flt11_id_map", V + "SELECT lower(title) AS name, min(id) AS id FROM f WHERE title IS NOT NULL GROUP BY 1")
def _(s, d):
    return lookup.id_map(films(s, d), "title", "id", lower=True)


@query("flt12_recent", "SELECT id, tomatometer_state FROM rt_scores WHERE tomatometer_state = 'fresh' ORDER BY updated_at DESC, id LIMIT 15")
def _(s, d):
    return lookup.top(table(s, d, "rt_scores"), F.col("tomatometer_state") == "fresh", [F.desc("updated_at"), "id"], 15).select("id", "tomatometer_state")


@query("flt13_get_or_create", V + """, k AS (SELECT k AS name, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS id FROM (SELECT DISTINCT unnest(keywords) AS k FROM f WHERE id % 2 = 0)),
w AS (SELECT DISTINCT unnest(keywords) AS name FROM f), n AS (SELECT name FROM w WHERE name NOT IN (SELECT name FROM k))
SELECT w.name, k.id, false AS created FROM w JOIN k USING (name) UNION ALL SELECT name, CAST(row_number() OVER (ORDER BY name) + (SELECT coalesce(max(id), 0) FROM k) AS BIGINT), true FROM n""")
def _(s, d):
    from loomframe.operators.ordered import row_numbers

    f = films(s, d)
    some = f.where(F.col("id") % 2 == 0).select(F.explode("keywords").alias("name")).distinct()
    return lookup.get_or_create(row_numbers(some, ["name"], "id"), f.select(F.explode("keywords").alias("name")), "name", "id")


@query("flt14_sorted", "SELECT id, name FROM spoken_languages ORDER BY name")
def _(s, d):
    return table(s, d, "spoken_languages").orderBy("name").select("id", "name")


@query("flt15_short_films", V + "SELECT count(*) FILTER (WHERE coalesce(runtime, 0) > 0 AND runtime < 40) AS short, count(*) FILTER (WHERE NOT (coalesce(runtime, 0) > 0 AND coalesce(runtime, 0) < 40)) AS kept FROM f")
def _(s, d):
    x = doc.short_film(F.col("runtime"))
    return films(s, d).agg(F.count_if(x).alias("short"), F.count_if(~x).alias("kept"))


@query("joi01_inner", V + "SELECT f.id, l.language_id, s.name FROM f JOIN film_languages l ON l.film_id = f.id JOIN spoken_languages s ON s.id = l.language_id")
def _(s, d):
    lang = table(s, d, "spoken_languages").select(F.col("id").alias("language_id"), "name")  # 12 rows, fixed
    return films(s, d).select("id").join(table(s, d, "film_languages").select(F.col("film_id").alias("id"), "language_id"), "id").join(F.broadcast(lang), "language_id").select("id", "language_id", "name")


@query("joi02_left", V + "SELECT f.id, r.tomatometer_score AS score FROM f LEFT JOIN rt_scores r ON r.film_id = f.id")
def _(s, d):
    return films(s, d).select("id").join(table(s, d, "rt_scores").select(F.col("film_id").alias("id"), F.col("tomatometer_score").alias("score")), "id", "left")


@query("joi03_anti", V + "SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM rt_scores r WHERE r.film_id = f.id)")
def _(s, d):
    return joins.without(films(s, d).select("id"), table(s, d, "rt_scores").select(F.col("film_id").alias("id")), ["id"])


@query("joi04_not_in", V + "SELECT id FROM f WHERE id NOT IN (SELECT film_id FROM rt_scores WHERE film_id IS NOT NULL) AND source = 'tmdb'")
def _(s, d):
    return joins.not_in(films(s, d).where(F.col("source") == "tmdb").select("id"), "id", table(s, d, "rt_scores").where(F.col("film_id").isNotNull()), "film_id")


@query("joi04_not_in_null", V + "SELECT count(*) AS n FROM f WHERE id NOT IN (SELECT film_id FROM rt_scores)")
def _(s, d):
    return joins.not_in(films(s, d).select("id"), "id", table(s, d, "rt_scores"), "film_id").agg(F.count("*").alias("n"))


@query("joi06_semi", V + "SELECT id FROM f WHERE tmdb_id IN (SELECT source_id FROM rag_documents)")
def _(s, d):
    return joins.within(films(s, d).select("id", F.col("tmdb_id").alias("source_id")), table(s, d, "rag_documents"), ["source_id"]).select("id")


@query("joi07_two_keys", V + """, r AS (SELECT * FROM aggregated_films), a AS (SELECT tmdb_id, arg_max(struct_pack(s := imdb_rating, i := rec_id), rec_id) AS m FROM r WHERE tmdb_id <> 0 GROUP BY 1),
b AS (SELECT imdb_id, arg_max(struct_pack(s := imdb_rating, i := rec_id), rec_id) AS m FROM r WHERE imdb_id <> '' AND imdb_id <> '0' GROUP BY 1)
SELECT f.id, coalesce(a.m, b.m).i AS rec_id, coalesce(a.m, b.m).s AS imdb_rating FROM f LEFT JOIN a ON a.tmdb_id = f.tmdb_id LEFT JOIN b ON b.imdb_id = f.imdb_id""")
def _(s, d):
    r = table(s, d, "aggregated_films").select("tmdb_id", "imdb_id", "imdb_rating", "rec_id", F.col("rec_id").alias("pos"))
    m = joins.two_key_match(films(s, d).select("id", "tmdb_id", "imdb_id"), r, "tmdb_id", "imdb_id", "pos", ["rec_id", "imdb_rating"])
    return m.select("id", "match.rec_id", "match.imdb_rating")


_A = "SELECT tmdb_id, arg_max(struct_pack(v := {v}), rec_id).v AS v FROM aggregated_films WHERE list_contains(sources, '{s}') AND tmdb_id <> 0 GROUP BY 1"
_B = "SELECT imdb_id, arg_max(struct_pack(v := {v}), rec_id).v AS v FROM aggregated_films WHERE list_contains(sources, '{s}') AND imdb_id NOT IN ('', '0') GROUP BY 1"


def _fold_sql() -> str:
    plan = [("rt", "rt", "tomatometer_score"), ("im", "imdb", "imdb_rating"), ("ka", "kaggle", "vote_average"), ("sp", "spark", "aggregated_score")]
    ctes = "".join(f", {k}1 AS ({_A.format(v=v, s=x)}), {k}2 AS ({_B.format(v=v, s=x)})" for k, x, v in plan)
    has = {k: f"({k}1.tmdb_id IS NOT NULL OR {k}2.imdb_id IS NOT NULL)" for k, _, _ in plan}
    val = {k: f"CASE WHEN {k}1.tmdb_id IS NOT NULL THEN {k}1.v ELSE {k}2.v END" for k, _, _ in plan}
    tables = " ".join(f"LEFT JOIN {k}1 ON {k}1.tmdb_id = f.tmdb_id LEFT JOIN {k}2 ON {k}2.imdb_id = f.imdb_id" for k, _, _ in plan)
    names = {"rt": "rotten_tomatoes", "im": "imdb", "ka": "kaggle", "sp": "spark"}
    src = " || ".join(["'tmdb'"] + [f"CASE WHEN {has[k]} THEN ',{names[k]}' ELSE '' END" for k, _, _ in plan])
    return V + ctes + f" SELECT f.id, {val['rt']} AS tomatometer_score, {val['im']} AS imdb_rating, {val['ka']} AS kaggle_rating, {val['sp']} AS spark_rating, {src} AS sources, " + " + ".join(f"CAST({has[k]} AS INT)" for k, _, _ in plan) + f" AS enrichment_count FROM f {tables}"


@query("joi08_enrich_fold", _fold_sql())
def _(s, d):
    a = table(s, d, "aggregated_films").withColumn("pos", F.col("rec_id"))
    part = lambda x, v, n: a.where(F.array_contains("sources", x)).select("tmdb_id", "imdb_id", "pos", F.col(v).alias(n), F.lit(None).cast("string").alias("overview"))
    out = joins.enrich_fold(films(s, d).select("id", "tmdb_id", "imdb_id", "overview"), part("rt", "tomatometer_score", "tomatometer_score"), part("imdb", "imdb_rating", "imdb_rating"), part("kaggle", "vote_average", "kaggle_rating"), part("spark", "aggregated_score", "spark_rating"))
    return out.select("id", "tomatometer_score", "imdb_rating", "kaggle_rating", "spark_rating", F.array_join("sources", ",").alias("sources"), "enrichment_count")


@query("joi10_enrich_or_insert", V + """, k AS (SELECT tmdb_id, max(budget) AS nb FROM aggregated_films WHERE budget > 0 GROUP BY 1)
SELECT coalesce(f.tmdb_id, k.tmdb_id) AS tmdb_id, CASE WHEN coalesce(f.budget, 0) = 0 AND nb > 0 THEN nb ELSE f.budget END AS budget, f.id IS NULL AS created FROM f FULL JOIN k USING (tmdb_id)""")
def _(s, d):
    k = table(s, d, "aggregated_films").where(F.col("budget") > 0).groupBy("tmdb_id").agg(F.max("budget").alias("nb"))
    j = films(s, d).select("id", "tmdb_id", "budget").join(k, "tmdb_id", "full")
    return j.select("tmdb_id", upserts.fill_amount(F.col("budget"), F.col("nb")).alias("budget"), F.col("id").isNull().alias("created"))


@query("joi11_fill_runtime", V + ", k AS (SELECT tmdb_id, max(runtime) AS n FROM aggregated_films WHERE runtime BETWEEN 1 AND 600 GROUP BY 1) SELECT f.id, coalesce(f.runtime, k.n) AS runtime FROM f LEFT JOIN k USING (tmdb_id)")
def _(s, d):
    k = table(s, d, "aggregated_films").where(F.col("runtime").between(1, 600)).groupBy("tmdb_id").agg(F.max("runtime").alias("runtime"))
    return films(s, d).select("id", "tmdb_id", F.col("runtime").alias("old")).join(k, "tmdb_id", "left").select("id", F.coalesce("old", "runtime").alias("runtime"))


@query("joi13_with_children", V + """SELECT f.id, coalesce((SELECT string_agg(language_id, ',' ORDER BY link_id) FROM film_languages l WHERE l.film_id = f.id), '') AS languages,
coalesce((SELECT string_agg(coalesce(tomatometer_score, -1), ',' ORDER BY r.id) FROM rt_scores r WHERE r.film_id = f.id), '') AS scores FROM f""")
def _(s, d):
    kids = {
        "languages": (table(s, d, "film_languages").withColumn("id", F.col("film_id")), "language_id", ["link_id"]),
        "scores": (table(s, d, "rt_scores").select(F.col("film_id").alias("id"), F.col("id").alias("o"), F.coalesce("tomatometer_score", F.lit(-1)).alias("v")), "v", ["o"]),
    }
    out = joins.with_children(films(s, d).select("id"), "id", kids)
    return out.select("id", F.array_join(F.col("languages").cast("array<string>"), ",").alias("languages"), F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"))


@query("joi15_near_years", V + "SELECT count(*) AS n FROM f JOIN imdb_films i ON lower(i.title) = lower(f.title) WHERE i.year IS NULL OR f.release_date IS NULL OR abs(i.year - year(f.release_date)) <= 1")
def _(s, d):
    i = table(s, d, "imdb_films").select(F.lower("title").alias("t"), F.col("year").alias("y"))
    return films(s, d).select(F.lower("title").alias("t"), F.year("release_date").alias("fy")).join(i, "t").where(joins.near_years(F.col("y"), F.col("fy"))).agg(F.count("*").alias("n"))


@query("agg02_count_by", V + "SELECT status, count(*) AS n FROM f GROUP BY 1")
def _(s, d):
    return g.count_by(films(s, d), "status")


@query("agg03_collection_stats", V + "SELECT original_language AS grp, CAST(grouping(original_language) AS INT) AS is_total, count(*) AS n, round(avg(vote_average) + 1e-9, 2) AS avg_rating FROM f GROUP BY ROLLUP (original_language)")
def _(s, d):
    return g.collection_stats(films(s, d), "vote_average", "original_language")


@query("agg04_score_stats", "SELECT count(*) AS total, round(avg(tomatometer_score) + 1e-9, 1) AS avg_critics, round(avg(audience_score) + 1e-9, 1) AS avg_audience, count(tomatometer_score) AS with_critics, count(*) FILTER (WHERE tomatometer_state = 'certified_fresh') AS certified FROM rt_scores")
def _(s, d):
    return g.score_stats(table(s, d, "rt_scores"), "tomatometer_score", "audience_score", F.col("tomatometer_state") == "certified_fresh")


@query("agg05_histogram", "SELECT bin, count(tomatometer_score) AS n FROM (VALUES ('0-19', 0, 19), ('20-39', 20, 39), ('40-59', 40, 59), ('60-79', 60, 79), ('80-100', 80, 100)) b(bin, lo, hi) LEFT JOIN rt_scores ON tomatometer_score BETWEEN lo AND hi GROUP BY 1")
def _(s, d):
    return g.histogram(table(s, d, "rt_scores"), F.col("tomatometer_score"), [(0, 19), (20, 39), (40, 59), (60, 79), (80, 100)])


@query("agg06_top_by_children", "SELECT name, count(*) AS n FROM spoken_languages s JOIN film_languages l ON l.language_id = s.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return g.top_by_children(table(s, d, "spoken_languages"), table(s, d, "film_languages"), "id", "language_id", "name", 5)


@query("agg07_having", "SELECT director, count(*) AS n FROM aggregated_films WHERE director IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def _(s, d):
    return g.having(table(s, d, "aggregated_films"), "director", 3)


@query("agg08_status_totals", V + "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Released') AS \"n_Released\", count(*) FILTER (WHERE status = 'Rumored') AS \"n_Rumored\", CAST(coalesce(sum(revenue), 0) AS BIGINT) AS amount FROM f")
def _(s, d):
    return g.status_totals(films(s, d), "status", ["Released", "Rumored"], "revenue")


@query("agg10_text_stats", "SELECT source_type, count(*) AS n, round(avg(length(content)) + 1e-9, 0) AS avg_length FROM rag_documents GROUP BY 1")
def _(s, d):
    return g.text_stats(table(s, d, "rag_documents"), "source_type", "content")


SCORE = "CASE WHEN {w} > 0 THEN round(least(({v}) / {w}, 10.0), 2) ELSE 0.0 END"
_W = "((CASE WHEN coalesce(vote_average > 0, false) THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN tomatometer_score IS NOT NULL THEN 0.30 ELSE 0 END)::DOUBLE + (CASE WHEN imdb_rating IS NOT NULL THEN 0.30 ELSE 0 END)::DOUBLE)"
_S = "(CASE WHEN coalesce(vote_average > 0, false) THEN vote_average * 0.25::DOUBLE ELSE 0 END) + (CASE WHEN tomatometer_score IS NOT NULL THEN tomatometer_score / 10.0::DOUBLE * 0.30::DOUBLE ELSE 0 END) + (CASE WHEN imdb_rating IS NOT NULL THEN imdb_rating * 0.30::DOUBLE ELSE 0 END)"


def _scored(s, d) -> DataFrame:  # noqa: ANN001
    none = F.lit(None).cast("double")
    return table(s, d, "aggregated_films").withColumn("score", c.film_score(F.col("vote_average"), F.col("tomatometer_score").cast("double"), F.col("imdb_rating"), none))


@query("agg12_weighted_score", f"SELECT rec_id, round({SCORE.format(w=_W, v=_S)}, 1) AS score FROM aggregated_films")
def _(s, d):
    return _scored(s, d).select("rec_id", F.round("score", 1).alias("score"))


@query("agg13_score_stats", f"SELECT count(*) AS n, round(avg({SCORE.format(w=_W, v=_S)}) + 1e-9, 1) AS mean, count(tomatometer_score) AS with_rt, count(imdb_rating) AS with_imdb FROM aggregated_films")
def _(s, d):
    return _scored(s, d).agg(F.count("*").alias("n"), mean("score", 1).alias("mean"), F.count("tomatometer_score").alias("with_rt"), F.count("imdb_rating").alias("with_imdb"))


@query("agg14_ordered_names", "SELECT film_id, string_agg(name, '|' ORDER BY name) AS names FROM film_languages l JOIN spoken_languages s ON s.id = l.language_id WHERE film_id IS NOT NULL GROUP BY 1")
def _(s, d):
    lang = table(s, d, "spoken_languages").select(F.col("id").alias("language_id"), "name")
    j = table(s, d, "film_languages").where(F.col("film_id").isNotNull()).join(F.broadcast(lang), "language_id")
    return g.ordered_names(j, "film_id", "name").select("film_id", F.array_join("names", "|").alias("names"))


@query("agg15_roles", "SELECT l_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag = 'A'), '') AS a, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag = 'N'), '') AS n FROM lineitem GROUP BY 1")
def _(s, d):
    r = g.roles(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", ["A", "N"])
    j = lambda k: F.array_join(F.col(k).cast("array<string>"), ",")
    return r.select("l_orderkey", j("A").alias("a"), j("N").alias("n"))


@query("agg16_first_of_order", "SELECT source_id, arg_min(id, (chunk_index, id)) AS first_chunk FROM rag_documents WHERE source_id IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "rag_documents").where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.min_by("id", F.struct("chunk_index", "id")).alias("first_chunk"))


@query("agg17_coverage", V + "SELECT count(*) AS total, count(*) FILTER (WHERE overview_fr IS NOT NULL) AS covered, round(100.0 * count(*) FILTER (WHERE overview_fr IS NOT NULL) / count(*), 2) AS pct FROM f")
def _(s, d):
    return g.coverage(films(s, d), F.col("overview_fr").isNotNull())


@query("agg20_latency_stats", "SELECT lang, count(*) AS n, round(avg(response_time_ms) + 1e-9, 2) AS mean, round(median(response_time_ms), 2) AS median, min(response_time_ms) AS least, max(response_time_ms) AS greatest, round(quantile_cont(response_time_ms, 0.95), 2) AS p95 FROM rag_queries WHERE response_time_ms IS NOT NULL GROUP BY 1")
def _(s, d):
    return g.latency_stats(table(s, d, "rag_queries"), "lang", "response_time_ms")


@query("win05_distinct_on", """SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE source_type WHEN 'film_overview' THEN 1 WHEN 'critics_consensus' THEN 2 WHEN 'film_metadata' THEN 3 ELSE 9 END, chunk_index, id) AS rn FROM rag_documents WHERE source_id IS NOT NULL) WHERE rn = 1""")
def _(s, d):
    p = F.when(F.col("source_type") == "film_overview", 1).when(F.col("source_type") == "critics_consensus", 2).when(F.col("source_type") == "film_metadata", 3).otherwise(9)
    return lookup.distinct_on(table(s, d, "rag_documents").where(F.col("source_id").isNotNull()).select("id", "source_id", "source_type", "chunk_index"), "source_id", p, ["chunk_index", "id"]).select("source_id", "id")


@query("top03_last_items", "SELECT session_id, string_agg(id, ',' ORDER BY created_at, id) AS last6 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT DISTINCT id, session_id, created_at FROM rag_queries WHERE session_id IS NOT NULL)) WHERE rn <= 6 GROUP BY 1")
def _(s, d):
    from pyspark.sql import Window

    q = table(s, d, "rag_queries").where(F.col("session_id").isNotNull()).select("id", "session_id", "created_at").distinct()
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))  # cut to six before anything is gathered
    kept = q.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 6)
    return kept.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"]), ",").alias("last6"))


@query("set01_key_union", "SELECT film_id FROM rt_scores WHERE film_id IS NOT NULL UNION SELECT film_id FROM film_languages WHERE film_id IS NOT NULL")
def _(s, d):
    return lookup.keys(table(s, d, "rt_scores"), "film_id").union(lookup.keys(table(s, d, "film_languages"), "film_id")).distinct()


@query("set02_hit_test", V + "SELECT id, list_has_any(genres, ['Horror', 'Thriller']) AS hit FROM f WHERE genres IS NOT NULL")
def _(s, d):
    return films(s, d).where(F.col("genres").isNotNull()).select("id", g.overlaps(F.col("genres"), F.array(F.lit("Horror"), F.lit("Thriller"))).alias("hit"))


@query("set03_difference", V + "SELECT tmdb_id FROM f WHERE tmdb_id NOT IN (SELECT source_id FROM rag_documents WHERE source_id IS NOT NULL)")
def _(s, d):
    return joins.without(films(s, d).select("tmdb_id"), table(s, d, "rag_documents").where(F.col("source_id").isNotNull()).select(F.col("source_id").alias("tmdb_id")), ["tmdb_id"])


@query("ded01_first_by_id", "SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY tmdb_id ORDER BY rec_id) AS rn FROM aggregated_films WHERE tmdb_id IS NOT NULL) WHERE rn = 1 UNION ALL SELECT rec_id FROM aggregated_films WHERE tmdb_id IS NULL")
def _(s, d):
    return dedup.first_by_key(table(s, d, "aggregated_films").select("rec_id", "tmdb_id"), "tmdb_id", ["rec_id"]).select("rec_id")


@query("ded02_first_by_imdb", "SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY imdb_id ORDER BY rec_id) AS rn FROM aggregated_films WHERE imdb_id IS NOT NULL AND imdb_id <> '') WHERE rn = 1 UNION ALL SELECT rec_id FROM aggregated_films WHERE coalesce(imdb_id, '') = ''")
def _(s, d):
    return dedup.first_by_key(table(s, d, "aggregated_films").select("rec_id", "imdb_id"), "imdb_id", ["rec_id"]).select("rec_id")


@query("ded04_greedy")
def _(s, d):
    a = table(s, d, "aggregated_films").select(F.col("rec_id").alias("pos"), "tmdb_id", "imdb_id", "title", F.year("release_date").alias("year"))
    return dedup.deduplicate(a)


@query("ded05_queries")
def _(s, d):
    q = table(s, d, "films").where(F.col("tagline").isNotNull())
    return dedup.dedupe_queries(q.select("tagline", "id"), "tagline", "id")


_NEW = "SELECT id, vote_count + 1 AS vote_count, title FROM f WHERE id % 3 = 0 UNION ALL SELECT id + 10000000, vote_count, title FROM f WHERE id % 7 = 0"


def _split(s, d) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    f = films(s, d).select("id", "vote_count", "title")
    return f, f.where(F.col("id") % 3 == 0).withColumn("vote_count", F.col("vote_count") + 1).unionByName(f.where(F.col("id") % 7 == 0).withColumn("id", F.col("id") + 10_000_000))


@query("snk03_upsert", V + f", n AS ({_NEW}) SELECT id, vote_count, title FROM n UNION ALL SELECT id, vote_count, title FROM f WHERE id NOT IN (SELECT id FROM n)")
def _(s, d):
    old, new = _split(s, d)
    return upserts.upsert(old, new, ["id"])


@query("snk03_write_counts", V + f", n AS ({_NEW}) SELECT count(*) FILTER (WHERE id NOT IN (SELECT id FROM f)) AS inserted, count(*) FILTER (WHERE id IN (SELECT id FROM f)) AS updated FROM n")
def _(s, d):
    return upserts.write_counts(*_split(s, d), ["id"])


@query("snk04_upsert_subset", V + f", n AS ({_NEW}) SELECT f.id, coalesce(n.vote_count, f.vote_count) AS vote_count, f.title FROM f LEFT JOIN n USING (id) UNION ALL SELECT id, vote_count, title FROM n WHERE id NOT IN (SELECT id FROM f)")
def _(s, d):
    old, new = _split(s, d)
    return upserts.upsert_subset(old, new, ["id"], ["vote_count"])


@query("snk05_insert_if_absent", V + f", n AS ({_NEW}) SELECT id, vote_count, title FROM f UNION ALL SELECT id, vote_count, title FROM n WHERE id NOT IN (SELECT id FROM f)")
def _(s, d):
    return upserts.insert_if_absent(*_split(s, d), ["id"])


@query("snk06_replace_children", "WITH n AS (SELECT film_id, 1 AS language_id FROM rt_scores WHERE film_id IS NOT NULL) SELECT film_id, language_id FROM film_languages WHERE film_id IS NULL OR film_id NOT IN (SELECT film_id FROM n) UNION ALL SELECT film_id, language_id FROM n")
def _(s, d):
    new = table(s, d, "rt_scores").where(F.col("film_id").isNotNull()).select("film_id", F.lit(1).alias("language_id"))
    return upserts.replace_children(table(s, d, "film_languages").select("film_id", "language_id"), new, "film_id")


@query("snk07_delete", V + "SELECT id FROM f WHERE id NOT IN (SELECT film_id FROM film_purges)")
def _(s, d):
    return upserts.delete_keys(films(s, d).select("id"), table(s, d, "film_purges").select(F.col("film_id").alias("id")), ["id"])


@query("snk08_update_from", V + "SELECT r.id, coalesce(f.vote_count, r.vote_count) AS vote_count FROM rag_documents r LEFT JOIN (SELECT tmdb_id, max(vote_count) AS vote_count FROM f GROUP BY 1) f ON f.tmdb_id = r.source_id")
def _(s, d):
    st = films(s, d).groupBy(F.col("tmdb_id").alias("source_id")).agg(F.max("vote_count").alias("vote_count"))
    return upserts.update_from(table(s, d, "rag_documents").select("id", "source_id", "vote_count"), st, ["source_id"], "vote_count").select("id", "vote_count")


@query("fun_clean_fields", V + r"""SELECT id, CASE WHEN length(trim(original_language)) = 2 THEN lower(trim(original_language)) END AS lang, CASE WHEN runtime BETWEEN 1 AND 600 THEN runtime END AS runtime,
CASE WHEN length(trim(tagline, E' \t\n\r')) > 10 AND lower(trim(tagline, E' \t\n\r')) NOT IN ('no overview', 'no description', 'n/a') THEN trim(tagline, E' \t\n\r') END AS tagline,
CASE WHEN vote_average >= 7.5 THEN 'excellent' WHEN vote_average >= 6 THEN 'good' WHEN vote_average >= 4 THEN 'average' ELSE 'poor' END AS category, md5(overview) AS content_hash FROM f""")
def _(s, d):
    from loomframe.operators.analytics import rating_category

    return films(s, d).select("id", c.clean_language(F.col("original_language")).alias("lang"), c.in_range(F.col("runtime"), 1, 600).alias("runtime"), c.clean_text(F.col("tagline")).alias("tagline"), rating_category(F.col("vote_average")).alias("category"), c.content_hash(F.col("overview")).alias("content_hash"))


@query("fun_scores", r"""SELECT rec_id, CASE WHEN lower(tomatometer_state) IN ('positive', 'upright') THEN 'fresh' WHEN lower(tomatometer_state) IN ('negative', 'spilled') THEN 'rotten' WHEN lower(tomatometer_state) = 'certified-fresh' THEN 'certified_fresh' ELSE lower(tomatometer_state) END AS state,
coalesce(tomatometer_score >= 60, false) AS fresh, nullif(regexp_extract(rt_url, '/m/([^/?#]+)', 1), '') AS slug FROM rt_enrichment""")
def _(s, d):
    return table(s, d, "rt_enrichment").select("rec_id", c.state(F.col("tomatometer_state")).alias("state"), c.is_fresh(F.col("tomatometer_score")).alias("fresh"), c.slug_of_url(F.col("rt_url")).alias("slug"))


@query("fun_slug", V + r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(lower(title), '^(the|a|an)\s+', ''), '''', ''), '&', 'and'), '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM f WHERE title IS NOT NULL""")
def _(s, d):
    return films(s, d).where(F.col("title").isNotNull()).select("id", c.slug(F.col("title")).alias("slug"))


@query("fun_popularity", V + "SELECT id, round(0.7 * ln(1 + coalesce(vote_count, 0)) / 10 + 0.3 * ln(1 + coalesce(popularity, 0)) / 6, 6) AS score FROM f")
def _(s, d):
    return films(s, d).select("id", F.round(c.popularity_score(F.col("vote_count"), F.col("popularity")), 6).alias("score"))


@query("fun_validate", V + """SELECT id, concat_ws(',', CASE WHEN NOT coalesce(tmdb_id > 0, false) THEN 'tmdb_id' END, CASE WHEN NOT regexp_full_match(imdb_id, 'tt[0-9]{7,8}') THEN 'imdb_id' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN NOT (runtime BETWEEN 1 AND 1000) THEN 'runtime' END, CASE WHEN NOT (vote_average BETWEEN 0 AND 10) THEN 'vote_average' END) AS errors FROM f""")
def _(s, d):
    rules = {"tmdb_id": F.coalesce(F.col("tmdb_id") > 0, F.lit(False)), "imdb_id": F.col("imdb_id").rlike(r"^tt\d{7,8}$"), "title": F.coalesce("title", F.lit("")) != "", "runtime": F.col("runtime").between(1, 1000), "vote_average": F.col("vote_average").between(0, 10)}
    return films(s, d).select("id", F.array_join(c.validate(rules), ",").alias("errors"))


@query("fun_documents")
def _(s, d):
    return doc.film_documents(_document_films(s, d))


def _document_films(s, d) -> DataFrame:  # noqa: ANN001
    cons = table(s, d, "rt_scores").where(F.col("film_id").isNotNull()).groupBy(F.col("film_id").alias("id")).agg(F.max_by("critics_consensus", F.struct("updated_at", F.col("id").alias("o"))).alias("critics_consensus"))
    return films(s, d).join(cons, "id", "left").withColumn("director", F.lit(None).cast("string")).withColumn("cast", F.array().cast("array<string>"))


@query("fun_document_counts", V + """, c AS (SELECT film_id AS id, arg_max(struct_pack(v := critics_consensus), (updated_at, id)).v AS cons FROM rt_scores WHERE film_id IS NOT NULL GROUP BY 1),
b AS (SELECT f.tmdb_id, trim(coalesce(overview, ''), E' \\t\\n\\r') <> '' AS o, trim(coalesce(cons, ''), E' \\t\\n\\r') <> '' AS k FROM f LEFT JOIN c USING (id) WHERE f.tmdb_id IS NOT NULL AND NOT (coalesce(runtime, 0) > 0 AND coalesce(runtime, 0) < 40))
SELECT 'film_overview' AS source_type, count(*) AS n FROM b WHERE o UNION ALL SELECT 'critics_consensus', count(*) FROM b WHERE k UNION ALL SELECT 'film_metadata', count(*) FROM b WHERE NOT o AND NOT k""")
def _(s, d):
    kinds = s.createDataFrame([("film_overview",), ("critics_consensus",), ("film_metadata",)], "source_type string")
    got = doc.film_documents(_document_films(s, d)).groupBy("source_type").agg(F.count("*").alias("n"))
    return kinds.join(got, "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("fun34_change_plan", """WITH k AS (SELECT id, md5(content) AS h, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn, length(content) AS n FROM rag_documents), a AS (SELECT id, h FROM k WHERE rn = 1 AND n % 5 <> 0), b AS (SELECT id, CASE WHEN n % 7 = 0 THEN 'x' ELSE h END AS h FROM k WHERE rn = 1 AND n % 3 <> 0)
SELECT id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'orphan' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS action FROM a FULL JOIN b USING (id)""")
def _(s, d):
    k = table(s, d, "rag_documents").select("id", c.content_hash(F.col("content")).alias("content_hash"), F.length("content").alias("n"))
    return doc.change_plan(k.where(F.col("n") % 5 != 0), k.where(F.col("n") % 3 != 0).withColumn("content_hash", F.when(F.col("n") % 7 == 0, "x").otherwise(F.col("content_hash"))), ["id"])
