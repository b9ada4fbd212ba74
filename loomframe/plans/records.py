"""SRC, SNK, FUN, CLS, ORC and AGG queries over raw records and over files written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions import cleaning as c
from loomframe.functions import documents as doc
from loomframe.functions import records as rec
from loomframe.operators import aggregates as g
from loomframe.operators import intent as it
from loomframe.operators import pipeline
from loomframe.operators.analytics import latest
from loomframe.operators.retrieval import hashing_embedder
from loomframe.plans.films import SCORE, V, _fold_sql
from loomframe.session import fresh_folder, table
from loomframe.sources import pages, readers, writers
from loomframe.streaming import sessions

QUERIES: dict = {}
SQL: dict = {}
W = r"E' \t\n\r'"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_CSV_COLUMNS = ["id", "title", "release_date", "vote_average", "vote_count", "popularity", "overview", "genre_names", "original_language", "budget", "revenue", "runtime"]


def _csv(s, d, **changed) -> str:  # noqa: ANN001
    path = fresh_folder(s, "films-csv")
    f = table(s, d, "films").withColumn("genre_names", F.array_join("genres", ", ")).withColumns(changed)
    f.select(*[F.col(x).cast("string").alias(x) for x in _CSV_COLUMNS]).write.options(**CSV).csv(path)
    return path


@query("src01_film_csv", "SELECT id, nullif(title, '') AS title, CAST(release_date AS VARCHAR) AS release_date, vote_average, vote_count, nullif(overview, '') AS overview, budget, runtime FROM films")
def _(s, d):
    return readers.film_csv(s, _csv(s, d)).select("id", "title", "release_date", "vote_average", "vote_count", "overview", "budget", "runtime")


@query("src02_lenient_csv", "SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE runtime END AS runtime, CASE WHEN id % 3 = 0 THEN NULL ELSE nullif(title, '') END AS title FROM films")
def _(s, d):
    n = F.col("id")
    path = _csv(s, d, runtime=F.when(n % 5 == 0, "NA").when(n % 7 == 0, "1x").otherwise(F.col("runtime").cast("string")), title=F.when(n % 3 == 0, "None").otherwise(F.col("title")))
    return readers.lenient_csv(s, path, {"id": "int", "runtime": "int"}).select("id", "runtime", "title")


@query("src03_valid_rows", "SELECT id, title FROM films WHERE id > 0 AND title IS NOT NULL")
def _(s, d):
    return readers.valid_rows(table(s, d, "films")).select("id", "title")


@query("src10_envelope", "SELECT rec_id, title, budget FROM aggregated_films")
def _(s, d):
    path = fresh_folder(s, "envelopes")
    f = table(s, d, "aggregated_films").select("rec_id", "title", "budget")
    # an envelope of a thousand films a file
    f.groupBy(F.floor(F.col("rec_id") / 1000).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("rec_id", "title", "budget")).alias("films"))).alias("value")).write.partitionBy("part").text(path)
    return readers.envelope(s, f"{path}/*", "rec_id: bigint, title: string, budget: bigint")


@query("src11_json_lines", "SELECT id, query_text, response_time_ms FROM rag_queries")
def _(s, d):
    path = fresh_folder(s, "queries-json")
    table(s, d, "rag_queries").select("id", "query_text", "response_time_ms").write.json(path)
    return readers.json_lines(s, path, "id string, query_text string, response_time_ms int")


@query("src12_sample", "SELECT least(count(*), 500) AS n, least(count(*), 500) AS ids FROM rag_documents")
def _(s, d):
    return readers.sample_rows(table(s, d, "rag_documents").select("id"), 500, "id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("src13_junit", "SELECT coalesce(lang, 'none') AS suite, id AS name, coalesce(response_time_ms, 0) / 1000.0::DOUBLE AS seconds, CASE WHEN coalesce(response_generated, false) THEN 'passed' ELSE 'failed' END AS status FROM rag_queries")
def _(s, d):
    path = fresh_folder(s, "junit")
    esc = F.replace(F.replace(F.replace(F.coalesce("lang", F.lit("none")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    fail = F.when(F.coalesce("response_generated", F.lit(False)), "").otherwise("<failure>no answer</failure>")
    line = F.concat(F.lit('<testcase classname="'), esc, F.lit('" name="'), F.col("id"), F.lit('" time="'), (F.coalesce("response_time_ms", F.lit(0)) / 1000).cast("string"), F.lit('">'), fail, F.lit("</testcase>"))
    q = table(s, d, "rag_queries")
    # a suite of about a thousand cases a file
    part = F.pmod(F.xxhash64("id"), F.lit(q.count() // 1000 + 1)).alias("part")
    suite = F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list("line"), "\n"), F.lit("</testsuite>"))
    q.select(part, line.alias("line")).groupBy("part").agg(suite.alias("value")).write.partitionBy("part").text(path)
    return readers.junit(s, f"{path}/*")


@query("src14_relations", "SELECT 'films' AS name, count(*) AS n FROM films UNION ALL SELECT 'rt_scores', count(*) FROM rt_scores UNION ALL SELECT 'film_languages', count(*) FROM film_languages UNION ALL SELECT 'spoken_languages', count(*) FROM spoken_languages")
def _(s, d):
    got = readers.tables(s, d, ["films", "rt_scores", "film_languages", "spoken_languages"])
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in got.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("src09_film_page", f"SELECT rt_url, nullif(tomatometer_score, 0) AS tomatometer_score, lower(tomatometer_state) AS tomatometer_state, coalesce(critics_count, 0) AS critics_count, nullif(audience_score, 0) AS audience_score, CASE WHEN length(critics_consensus) > 20 THEN critics_consensus END AS critics_consensus FROM rt_enrichment WHERE rt_url IS NOT NULL AND regexp_matches(coalesce(critics_consensus, ''), '^[A-Za-z0-9 .,;:!?-]*$') AND trim(coalesce(critics_consensus, ''), {W}) = coalesce(critics_consensus, '')")
def _(s, d):
    t = table(s, d, "rt_enrichment").where(F.col("rt_url").isNotNull() & F.coalesce("critics_consensus", F.lit("")).rlike("^[A-Za-z0-9 .,;:!?-]*$") & (c.strip(F.coalesce("critics_consensus", F.lit(""))) == F.coalesce("critics_consensus", F.lit(""))))
    side = lambda score, n, state: F.struct(F.col(score).cast("string").alias("score"), F.col(n).alias("reviewCount"), (F.col(state) if state else F.lit(None).cast("string")).alias("sentiment"))
    card = F.to_json(F.struct(side("tomatometer_score", "critics_count", "tomatometer_state").alias("criticsScore"), side("audience_score", "audience_count", None).alias("audienceScore")))
    says = F.coalesce(F.concat(F.lit('<p data-qa="critics-consensus">'), F.col("critics_consensus"), F.lit("</p>")), F.lit(""))
    html = F.concat(F.lit('<html><script type="application/json" id="media-scorecard-json">'), card, F.lit("</script><div>"), says, F.lit("</div></html>"))
    return pages.film_fields(t.select("rt_url", html.alias("html")), "html", "rt_url").select("rt_url", "tomatometer_score", "tomatometer_state", "critics_count", "audience_score", "critics_consensus")


@query("src08_search_page", V + r", t AS (SELECT id, title, year(release_date) AS y FROM f WHERE regexp_full_match(title, '[A-Za-z0-9 :&-]+') AND trim(title) = title) SELECT id, 0 AS place, '/m/x' || id AS url, replace(title, '&', 'and') AS title, y AS year FROM t")
def _(s, d):
    f = latest(table(s, d, "films")).where(F.col("title").rlike("^[A-Za-z0-9 :&-]+$") & (F.trim("title") == F.col("title")))
    year = F.when(F.col("release_date").isNotNull(), F.concat(F.lit(' releaseyear="'), F.year("release_date").cast("string"), F.lit('"'))).otherwise("")
    html = F.concat(F.lit('<search-page-media-row data-qa="data-row"'), year, F.lit('><a slot="title" href="/m/x'), F.col("id").cast("string"), F.lit('"> '), F.replace("title", F.lit("&"), F.lit("and")), F.lit(" </a></search-page-media-row>"))
    return pages.search_results(f.select("id", html.alias("html")), "html", "id")


@query("snk01_parquet", "SELECT id, title, runtime, (SELECT count(*) FROM films) AS written FROM films")
def _(s, d):
    path = fresh_folder(s, "films-parquet")
    n = writers.write_parquet(table(s, d, "films").select("id", "title", "runtime"), path)
    return s.read.parquet(path).withColumn("written", F.lit(n).cast("long"))


@query("snk02_envelope", "SELECT count(*) AS total_films, round(avg(aggregated_score), 2) AS avg_score, round(100.0 * count(tomatometer_score) / count(*), 2) AS rt_coverage, (SELECT count(*) FROM aggregated_films) AS films FROM aggregated_films")
def _(s, d):
    path = fresh_folder(s, "export")
    writers.write_envelope(table(s, d, "aggregated_films").select("rec_id", "aggregated_score", "tomatometer_score"), path)
    head = F.from_json("value", "total_films bigint, avg_score double, rt_coverage double")
    return s.read.text(f"{path}/head").select(head.alias("h")).select("h.*").withColumn("films", F.lit(s.read.schema("rec_id bigint").json(f"{path}/films").count()).cast("long"))


@query("snk09_documents", V + "SELECT id AS source_id, CASE WHEN id % 3 = 0 THEN upper(title) ELSE title END AS content FROM f WHERE title IS NOT NULL AND id % 2 = 0 UNION ALL SELECT id, upper(title) FROM f WHERE title IS NOT NULL AND id % 3 = 0 AND id % 2 <> 0")
def _(s, d):
    f = latest(table(s, d, "films")).where(F.col("title").isNotNull())
    row = lambda t: [F.lit("film").alias("source_type"), F.col("id").alias("source_id"), F.lit(0).alias("chunk_index"), t.alias("content")]
    old = f.where(F.col("id") % 2 == 0).select(*row(F.col("title"))).withColumn("embedding", F.lit(None).cast("array<float>"))
    new = f.where(F.col("id") % 3 == 0).select(*row(F.upper("title"))).withColumn("embed_text", F.col("content"))
    return writers.upsert_documents(old, new, hashing_embedder(16)).where((F.col("source_id") % 3 != 0) | (F.size("embedding") == 16)).select("source_id", "content")


@query("snk10_delivery", "SELECT count(*) AS delivered, count(*) AS seen FROM film_purges")
def _(s, d):
    seen: list[int] = []
    n = writers.deliver(table(s, d, "film_purges"), lambda rows: seen.append(len(rows)), 100)
    return s.createDataFrame([(n, sum(seen))], "delivered long, seen long")


@query("snk11_progress", "SELECT max(id) AS last, true AS existed, true AS deleted, false AS left_over FROM films")
def _(s, d):
    p = writers.Progress(s, fresh_folder(s, "progress"))
    p.save("films/load", {"last": table(s, d, "films").agg(F.max("id")).first()[0]})
    return s.createDataFrame([(p.load("films/load")["last"], p.exists("films/load"), p.delete("films/load"), p.exists("films/load"))], "last int, existed boolean, deleted boolean, left_over boolean")


@query("fun02_04_dates", V + """SELECT id, substr(CAST(release_date AS VARCHAR), 1, 4) AS year, CASE id % 4 WHEN 0 THEN release_date WHEN 1 THEN release_date END AS iso, CASE id % 4 WHEN 0 THEN release_date WHEN 1 THEN release_date WHEN 2 THEN make_date(year(release_date), 1, 1) END AS date FROM f""")
def _(s, d):
    iso = F.col("release_date").cast("string")
    raw = F.when(F.col("id") % 4 == 0, iso).when(F.col("id") % 4 == 1, F.replace(iso, F.lit("-"), F.lit(""))).when(F.col("id") % 4 == 2, F.concat(F.lit(" "), F.substring(iso, 1, 4))).otherwise(F.concat(iso, F.lit("?")))
    return latest(table(s, d, "films")).select("id", c.year_of(iso).alias("year"), c.iso_date(raw).alias("iso"), c.date_or_year(raw).alias("date"))


@query("fun05_07_numbers", V + "SELECT id, CASE id % 3 WHEN 0 THEN coalesce(runtime, 0) ELSE 0 END AS whole, CASE id % 3 WHEN 0 THEN nullif(runtime, 0) END AS positive, CASE WHEN id % 3 = 2 THEN NULL ELSE round(vote_average, 1) END AS real FROM f")
def _(s, d):
    n = F.col("id") % 3
    text = F.when(n == 0, F.concat(F.lit(" "), F.col("runtime").cast("string"), F.lit(" "))).when(n == 1, F.concat(F.lit("-"), (F.col("runtime") + 1).cast("string"))).otherwise(F.concat(F.col("runtime").cast("string"), F.lit(".5")))
    real = F.when(n == 2, "n/a").otherwise(F.col("vote_average").cast("string"))
    return latest(table(s, d, "films")).select("id", c.safe_int(text).alias("whole"), c.safe_positive(text).alias("positive"), c.safe_float(real, 1).alias("real"))


@query("fun09_percent", "SELECT id, CASE WHEN s BETWEEN 0 AND 100 THEN s END AS score FROM (SELECT id, tomatometer_score + id % 50 - 20 AS s FROM rt_scores)")
def _(s, d):
    return table(s, d, "rt_scores").select("id", c.in_range(F.col("tomatometer_score") + F.col("id") % 50 - 20, 0, 100).alias("score"))


_TRIM = f"trim(critics_consensus, {W})"
_BARE = rf"trim(regexp_replace(regexp_replace({_TRIM}, '^Critics Consensus:?', ''), '^\s*Critic''s Consensus:', ''), {W})"


@query("fun15_consensus", f"SELECT id, CASE WHEN NOT contains(lower({_BARE}), 'no consensus yet') AND length({_BARE}) > 20 THEN {_BARE} END AS consensus FROM rt_scores")
def _(s, d):
    says = F.col("critics_consensus")
    return table(s, d, "rt_scores").select("id", c.consensus(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Critics Consensus: "), says)).otherwise(says)).alias("consensus"))


@query("fun17_imdb_ids", "SELECT rec_id, coalesce(regexp_full_match(imdb_id, 'tt[0-9]{7,8}'), false) AS strict, coalesce(regexp_full_match(imdb_id, 'tt[0-9]+'), false) AS loose FROM aggregated_films")
def _(s, d):
    return table(s, d, "aggregated_films").select("rec_id", c.valid_imdb(F.col("imdb_id")).alias("strict"), c.valid_imdb(F.col("imdb_id"), False).alias("loose"))


@query("fun19_url_variants", V + r""", t AS (SELECT id, title, year(release_date) AS y FROM f WHERE regexp_full_match(title, '[A-Za-z]+( [A-Za-z]+)*') AND NOT regexp_matches(lower(title), '^(the|a|an)\s| (ii|iii|iv|v|vi)'))
SELECT id, '/m/' || replace(lower(title), ' ', '_') || CASE WHEN y IS NULL THEN '' ELSE ' /m/' || replace(lower(title), ' ', '_') || '_' || y END AS variants FROM t""")
def _(s, d):
    f = latest(table(s, d, "films")).where(F.col("title").rlike("^[A-Za-z]+( [A-Za-z]+)*$") & ~F.lower("title").rlike(r"^(the|a|an)\s| (ii|iii|iv|v|vi)"))
    return f.select("id", F.array_join(c.url_variants(F.col("title"), F.year("release_date")), " ").alias("variants"))


@query("fun20_search_url", V + "SELECT id, 'https://x.test/search?search=' || replace(url_encode(title || CASE WHEN release_date IS NULL THEN '' ELSE ' ' || year(release_date) END), '%20', '+') AS url FROM f WHERE regexp_full_match(title, '[A-Za-z0-9 :&,]+')")
def _(s, d):
    return latest(table(s, d, "films")).where(F.col("title").rlike("^[A-Za-z0-9 :&,]+$")).select("id", c.search_url("https://x.test", F.col("title"), F.year("release_date")).alias("url"))


@query("fun21_split_list", f"SELECT imdb_id, imdb_votes, coalesce(array_to_string(list_filter(list_transform(string_split(genres, ','), lambda x: trim(x, {W})), lambda x: x <> ''), '|'), '') AS genres FROM imdb_films")
def _(s, d):
    return table(s, d, "imdb_films").select("imdb_id", "imdb_votes", F.array_join(c.split_list(F.col("genres")), "|").alias("genres"))


_ALT = "list_distinct(list_filter(list_transform(list_filter(list_transform(alternative_titles, lambda t, i: {'t': t, 'i': i}), lambda x: x.i % 3 <> 2), lambda x: trim(x.t, " + W + ")), lambda x: x <> ''))"


@query("fun22_24_nested", V + f"SELECT id, nullif(trim(title_fr, {W}), '') AS title_fr, coalesce(array_to_string(list_sort({_ALT}), '|'), '') AS others, '0:Director' || CASE WHEN title IS NULL THEN '' ELSE '' END AS crew FROM f")
def _(s, d):
    part = lambda lang, land, t: F.struct(F.lit(lang).alias("iso_639_1"), F.lit(land).alias("iso_3166_1"), F.struct(t.alias("title")).alias("data"))
    texts = F.array(part("en", "US", F.col("title")), part("fr", "FR", F.lit(" ")), part("fr", "CH", F.col("title")), part("fr", "CA", F.col("title_fr")))
    lands = F.transform("alternative_titles", lambda t, i: F.struct(F.when(i % 3 == 1, "US").otherwise("BE").alias("iso_3166_1"), t.alias("title")))
    crew = F.array(F.struct(F.lit("Writer").alias("job"), F.lit("a").alias("name")), F.struct(F.lit("Director").alias("job"), F.col("title").alias("name")))
    roles = F.transform(c.crew_of(crew, ["Director"]), lambda m: F.concat_ws(":", m["display_order"].cast("string"), m["job"]))
    return latest(table(s, d, "films")).select("id", c.french(texts, "title").alias("title_fr"), F.array_join(F.array_sort(c.regional_titles(lands)), "|").alias("others"), F.array_join(roles, ",").alias("crew"))


@query("fun25_references", V + f"SELECT id, coalesce(array_to_string(list_transform(genres, lambda g, i: i || ':' || coalesce(nullif(trim(g, {W}), ''), '')), '|'), '') AS genres, CASE WHEN original_language = 'fr' THEN 'French' ELSE coalesce(original_language, '') END AS language FROM f")
def _(s, d):
    items = F.transform("genres", lambda g, i: F.struct((i + 1).alias("id"), g.alias("name")))
    spoken = F.array(F.struct(F.lit("x").alias("iso_639_1"), F.when(F.col("original_language") == "fr", "French").otherwise("").alias("english_name"), F.coalesce("original_language", F.lit("")).alias("name")))
    shown = F.transform(rec.renamed(items, "genre"), lambda x: F.concat(x["tmdb_genre_id"].cast("string"), F.lit(":"), F.coalesce(x["name"], F.lit(""))))
    return latest(table(s, d, "films")).select("id", F.array_join(shown, "|").alias("genres"), rec.languages(spoken)[0]["name"].alias("language"))


@query("fun26_film_records", f"SELECT id AS tmdb_id, nullif(trim(title, {W}), '') AS title, release_date, nullif(trim(overview, {W}), '') AS overview, coalesce(popularity, 0) AS popularity, coalesce(vote_count, 0) AS vote_count, CASE WHEN runtime BETWEEN 1 AND 1000 THEN runtime END AS runtime, coalesce(status, 'Unknown') AS status, coalesce(budget, 0) AS budget, 'tmdb_discover' AS source FROM films WHERE id IS NOT NULL")
def _(s, d):
    r = rec.film_records(table(s, d, "films").drop("alternative_titles"))
    return r.select("tmdb_id", "title", "release_date", "overview", "popularity", "vote_count", "runtime", "status", "budget", "source")


@query("fun27_csv_records", f"SELECT id AS tmdb_id, trim(title, {W}) AS title, CASE WHEN length(trim(original_language, {W})) = 2 THEN lower(trim(original_language, {W})) END AS original_language, release_date, CASE WHEN vote_count >= 0 THEN vote_count ELSE 0 END AS vote_count, CASE WHEN runtime > 0 THEN runtime END AS runtime, coalesce(nullif(status, ''), 'Released') AS status FROM films WHERE id <> 0 AND trim(title, {W}) <> ''")
def _(s, d):
    return rec.csv_records(table(s, d, "films")).select("tmdb_id", "title", "original_language", "release_date", "vote_count", "runtime", "status")


@query("fun27_enriched_records", f"SELECT id AS kaggle_id, trim(title, {W}) AS title, round(vote_average, 2) AS rating, vote_count AS votes, CASE WHEN runtime BETWEEN 1 AND 600 THEN runtime END AS runtime, CASE WHEN id % 2 = 0 THEN 'given' WHEN vote_average >= 7.5 THEN 'excellent' WHEN vote_average >= 6 THEN 'good' WHEN vote_average >= 4 THEN 'average' ELSE 'poor' END AS rating_category FROM films WHERE id > 0 AND trim(title, {W}) <> '' AND vote_average IS NOT NULL AND vote_count IS NOT NULL")
def _(s, d):
    raw = table(s, d, "films").select(F.col("id").alias("kaggle_id"), "title", F.year("release_date").alias("release_year"), F.col("vote_average").alias("rating"), F.col("vote_count").alias("votes"), "runtime", "overview", F.when(F.col("id") % 2 == 0, "given").alias("rating_category"))
    return rec.enriched_records(raw).select("kaggle_id", "title", "rating", "votes", "runtime", "rating_category")


@query("fun27_ratings", "SELECT imdb_id, round(imdb_rating, 1) AS imdb_rating, imdb_votes, CASE WHEN runtime BETWEEN 1 AND 600 THEN runtime END AS runtime FROM imdb_films WHERE regexp_full_match(imdb_id, 'tt[0-9]+') AND imdb_rating IS NOT NULL AND imdb_votes IS NOT NULL")
def _(s, d):
    return rec.imdb_ratings(table(s, d, "imdb_films"))


@query("fun27_rt_scores", "SELECT rec_id, CASE WHEN tomatometer_score BETWEEN 0 AND 100 THEN tomatometer_score END AS tomatometer_score, coalesce(critics_count, 0) AS critics_count, CASE WHEN audience_score BETWEEN 0 AND 100 THEN audience_score END AS audience_score, rt_url FROM rt_enrichment WHERE tomatometer_score IS NOT NULL OR audience_score IS NOT NULL")
def _(s, d):
    return rec.rt_scores(table(s, d, "rt_enrichment")).select("rec_id", "tomatometer_score", "critics_count", "audience_score", "rt_url")


_TITLES = "CASE WHEN coalesce(title_fr, '') <> '' AND title_fr <> title THEN concat_ws(' / ', title, title_fr) ELSE coalesce(title, '') END"
_KEYS = "CASE WHEN len(keywords) > 0 THEN 'Keywords: ' || array_to_string(list_slice(keywords, 1, 15), ', ') END"


def _film_texts(s, d) -> DataFrame:  # noqa: ANN001
    return latest(table(s, d, "films")).withColumn("director", F.lit("Ada")).withColumn("cast", F.lit(None).cast("array<string>")).withColumn("critics_consensus", F.lit(None).cast("string"))


_OTHERS = "CASE WHEN len(alternative_titles) > 0 THEN 'Alternative titles: ' || array_to_string(list_slice(alternative_titles, 1, 5), ', ') END"
_LINE = f"{_TITLES} || ' (' || coalesce(CAST(year(release_date) AS VARCHAR), '') || ') - Genres: ' || coalesce(array_to_string(genres, ', '), '')"


@query("fun29_combined_text", V + f"SELECT id, concat_ws(' ', {_TITLES}, nullif(overview, ''), CASE WHEN coalesce(overview_fr, '') <> '' AND overview_fr IS DISTINCT FROM overview THEN overview_fr END, nullif(tagline, ''), 'Director: Ada', {_KEYS}, {_OTHERS}) AS text FROM f")
def _(s, d):
    return _film_texts(s, d).select("id", doc.combined_text().alias("text"))


@query("fun30_header", V + f"SELECT id, concat_ws(E'\\n', {_LINE}, {_OTHERS}, {_KEYS}, 'Director: Ada') AS header, concat_ws(E'\\n', {_LINE}, nullif(overview, ''), {_KEYS}) AS embed FROM f")
def _(s, d):
    return _film_texts(s, d).select("id", doc.header().alias("header"), doc.embed_text(F.col("overview")).alias("embed"))


@query("fun32_metadata", V + "SELECT id, title, runtime, coalesce(CAST(year(release_date) AS VARCHAR), NULL) AS year, 'Ada' AS director FROM f")
def _(s, d):
    m = F.from_json(doc.metadata(), "title string, runtime int, year string, director string")
    return _film_texts(s, d).select("id", m.alias("m")).select("id", "m.*")


_FOLDED = f"translate(query_text, '{c.ACCENTED}', '{c.PLAIN}')"


@query("fun35_fold_accents", rf"SELECT id, received_at, trim(regexp_replace({_FOLDED}, '\s+', ' ', 'g'), ' ') AS folded FROM rag_queries")
def _(s, d):
    return table(s, d, "rag_queries").select("id", "received_at", c.fold_accents(F.col("query_text")).alias("folded"))


_FR_TERMS, _FR_WORDS = ["films", "peur", "fantôme"], ["le", "la", "les", "des", "un", "une", "est", "dans", "pour", "avec", "que", "qui"]


@query("fun36_looks_french", "SELECT id, received_at, coalesce(regexp_matches(query_text, '[àâäçéèêëîïôöùûüÿœ]') OR " + " OR ".join(f"contains(lower(query_text), '{t}')" for t in _FR_TERMS) + f" OR len(list_filter(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda w: w IN ({', '.join(repr(w) for w in _FR_WORDS)}))) >= 2, false) AS french FROM rag_queries")
def _(s, d):
    return table(s, d, "rag_queries").select("id", "received_at", c.looks_french(F.col("query_text"), _FR_TERMS, _FR_WORDS).alias("french"))


@query("fun37_language_gate", rf"SELECT id, received_at, CASE WHEN len(list_filter(regexp_split_to_array(trim(query_text, {W}), '\s+'), lambda w: w <> '')) >= 2 AND top_similarity_score >= 0.7 AND lang IN ('fr', 'en') THEN lang ELSE 'mixed' END AS language FROM rag_queries")
def _(s, d):
    return table(s, d, "rag_queries").select("id", "received_at", c.language_gate(F.col("query_text"), F.col("lang"), F.col("top_similarity_score")).alias("language"))


@query("fun39_expand", "SELECT id, received_at, CASE WHEN " + " OR ".join(f"contains(lower(query_text), '{k}')" for k in it.DOMAIN) + " THEN query_text ELSE query_text || ' horror film' END AS query FROM rag_queries WHERE query_text IS NOT NULL")
def _(s, d):
    return table(s, d, "rag_queries").where(F.col("query_text").isNotNull()).select("id", "received_at", c.expand_query(F.col("query_text"), it.DOMAIN, "horror film").alias("query"))


@query("fun40_redact", "SELECT id, received_at, lang AS shown, '[REDACTED]' AS hidden FROM rag_queries")
def _(s, d):
    event = c.redact(F.create_map(F.lit("lang"), F.col("lang"), F.lit("Session_ID"), F.col("session_id")), ["session_id", "password"])
    return table(s, d, "rag_queries").select("id", "received_at", event["lang"].alias("shown"), event["Session_ID"].alias("hidden"))


@query("fun42_prompt_context", """WITH r AS (SELECT source_id, content, metadata, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS rank FROM rag_documents WHERE source_id IS NOT NULL)
SELECT source_id, string_agg('[' || rank || '] ' || coalesce(json_extract_string(metadata, '$.title'), '') || CASE WHEN coalesce(json_extract_string(metadata, '$.year'), '') <> '' THEN ' (' || json_extract_string(metadata, '$.year') || ')' ELSE '' END || E'\\n' || content, E'\\n\\n' ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY 1""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy("chunk_index", "id")
    r = table(s, d, "rag_documents").where(F.col("source_id").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    return doc.prompt_context(r, ["source_id"])


@query("fun43_sources", "SELECT id, received_at, round(top_similarity_score, 4) AS similarity, CAST(NULL AS DOUBLE) AS rerank FROM rag_queries")
def _(s, d):
    return table(s, d, "rag_queries").select("id", "received_at", doc.response_sources(F.col("top_similarity_score"), F.lit(None).cast("double")).alias("x")).select("id", "received_at", "x.*")


@query("cls02_model_scores", "SELECT id, received_at, CASE WHEN s < 0.4 THEN 'needs_database' WHEN " + "(" + " OR ".join(f"contains(lower(query_text), '{k}')" for k in it.DOMAIN) + ") THEN 'needs_database' ELSE 'off_topic' END AS intent FROM (SELECT *, coalesce(top_similarity_score, 0) AS s FROM rag_queries WHERE query_text IS NOT NULL)")
def _(s, d):
    q = table(s, d, "rag_queries").where(F.col("query_text").isNotNull())
    scores = F.create_map(F.lit("off_topic"), F.coalesce("top_similarity_score", F.lit(0.0)), F.lit("thanks"), F.lit(-1.0))
    return q.select("id", "received_at", it.model_intent(F.col("query_text"), scores).alias("intent"))


_REPLIES = {"conversational": "welcome", "farewell": "goodbye", "thanks": "at your service", "off_topic": "films only"}


@query("cls03_routes", "SELECT CASE WHEN response_generated THEN 'retrieval' WHEN documents_retrieved = 0 THEN 'refusal' ELSE 'template' END AS route, count(*) AS n FROM rag_queries GROUP BY 1")
def _(s, d):
    kind = F.when(F.col("response_generated"), it.FALLBACK).when(F.col("documents_retrieved") == 0, "off_topic").otherwise("thanks")
    parts = it.split_routes(table(s, d, "rag_queries").select(it.route(kind).alias("route")))
    return parts["retrieval"].unionByName(parts["refusal"]).unionByName(parts["template"]).groupBy("route").agg(F.count("*").alias("n"))


@query("cls04_templates", "SELECT id, received_at, CASE WHEN id < '8' THEN CASE WHEN " + " OR ".join(f"contains(lower(coalesce(query_text, '')), '{k}')" for k in it.FAREWELLS) + " THEN 'goodbye' ELSE 'welcome' END ELSE 'at your service' END AS reply FROM rag_queries")
def _(s, d):
    kind = F.when(F.col("id") < "8", "conversational").otherwise("thanks")
    return table(s, d, "rag_queries").select("id", "received_at", it.template(kind, F.col("query_text"), _REPLIES).alias("reply"))


@query("agg18_success_rates", "SELECT source_type, CASE WHEN count(*) FILTER (WHERE chunk_index > 0) > 0 THEN round(100.0 * (1 - count(*) FILTER (WHERE chunk_index > 0 AND embedding IS NULL) / count(*) FILTER (WHERE chunk_index > 0)), 2) ELSE 100.0 END::DOUBLE AS loader_rate FROM rag_documents GROUP BY 1")
def _(s, d):
    later = F.col("chunk_index") > 0
    n, bad = F.count_if(later), F.count_if(later & F.col("embedding").isNull())
    return table(s, d, "rag_documents").groupBy("source_type").agg(g.success_rate(bad, n, 100.0).alias("loader_rate"))


@query("agg19_merged_stats", "SELECT count(*) FILTER (WHERE o = 0) AS inserted, count(*) FILTER (WHERE o = 1) AS updated, count(*) FILTER (WHERE o = 2) AS skipped, count(*) FILTER (WHERE o = 3) AS errors, count(*) AS total, round(100.0 * (1 - count(*) FILTER (WHERE o = 3) / count(*)), 2)::DOUBLE AS success_rate FROM (SELECT link_id % 4 AS o FROM film_languages)")
def _(s, d):
    kinds = F.array(*map(F.lit, g.LOADED))
    rows = table(s, d, "film_languages").select(kinds[(F.col("link_id") % 4).cast("int")].alias("outcome"), (F.col("link_id") % 10).alias("batch"), "language_id")
    return g.merge_stats(g.merge_stats(g.partial_stats(rows, "outcome", ["batch", "language_id"]), ["batch"]).select("batch", *g.LOADED))


@query("set05_ordered_distinct", "SELECT id, array_to_string(list_transform(list_filter(list_transform(genres, lambda g, i: {'g': g, 'i': i}), lambda x: list_position(genres, x.g) = x.i), lambda x: x.g), '|') AS genres FROM films WHERE genres IS NOT NULL")
def _(s, d):
    return table(s, d, "films").where(F.col("genres").isNotNull()).select("id", F.array_join(F.array_distinct("genres"), "|").alias("genres"))


@query("orc01_steps", "SELECT 'extract' AS step, 'success' AS status, (SELECT count(*) FROM films) AS \"rows\" UNION ALL SELECT 'score', 'skipped', NULL UNION ALL SELECT 'load', 'failed', NULL")
def _(s, d):
    def fails() -> DataFrame:
        raise ValueError("no target")

    audit = pipeline.run_steps(s, [("extract", lambda: table(s, d, "films")), ("score", lambda: table(s, d, "films")), ("load", fails), ("never", fails)], "r1", {"score"})
    return audit.select("step", "status", "rows")


@query("orc02_staged_run", f"WITH k AS (SELECT * FROM films WHERE vote_count >= 5 AND id > 0), n AS (SELECT * FROM k WHERE trim(title, {W}) <> '') SELECT (SELECT count(*) FROM films) AS total_rows, (SELECT count(*) FROM k) AS filtered, (SELECT count(*) FROM n) AS normalized, (SELECT count(*) FROM n) AS exported, 0::BIGINT AS errors, (SELECT count(DISTINCT original_language) + max(CASE WHEN original_language IS NULL THEN 1 ELSE 0 END) FROM k) AS languages")
def _(s, d):
    path = fresh_folder(s, "staged")
    out = pipeline.staged_run(table(s, d, "films"), (F.col("vote_count") >= 5) & (F.col("id") > 0), {"languages": lambda f: g.count_by(f, "original_language")}, rec.csv_records, lambda f: writers.write_parquet(f, path))
    row = (*[int(out[k]) for k in ("total_rows", "filtered", "normalized", "exported", "errors")], out["analytics"].get("languages", 0))
    return s.createDataFrame([row], "total_rows long, filtered long, normalized long, exported long, errors long, languages long")


_RULES = "CASE WHEN title IS NULL OR title = '' THEN 'title' END, CASE WHEN runtime NOT BETWEEN 1 AND 600 THEN 'runtime' END"


@query("orc04_validated", V + f"SELECT count(*) FILTER (WHERE e = '') AS valid, count(*) FILTER (WHERE e <> '') AS invalid, count(*) FILTER (WHERE e LIKE '%runtime%') AS bad_runtime FROM (SELECT concat_ws(',', {_RULES}) AS e FROM f)")
def _(s, d):
    good, bad = pipeline.validated(latest(table(s, d, "films")), {"title": F.coalesce("title", F.lit("")) != "", "runtime": F.col("runtime").between(1, 600)})
    n = good.agg(F.count("*").alias("valid"))
    return n.join(F.broadcast(bad.agg(F.count("*").alias("invalid"), F.count_if(F.array_contains("errors", "runtime")).alias("bad_runtime"))))


@query("orc03_aggregate", f"WITH x AS ({_fold_sql()}), f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vote_count DESC NULLS LAST) AS _rn FROM films) WHERE _rn = 1) SELECT id, round(" + SCORE.format(w="((CASE WHEN coalesce(vote_average > 0, false) THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN tomatometer_score IS NOT NULL THEN 0.30 ELSE 0 END)::DOUBLE + (CASE WHEN imdb_rating IS NOT NULL THEN 0.30 ELSE 0 END)::DOUBLE + (CASE WHEN kaggle_rating IS NOT NULL THEN 0.15 ELSE 0 END)::DOUBLE)", v="(CASE WHEN coalesce(vote_average > 0, false) THEN vote_average * 0.25::DOUBLE ELSE 0 END) + (CASE WHEN tomatometer_score IS NOT NULL THEN tomatometer_score / 10.0::DOUBLE * 0.30::DOUBLE ELSE 0 END) + (CASE WHEN imdb_rating IS NOT NULL THEN imdb_rating * 0.30::DOUBLE ELSE 0 END) + (CASE WHEN kaggle_rating IS NOT NULL THEN kaggle_rating * 0.15::DOUBLE ELSE 0 END)") + ", 1) AS score FROM x JOIN (SELECT id, vote_average FROM f2) USING (id)")
def _(s, d):
    a = table(s, d, "aggregated_films").withColumn("pos", F.col("rec_id"))
    part = lambda x, v, n: a.where(F.array_contains("sources", x)).select("tmdb_id", "imdb_id", "pos", F.col(v).alias(n), F.lit(None).cast("string").alias("overview"))
    base = latest(table(s, d, "films")).select("id", "tmdb_id", "imdb_id", "overview", "title", "release_date", "vote_average")
    out = pipeline.aggregate_films(base, part("rt", "tomatometer_score", "tomatometer_score"), part("imdb", "imdb_rating", "imdb_rating"), part("kaggle", "vote_average", "kaggle_rating"), part("spark", "aggregated_score", "spark_rating"), dedupe=False)
    return out.select("id", F.round("aggregated_score", 1).alias("score"))


@query("orc05_bundle", "SELECT 'films' AS name, count(*) AS n FROM films UNION ALL SELECT 'genres', sum(len(genres))::BIGINT FROM films UNION ALL SELECT 'ref_genres', (SELECT count(DISTINCT g) FROM (SELECT unnest(genres) AS g FROM films)) UNION ALL SELECT 'keywords', sum(len(keywords))::BIGINT FROM films UNION ALL SELECT 'ref_keywords', (SELECT count(DISTINCT g) FROM (SELECT unnest(keywords) AS g FROM films))")
def _(s, d):
    wrap = lambda col: F.transform(col, lambda x: F.struct(x.alias("name")))
    raw = table(s, d, "films").select("id", "title", wrap("genres").alias("genres"), wrap("keywords").alias("keywords"))
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in pipeline.bundle(raw, "id", {"genres": "genres", "keywords": "keywords"}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("orc06_retention", "SELECT 'rag_queries' AS table_name, count(*) FILTER (WHERE created_at < m - INTERVAL 30 DAY) AS deleted, count(*) FILTER (WHERE created_at IS NULL OR created_at >= m - INTERVAL 30 DAY) AS kept FROM rag_queries, (SELECT max(created_at) AS m FROM rag_queries)")
def _(s, d):
    q = table(s, d, "rag_queries").select("id", "created_at")
    newest = q.agg(F.max("created_at")).first()[0]
    kept, log = pipeline.retained(q, "created_at", F.lit(newest) - F.expr("INTERVAL 30 DAYS"), "rag_queries")
    return log.select("table_name", "deleted").join(F.broadcast(kept.agg(F.count("*").alias("kept"))))


@query("str01_recent_messages", "SELECT session_id, count(*) AS n, min(created_at) AS since FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT DISTINCT id, session_id, created_at FROM rag_queries WHERE session_id IS NOT NULL)) WHERE rn <= 10 GROUP BY 1")
def _(s, d):
    q = table(s, d, "rag_queries").where(F.col("session_id").isNotNull()).select("id", "session_id", "created_at").distinct()
    return sessions.recent(q, "session_id", ["created_at", "id"]).groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("since"))
