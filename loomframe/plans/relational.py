"""SQL-*, REL-* queries over the film tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import analytics as a
from loomframe.operators import titles as r
from loomframe.session import table


def _on_films(f, **kw):  # noqa: ANN001, ANN202
    return lambda spark, d: f(a.film_view(table(spark, d, "films")), **kw)


def _on_titles(f, *args, **kw):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, d: f(*r.titles_and_ratings(table(spark, d, "imdb_films")), *args, **kw)


def _crew(spark, d):  # noqa: ANN001, ANN202
    """Directors of linked titles: rows of aggregated_films in plain notation."""
    g = table(spark, d, "aggregated_films").where(F.col("director").isNotNull() & F.col("imdb_id").rlike("^tt[0-9]{8}$"))
    crew = g.select(F.col("imdb_id").alias("title_id"), F.lower("director").alias("name_id"), F.lit("director").alias("category")).distinct()
    return crew, g.select(F.lower("director").alias("name_id"), F.lower("director").alias("name")).distinct()


def rel08(spark, d):  # noqa: ANN001, ANN201
    """Titles of films with an imdb id serve as the ids of crew rows here."""
    g = table(spark, d, "aggregated_films").where(F.col("imdb_id").rlike("^tt[0-9]{8}$"))
    t = g.groupBy("imdb_id").agg(F.max("title").alias("primary_title")).select(F.col("imdb_id").alias("title_id"), F.lit("movie").alias("type"), "primary_title", F.lit("Horror").alias("genres"))
    rt = g.groupBy("imdb_id").agg(F.max("imdb_rating").alias("rating"), F.max("vote_count").alias("votes")).withColumnRenamed("imdb_id", "title_id")
    crew, people = _crew(spark, d)
    return r.top_people(t, rt, crew, people, least=2, min_votes=0)


V = "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vote_count DESC NULLS LAST) AS _rn FROM films) WHERE _rn = 1)\n"
DEC = "CAST(year(release_date) - year(release_date) % 10 AS BIGINT)"
T = """WITH t AS (SELECT imdb_id AS title_id, arg_max(title, (imdb_votes, title)) AS primary_title, arg_max({y: year}, (imdb_votes, title)).y AS premiered,
  arg_max({y: runtime}, (imdb_votes, title)).y AS runtime_minutes, arg_max({y: genres}, (imdb_votes, title)).y AS genres FROM imdb_films GROUP BY imdb_id),
r AS (SELECT imdb_id AS title_id, arg_max({y: imdb_rating}, (imdb_votes, title)).y AS rating, arg_max({y: imdb_votes}, (imdb_votes, title)).y AS votes FROM imdb_films GROUP BY imdb_id),
j AS (SELECT * FROM t JOIN r USING (title_id) WHERE genres ILIKE '%Horror%')
"""
SHOW = "SELECT title_id AS imdb_id, primary_title AS title, premiered AS year, runtime_minutes AS runtime, genres, rating, votes FROM j WHERE "

QUERIES = {
    "sql01_filtered": _on_films(a.filtered), "sql02_ranked_by_year": _on_films(a.ranked_by_year), "sql03_rating_percentiles": _on_films(a.rating_percentiles), "sql04_popularity_trend": _on_films(a.popularity_trend),
    "sql05_stats_by_decade": _on_films(a.stats_by_decade, min_votes=1, least=3), "sql06_stats_by_language": _on_films(a.stats_by_language, min_votes=10), "sql07_top_with_context": _on_films(a.top_with_context, min_votes=10),
    "sql08_genre_groups": _on_films(a.genre_groups, min_votes=5, least=2), "sql09_monthly_pattern": _on_films(a.monthly_pattern), "sql10_export_enriched": _on_films(a.export_enriched), "sql11_count_filtered": _on_films(a.count_filtered),
    "rel01_with_ratings": _on_titles(r.with_ratings, min_votes=50), "rel02_top_rated": _on_titles(r.top_rated, min_votes=50, n=25), "rel03_by_decade": _on_titles(r.by_decade, 1980, min_votes=5), "rel04_statistics": _on_titles(r.statistics, min_votes=50),
    "rel05_count_by_decade": _on_titles(r.count_by_decade, min_votes=5), "rel06_count_by_genres": _on_titles(r.count_by_genres, min_votes=5, least=3), "rel07_above_average": _on_titles(r.above_average, min_votes=50), "rel08_top_people": rel08,
    "rel09_for_enrichment": lambda s, d: r.for_enrichment(*r.titles_and_ratings(table(s, d, "imdb_films")), table(s, d, "aggregated_films").where(F.col("imdb_id").isNotNull()).select("imdb_id")).unionByName(r.for_enrichment(*r.titles_and_ratings(table(s, d, "imdb_films")), table(s, d, "films").where(F.col("imdb_id").isNotNull()).select("imdb_id"))),
    "rel10_distinct_ids": _on_titles(r.distinct_ids, min_votes=10), "rel11_bundle": _on_titles(r.bundle, min_votes=50),
}
SQL = {
    "sql01_filtered": V + "SELECT id, title, year(release_date) AS release_year, vote_average AS rating, vote_count AS votes, coalesce(popularity, 0.0) AS popularity, original_language FROM f WHERE vote_count >= 100 AND vote_average >= 5.0",
    "sql02_ranked_by_year": V + "SELECT id, title, year(release_date) AS release_year, vote_average AS rating, vote_count AS votes, CAST(row_number() OVER (PARTITION BY year(release_date) ORDER BY vote_average DESC NULLS LAST, vote_count DESC, id) AS INT) AS year_rank FROM f WHERE vote_count >= 100 AND release_date IS NOT NULL",
    "sql03_rating_percentiles": V + "SELECT id, title, vote_average AS rating, vote_count AS votes, round(percent_rank() OVER (ORDER BY vote_average), 3) AS percentile, CAST(ntile(4) OVER (ORDER BY vote_average, id) AS INT) AS quartile FROM f WHERE vote_count >= 50 AND vote_average IS NOT NULL",
    "sql04_popularity_trend": V + "SELECT id, title, year(release_date) AS release_year, popularity, lag(popularity) OVER w AS prev_popularity, lead(popularity) OVER w AS next_popularity, round(popularity - lag(popularity) OVER w, 6) AS popularity_change FROM f WHERE vote_count >= 100 AND release_date IS NOT NULL WINDOW w AS (ORDER BY release_date, id)",
    "sql05_stats_by_decade": V + f"SELECT {DEC} AS decade, count(*) AS movie_count, round(avg(vote_average) + 1e-9, 2) AS avg_rating, round(avg(vote_count) + 1e-9, 0) AS avg_votes, round(avg(popularity) + 1e-9, 2) AS avg_popularity, min(vote_average) AS min_rating, max(vote_average) AS max_rating FROM f WHERE release_date IS NOT NULL AND vote_count >= 1 GROUP BY 1 HAVING count(*) >= 3",
    "sql06_stats_by_language": V + "SELECT original_language, count(*) AS movie_count, round(avg(vote_average) + 1e-9, 2) AS avg_rating, count(*) FILTER (WHERE vote_average >= 7.0) AS high_rated_count, round(count(*) FILTER (WHERE vote_average >= 7.0) * 100.0 / count(*), 1) AS high_rated_pct FROM f WHERE vote_count >= 10 GROUP BY 1 HAVING count(*) >= 5",
    "sql07_top_with_context": V + f", s AS (SELECT *, {DEC} AS decade FROM f WHERE release_date IS NOT NULL AND vote_count >= 10), m AS (SELECT decade, avg(vote_average) AS mean FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY vote_average DESC NULLS LAST, id) AS decade_rank FROM s) SELECT id, title, decade, vote_average AS rating, vote_count AS votes, CAST(decade_rank AS INT) AS decade_rank, round(mean + 1e-9, 2) AS decade_avg, round(vote_average - mean + 1e-9, 2) AS vs_decade_avg FROM k JOIN m USING (decade) WHERE decade_rank <= 10",
    "sql08_genre_groups": V + ", g AS (SELECT array_to_string(genres, ', ') AS genre_names, vote_average FROM f WHERE vote_count >= 5) SELECT genre_names, count(*) AS movie_count, round(avg(vote_average) + 1e-9, 2) AS avg_rating, CAST(len(string_split(genre_names, ', ')) AS INT) AS genre_count FROM g WHERE coalesce(genre_names, '') <> '' GROUP BY genre_names HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20",
    "sql09_monthly_pattern": V + "SELECT month(release_date) AS release_month, monthname(release_date) AS month_name, count(*) AS movie_count, round(avg(vote_average) + 1e-9, 2) AS avg_rating, round(avg(popularity) + 1e-9, 2) AS avg_popularity FROM f WHERE release_date IS NOT NULL AND vote_count >= 50 GROUP BY 1, 2",
    "sql10_export_enriched": V + f"SELECT id AS kaggle_id, title, CAST(release_date AS VARCHAR) AS release_date, year(release_date) AS release_year, {DEC} AS decade, coalesce(vote_average, 0.0) AS rating, vote_count AS votes, coalesce(popularity, 0.0) AS popularity, original_language, coalesce(runtime, 0) AS runtime, overview, array_to_string(genres, ', ') AS genre_names, coalesce(budget, 0) AS budget, coalesce(revenue, 0) AS revenue, CASE WHEN vote_average >= 7.5 THEN 'excellent' WHEN vote_average >= 6.0 THEN 'good' WHEN vote_average >= 4.0 THEN 'average' ELSE 'poor' END AS rating_category, row_number() OVER (ORDER BY coalesce(vote_average, 0.0) DESC, vote_count DESC, id) AS global_rank FROM f WHERE vote_count >= 50",
    "sql11_count_filtered": V + "SELECT count(*) AS n FROM f WHERE vote_count >= 50",
    "rel01_with_ratings": T + SHOW + "votes >= 50 AND rating >= 0.0",
    "rel02_top_rated": T + SHOW + "votes >= 50 ORDER BY rating DESC NULLS LAST, votes DESC, imdb_id LIMIT 25",
    "rel03_by_decade": T + SHOW + "votes >= 5 AND premiered BETWEEN 1980 AND 1989",
    "rel04_statistics": T + "SELECT count(*) AS total_movies, round(avg(rating) + 1e-9, 2) AS avg_rating, min(rating) AS min_rating, max(rating) AS max_rating, round(avg(votes) + 1e-9, 0) AS avg_votes, min(premiered) AS earliest_year, max(premiered) AS latest_year, round(avg(runtime_minutes) + 1e-9, 0) AS avg_runtime FROM j WHERE votes >= 50",
    "rel05_count_by_decade": T + "SELECT CAST(premiered - premiered % 10 AS BIGINT) AS decade, count(*) AS movie_count, round(avg(rating) + 1e-9, 2) AS avg_rating FROM j WHERE votes >= 5 AND premiered IS NOT NULL GROUP BY 1",
    "rel06_count_by_genres": T + "SELECT genres, count(*) AS movie_count, round(avg(rating) + 1e-9, 2) AS avg_rating FROM j WHERE votes >= 5 GROUP BY 1 HAVING count(*) >= 3",
    "rel07_above_average": T + "SELECT title_id AS imdb_id, primary_title AS title, premiered AS year, rating, votes FROM j WHERE votes >= 50 AND rating > (SELECT avg(rating) FROM j WHERE votes >= 50)",
    "rel08_top_people": """WITH g AS (SELECT * FROM aggregated_films WHERE regexp_full_match(imdb_id, 'tt[0-9]{8}')),
t AS (SELECT imdb_id, max(imdb_rating) AS rating, max(vote_count) AS votes FROM g GROUP BY 1), c AS (SELECT DISTINCT imdb_id, lower(director) AS name FROM g WHERE director IS NOT NULL)
SELECT name, count(*) AS film_count, round(avg(rating) + 1e-9, 2) AS avg_rating FROM t JOIN c USING (imdb_id) WHERE votes >= 0 GROUP BY name HAVING count(*) >= 2 ORDER BY 2 DESC, 3 DESC NULLS LAST, 1 LIMIT 50""",
    "rel09_for_enrichment": T.replace("j AS (SELECT * FROM t JOIN r USING (title_id) WHERE genres ILIKE '%Horror%')", "j AS (SELECT * FROM t JOIN r USING (title_id))") + SHOW + "title_id IN (SELECT imdb_id FROM aggregated_films WHERE imdb_id IS NOT NULL) UNION ALL " + SHOW + "title_id IN (SELECT imdb_id FROM films WHERE imdb_id IS NOT NULL)",
    "rel10_distinct_ids": T + "SELECT DISTINCT title_id AS imdb_id FROM j WHERE votes >= 10",
    "rel11_bundle": T + "SELECT 'total' AS item, CAST(count(*) AS VARCHAR) AS value FROM j WHERE votes >= 50 UNION ALL SELECT 'top', title_id FROM (SELECT title_id FROM j WHERE votes >= 50 ORDER BY rating DESC NULLS LAST, votes DESC, title_id LIMIT 10) UNION ALL SELECT 'eighties', CAST(count(*) AS VARCHAR) FROM j WHERE votes >= 50 AND premiered BETWEEN 1980 AND 1989",
}
