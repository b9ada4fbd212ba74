"""RET-*, EVA-*, CLS-* queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions import vectors as v
from loomframe.functions.cleaning import popularity_score, strip_noise
from loomframe.operators import evaluate as ev
from loomframe.operators import intent as it
from loomframe.operators import retrieval as r
from loomframe.operators.analytics import latest
from loomframe.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


Q1 = "q AS (SELECT embedding::DOUBLE[] AS q FROM rag_documents WHERE len(embedding) = 64 AND vote_count >= 100 ORDER BY id LIMIT 1)"
C = "list_cosine_similarity(embedding::DOUBLE[], q)"
VEC = f"WITH {Q1}, h AS (SELECT id, source_id, {C} AS s FROM rag_documents, q WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND vote_count >= {{votes}})"


def _one(s, d) -> DataFrame:  # noqa: ANN001
    return table(s, d, "rag_documents").where((F.size("embedding") == 64) & (F.col("vote_count") >= 100)).orderBy("id").limit(1).select(F.col("embedding").alias("q"))


def _hits(s, d, k=20, threshold=0.3, votes=100) -> DataFrame:  # noqa: ANN001
    docs = table(s, d, "rag_documents").where(F.size("embedding") == 64)
    return r.cosine_topk(docs, None, "embedding", "id", k, threshold, None, votes, _one(s, d))


@query("ret01_cosine_topk", VEC.format(votes=10) + " SELECT id, round(s, 6) AS similarity FROM h WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 20")
def _(s, d):
    return _hits(s, d, 20, 0.1, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("ret11_film_search", VEC.format(votes=1) + ", t AS (SELECT * FROM h WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 60) SELECT source_id, round(max(s), 4) AS score FROM t WHERE source_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(s, d):
    return r.best_per_film(_hits(s, d, 60, 0.1, 1).where(F.col("source_id").isNotNull()), "source_id", 20)


@query("ret13_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round(v.cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("ret14_quality", "SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS dimension, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) <= 0.01) AS unit, count(*) FILTER (WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0) AS nonzero FROM rag_documents")
def _(s, d):
    q = v.quality(F.col("embedding"), 64)
    return table(s, d, "rag_documents").select(q.alias("q")).agg(F.count("*").alias("n"), *[F.count_if(F.col(f"q.{x}")).alias(x) for x in ("dimension", "unit", "nonzero")])


@query("ret15_pair_thresholds", "SELECT a.label = b.label AS alike, count(*) AS n, count(*) FILTER (WHERE CASE WHEN a.label = b.label THEN c >= 0.1 ELSE c <= 0.3 END) AS ok FROM (SELECT a, b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3) GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings")
    p = e.join(e.select((F.col("vec_id") - 3).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("lb")), "vec_id").withColumn("c", v.cosine(F.col("embedding"), F.col("b")))
    alike = F.col("label") == F.col("lb")
    return p.groupBy(alike.alias("alike")).agg(F.count("*").alias("n"), F.count_if(F.when(alike, F.col("c") >= 0.1).otherwise(F.col("c") <= 0.3)).alias("ok"))


@query("ret16_batch_topk", "WITH p AS (SELECT a.vec_id, b.vec_id AS near_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, near_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, CAST(near_id AS VARCHAR)) AS rn FROM p) WHERE rn <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    t = r.batch_topk(e, e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), "embedding"), "vec_id", "embedding", 64)
    return t.select(F.col("query").cast("long").alias("vec_id"), F.col("key").cast("long").alias("near_id"), F.round("similarity", 6).alias("similarity"))


ASK = "the drowned boy and the widows of the lighthouse"
_V = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vote_count DESC NULLS LAST) AS _rn FROM films) WHERE _rn = 1)"
_STEM = "CASE WHEN regexp_matches(w, '[^ea]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[^aeo]es$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, '[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
_WORDS = "unnest(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+'))"
_Y = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 's$', ''), 'r$', ''), 'e$', ''), 'é$', '')"
_STEM_FR = f"CASE WHEN length(w) < 6 THEN w WHEN w LIKE '%aux' THEN regexp_replace(w, 'aux$', 'al') WHEN w LIKE '%x' THEN regexp_replace(w, 'x$', '') WHEN right({_Y}, 1) = left(right({_Y}, 2), 1) AND length({_Y}) > 1 THEN left({_Y}, length({_Y}) - 1) ELSE {_Y} END"
_FIELDS = [("fr", "coalesce(nullif(title_fr, ''), title)", "A", "fr"), ("fr", "array_to_string(alternative_titles, ' ')", "A", "fr"), ("fr", "director", "A", "w"), ("fr", "array_to_string(keywords, ' ')", "C", "w"), ("fr", "overview_fr", "C", "fr"), ("en", "title", "A", "en"), ("en", "director", "A", "w"), ("en", "array_to_string(keywords, ' ')", "C", "w"), ("en", "overview", "C", "en")]
_STEMS = {"fr": _STEM_FR, "en": _STEM, "w": "w"}
INDEX = f"""{_V}, dr AS (SELECT tmdb_id, max(director) AS director FROM aggregated_films WHERE director IS NOT NULL GROUP BY 1), fd AS (SELECT f.*, director FROM f LEFT JOIN dr USING (tmdb_id)),
ix AS (SELECT tmdb_id, vote_count, side, weight, lexeme, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT tmdb_id, vote_count, '{side}' AS side, '{wt}' AS weight, {_STEMS[st]} AS lexeme FROM (SELECT tmdb_id, vote_count, {_WORDS.format(x)} AS w FROM fd)" for side, x, wt, st in _FIELDS) + ") GROUP BY ALL)"
LEX = f"""{INDEX}, qw AS (SELECT unnest(string_split('{ASK}', ' ')) AS w), q AS (SELECT DISTINCT unnest([w, {_STEM}, {_STEM_FR}]) AS lexeme FROM qw WHERE length(w) > 1),
lx AS (SELECT tmdb_id, sum(CASE weight WHEN 'A' THEN n ELSE 0 END)::DOUBLE AS score, CASE WHEN sum(CASE WHEN weight = 'A' AND side = 'fr' THEN n ELSE 0 END) >= sum(CASE WHEN weight = 'A' AND side = 'en' THEN n ELSE 0 END) THEN 'fr' ELSE 'en' END AS source,
row_number() OVER (ORDER BY sum(CASE weight WHEN 'A' THEN n ELSE 0 END) DESC, tmdb_id) AS rank FROM ix JOIN q USING (lexeme) WHERE vote_count >= 5 GROUP BY 1)"""


def _index(s, d, votes=0) -> DataFrame:  # noqa: ANN001
    who = table(s, d, "aggregated_films").where(F.col("director").isNotNull()).groupBy("tmdb_id").agg(F.max("director").alias("director"))
    f = latest(table(s, d, "films")).where(F.coalesce("vote_count", F.lit(0)) >= votes)
    return r.film_index(f.join(who, "tmdb_id", "left").withColumn("cast", F.lit(None).cast("array<string>")))


def _lexeme_hits(s, d, k=20) -> DataFrame:  # noqa: ANN001
    ask = s.createDataFrame([(1, ASK)], "query int, text string").withColumn("text", strip_noise(F.col("text")))
    return r.lexeme_search(_index(s, d, 5), r.query_lexemes(ask, "query", "text", ["simple", "en", "fr"]), "tmdb_id", "query", k)


@query("ret04_lexeme_search", f"WITH {LEX} SELECT tmdb_id, score, source, rank FROM lx WHERE rank <= 20")
def _(s, d):
    return _lexeme_hits(s, d).select("tmdb_id", "score", "source", "rank")


@query("ret03_lexeme_index", f"WITH {INDEX} SELECT tmdb_id, side, weight, lexeme, n FROM ix")
def _(s, d):
    return _index(s, d).select("tmdb_id", "side", "weight", "lexeme", "n")


_FUSE = f"""WITH {Q1}, h AS (SELECT id, source_id AS tmdb_id, {C} AS s FROM rag_documents, q WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND vote_count >= 5),
hr AS (SELECT tmdb_id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM h WHERE s >= 0.0), va AS (SELECT tmdb_id, min(rank) AS rank FROM hr WHERE rank <= 20 AND tmdb_id IS NOT NULL GROUP BY 1), """ + LEX.replace("q AS (SELECT DISTINCT", "ql AS (SELECT DISTINCT").replace("JOIN q USING", "JOIN ql USING") + """,
fu AS (SELECT coalesce(a.tmdb_id, b.tmdb_id) AS tmdb_id, coalesce(0.5 / (60 + a.rank), 0)::DOUBLE + coalesce(0.5 / (60 + b.rank), 0)::DOUBLE AS rrf FROM va a FULL JOIN (SELECT * FROM lx WHERE rank <= 20) b ON a.tmdb_id = b.tmdb_id)"""


def _fused(s, d) -> DataFrame:  # noqa: ANN001
    h = _hits(s, d, 20, 0.0, 5).select("id", F.col("source_id").alias("tmdb_id"), "similarity")
    w = r.Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "id")  # 20 rows
    vec = r.first_ranks(h.withColumn("rank", F.row_number().over(w)).where(F.col("tmdb_id").isNotNull()), "tmdb_id", [])
    return r.rrf(vec, _lexeme_hits(s, d).select("tmdb_id", "rank"), ["tmdb_id"])


@query("ret06_rrf", _FUSE + " SELECT tmdb_id, round(rrf, 8) AS rrf FROM fu")
def _(s, d):
    return _fused(s, d).select("tmdb_id", F.round("rrf", 8).alias("rrf"))


@query("ret08_hybrid", _FUSE + """, p AS (SELECT tmdb_id, max(0.7 * ln(1 + coalesce(vote_count, 0)) / 10 + 0.3 * ln(1 + coalesce(popularity, 0)) / 6) AS pop FROM f GROUP BY 1)
SELECT tmdb_id, round(rrf + 0.02 * coalesce(pop, 0), 8) AS final FROM fu LEFT JOIN p USING (tmdb_id) WHERE tmdb_id IN (SELECT source_id FROM rag_documents) ORDER BY rrf + 0.02 * coalesce(pop, 0) DESC, tmdb_id LIMIT 5""")
def _(s, d):
    pop = latest(table(s, d, "films")).groupBy("tmdb_id").agg(F.max(popularity_score(F.col("vote_count"), F.col("popularity"))).alias("popularity"))
    b = r.boosted(_fused(s, d), pop, table(s, d, "rag_documents").select(F.col("source_id").alias("tmdb_id")), "tmdb_id")
    return b.orderBy(F.desc("final"), "tmdb_id").limit(5).select("tmdb_id", F.round("final", 8).alias("final"))


@query("ret10_answers", """WITH q AS (SELECT DISTINCT id, session_id, top_similarity_score FROM rag_queries WHERE session_id IS NOT NULL)
SELECT session_id, count(*) FILTER (WHERE top_similarity_score IS NULL OR top_similarity_score >= 0.5) AS documents, CASE WHEN count(*) FILTER (WHERE top_similarity_score IS NULL OR top_similarity_score >= 0.5) = 0 THEN 'nothing reliable' END AS refusal FROM q GROUP BY 1""")
def _(s, d):
    q = table(s, d, "rag_queries").where(F.col("session_id").isNotNull()).select("session_id", F.col("id").alias("doc"), F.col("top_similarity_score").alias("rerank"), F.lit(1).alias("rank")).distinct()
    return r.answers(q, q, "session_id", "doc", "nothing reliable", floor=0.5).select("session_id", F.size("documents").cast("long").alias("documents"), "refusal")


@query("ret12_embed_texts", """SELECT kind, CASE WHEN trim(coalesce(t, ''), ' ') = '' THEN 0.0 ELSE 1.0 END AS norm, count(*) AS n FROM (SELECT 'passage' AS kind, title AS t FROM films UNION ALL SELECT 'query', query_text FROM rag_queries) GROUP BY 1, 2""")
def _(s, d):
    e = r.hashing_embedder(64)
    t = table(s, d, "films").select(F.lit("passage").alias("kind"), F.col("title").alias("t")).unionByName(table(s, d, "rag_queries").select(F.lit("query").alias("kind"), F.col("query_text").alias("t")))
    text = F.when(F.col("kind") == "query", r.prefixed(F.col("t"), "query")).otherwise(r.prefixed(F.col("t"), "passage"))
    return t.select("kind", F.round(v.norm(e(text)), 3).alias("norm")).groupBy("kind", "norm").agg(F.count("*").alias("n"))


@query("ret02_retrieve", VEC.format(votes=5) + " SELECT id, round(s, 6) AS similarity FROM h WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 10")
def _(s, d):
    return _hits(s, d, 10, 0.2, 5).select("id", F.round("similarity", 6).alias("similarity"))


@query("ret09_rerank", VEC.format(votes=1) + ", t AS (SELECT * FROM h WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 60), z AS (SELECT t.id, length(content) AS n FROM t JOIN rag_documents d USING (id) WHERE length(content) >= 100) SELECT id, n::DOUBLE AS rerank, row_number() OVER (ORDER BY n DESC, id) AS rank FROM z ORDER BY 3 LIMIT 10")
def _(s, d):
    hits = _hits(s, d, 60, 0.1, 1).select("id", F.lit(1).alias("query"), "content")
    return r.rerank(hits, F.length("content").cast("double"), ["query"], "id", 100.0, 10).select("id", "rerank", "rank")


@query("ret14_consistent", "SELECT count(*) AS n, count(*) FILTER (WHERE list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: x * 2)) >= 0.99) AS ok FROM rag_documents WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0")
def _(s, d):
    e = table(s, d, "rag_documents").where((F.size("embedding") == 64) & (v.norm(F.col("embedding")) > 0))
    return e.agg(F.count("*").alias("n"), F.count_if(v.consistent(F.col("embedding"), F.transform("embedding", lambda x: x * 2))).alias("ok"))


_P = "p AS (SELECT a.vec_id AS query, a.label, b.vec_id AS key, b.label AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, CAST(key AS VARCHAR)) AS rank FROM p)"


def _probes(s, d, k) -> DataFrame:  # noqa: ANN001
    e = table(s, d, "embeddings")
    t = r.batch_topk(e, e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), "embedding"), "vec_id", "embedding", 64, k)
    lab = lambda c: e.select(F.col("vec_id").cast("string").alias(c), F.col("label").alias(f"l_{c}"))
    return t.join(lab("query"), "query").join(lab("key"), "key")


@query("eva01_hit_at_5", f"WITH {_P} SELECT query AS vec_id, bool_or(label = other) AS hit FROM t WHERE rank <= 5 GROUP BY 1")
def _(s, d):
    t = _probes(s, d, 5).groupBy("query", "l_query").agg(F.collect_list("l_key").alias("found"))
    return t.select(F.col("query").cast("long").alias("vec_id"), ev.hit_at_k(F.col("found"), F.array("l_query")).alias("hit"))


@query("eva02_accuracy", f"WITH {_P}, n AS (SELECT * FROM t WHERE rank = 1) SELECT label, count(*) AS n, round(avg(CAST(label = other AS INT)) + 1e-9, 4) AS recall, round(avg(s) + 1e-9, 4) AS confidence FROM n GROUP BY ROLLUP (label)")
def _(s, d):
    return ev.accuracy(_probes(s, d, 1), "l_query", "l_key", "similarity").withColumnRenamed("l_query", "label")


@query("eva04_empty_answers", "SELECT count(*) AS n FROM rag_queries WHERE documents_retrieved = 0 AND response_generated")
def _(s, d):
    q = table(s, d, "rag_queries").select(F.lit("needs_database").alias("intent"), F.when(F.col("documents_retrieved") == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("sources"), F.when(~F.col("response_generated"), F.lit("error")).alias("error"), "documents_retrieved", "response_generated")
    return ev.empty_answers(q.where(F.col("response_generated").isNotNull()), "intent", "sources", "error")


_R = f"WITH {_P}, m AS (SELECT query, label, min(CASE WHEN label = other THEN rank END) AS a, min(CASE WHEN label = other AND key % 2 = 0 THEN rank END) AS b FROM t WHERE rank <= 20 GROUP BY 1, 2)"


def _ranks(s, d) -> DataFrame:  # noqa: ANN001
    same = F.col("l_query") == F.col("l_key")
    return _probes(s, d, 20).groupBy("query").agg(F.min(F.when(same, F.col("rank"))).alias("a"), F.min(F.when(same & (F.col("key").cast("long") % 2 == 0), F.col("rank"))).alias("b"))


@query("eva06_fate", _R + " SELECT query AS vec_id, CASE WHEN b <= 5 THEN 'OK' WHEN b IS NOT NULL THEN 'RANKING' WHEN a IS NOT NULL THEN 'POOL_CUT' ELSE 'UNREACHABLE' END AS fate FROM m")
def _(s, d):
    return _ranks(s, d).select(F.col("query").cast("long").alias("vec_id"), ev.fate(F.col("b"), F.col("a"), F.col("a")).alias("fate"))


@query("eva09_loss_stage", _R + " SELECT stage, count(*) AS n FROM (SELECT CASE WHEN a IS NULL THEN 'RETRIEVAL' WHEN coalesce(b > 5, true) THEN 'FUSION' WHEN a < 1 THEN 'RERANK' ELSE 'HIT' END AS stage FROM m) GROUP BY 1")
def _(s, d):
    st = ev.loss_stage(F.col("a").isNotNull(), F.col("b"), F.col("a").cast("double"), F.lit(1.0))
    return ev.furthest(_ranks(s, d).withColumn("stage", st), "query", "stage").groupBy("stage").agg(F.count("*").alias("n"))


_GRID = f"""WITH {_P}, k AS (SELECT query, label, key, other, rank AS rank_a, row_number() OVER (PARTITION BY query ORDER BY key) AS rank_b, s AS rerank FROM t WHERE rank <= 12),
g AS (SELECT w::DOUBLE AS weight, k::INT AS rrf_k, f::DOUBLE AS floor FROM (SELECT unnest([0.3, 0.5, 0.7]) AS w), (SELECT unnest([20, 60]) AS k), (SELECT unnest([0.0, 0.2]) AS f)),
s AS (SELECT g.*, k.*, row_number() OVER (PARTITION BY weight, rrf_k, floor, query ORDER BY round(weight / (rrf_k + rank_a) + (1 - weight) / (rrf_k + rank_b), 12) DESC, key) AS place FROM k, g),
h AS (SELECT weight, rrf_k, floor, count(DISTINCT query) FILTER (WHERE place <= 5 AND rerank >= floor AND label = other) AS hits FROM s GROUP BY 1, 2, 3)"""


def _sweep(s, d) -> DataFrame:  # noqa: ANN001
    p = _probes(s, d, 12).withColumn("key", F.col("key").cast("long"))
    w = r.Window.partitionBy("query").orderBy("key")
    p = p.select("query", "key", F.col("rank").alias("rank_a"), F.row_number().over(w).alias("rank_b"), F.col("similarity").alias("rerank"), "l_query", "l_key")
    grid = s.createDataFrame([(a, b, c) for a in (0.3, 0.5, 0.7) for b in (20, 60) for c in (0.0, 0.2)], "weight double, rrf_k int, floor double")
    return ev.grid_sweep(p.drop("l_query", "l_key"), p.where(F.col("l_query") == F.col("l_key")).select("query", "key"), grid)


@query("eva07_grid_sweep", _GRID + " SELECT weight, rrf_k, floor, hits FROM h")
def _(s, d):
    return _sweep(s, d)


@query("eva08_best_params", _GRID + " SELECT weight, rrf_k, floor, hits FROM h ORDER BY hits DESC, floor DESC, abs(weight - 0.5), abs(rrf_k - 60) LIMIT 1")
def _(s, d):
    return ev.best_params(_sweep(s, d))


@query("eva10_overlap", f"WITH {_P}, l AS (SELECT query, list(key) FILTER (WHERE rank <= 5) AS a, list(key) FILTER (WHERE rank BETWEEN 3 AND 7) AS b FROM t GROUP BY 1) SELECT round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 4) AS overlap FROM l")
def _(s, d):
    t = _probes(s, d, 7).groupBy("query").agg(F.collect_list(F.when(F.col("rank") <= 5, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("rank") >= 3, F.col("key"))).alias("b"))
    return ev.mean_overlap(t, "a", "b")


@query("eva11_ab_report", f"WITH {_P} SELECT label AS model, round(avg(s) + 1e-9, 4) AS mean_top1, round(median(s), 4) AS median_top1, round(quantile_cont(query::DOUBLE, 0.5), 2) AS p50, round(quantile_cont(query::DOUBLE, 0.95), 2) AS p95 FROM t WHERE rank = 1 GROUP BY 1")
def _(s, d):
    return ev.ab_report(_probes(s, d, 1).withColumn("ms", F.col("query").cast("double")), "l_query", "similarity", "ms").withColumnRenamed("l_query", "model")


@query("eva12_suites", "SELECT lang AS suite, count(*) AS tests, count(*) FILTER (WHERE NOT response_generated) AS failed, round(sum(response_time_ms) / 1000.0, 3) AS seconds, bool_and(response_generated) AS passed FROM rag_queries WHERE response_generated IS NOT NULL GROUP BY 1")
def _(s, d):
    c = table(s, d, "rag_queries").where(F.col("response_generated").isNotNull()).select(F.col("lang").alias("suite"), F.when(F.col("response_generated"), "passed").otherwise("failed").alias("status"), (F.col("response_time_ms") / 1000).alias("seconds"))
    return ev.suites(c, "suite", "status", "seconds")


_KW = "|".join(sorted(it.DOMAIN))
_G, _TH = "|".join(sorted(it.GREETINGS, key=lambda p: (-len(p), p))), "|".join(sorted(it.THANKS, key=lambda p: (-len(p), p)))
_B = "(^|[^\\p{{L}}\\p{{N}}_\\p{{M}}])({})($|[^\\p{{L}}\\p{{N}}_\\p{{M}}])"


@query("cls01_rules", f"""WITH q AS (SELECT query_text AS t, NOT regexp_matches(lower(query_text), '{_KW}') AND len(regexp_split_to_array(trim(query_text), '\\s+')) <= 10 AS short FROM rag_queries)
SELECT CASE WHEN trim(coalesce(t, '')) = '' THEN 'needs_database' WHEN short AND regexp_matches(t, '(?i){_B.format(_TH)}') THEN 'thanks' WHEN short AND regexp_matches(t, '(?i){_B.format(_G)}') THEN 'conversational' ELSE 'needs_database' END AS intent, count(*) AS n FROM q GROUP BY 1""")
def _(s, d):
    return it.classify(table(s, d, "rag_queries"), "query_text").groupBy("intent").agg(F.count("*").alias("n"))
