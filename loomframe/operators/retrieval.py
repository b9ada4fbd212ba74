"""Vector, lexeme and hybrid retrieval (RET-01..16, TOP-01, 02)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.vectors import cosine

QUERY_BLOCK = 4096  # query vectors that are broadcast at once
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def cosine_topk(docs: DataFrame, query: Column | None, vec: str, key: str, k: int = 20, threshold: float = 0.3, kind: str | None = None, min_votes: int | None = 100, one: DataFrame | None = None) -> DataFrame:
    """RET-01, 02: the k rows most similar to one query vector; filters reach the scan before any vector is read.

    The query is a literal column, or the only row of `one` (column `q`), which is broadcast.
    """
    d = docs if kind is None else docs.where(F.col("source_type") == kind)
    d = d if min_votes is None else d.where(F.col("vote_count") >= min_votes)
    if one is not None:
        d = d.join(F.broadcast(one.limit(1)))
        query = F.col("q")
    d = d.withColumn("similarity", cosine(F.col(vec), query)).where(F.col("similarity") >= threshold)
    return d.orderBy(F.desc("similarity"), key).limit(k)


def _block_scores(ids: list, q: np.ndarray, dim: int, k: int, threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            s = q @ x.T
            if s.shape[1] > k:  # what is not among the k best of a batch is not among them at all; ties stay
                kth = np.partition(s, -k, axis=1)[:, -k]
                i, j = np.nonzero((s >= kth[:, None]) & (s >= threshold))
            else:
                i, j = np.nonzero(s >= threshold)
            yield pa.record_batch([pa.array([ids[m] for m in i], pa.string()), b.column(0).take(pa.array(j)), pa.array(s[i, j])], ["query", "key", "similarity"])

    return run


def batch_topk(docs: DataFrame, queries: DataFrame, key: str, vec: str, dim: int, k: int = 5, threshold: float = -1.0, skip_self: bool = True) -> DataFrame:
    """Exact k nearest rows of each query: queries in blocks of bounded size against all rows, partial top-k per batch.

    queries: (query, vec). Unusable vectors are left out on both sides.
    """
    ok = (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    rows = queries.where(ok).select(F.col("query").cast("string").alias("query"), F.col(vec).cast("array<double>").alias("v"))
    held = docs.where(ok).select(F.col(key).cast("string").alias("key"), F.col(vec).cast("array<double>").alias("v"))
    out = None
    block: list = []

    def flush(block: list) -> DataFrame:
        q = np.array([r["v"] for r in block])
        n = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, n, out=np.zeros_like(q), where=n > 0)
        return held.mapInArrow(_block_scores([r["query"] for r in block], q, dim, k + 1, threshold), "query string, key string, similarity double")

    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part = flush(block)
            out, block = (part if out is None else out.unionByName(part)), []
    if block or out is None:
        part = flush(block) if block else held.select(F.lit("").alias("query"), "key", F.lit(0.0).alias("similarity")).limit(0)
        out = part if out is None else out.unionByName(part)
    if skip_self:
        out = out.where(F.col("query") != F.col("key"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_film(hits: DataFrame, film: str, k: int) -> DataFrame:
    """RET-11, WIN-07: the best similarity of each film, then the first k."""
    return hits.groupBy(film).agg(F.round(F.max("similarity"), 4).alias("score")).orderBy(F.desc("score"), film).limit(k)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))


def stem_en(w: Column) -> Column:
    """Plural endings after Harman's S-stemmer: ies to y, es to e, s to nothing, each with its exceptions."""
    return (
        F.when(w.rlike("[^ea]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("[^aeo]es$"), F.regexp_replace(w, "s$", ""))
        .when(w.rlike("[^us]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def stem_fr(w: Column) -> Column:
    """Savoy's minimal French stemmer on words of six letters or more: aux to al, then x, s, r, e, é and a doubled last letter."""
    x = F.when(w.endswith("aux"), F.regexp_replace(w, "aux$", "al")).otherwise(F.regexp_replace(w, "x$", ""))
    y = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "s$", ""), "r$", ""), "e$", ""), "é$", "")
    y = F.regexp_replace(y, r"(.)\1$", "$1")
    return F.when(F.length(w) < 6, w).when(w.endswith("x"), x).otherwise(y)


STEMS: dict[str, Callable[[Column], Column]] = {"simple": lambda w: w, "en": stem_en, "fr": stem_fr}


def lexeme_index(df: DataFrame, key: str, fields: list[tuple[Column, str, str]]) -> DataFrame:
    """RET-03: (key, lexeme, weight, n): how often each lexeme stands in fields of each weight.

    fields: (text, weight letter, stemmer). One row per key, lexeme and weight; bucket it by lexeme to
    keep it.
    """
    def cell(text: Column, weight: str, stem: str) -> Column:
        return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.struct(STEMS[stem](w).alias("lexeme"), F.lit(weight).alias("weight")))

    cells = [cell(*f) for f in fields]
    return df.select(key, F.explode(F.flatten(F.array(*cells))).alias("x")).groupBy(key, "x.lexeme", "x.weight").agg(F.count("*").alias("n"))


def film_index(films: DataFrame, key: str = "tmdb_id") -> DataFrame:
    """RET-03: (key, side, lexeme, weight, n) in two languages: A titles and director, B cast, C overview and keywords.

    Names and keywords are not stemmed. The French title falls back to the title.
    """
    arr = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    fr = F.coalesce(F.nullif("title_fr", F.lit("")), F.col("title"))
    names = [(F.col("director"), "A", "simple"), (arr("cast"), "B", "simple"), (arr("keywords"), "C", "simple")]
    sides = {"fr": [(fr, "A", "fr"), (arr("alternative_titles"), "A", "fr"), *names, (F.col("overview_fr"), "C", "fr")], "en": [(F.col("title"), "A", "en"), *names, (F.col("overview"), "C", "en")]}
    parts = [lexeme_index(films, key, fields).withColumn("side", F.lit(side)) for side, fields in sides.items()]
    return parts[0].unionByName(parts[1]).select(key, "side", "lexeme", "weight", "n")


def query_lexemes(queries: DataFrame, query: str, text: str, stems: list[str]) -> DataFrame:
    """SET-04: the union of the lexemes of all configurations."""
    arrays = [F.transform(words(F.col(text)), STEMS[s]) for s in stems]
    return queries.select(query, F.explode(F.array_distinct(F.flatten(F.array(*arrays)))).alias("lexeme"))


def lexeme_search(index: DataFrame, lexemes: DataFrame, key: str, query: str, k: int = 20) -> DataFrame:
    """RET-04: rows holding any lexeme, ranked by cover density over weights A and B only; `source` is the stronger side.

    In a query of alternatives every occurrence is a cover of its own, so the density is the sum
    of the weights of all occurrences. Rows matched by weight C only score 0. An index without sides has one.
    """
    w = F.create_map(*[F.lit(x) for g, v in WEIGHTS.items() if g in "AB" for x in (g, v)])
    worth = F.col("n") * F.coalesce(F.try_element_at(w, F.col("weight")), F.lit(0.0))
    side = F.col("side") if "side" in index.columns else F.lit("en")
    each = lambda s: F.coalesce(F.sum(F.when(F.col("_side") == s, worth)), F.lit(0.0))
    hit = index.withColumn("_side", side).join(lexemes, "lexeme").groupBy(query, key).agg(F.sum(worth).alias("score"), F.when(each("fr") >= each("en"), "fr").otherwise("en").alias("source"))
    o = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return hit.withColumn("rank", F.row_number().over(o)).where(F.col("rank") <= k)


def first_ranks(ranked: DataFrame, key: str, by: list[str]) -> DataFrame:
    """WIN-06: the best rank of each key; gaps stay."""
    return ranked.groupBy(*by, key).agg(F.min("rank").alias("rank"))


def rrf(a: DataFrame, b: DataFrame, keys: list[str], k: int = 60, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """RET-06: weighted reciprocal ranks; a list without the key adds nothing."""
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    j = a.select(*keys, F.col("rank").alias("rank_a")).join(b.select(*keys, F.col("rank").alias("rank_b")), keys, "full")
    return j.withColumn("rrf", part("rank_a", wa) + part("rank_b", wb))


def boosted(fused: DataFrame, popularity: DataFrame, docs: DataFrame, key: str, weight: float = 0.02) -> DataFrame:
    """RET-07: plus weight times popularity (missing is 0); films without a document drop out."""
    return fused.join(popularity, key, "left").join(docs.select(key).distinct(), key, "left_semi").withColumn("final", F.col("rrf") + weight * F.coalesce("popularity", F.lit(0.0)))


def top_final(scored: DataFrame, by: list[str], key: str, score: str, k: int = 5) -> DataFrame:
    """RET-08, TOP-02."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, scorer: Column, by: list[str], key: str, floor: float, k: int) -> DataFrame:
    """RET-09, TOP-01: any scorer column (a pandas UDF holds the model), floor, then the first k."""
    return top_final(hits.withColumn("rerank", scorer).where(F.col("rerank") >= floor), by, key, "rerank", k)


def trusted(hits: DataFrame, score: str = "rerank", floor: float = -5.0) -> DataFrame:
    """RET-10: a missing score passes."""
    return hits.where(F.col(score).isNull() | (F.col(score) >= floor))


def answers(queries: DataFrame, hits: DataFrame, query: str, key: str, refusal: str, score: str = "rerank", floor: float = -5.0) -> DataFrame:
    """RET-10: the trusted documents of each query in order; where none is left, a fixed refusal and no document."""
    kept = trusted(hits, score, floor).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("documents"))
    none = F.array().cast(dict(kept.dtypes)["documents"])
    return queries.select(query).distinct().join(kept, query, "left").select(query, F.coalesce("documents", none).alias("documents"), F.when(F.col("documents").isNull(), F.lit(refusal)).alias("refusal"))


def prefixed(text: Column, kind: str) -> Column:
    """RET-12: the mark that an asymmetric embedder wants before a query or a passage; blanks stay blank."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit(kind + ": "), text))


def hashing_embedder(dim: int):  # noqa: ANN201
    """RET-12: a deterministic stand-in for an embedding model: signed word hashes, L2-normalised; blanks give zeros."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            if (t or "").strip() and not v.any():  # its words cancel out
                v[len(t) % dim] = 1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return embed
