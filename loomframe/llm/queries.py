"""Queries of the problems tagged llm, with SQL where it can express them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import entities, language, lookalikes, neighbours, packing, splitting, survivors, tokenize
from loomframe.session import cut, fresh_folder, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "rag_documents"), "id", "embedding").select("id_a", "id_b")


def _by_twenty(c: str):  # noqa: ANN202
    """Whether a uuid, read as a number, is divisible by 20: every power of 16 leaves 16."""
    digit = lambda x: F.conv(x, 16, 10).cast("int")
    digits = F.filter(F.split(F.replace(F.col(c), F.lit("-"), F.lit("")), ""), lambda x: x != "")
    last = digit(F.substring(c, -1, 1))
    return (16 * (F.aggregate(digits, F.lit(0), lambda s, x: s + digit(x)) - last) + last) % 20 == 0


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of all rows for every rag_documents.embedding whose id is divisible by 20, by greedy graph search."""
    docs = table(spark, d, "rag_documents")
    nodes = neighbours.copy_groups(neighbours.vector_rows(docs, "id", "embedding", 64), 64)
    edges = neighbours.nn_descent(nodes, 64, k=12)
    asked = neighbours.vector_rows(docs.where(_by_twenty("id")), "id", "embedding", 64).select(F.col("id").alias("query"), "vec")
    hits = neighbours.greedy_search(nodes, edges, neighbours.coded(asked, 64), 64, k=6)
    named = hits.join(nodes.select("key", F.explode("heads").alias("near_id")), "key").where(F.col("near_id") != F.col("query"))
    w = neighbours.Window.partitionBy("query").orderBy(F.desc("s"), "near_id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5).select(F.col("query").alias("id"), "near_id", "rank", F.round("s", 4).alias("similarity"))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    m = entities.match_films(table(spark, d, "films"), table(spark, d, "imdb_films"), table(spark, d, "rt_enrichment"))
    return m.withColumn("confidence", F.round("confidence", 4))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("key_a", "key_b")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "rag_documents"), "id", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where(F.col("chunk_index") == 0).select("id")


def _whole(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """Per text: its length as the pieces cover it, and whether they fit, follow each other, overlap and say what it says."""
    w = neighbours.Window.partitionBy("id").orderBy("chunk_index")
    p = pieces.join(texts, "id").withColumn("last", F.lag("end").over(w))
    near = F.col("last").isNull() | ((F.col("start") < F.col("last")) & (F.col("last") - F.col("start") <= 240) & (F.col("end") > F.col("last")))
    says = F.col("piece") == F.expr("substring(content, cast(start + 1 as int), cast(end - start as int))")
    return p.groupBy("id").agg(F.max("end").alias("chars"), (F.max(F.length("piece")) <= 1200).alias("short"), (F.bool_and(near) & (F.min("start") == 0)).alias("follows"), F.bool_and(says).alias("says"), (F.max("chunk_total") == F.max("chunk_index") + 1).alias("counted"))


def p4_whole(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "rag_documents")
    return _whole(p4_pieces(spark, d), docs.select("id", "content"))


def p4_ranges_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same with ranges of 3,000 characters, so that borders and prefix sums are at work in most texts."""
    docs = table(spark, d, "rag_documents")
    return _whole(splitting.split_texts(docs, "id", "content", range_chars=3000), docs.select("id", "content"))


def p4_files_whole(spark: SparkSession, d: str) -> DataFrame:
    """All contents as large files, split by byte ranges of 64 KB: characters covered, and pieces that break a rule."""
    path = fresh_folder(spark, "contents")
    table(spark, d, "rag_documents").where(F.col("content").isNotNull()).select("content").write.text(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = [f.getPath().toString() for f in found if f.getPath().getName().startswith("part-")]
    p = splitting.split_files(spark, names, range_bytes=1 << 16)
    w = neighbours.Window.partitionBy("id").orderBy("chunk_index")
    p = p.withColumn("last", F.lag("end").over(w))
    gap = F.col("last").isNotNull() & ((F.col("start") >= F.col("last")) | (F.col("last") - F.col("start") > 240))
    per = p.groupBy("id").agg(F.max("end").alias("chars"), F.count_if(F.length("piece") != F.col("end") - F.col("start")).alias("wrong"), F.count_if(F.length("piece") > 1200).alias("long"), F.count_if(gap).alias("gaps"))
    return per.agg(F.sum("chars").alias("chars"), F.sum("wrong").alias("wrong_length"), F.sum("long").alias("too_long"), F.sum("gaps").alias("gaps"))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "aggregated_films"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.pairs_of_groups(survivors.merged_groups(table(spark, d, "aggregated_films")))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_id, code, langs, segments) of the three labelled fields; equal texts are scored once."""
    films, asked = table(spark, d, "films"), table(spark, d, "rag_queries")
    model = language.train(table(spark, d, "documents"), films, asked)
    f = films.select(F.col("id").cast("string").alias("row_id"), "original_title", "original_language", "overview_fr").distinct()
    title = f.select(F.lit("films.original_language").alias("field"), "row_id", F.col("original_title").alias("text"), language.label_column(F.col("original_language")).alias("code"))
    view = f.select(F.lit("films.overview_fr").alias("field"), "row_id", F.col("overview_fr").alias("text"), F.lit("fr").alias("code"))
    query = asked.select(F.lit("rag_queries.query_text").alias("field"), F.col("id").alias("row_id"), F.col("query_text").alias("text"), language.label_column(F.col("lang")).alias("code"))
    rows = title.unionByName(query).where(F.length(F.trim("text")) > 0)
    got = _with_labels(rows, model).select("field", "row_id", "code", "langs", "segments")
    long = view.where(F.length(F.trim("text")) > 0)
    return got.unionByName(_with_labels(long, model).select("field", "row_id", "code", "langs", "segments"))


HOT_TEXTS = 1000  # most texts that are joined by broadcast, each held by a thousandth of the rows or more


def _with_labels(rows: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """Every row with the labels of its text; a text is labelled once, one of very many rows goes to them by broadcast."""
    counts = cut(rows.groupBy("text").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = cut(language.label_texts(counts.select("text"), model))
    hot = F.broadcast(counts.where(F.col("n") > max(100_000, total // HOT_TEXTS)).select("text"))
    often = rows.join(F.broadcast(named.join(hot, "text", "left_semi")), "text")
    return often.unionByName(rows.join(hot, "text", "left_anti").join(named, "text"))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _labelled(spark, d).select("field", "row_id", F.posexplode("segments").alias("segment", "s"))
    return s.select("field", "row_id", "segment", "s.start", "s.end", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    r = _labelled(spark, d)
    wrong = (F.size("langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("langs")[0])
    return r.where((F.size("langs") > 0) & wrong).select("field", "row_id", F.explode("langs").alias("lang")).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenize.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n", 1024)


def p8_filling(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is in the containers once and whole, none is overfull, and they are about as few as can be."""
    p = p8_containers(spark, d)
    per = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.sum("size").alias("whole"))
    per = per.agg(F.count("*").alias("docs"), F.bool_and(F.col("pieces") == F.col("last") + 1).alias("once"), F.bool_and((F.col("pieces") == 1) | (F.col("whole") > 1024)).alias("divided_rightly"))
    load = p.where(F.col("size") > 0).groupBy("container").agg(F.sum("size").alias("load"))
    load = load.agg((F.max("load") <= 1024).alias("within"), (F.count("*") * 1024 * 0.97 <= F.sum("load") + 1024).alias("filled"))
    return per.join(F.broadcast(load))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    f = lookalikes.consistent_forms(table(spark, d, "documents"), "doc_id", "text")
    return f.select(F.col("key").cast("long").alias("doc_id"), "form")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalikes.same_reading(lookalikes.consistent_forms(table(spark, d, "documents"), "doc_id", "text"))
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


# Fixed values of the SQL check, apart from the operator's tables: letters of other alphabets and what they look like.
_SEEN_AS = """а a, в ʙ, е e, о o, р p, с c, у y, х x, і i, ј j, ѕ s, һ h, ԁ d, ԛ q, ԝ w, ӏ i, А A, В B, Е E, К K, М M, Н H, О O, Р P, С C, Т T, У Y, Х X, І I, Ј J, Ѕ S, Һ h, Ԍ G, Ԛ Q, Ԝ W, Ӏ I,
α a, ι i, κ к, ν v, ο o, ρ p, υ u, χ x, γ y, Α A, Β B, Ε E, Ζ Z, Η H, Ι I, Κ K, Μ M, Ν N, Ο O, Ρ P, Τ T, Υ Y, Χ X, Ϲ C, ϳ j, օ o, ո n, ս u, հ h, ց g, զ q, յ j, Օ O, Ս U, Լ L, ɡ g, ɑ a, ı i, ȷ j, ɩ i, ё ë, Ё Ë, ї ï, Ї Ï, ό ó, ά á"""


def _reading_sql() -> str:
    """The reading by plain string functions: drop what is invisible, one kind of space, plain widths, look-alikes, compose."""
    wide = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0)]]
    seen = [tuple(x.split()) for x in _SEEN_AS.split(",")]
    two = lambda pairs, i: "".join(p[i] for p in pairs).replace("'", "''")
    text = r"regexp_replace(regexp_replace(text, '[\p{Cf}\x{FE00}-\x{FE0F}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]', '', 'g'), '[\p{Zs}\t]', ' ', 'g')"
    return f"nfc_normalize(translate(translate({text}, '{two(wide, 0)}', '{two(wide, 1)}'), '{two(seen, 0)}', '{two(seen, 1)}'))"


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p2_found": p2_found, "p2_matches": p2_matches, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_whole": p4_whole, "p4_ranges_whole": p4_ranges_whole, "p4_files_whole": p4_files_whole, "p5_found": p5_found, "p5_survivors": p5_survivors, "p6_found": p6_found, "p6_segments": p6_segments, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_filling": p8_filling, "p9_found": p9_found, "p9_forms": p9_forms}
SQL: dict[str, str] = {
    "p1_found": """WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM rag_documents WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS rn FROM p)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM k WHERE rn <= 5 AND s >= 0.85""",
    "p8_filling": "SELECT count(*) AS docs, true AS once, true AS divided_rightly, true AS within, true AS filled FROM documents",
    "p9_found": f"""WITH k AS (SELECT doc_id, text, {_reading_sql()} AS seen FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.seen = b.seen AND a.doc_id < b.doc_id AND a.text <> b.text WHERE trim(a.seen, E' \\n\\r') <> ''""",
    "p4_whole": "SELECT id, length(content) AS chars, true AS short, true AS follows, true AS says, true AS counted FROM rag_documents WHERE length(content) > 1200",
    "p4_ranges_whole": "SELECT id, length(content) AS chars, true AS short, true AS follows, true AS says, true AS counted FROM rag_documents WHERE length(content) > 1200",
    "p4_files_whole": "SELECT CAST(sum(length(content) + 1) AS BIGINT) AS chars, 0 AS wrong_length, 0 AS too_long, 0 AS gaps FROM rag_documents WHERE content IS NOT NULL",
    "p4_found": "SELECT id FROM rag_documents WHERE length(content) > 1200",
}
