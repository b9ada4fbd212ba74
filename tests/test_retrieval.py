import numpy as np
from pyspark.sql import functions as F

from loomframe.functions import vectors as v
from loomframe.operators import evaluate as ev
from loomframe.operators import intent as it
from loomframe.operators import retrieval as r


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [x["c"] for x in df.select(F.round(v.cosine(F.col("a"), F.col("b")), 4).alias("c")).collect()] == [0.7071, 0.0, None, None]


def test_batch_topk_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(900, None), (901, [1.0])], "id long, e array<double>").repartition(5)
    q = df.where("id < 20").select(F.col("id").alias("query"), "e")
    got = {(int(h["query"]), h["rank"]): int(h["key"]) for h in r.batch_topk(df, q, "id", "e", 8, 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(20):
        s = u @ u[i]
        s[i] = -2
        assert [got[i, k + 1] for k in range(4)] == np.argsort(-s)[:4].tolist()


def test_batch_topk_empty(spark):
    e = spark.createDataFrame([], "id long, e array<double>")
    assert r.batch_topk(e, e.select(F.col("id").alias("query"), "e"), "id", "e", 8).count() == 0


def test_rrf_closed_form(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "k int, rank int")
    got = {x["k"]: x["rrf"] for x in r.rrf(a, b, ["k"], 60, 1.0, 1.0).collect()}
    assert got == {1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}


def test_stemmers(spark):
    df = spark.createDataFrame([(w,) for w in ("skies", "horses", "widows", "glass", "virus", "chevaux", "maudites", "belles")], "w string")
    assert [x[0] for x in df.select(r.stem_en(F.col("w"))).collect()][:5] == ["sky", "horse", "widow", "glass", "virus"]
    assert [x[0] for x in df.select(r.stem_fr(F.col("w"))).collect()][5:] == ["cheval", "maudit", "bel"]


def test_lexeme_weights(spark):
    films = spark.createDataFrame([(1, "The Ghost Ship", "a ghost on a ship"), (2, "Calm", "ghost ghost"), (3, None, None)], "id int, title string, overview string")
    index = r.lexeme_index(films, "id", [(F.col("title"), "A", "en"), (F.col("overview"), "C", "en")])
    q = r.query_lexemes(spark.createDataFrame([(1, "ghosts ship")], "q int, t string"), "q", "t", ["en"])
    assert [(x["id"], x["score"]) for x in r.lexeme_search(index, q, "id", "q").orderBy("rank").collect()] == [(1, 2.0), (2, 0.0)]


def test_intents(spark):
    texts = ["merci beaucoup", "Bonjour !", "bonjour, un film de zombie ?", "  ", "something else entirely", None]
    got = [x["intent"] for x in it.classify(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()]
    assert got == ["thanks", "conversational", "needs_database", "needs_database", "needs_database", "needs_database"]
    s = F.create_map(F.lit("off_topic"), F.lit(0.9), F.lit("conversational"), F.lit(0.1))
    df = spark.createDataFrame([("weather today",), ("a scary thing",)], "t string")
    assert [x[0] for x in df.select(it.model_intent(F.col("t"), s)).collect()] == ["off_topic", "needs_database"]


def test_fate_and_stage(spark):
    df = spark.createDataFrame([(3, 1, None), (9, 1, None), (None, 4, None), (None, None, None)], "f int, v int, l int")
    assert [x[0] for x in df.select(ev.fate(F.col("f"), F.col("v"), F.col("l"))).collect()] == ["OK", "RANKING", "POOL_CUT", "UNREACHABLE"]


def test_embedder(spark):
    e = r.hashing_embedder(16)
    got = [x["e"] for x in spark.createDataFrame([("a b",), ("a b",), (" ",), (None,)], "t string").select(e("t").alias("e")).collect()]
    assert got[0] == got[1] and sum(got[2]) == 0 and sum(got[3]) == 0
