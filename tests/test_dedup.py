import random

from loomframe.operators import dedup as d

SCHEMA = "pos long, tmdb_id long, imdb_id string, title string, year int"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["pos"]: r["reason"] for r in d.deduplicate(df, **kw).collect()}


def test_order_decides(spark):
    rows = [(0, 1, "i1", "Alpha", 2000), (1, 2, "i1", "Beta beta", 1980), (2, 2, "i2", "Gamma g", 1960)]
    assert run(spark, rows) == {0: "", 1: "imdb", 2: ""}


def test_titles_and_years(spark):
    rows = [(0, 1, None, "The Shining Light", 1980), (1, 2, "", "The Shinning Light", 1981), (2, 3, None, "the shining light ", 1983), (3, 4, None, "The Shining Light", None)]
    assert run(spark, rows) == {0: "", 1: "fuzzy", 2: "", 3: ""}


def test_empty_and_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, None, None, None, None), (1, 0, "", "", 2000)]) == {0: "", 1: ""}


def test_against_one_pass(spark):
    rng = random.Random(5)
    words = ["night", "well", "mirror", "orchard", "silence", "curse", "lantern", "tide"]
    rows = []
    for i in range(160):
        t = " ".join(rng.sample(words, 2)) + rng.choice(["", " ii", "s", " of gold"])
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + t[k + 1 :]
        rows.append((i, rng.choice([None, 0, rng.randrange(60)]), rng.choice([None, "", f"tt{rng.randrange(60)}"]), t, rng.choice([None, 1990, 1991, 1992, 1999])))
    want = d.fold([(t, i, x, y) for _, t, i, x, y in rows])
    assert run(spark, rows) == dict(enumerate(want))


def test_long_chain_is_one_block(spark):
    rows = [(i, (i + 1) // 2 + 1, f"tt{i // 2}", None, None, "") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA + ", name string")
    assert {(r["pos"], r["block"]) for r in d._blocks(df, 0.9, 1).collect()} == {(i, 0) for i in range(120)}


def test_queries(spark):
    df = spark.createDataFrame([(0, "Où est  le film ?"), (1, "ou est le film ?"), (2, "another question"), (3, None)], "i int, q string")
    assert sorted(r["pos"] for r in d.dedupe_queries(df, "q", "i").collect()) == [0, 2]
