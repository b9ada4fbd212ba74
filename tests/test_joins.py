from loomframe.operators import joins as j
from loomframe.operators import upserts as u


def test_two_keys(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 99, "b"), (3, None, None), (4, 0, "")], "id int, tmdb_id int, imdb_id string")
    right = spark.createDataFrame([(10, "b", 1, 5.0), (10, "x", 2, 6.0), (77, "b", 3, 7.0), (0, "", 4, 8.0)], "tmdb_id int, imdb_id string, pos int, v double")
    got = {r["id"]: r["match"] and r["match"]["v"] for r in j.two_key_match(left, right, "tmdb_id", "imdb_id", "pos", ["v"]).collect()}
    assert got == {1: 6.0, 2: 7.0, 3: None, 4: None}


def test_fold(spark):
    base = spark.createDataFrame([(1, 10, None, ""), (2, 20, "tt2", "own")], "id int, tmdb_id int, imdb_id string, overview string")
    s = "tmdb_id int, imdb_id string, pos int, "
    rt = spark.createDataFrame([(10, None, 1, 0)], s + "tomatometer_score int")
    imdb = spark.createDataFrame([(10, "tt1", 1, 6.5)], s + "imdb_rating double")
    kaggle = spark.createDataFrame([(99, "tt1", 1, "k", 5.0), (20, None, 2, "k2", 4.0)], s + "overview string, kaggle_rating double")
    extra = spark.createDataFrame([], s + "spark_rating double")
    got = {r["id"]: r for r in j.enrich_fold(base, rt, imdb, kaggle, extra).collect()}
    assert got[1]["imdb_id"] == "tt1" and got[1]["sources"] == ["tmdb", "rotten_tomatoes", "imdb"]  # a filled id matches nothing
    assert got[2]["overview"] == "own" and got[2]["sources"] == ["tmdb", "kaggle"] and got[2]["enrichment_count"] == 1


def test_not_in(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r[0] for r in j.not_in(a, "k", spark.createDataFrame([(2,)], "x int"), "x").collect()] == [1]
    assert j.not_in(a, "k", spark.createDataFrame([(2,), (None,)], "x int"), "x").count() == 0
    assert j.not_in(a, "k", spark.createDataFrame([], "x int"), "x").count() == 3


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, n int")
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert rows(u.upsert(old, new, ["k"])) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert rows(u.upsert_subset(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert rows(u.insert_if_absent(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert u.write_counts(old, new, ["k"]).first().asDict() == {"inserted": 1, "updated": 1}
