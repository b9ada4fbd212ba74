import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.operators import ordered as o
from loomframe.session import global_rank


def table(spark, n=700, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice([None, *range(12)])) for i in range(n)], "id long, v int")


def test_rank_matches_window(spark):
    df = table(spark)
    a = {r["id"]: r["rn"] for r in o.row_numbers(df, [F.desc("v"), "id"]).collect()}
    b = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("v"), "id"))).collect()}
    assert a == b


def test_rank_by_group(spark):
    df = table(spark)
    a = {r["id"]: r["rank"] + 1 for r in global_rank(df, ["v", "id"], by="v").collect()}
    b = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).collect()}
    assert a == b


def test_percent_rank_and_tile(spark):
    df = table(spark).where("v is not null")
    w = Window.orderBy("v")
    want = df.withColumn("p", F.round(F.percent_rank().over(w), 3)).withColumn("q", F.ntile(4).over(Window.orderBy("v", "id")))
    got = o.percent_rank_and_tile(df, "v", ["v", "id"])
    assert {(r["id"], r["percentile"], r["quartile"]) for r in got.collect()} == {(r["id"], r["p"], r["q"]) for r in want.collect()}


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(o, "BLOCK", 7)
    df = table(spark, 100)
    w = Window.orderBy("v", "id")
    want = df.select("id", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"))
    got = o.with_neighbours(df, ["v", "id"], F.col("v"), "a", "b").select("id", "a", "b")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, v int")
    assert o.row_numbers(df, ["id"]).count() == 0
    assert o.percent_rank_and_tile(df, "v", ["v", "id"]).count() == 0
    assert o.with_neighbours(df, ["id"], F.col("v"), "a", "b").count() == 0
