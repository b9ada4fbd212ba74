import math
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import packing as pk


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_best_fit_decreasing(sizes):
    counts = Counter(sizes)
    runs, used = pk.best_fit_plan(dict(counts), 64)
    room = defaultdict(int)
    placed = Counter()
    for size, lo, hi, first, fit in runs:
        for r in range(lo, hi):
            room[first + (r - lo) // fit] += size
            placed[size] += 1
    assert placed == counts and all(v <= 64 for v in room.values())
    assert set(room) == set(range(used)) and used == best_fit_decreasing(sizes, 64)


def test_rows(spark):
    rows = [(1, 2500), (2, 0), (3, None), (4, 1024), (5, 300), (5, 300), (6, 200), (7, 424)]
    got = pk.pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", 1024).collect()
    assert sum(r["size"] for r in got) == sum(n or 0 for _, n in rows)
    assert sorted((r["piece"], r["size"]) for r in got if r["doc_id"] == 1) == [(0, 1024), (1, 1024), (2, 452)]
    full = Counter()
    for r in got:
        full[r["container"]] += r["size"]
    assert max(full.values()) <= 1024 and len(full) == math.ceil(sum(n or 0 for _, n in rows) / 1024)
    assert all(r["piece"] == 0 for r in got if r["doc_id"] != 1)


def test_empty(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", 8).count() == 0
    assert [r["container"] for r in pk.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n long"), "doc_id", "n", 8).collect()] == [0, 0]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, 3, 0)], "piece long, size long, rank int")
    got = pk.pack(df.withColumnRenamed("piece", "rank_id"), "rank_id", "size", 8).collect()
    assert {r["rank_id"]: r["container"] for r in got} == {1: 0, 2: 0}


def test_one_hot_size(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(3).alias("n"))
    got = pk.pack(df, "doc_id", "n", 8).groupBy("container").agg(F.count("*").alias("c")).collect()
    assert len(got) == 1500 and {r["c"] for r in got} == {2}
