import datetime

from loomframe.operators import references as r

T = lambda d: datetime.datetime(2024, 1, d, tzinfo=datetime.UTC)


def inputs(spark, rows, parents):
    refs = spark.createDataFrame(rows, "id long, k int, t timestamp, target string")
    p = spark.createDataFrame(parents, "id int, created_at timestamp")
    return r.gather([r.Reference("x", refs, "id", "k", "t", "id")]), r.first_seen(p, {"id": "id"}, "created_at")


def test_cases(spark):
    rows = [(1, 1, T(5), "clash"), (2, 1, T(1), "c"), (3, 2, T(5), "c"), (4, None, T(5), "c"), (5, 1, None, "c"), (6, 3, T(9), "c"), (3, 2, T(5), "c")]
    refs, seen = inputs(spark, rows, [(1, T(3)), (1, T(4)), (3, None), (None, T(1))])
    for heavy in (1, 2, 1000):  # all heavy, some heavy, none heavy
        assert sorted(int(x["row_id"]) for x in r.orphans(refs, seen, heavy).collect()) == [2, 3, 3, 5, 6]


def test_empty(spark):
    refs, seen = inputs(spark, [], [])
    assert r.orphans(refs, seen).count() == 0
    refs, seen = inputs(spark, [(1, 1, T(1), "c")], [])
    assert r.orphans(refs, seen).count() == 1


def test_report(spark):
    rows = [(i, 1, T(1 + i % 9), "c") for i in range(300)] + [(1000, 7, T(2), "c"), (1001, 8, T(2), "c")]
    refs, seen = inputs(spark, rows, [(1, T(4))])
    gone = spark.createDataFrame([("id", 7)], "target string, key int")
    got = r.orphan_report(refs, seen, gone, heavy_rows=50).collect()
    assert len(got) == 1
    want = sum(1 + i % 9 < 4 for i in range(300))
    assert got[0].asDict() == {"src_table": "x", "period": "2024-01", "refs": 302, "orphans": want + 2, "missing": 1, "purged": 1, "late": want}
