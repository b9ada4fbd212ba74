import datetime

from pyspark.sql import functions as F

from loomframe.sources.writers import stream_parquet
from loomframe.streaming import metrics as m
from loomframe.streaming import sessions as s

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, k string, v double"


def rows(*minutes, k="a"):
    return [(i, T0 + datetime.timedelta(minutes=x), k, float(x)) for i, x in enumerate(minutes)]


def test_sessions(spark):
    e = spark.createDataFrame(rows(0, 10, 39.9, 70, 100), SCHEMA)
    assert sorted(r["n"] for r in s.sessions(e, "ts", "k").collect()) == [2, 3]  # a gap of exactly 30 minutes does not part


def test_bucket_replay(spark):
    e = spark.createDataFrame([(i, T0 + datetime.timedelta(seconds=x), "a", 0.0) for i, x in enumerate([0, 1, 2, 31, 32])], SCHEMA)
    got = {r["id"]: r["allowed"] for r in s.token_bucket(e, "ts", "k", "id", 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_bucket_stream(spark, tmp_path):
    spark.createDataFrame([(i, T0 + datetime.timedelta(seconds=x), "a", 0.0) for i, x in enumerate([0, 1, 2])], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = s.token_bucket_stream(src, "ts", "k", "id", 2).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["i"]: r["allowed"] for r in spark.table("bucket").collect()} == {0: True, 1: True, 2: False}


def test_rate_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame(rows(0, 1, 6, 7, 12), SCHEMA)
    e.write.parquet(str(tmp_path / "in"))
    batch = {(str(r["start"]), r["n"]) for r in m.rate(e, "ts", ["k"]).collect()}
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    q = m.rate(src, "ts", ["k"]).writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r["start"]), r["n"]) for r in spark.table("rate").collect()} == batch


def test_incremental_file_stream(spark, tmp_path):
    a = [str(tmp_path / x) for x in ("in", "out", "state")]
    spark.createDataFrame(rows(0, 1), SCHEMA).write.parquet(a[0])
    assert stream_parquet(spark, a[0], SCHEMA, a[1], a[2]) == 2
    spark.createDataFrame(rows(5), SCHEMA).write.mode("append").parquet(a[0])
    assert stream_parquet(spark, a[0], SCHEMA, a[1], a[2]) == 1
    assert spark.read.parquet(a[1]).count() == 3


def test_increase_with_reset(spark):
    e = spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=i), "a", v) for i, v in enumerate([5.0, 8.0, 2.0, 3.0])], SCHEMA)
    assert m.increase(e, "ts", "k", "v", "id").first()["increase"] == 3 + 2 + 1


def test_quantile(spark):
    e = spark.createDataFrame([(0, T0, "a", x) for x in (0.5, 1.5, 1.5, 3.0)], SCHEMA)
    b = m.observe(e, "v", ["k"], [1.0, 2.0])
    assert m.histogram_quantile(b, ["k"], 0.5).first()["value"] == 1.5
    assert m.histogram_quantile(b, ["k"], 0.99).first()["value"] == 2.0


def test_alert(spark):
    w = spark.createDataFrame([(T0 + datetime.timedelta(hours=h), 50.0 if h in (1, 2, 3, 7) else 0.0) for h in range(9)], "start timestamp, pct double")
    got = m.held_for(w, "start", "pct", 10.0, 3600, 7200).collect()
    assert [(r["windows"], r["peak"]) for r in got] == [(3, 50.0)]


def test_route(spark):
    d = spark.createDataFrame([("get", "/films/12/x/7", "200", 0.1)], "m string, p string, s string, d double")
    assert m.request_record(d, "m", "p", "s", "d").first().asDict() == {"method": "GET", "route": "/films/{id}/x/{id}", "status": 200, "duration": 0.1}
    assert s.resume_after(d.withColumn("id", F.lit(3)), "id", 3).count() == 0
