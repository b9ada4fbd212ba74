"""STR-* queries over the events table, EVA-05 over the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.numbers import mean
from loomframe.operators import aggregates as g
from loomframe.session import table
from loomframe.streaming import metrics as m
from loomframe.streaming import sessions as ss

QUERIES: dict = {}
SQL: dict = {}
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _time(c):  # noqa: ANN001, ANN202
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_SESS = "WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM s GROUP BY user_id, k"


@query("str01_sessions_30m", _SESS.format(gap="30 minute"))
def _(s, d):
    return ss.sessions(table(s, d, "events"), "ts", "user_id").select("user_id", _time("start").alias("start"), _time("last").alias("last"), "n")


@query("str01_sessions_1d", _SESS.format(gap="1 day"))
def _(s, d):
    return ss.sessions(table(s, d, "events"), "ts", "user_id", "1 day").select("user_id", _time("start").alias("start"), _time("last").alias("last"), "n")


@query("str02_token_bucket")
def _(s, d):
    return ss.token_bucket(table(s, d, "events"), "ts", "user_id", "event_id", 1)


@query("str03_rate_5m", f"SELECT {_T.format('time_bucket(INTERVAL 5 minute, ts)')} AS start, event_type, count(*) AS n, round(count(*) / 300.0, 6) AS rate FROM events GROUP BY 1, 2")
def _(s, d):
    return m.rate(table(s, d, "events"), "ts", ["event_type"]).select(_time("start").alias("start"), "event_type", "n", "rate")


@query("str03_rate_sliding", f"WITH e AS (SELECT ts, time_bucket(INTERVAL 1 hour, ts) AS b FROM events), w AS (SELECT b - INTERVAL (k) hour AS start FROM e, (SELECT unnest(range(0, 6)) AS k)) SELECT {_T.format('start')} AS start, count(*) AS n, round(count(*) / 21600.0, 6) AS rate FROM w GROUP BY 1")
def _(s, d):
    return m.rate(table(s, d, "events"), "ts", [], "6 hours", "1 hour", 21600).select(_time("start").alias("start"), "n", "rate")


@query("str04_increase_1h", f"WITH l AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) SELECT {_T.format('time_bucket(INTERVAL 1 hour, ts)')} AS start, event_type, round(sum(CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END), 4) AS increase FROM l GROUP BY 1, 2")
def _(s, d):
    return m.increase(table(s, d, "events").select("ts", "event_type", "value", "event_id"), "ts", "event_type", "value", "event_id").select(_time("start").alias("start"), "event_type", "increase")


_B = "WITH b AS (SELECT event_type, le, count(value) FILTER (WHERE le IS NULL OR value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, NULL])::DOUBLE AS le) GROUP BY 1, 2)"


@query("str08_observe", _B + " SELECT event_type, le, n FROM b")
def _(s, d):
    return m.observe(table(s, d, "events"), "value", ["event_type"], BOUNDS)


@query("str05_histogram_quantile", _B + """, w AS (SELECT *, coalesce(lag(le) OVER o, 0.0) AS lo, coalesce(lag(n) OVER o, 0) AS below, max(n) OVER (PARTITION BY event_type) * 0.95 AS want FROM b WINDOW o AS (PARTITION BY event_type ORDER BY le ASC NULLS LAST))
SELECT event_type, round(CASE WHEN le IS NULL THEN lo ELSE lo + (le - lo) * (want - below) / (n - below) END, 4) AS value FROM w WHERE n >= want AND below < want""")
def _(s, d):
    return m.histogram_quantile(m.observe(table(s, d, "events"), "value", ["event_type"], BOUNDS), ["event_type"], 0.95)


@query("str06_error_ratio", f"SELECT {_T.format('time_bucket(INTERVAL 1 hour, ts)')} AS start, count(*) FILTER (WHERE event_type = 'error') AS part, count(*) AS n, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS pct FROM events GROUP BY 1")
def _(s, d):
    return m.ratio(table(s, d, "events"), "ts", F.col("event_type") == "error").select(_time("start").alias("start"), "part", "n", "pct")


@query("str07_held_for", """WITH r AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, 100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS pct FROM events GROUP BY 1), h AS (SELECT *, epoch(w) - 3600 * row_number() OVER (ORDER BY w) AS g FROM r WHERE round(pct, 4) > 10)
SELECT strftime(min(w), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS windows, round(max(pct), 4) AS peak FROM h GROUP BY g HAVING count(*) >= 3""")
def _(s, d):
    r = m.ratio(table(s, d, "events"), "ts", F.col("event_type") == "error")
    h = m.held_for(r.withColumn("start", F.col("start").cast("timestamp")), "start", "pct", 10.0, 3600, 3 * 3600)
    return h.select(F.from_unixtime("from_s").alias("start"), "windows", "peak")


@query("str09_request_record", "SELECT upper(event_type) AS method, regexp_replace('/users/' || user_id || '/events/' || event_id, '/[0-9]+', '/{id}', 'g') AS route, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events").select("event_type", F.concat(F.lit("/users/"), "user_id", F.lit("/events/"), "event_id").alias("path"), F.lit(200).alias("status"), "value")
    return m.request_record(e, "event_type", "path", "status", "value").groupBy("method", "route").agg(F.count("*").alias("n"))


@query("str10_resume", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id > 500")
def _(s, d):
    return ss.resume_after(table(s, d, "events"), "event_id", 500).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("src10_json_props", "SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS INT)) + 1e-9, 4) AS mean_k, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type").agg(mean("k", 4).alias("mean_k"), F.count("*").alias("n"))


@query("eva05_index_percentile", """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(value, 1) AS p95 FROM v WHERE i = least(CAST(floor(n * 95 / 100.0) AS BIGINT), n - 1)""")
def _(s, d):
    return g.index_percentile(table(s, d, "events"), ["event_type"], "value", 95)


@query("agg20_latency_sketch")
def _(s, d):
    return g.latency_sketch(table(s, d, "rag_queries"), "lang", "response_time_ms")
