"""Sessions and rate limits per key (STR-01, 02, 10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """STR-01: sessions parted by more than `gap` of inactivity; parts of a session are merged before and after the shuffle. Works on streams."""
    s = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return s.select(key, F.col("w.start").alias("start"), "last", "n")


def recent(messages: DataFrame, session: str, order: list[str], n: int = 10) -> DataFrame:
    """STR-01: the last n messages of each session; cut to n within each task before anything is gathered."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _bucket(times: list[float], tokens: float, last: float, capacity: float, per_second: float) -> tuple[list[bool], float, float]:
    out = []
    for t in times:
        tokens = min(capacity, tokens + max(0.0, t - last) * per_second)
        last = max(last, t)
        out.append(tokens >= 1.0)
        if out[-1]:
            tokens -= 1.0
    return out, tokens, last


def token_bucket(events: DataFrame, ts: str, key: str, tie: str, per_minute: int = 30) -> DataFrame:
    """STR-02, replay: (key, tie, allowed). Each key's events are taken in time order; a key's
    events depend on each other by definition, so a key is one task."""
    e = events.select(F.col(key).alias("k"), F.col(tie).alias("i"), F.col(ts).cast("timestamp").cast("double").alias("t"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["t", "i"])
        ok, _, _ = _bucket(p["t"].tolist(), float(per_minute), p["t"].iloc[0], float(per_minute), per_minute / 60)
        return pd.DataFrame({"k": p["k"].to_numpy(), "i": p["i"].to_numpy(), "allowed": ok})

    kinds = dict(e.dtypes)
    return e.groupBy("k").applyInPandas(run, f"k {kinds['k']}, i {kinds['i']}, allowed boolean").withColumnsRenamed({"k": key, "i": tie})


def token_bucket_stream(events: DataFrame, ts: str, key: str, tie: str, per_minute: int = 30) -> DataFrame:
    """STR-02 on a stream: the bucket of each key is kept state, dropped after ten idle minutes."""
    e = events.select(F.col(key).cast("string").alias("k"), F.col(tie).cast("long").alias("i"), F.col(ts).cast("timestamp").cast("double").alias("t"))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        p = pd.concat(list(parts)).sort_values(["t", "i"])
        tokens, last = state.get if state.exists else (float(per_minute), float(p["t"].iloc[0]))
        ok, tokens, last = _bucket(p["t"].tolist(), tokens, last, float(per_minute), per_minute / 60)
        state.update((tokens, last))
        state.setTimeoutDuration(600_000)
        yield pd.DataFrame({"k": p["k"], "i": p["i"], "allowed": ok})

    return e.groupBy("k").applyInPandasWithState(run, "k string, i long, allowed boolean", "tokens double, last double", "append", "ProcessingTimeTimeout")


def resume_after(df: DataFrame, key: str, last: int | None) -> DataFrame:
    """STR-10: keyset resume; the predicate reaches the scan."""
    return df if last is None else df.where(F.col(key) > last)
