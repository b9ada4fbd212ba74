"""Sinks (SNK-01, 02, 09..11)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.upserts import upsert


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> int:
    """SNK-01: overwrite; the rows are counted by the write itself."""
    seen = Observation("rows")
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return seen.get["n"]


def write_envelope(films: DataFrame, path: str, score: str = "aggregated_score", critics: str = "tomatometer_score") -> dict:
    """SNK-02: films as JSON lines in `path`/films, head figures in `path`/head: any size, one pass."""
    seen = Observation("head")
    n = F.count(F.lit(1))
    films.observe(seen, n.alias("n"), F.avg(score).alias("mean"), F.count(critics).alias("rated")).write.mode("overwrite").json(f"{path}/films")
    got = seen.get
    head = {"generated_at": datetime.now(UTC).isoformat(), "total_films": got["n"], "avg_score": round(got["mean"] or 0.0, 2), "rt_coverage": round(100.0 * got["rated"] / got["n"], 2) if got["n"] else 0.0}
    films.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    return head


def upsert_documents(old: DataFrame, new: DataFrame, embed, text: str = "embed_text") -> DataFrame:  # noqa: ANN001
    """SNK-09: new documents get their vectors from a pandas UDF and replace those of the same (type, source, chunk)."""
    return upsert(old, new.withColumn("embedding", embed(F.col(text))).select(*old.columns), ["source_type", "source_id", "chunk_index"])


def deliver(df: DataFrame, take: Callable[[list[dict]], None], size: int = 1000) -> int:
    """SNK-10: rows to a callback in batches, one partition at a time on the driver."""
    batch, n = [], 0
    for row in df.toLocalIterator():
        batch.append(row.asDict(recursive=True))
        if len(batch) == size:
            take(batch)
            n, batch = n + size, []
    if batch:
        take(batch)
    return n + len(batch)


class Progress:
    """SNK-11: small named states with their time, in any folder that the session's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):  # noqa: ANN202
        path = self.jvm.org.apache.hadoop.fs.Path(self.root, re.sub(r"[/\\]", "_", name) + ".json")
        return path.getFileSystem(self.conf), path

    def save(self, name: str, data: dict) -> None:
        fs, path = self._at(name)
        text = json.dumps({"timestamp": datetime.now(UTC).isoformat(), "data": data})
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def load(self, name: str) -> dict | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        got = fs.open(path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(got, "UTF-8"))["data"]
        finally:
            got.close()

    def delete(self, name: str) -> bool:
        fs, path = self._at(name)
        return bool(fs.delete(path, False))

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return bool(fs.exists(path))


def stream_parquet(spark: SparkSession, source: str, schema: str, sink: str, state: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> int:
    """STR-10: what has arrived since the last call, exactly once; the checkpoint folder is the progress mark."""
    q = transform(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)
