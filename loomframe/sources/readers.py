"""Readers with explicit schemas (SRC-01..04, 10..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.cleaning import null_token

FILM_CSV = "id int, title string, release_date string, vote_average double, vote_count int, popularity double, overview string, genre_names string, original_language string, budget long, revenue long, runtime int"


def film_csv(spark: SparkSession, path: str, schema: str = FILM_CSV) -> DataFrame:
    """SRC-01: header, quoted line breaks, doubled quotes; no inference pass."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def lenient_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """SRC-02: all cells as text, five spellings of nothing to null, then lenient casts: a bad cell never costs its row."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return raw.select(*[null_token(F.trim(c)).try_cast(types[c]).alias(c) if c in types else null_token(F.col(c)).alias(c) for c in raw.columns])


def valid_rows(df: DataFrame, counts=None) -> DataFrame:  # noqa: ANN001
    """SRC-03: rows with a positive id and a title; an Observation counts both kinds in the same pass."""
    ok = F.coalesce((F.col("id") > 0) & F.col("title").isNotNull(), F.lit(False))
    seen = df if counts is None else df.observe(counts, F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))
    return seen.where(ok)


def sqlite_table(spark: SparkSession, path: str, name: str, key: str | None = None, parts: int = 8) -> DataFrame:
    """SRC-04: a table over JDBC (needs the driver jar), split by ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", f"jdbc:sqlite:{path}").option("driver", "org.sqlite.JDBC").option("dbtable", name)
    if key:
        lo, hi = spark.read.format("jdbc").option("url", f"jdbc:sqlite:{path}").option("driver", "org.sqlite.JDBC").option("query", f"SELECT min({key}) AS lo, max({key}) AS hi FROM {name}").load().first()
        r = r.option("partitionColumn", key).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", parts)
    return r.load()


def envelope(spark: SparkSession, path: str, film: str) -> DataFrame:
    """SRC-10: films of an export envelope; a missing file raises."""
    return spark.read.option("multiLine", True).schema(f"films array<struct<{film}>>").json(path).select(F.inline("films"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-11: one object per line, blank lines skipped."""
    return spark.read.schema(schema).json(path)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """SRC-12: n rows by a seeded hash of the key: repeatable however the table is laid out."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def junit(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: test cases with suite, seconds and status."""
    schema = "_classname string, _name string, _time double, failure string, error string, skipped string"
    x = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return x.select(F.col("_classname").alias("suite"), F.col("_name").alias("name"), F.coalesce("_time", F.lit(0.0)).alias("seconds"), status.alias("status"))


def tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC-14: several relations of one export."""
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}
