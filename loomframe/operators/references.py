"""References to records that do not exist: orphans per row, and per table and period.

A reference is orphaned when it is not null and the parent side has no row with that key whose
creation time is at or before the reference's own time (a null time on either side never
qualifies). Defined cases: null references are no rows of the result; repeated rows stay
repeated; an empty parent table makes every non-null reference an orphan; other columns, also
ones with clashing names, are ignored since only the named columns are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS_MAX = 1024  # rows of the broadcast list of heavy keys, whatever the input size


@dataclass(frozen=True)
class Reference:
    """Where references of one table are, and the kind of parent key they hold."""

    name: str
    df: DataFrame
    row_id: str
    key: str
    time: str
    target: str


def gather(refs: list[Reference]) -> DataFrame:
    """All non-null references as (src_table, row_id, target, key, t)."""
    out = None
    for r in refs:
        one = r.df.where(F.col(r.key).isNotNull()).select(
            F.lit(r.name).alias("src_table"), F.col(r.row_id).cast("string").alias("row_id"), F.lit(r.target).alias("target"),
            F.col(r.key).cast("long").alias("key"), F.col(r.time).alias("t"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def first_seen(parents: DataFrame, keys: dict[str, str], created: str) -> DataFrame:
    """Earliest creation time of each parent key, per kind of key: (target, key, seen)."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).cast("long").alias("key")) for t, c in keys.items()])
    return (
        parents.select(F.explode(pairs).alias("k"), F.col(created).alias("c"))
        .select("k.target", "k.key", "c").where(F.col("key").isNotNull() & F.col("c").isNotNull())
        .groupBy("target", "key").agg(F.min("c").alias("seen"))
    )


def orphans(refs: DataFrame, seen: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """Rows of `refs` (see gather) without a parent in time; adds `seen`.

    Keys with `heavy_rows` references or more are found by a partial aggregate; at most
    HEAVY_KEYS_MAX of them, with their parent times, are broadcast and their rows are checked
    where they lie. All other rows go through a shuffle join, in which no key has more than
    `heavy_rows` rows. Both parts are united.
    """
    k = ["target", "key"]
    heavy = (
        refs.groupBy(*k).agg(F.count("*").alias("n")).where(F.col("n") >= heavy_rows)
        .orderBy(F.desc("n"), *k).limit(HEAVY_KEYS_MAX).select(*k)
        .join(seen, k, "left").select(*k, F.col("seen").alias("heavy_seen"), F.lit(True).alias("is_heavy"))
    )
    tagged = refs.join(F.broadcast(heavy), k, "left")
    late = lambda s: F.col(s).isNull() | F.col("t").isNull() | (F.col(s) > F.col("t"))
    cols = ["src_table", "row_id", *k, "t"]
    hot = tagged.where(F.col("is_heavy") & late("heavy_seen")).select(*cols, F.col("heavy_seen").alias("seen"))
    rest = tagged.where(F.col("is_heavy").isNull()).select(*cols).join(seen, k, "left").where(late("seen")).select(*cols, "seen")
    return hot.unionByName(rest)


def orphan_report(refs: DataFrame, seen: DataFrame, purged: DataFrame, period: str = "yyyy-MM", heavy_rows: int = 50_000) -> DataFrame:
    """References and orphans per table and period, split into purged, late and missing keys.

    References are first counted per key and period with their earliest and latest time, so a hot
    key is one row per period before anything is shuffled by key. Where both ends fall on one side
    of the parent's creation, the count decides; only the periods in which a parent appeared
    are checked row by row. `purged` has (target, key).
    """
    k = ["target", "key"]
    p = F.date_format("t", period)
    pre = refs.withColumn("period", p).groupBy("src_table", *k, "period").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.when(F.col("t").isNull(), 1)).alias("undated"))
    dead = purged.where(F.col("key").isNotNull()).select("target", F.col("key").cast("long").alias("key"), F.lit(True).alias("gone")).distinct()
    met = pre.join(seen, k, "left").join(dead, k, "left")
    met = met.withColumn("side", F.when(F.col("seen").isNull() | F.col("hi").isNull() | (F.col("hi") < F.col("seen")), F.lit("all")).when((F.col("lo") >= F.col("seen")) & (F.col("undated") == 0), F.lit("none")).otherwise(F.lit("some")))
    kind = F.when(F.col("seen").isNotNull(), "late").when(F.col("gone"), "purged").otherwise("missing")
    sure = met.where(F.col("side") != "some").select("src_table", "period", F.col("n").alias("refs"), F.when(F.col("side") == "all", F.col("n")).otherwise(F.lit(0)).alias("orphans"), kind.alias("kind"))
    mixed = met.where(F.col("side") == "some")
    split = mixed.select("src_table", "period", F.col("n").alias("refs"), F.lit(0).cast("long").alias("orphans"), F.lit("late").alias("kind"))
    rows = refs.withColumn("period", p).join(mixed.select("src_table", *k, "period").distinct(), ["src_table", *k, "period"], "left_semi").drop("period")
    late = orphans(rows.select("src_table", "row_id", *k, "t"), seen, heavy_rows).groupBy("src_table", p.alias("period")).agg(F.count("*").alias("orphans"))
    late = late.select("src_table", "period", F.lit(0).cast("long").alias("refs"), "orphans", F.lit("late").alias("kind"))
    of = lambda x: F.sum(F.when(F.col("kind") == x, F.col("orphans")).otherwise(0)).cast("long").alias(x)
    return sure.unionByName(split).unionByName(late).groupBy("src_table", "period").agg(
        F.sum("refs").cast("long").alias("refs"), F.sum("orphans").cast("long").alias("orphans"), of("missing"), of("purged"), of("late")
    )
