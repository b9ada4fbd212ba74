"""Ordered, greedy duplicate removal (DED-01..05)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import cut


def first_by_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """DED-01, 02: the first row of each key in input order; rows without a key all stay."""
    text = F.col(key).cast("string")
    keyed = df.where(text.isNotNull() & (text != ""))
    w = Window.partitionBy(key).orderBy(*order)
    first = keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return first.unionByName(df.where(text.isNull() | (text == "")))


def similar(a: str, b: str, least: float) -> bool:
    """Ratio of matching blocks, with the cheap upper bounds first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def fold(rows: list[tuple], least: float = 0.9, years: int = 1) -> list[str]:
    """DED-04: the reason for dropping each row ('' for kept) in input order.

    rows: (tmdb, imdb, title, year). Only kept rows enter the indexes; rows without a year never match
    by title; of one title the year kept last counts.
    """
    tmdb, imdb, titles = set(), set(), {}
    out = []
    for t, i, title, year in rows:
        name = (title or "").lower().strip()
        if t and t in tmdb:
            out.append("tmdb")
        elif i and i in imdb:
            out.append("imdb")
        elif year is not None and any(y is not None and abs(year - y) <= years and similar(name, k, least) for k, y in titles.items()):
            out.append("fuzzy")
        else:
            out.append("")
            if t:
                tmdb.add(t)
            if i:
                imdb.add(i)
            titles[name] = year
    return out


def _blocks(df: DataFrame, least: float, years: int) -> DataFrame:
    """(pos, block): rows that can influence each other share a block.

    Candidates by title are pairs of distinct titles of neighbouring years whose lengths allow the
    ratio and that share one of their rarest trigrams; ids join them further. Components are found
    by spreading the smallest position, with pointer jumping, until nothing changes.
    """
    links = []
    for key in ("tmdb_id", "imdb_id"):
        text = F.col(key).cast("string")
        k = df.where(text.isNotNull() & ~text.isin("", "0")).select("pos", F.col(key).alias("k"))
        first = k.groupBy("k").agg(F.min("pos").alias("b"))
        links.append(k.join(first, "k").select(F.col("pos").alias("a"), "b"))
    every = df.where(F.col("year").isNotNull() & (F.length("name") > 0)).select("pos", "name", "year")
    # equal titles of a year are one candidate; its other rows hang on the first
    t = every.groupBy("name", "year").agg(F.min("pos").alias("pos"))
    links.append(every.join(t.withColumnRenamed("pos", "b"), ["name", "year"]).select(F.col("pos").alias("a"), "b"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(3))))
    g = t.select("pos", "name", "year", F.explode(grams).alias("g"))
    rare = g.groupBy("g").agg(F.count("*").alias("df"))
    # prefix filter: of n trigrams at least the rarest n - need + 1 hold a common one
    w = Window.partitionBy("pos").orderBy("df", "g")
    n = F.count("*").over(Window.partitionBy("pos"))
    may_lose = F.ceil(F.length("name") * 2 * (1 - least)) * 3 + 1
    pre = g.join(rare, "g").withColumn("rn", F.row_number().over(w)).withColumn("n", n).where(F.col("rn") <= F.least(F.col("n"), may_lose))
    pre = pre.select("pos", "name", "year", "g", F.explode(F.sequence(F.col("year") - years, F.col("year") + years)).alias("y"))
    x = pre.select(F.col("pos").alias("a"), F.col("name").alias("na"), F.col("year").alias("y"), "g").distinct()
    y = pre.select(F.col("pos").alias("b"), F.col("name").alias("nb"), "y", "g").distinct()
    lo, hi = F.least(F.length("na"), F.length("nb")), F.greatest(F.length("na"), F.length("nb"))
    cand = x.join(y, ["g", "y"]).where((F.col("a") < F.col("b")) & (2 * lo / (lo + hi) >= least)).select("a", "b", "na", "nb").distinct()

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ok = [similar(b, a, least) or similar(a, b, least) for a, b in zip(p["na"], p["nb"], strict=True)]
            yield p.loc[ok, ["a", "b"]]

    links.append(cand.mapInPandas(keep, "a long, b long"))
    edges = links[0].unionByName(links[1]).unionByName(links[2]).unionByName(links[3]).where(F.col("a") != F.col("b"))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(df.select("pos", F.col("pos").alias("block")))
    while True:
        low = both.join(label.select(F.col("pos").alias("b"), "block"), "b").groupBy("a").agg(F.min("block").alias("m"))
        new = label.join(low.withColumnRenamed("a", "pos"), "pos", "left").select("pos", F.least("block", F.coalesce("m", "block")).alias("block"), F.col("block").alias("was"))
        up = label.select(F.col("pos").alias("block"), F.col("block").alias("top"))
        new = cut(new.join(up, "block").select("pos", F.least("block", "top").alias("block"), "was"))
        done = new.where(F.col("block") != F.col("was")).isEmpty()
        label = new.drop("was")
        if done:
            break
    return label


def deduplicate(films: DataFrame, least: float = 0.9, years: int = 1) -> DataFrame:
    """DED-03, 04: (pos, reason) of every row; films: (pos, tmdb_id, imdb_id, title, year).

    Rows fold in input order within connected blocks only: rows of different blocks share no
    id and no similar title, so the result is that of one pass over all rows. The fold itself is
    sequential by definition: a block is one task.
    """
    df = cut(films.select(F.col("pos").cast("long").alias("pos"), "tmdb_id", "imdb_id", "title", F.col("year").cast("int").alias("year"), F.trim(F.lower(F.coalesce("title", F.lit("")))).alias("name")))
    label = _blocks(df, least, years)
    size = label.groupBy("block").agg(F.count("*").alias("n"))
    met = df.join(label, "pos").join(size, "block")
    alone = met.where(F.col("n") == 1).select("pos", F.lit("").alias("reason"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        none = lambda v: None if pd.isna(v) else v
        rows = [(none(t), none(i), none(x), none(y)) for t, i, x, y in zip(p["tmdb_id"], p["imdb_id"], p["title"], p["year"], strict=True)]
        return pd.DataFrame({"pos": p["pos"].to_numpy(), "reason": fold(rows, least, years)})

    several = met.where(F.col("n") > 1).select("block", "pos", "tmdb_id", "imdb_id", "title", "year").groupBy("block").applyInPandas(run, "pos long, reason string")
    return alone.unionByName(several)


def dedupe_queries(df: DataFrame, text: str, order: str, least: float = 0.9) -> DataFrame:
    """DED-05: queries not similar to one kept before; equal folded texts are one row before any comparison.

    A year of 0 for all makes the title fold apply to plain texts.
    """
    from loomframe.functions.cleaning import fold_accents

    t = df.where(F.col(text).isNotNull()).select(F.lower(fold_accents(F.col(text))).alias("title"), F.col(order).cast("long").alias("pos"), F.col(text).alias("query"))
    first = t.groupBy("title").agg(F.min("pos").alias("pos"), F.min_by("query", "pos").alias("query"))
    rows = first.select("pos", F.lit(None).cast("long").alias("tmdb_id"), F.lit(None).cast("string").alias("imdb_id"), "title", F.lit(0).alias("year"))
    kept = deduplicate(rows, least, 0).where(F.col("reason") == "").select("pos")
    return first.join(kept, "pos").select("pos", "query")
