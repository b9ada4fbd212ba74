"""Sorted neighbourhood over records with titles: candidate pairs and their field similarities.

Shared by entity matching between tables and by duplicate groups within one. A record is
(key, src, title, part, year, ...); several rows may give one record several titles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import cut, global_rank

BLOCK = 2000  # rows of the sorted order that one window partition holds
FEW = 20  # records that one film may have: a word of so few names a film in the smallest table too
LIKE_RAREST = 3  # held by more than FEW, a title's second word names it only where it is at most so many times as frequent as the rarest
SHARE = 0.001  # beyond that, greatest share of the records that may hold a word for it to name a film
SALTED = 1000  # records of one name, part and year that one share of a join holds

# Accented letters and their plain forms; roman numerals of sequels.
ACCENTED = "àáâãäåèéêëìíîïòóôõöøùúûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiioooooouuuucnyy"
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def plain_title(c: Column) -> Column:
    """Lower case, without accents, bracketed remarks, the suffix of film adaptations and an article put last."""
    t = F.translate(F.lower(c), ACCENTED, PLAIN)
    t = F.regexp_replace(t, r"\[[^\]]*\]|\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\s-\s*the movie\s*$", " ")
    return F.regexp_replace(t, r"\s*,\s*(?:the|an?|les?|las?|los|el|il|gli|der|die|das|l')\s*$", " ")


def title_words(c: Column) -> Column:
    return F.regexp_extract_all(plain_title(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sequel(words: Column) -> Column:
    """The number of a sequel from a roman or short arabic numeral at the end; 1 without one."""
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    last = F.element_at(words, -1)
    arabic = F.when(last.rlike(r"^\d{1,2}$"), last.cast("int"))
    return F.when(F.size(words) > 1, F.coalesce(F.try_element_at(table, last), arabic, F.lit(1))).otherwise(F.lit(1))


def with_names(records: DataFrame) -> DataFrame:
    """(key, name) of each record: the rarest word of each title and the next one if it is nearly as rare, or the whole title if no word is rare.

    `records` has key and words (array), a row for each title. A word is rare by the share of the records that hold it, so
    that more records of the same vocabulary change nothing. At most 1 / SHARE times the words of a mean record are
    frequent; they are put aside by a broadcast list before rare words are joined.
    """
    most = FEW + SHARE * records.select("key").distinct().count()
    w = records.select("key", F.concat_ws(" ", "words").alias("title"), F.explode(F.array_distinct("words")).alias("word"))
    count = w.select("key", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    hot = count.where(F.col("df") > most).select("word")
    rare = count.where(F.col("df") <= most)
    long = w.where((F.length("word") >= 4) & ~F.col("word").rlike(r"\d"))
    named = long.join(F.broadcast(hot), "word", "left_anti").join(rare, "word")
    title = Window.partitionBy("key", "title").orderBy("df", F.desc(F.length("word")), "word")
    best = named.withColumn("rn", F.row_number().over(title)).withColumn("least", F.first("df").over(title)).where((F.col("rn") <= 2) & (F.col("df") <= F.greatest(F.lit(FEW), LIKE_RAREST * F.col("least")))).select("key", F.col("word").alias("name")).distinct()
    rest = records.join(best.select("key").distinct(), "key", "left_anti").select("key", F.concat_ws(" ", "words").alias("name")).where(F.col("name") != "").distinct()
    return best.unionByName(rest)


def sort_keys(name: Column, tail: Column) -> Column:
    """Composite keys for the same film: the name, the name backwards, and its two ends; each then sequel and year.

    Wherever one letter of the name is wrong, one of the three still sorts next to the right one.
    """
    ends = F.concat(F.substring(name, 1, 3), F.lit("~"), F.substring(F.reverse(name), 1, 3))
    return F.array(
        F.struct(F.lit(1).alias("kind"), F.concat_ws("|", name, tail).alias("sort")),
        F.struct(F.lit(2).alias("kind"), F.concat_ws("|", F.reverse(name), tail).alias("sort")),
        F.struct(F.lit(3).alias("kind"), F.concat_ws("|", ends, tail, name).alias("sort")),
    )


def neighbours(entries: DataFrame, window: int) -> DataFrame:
    """Pairs (x, y) of `rec` structs of entries (kind, sort, rec) at most `window` places apart in the order of a kind.

    Positions come from a range sort; blocks of BLOCK positions take a halo of `window` rows from
    the next one, so hot keys only make long runs of the order, never a large group.
    """
    ranked = global_rank(entries, ["kind", "sort", "rec"], "pos")
    here = ranked.withColumn("block", F.floor(F.col("pos") / BLOCK))
    halo = here.where((F.col("pos") % BLOCK < window) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    both = here.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(1, window)
    seen = both.select("kind", "own", F.col("rec").alias("x"), F.collect_list(F.struct("kind", "rec")).over(w).alias("next")).where("own")
    return seen.select("kind", "x", F.explode("next").alias("n")).where(F.col("kind") == F.col("n.kind")).select("x", F.col("n.rec").alias("y"))


def near_names(entries: DataFrame, window: int) -> DataFrame:
    """Pairs (x, y) of `rec` structs with two names that typing errors can explain, from entries (kind, sort, rec).

    Places are counted by distinct sort keys, so a run of equal keys is one place however long it is; the records of both
    places are joined back. A sort key must hold the name.
    """
    places = entries.select("kind", "sort", F.struct("kind", "sort", "rec.name").alias("rec")).distinct()
    d = edits(F.col("x.name"), F.col("y.name"))
    near = neighbours(places, window).where((F.col("x.name") != F.col("y.name")) & d.isNotNull()).select("x.kind", F.col("x.sort").alias("sx"), F.col("y.sort").alias("sy"))
    x = entries.select("kind", F.col("sort").alias("sx"), F.col("rec").alias("x"))
    y = entries.select("kind", F.col("sort").alias("sy"), F.col("rec").alias("y"))
    return near.join(x, ["kind", "sx"]).join(y, ["kind", "sy"]).select("x", "y")


def equal_names(recs: DataFrame, years: int) -> DataFrame:
    """All pairs (x, y) of `rec` structs (key, name, part, year, ...) of equal name and part, years at most `years` apart or unknown.

    An equi-join on name, part and year (or a mark where the left one has none); keys of many records are salted.
    """
    by, unknown = ["name", "part", "at"], F.lit(-9999)
    year = F.col("rec.year")
    at = lambda ys: F.explode(ys).alias("at")
    x = recs.select("rec.name", "rec.part", at(F.when(year.isNull(), F.array(unknown)).otherwise(F.sequence(year, year + years))), F.col("rec").alias("x"))
    y = recs.select("rec.name", "rec.part", at(F.array_compact(F.array(year, unknown))), F.col("rec").alias("y"))
    hot = y.groupBy(*by).agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")).where(F.col("salts") > 1)
    salts = F.coalesce("salts", F.lit(1))
    x = x.join(hot, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    y = y.join(hot, by, "left").withColumn("salt", F.pmod(F.hash("y.key"), salts)).drop("salts")
    return x.join(y, [*by, "salt"]).where(~F.col("x.year").eqNullSafe(F.col("y.year")) | (F.col("x.key") < F.col("y.key"))).select("x", "y")


def alike(records: DataFrame, same: list[str]) -> DataFrame:
    """(key, rep): the smallest key of the records that equal each other in all columns of `same`."""
    reps = records.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min("key").alias("rep"))
    equal = F.lit(True)
    for c in same:
        equal &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return records.join(reps, equal).select("key", "rep")


def edits(a: Column, b: Column) -> Column:
    """Edit distance of two names where typing errors can explain it, else null."""
    d = F.levenshtein(a, b, 3)
    short = F.least(F.length(a), F.length(b))
    return F.when((d >= 0) & (d <= F.when(short >= 8, 3).when(short >= 6, 2).when(short >= 4, 1).otherwise(0)), d)


def other_words(titles: Column, name: Column, stop: str) -> Column:
    """The words of each title beside its name and those in `stop`, the long ones (four letters or more) apart."""
    kept = F.transform(titles, lambda t: F.filter(t, lambda w: (w != name) & ~F.contains(F.lit(stop), F.concat(F.lit(" "), w, F.lit(" ")))))
    return F.transform(kept, lambda t: F.struct(F.filter(t, lambda w: F.length(w) >= 4).alias("long"), F.filter(t, lambda w: F.length(w) < 4).alias("short")))


def same_words(rest: Column) -> Column:
    """The long words of each title as one text, where they tell: equal texts agree without a look at single words."""
    told = F.filter(rest, lambda t: (F.size(t["long"]) > 0) | (F.size(t["short"]) == 0))
    return F.transform(told, lambda t: F.concat_ws(" ", t["long"]))


def agreement(p: Column, q: Column) -> Column:
    """Whether the other words of two titles agree (1), disagree (0) or may be translations (null).

    Words of four letters or more agree up to two wrong letters; half of the fewer ones must. Titles that share a short word
    are taken to be of one language, so that different long words disagree.
    """
    a, b = p["long"], q["long"]
    near = F.size(F.filter(a, lambda x: F.exists(b, lambda y: (x == y) | ((F.length(x) >= 5) & (F.levenshtein(x, y, 2) >= 0)))))
    fewer = F.least(F.size(a), F.size(b))
    one = F.arrays_overlap(p["short"], q["short"])
    bare = (F.size(a) + F.size(p["short"]) == 0) & (F.size(b) + F.size(q["short"]) == 0)
    return F.when(bare | ((fewer > 0) & (near >= fewer / 2)), 1.0).when(one & (F.greatest(F.size(a), F.size(b)) > 0), 0.0)


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the similarities that are present, by weight."""
    total = sum((F.when(s.isNotNull(), F.lit(w) * s).otherwise(F.lit(0.0)) for w, s in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, s in parts), F.lit(0.0))
    return total / F.when(weight > 0, weight)


def assign(pairs: DataFrame, epsilon: float = 0.01, rounds: int = 40, small: int = 200_000) -> DataFrame:
    """One-to-one assignment of (l, r, conf) with the greatest total confidence, by auction.

    Pairs whose both sides have no other are taken at once. For the others, every free left
    bids for its best right by how much it is better than its second best (or than staying
    alone) plus epsilon; the highest bid holds the right. Joint rounds go on until no bid is left;
    after `rounds` of them, connected components of up to `small` pairs that still bid are
    auctioned to the end each by itself. The total is within epsilon per left of the maximum.
    """
    dl, dr = pairs.groupBy("l").agg(F.count("*").alias("nl")), pairs.groupBy("r").agg(F.count("*").alias("nr"))
    deg = cut(pairs.join(dl, "l").join(dr, "r"))
    easy = deg.where((F.col("nl") == 1) & (F.col("nr") == 1)).select("l", "r", "conf")
    hard = cut(deg.where((F.col("nl") > 1) | (F.col("nr") > 1)).select("l", "r", "conf"))
    held = hard.select("r", "l", F.lit(0.0).alias("price")).limit(0)
    rest = hard.limit(0)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return _auction(p, epsilon)

    at = 0
    while True:
        tie = F.col("r") if at < rounds else F.xxhash64("l", "r")  # later, tied bids are spread over the rights
        best = Window.partitionBy("l").orderBy(F.desc("v"), tie)
        offers = hard.join(held.select("l"), "l", "left_anti").join(held.select("r", "price"), "r", "left").withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn("v", F.col("conf") - F.col("price"))
        offers = offers.withColumn("next", F.lead("v", 1, 0.0).over(best)).withColumn("rn", F.row_number().over(best)).where((F.col("rn") == 1) & (F.col("v") > 0))
        bids = cut(offers.select("r", "l", (F.col("price") + F.col("v") - F.greatest(F.col("next"), F.lit(0.0)) + epsilon).alias("price")))
        if bids.isEmpty():
            break
        if at == rounds:
            side = lambda c: F.concat(F.lit(c), F.col(c).cast("string"))
            edges = hard.select(side("l").alias("a"), side("r").alias("b"))
            of = components(edges.select(F.col("a").alias("key")), edges)
            still = of.join(bids.select(side("l").alias("key")), "key").select("group").distinct()
            met = hard.withColumn("key", side("l")).join(of.join(still, "group"), "key")
            few = met.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") <= small)
            met = cut(met.join(few, "group").select("group", "l", "r", "conf"))
            rest = cut(met.groupBy("group").applyInPandas(run, hard.schema))
            done = met.select("l").distinct()
            hard, held = cut(hard.join(done, "l", "left_anti")), held.join(done, "l", "left_anti")
            bids = bids.join(done, "l", "left_anti")
        w = Window.partitionBy("r").orderBy(F.desc("price"), "l")
        held = cut(held.unionByName(bids).withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn"))
        at += 1
    return easy.unionByName(hard.join(held.select("l", "r"), ["l", "r"]).select("l", "r", "conf")).unionByName(rest)


def _auction(p: pd.DataFrame, epsilon: float) -> pd.DataFrame:
    """One component of `assign`, until no left bids: each bid raises a price by epsilon or more, and none beyond the greatest confidence by more."""
    p = p.sort_values(["l", "r"], ignore_index=True)
    r, conf = p["r"].astype("category").cat.codes.to_numpy(), p["conf"].to_numpy()
    edges = list(p.groupby("l").indices.values())
    price, holder = np.zeros(r.max() + 1), {}
    free = list(range(len(edges)))
    while free:
        l = free.pop()
        e = edges[l]
        v = conf[e] - price[r[e]]
        k = int(v.argmax())
        if v[k] <= 0:
            continue
        at = r[e[k]]
        price[at] += v[k] - max(np.delete(v, k).max(initial=0.0), 0.0) + epsilon
        if at in holder:
            free.append(holder[at][0])
        holder[at] = (l, e[k])
    return p.loc[sorted(e for _, e in holder.values()), ["l", "r", "conf"]]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, group) with the smallest key of each connected component, by label spreading and pointer jumping until nothing changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = both.select(F.col("a").alias("key")).distinct()
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("group")).withColumnRenamed("a", "key"))
    while True:
        spread = both.join(label.select(F.col("key").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("g"))
        low = label.join(spread.withColumnRenamed("a", "key"), "key").select("key", F.least("group", "g").alias("group"), F.col("group").alias("old"))
        up = label.select(F.col("key").alias("group"), F.col("group").alias("top"))
        new = cut(low.join(up, "group", "left").select("key", F.least("group", F.coalesce("top", "group")).alias("group"), "old"))
        if new.where(F.col("group") != F.col("old")).isEmpty():
            label = new
            break
        label = new.drop("old")
    alone = nodes.select("key").distinct().join(touched, "key", "left_anti").select("key", F.col("key").alias("group"))
    return label.select("key", "group").unionByName(alone)
