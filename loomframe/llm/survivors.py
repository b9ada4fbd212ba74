"""Duplicate groups of film records, and the best value of each field by truth discovery.

Groups: a join of equal names, sorted neighbourhoods over names and ids, pairs by agreeing evidence, connected components.
Values: each record claims a value per field in the name of its sources; the reliability of a
source and the support of each value are estimated in turn until they settle, and each
field takes its best supported value. A record that the year and the director so found both speak
against is another film that a chain of pairs had joined: it leaves its group, with its likes.

Defined cases: fillers, values out of range and blanks claim nothing; a field without any claim
is null; ties go to the value claimed latest, then to the smaller one; a record without
duplicates is its own group; repeated rows with one rec_id are one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm import matching as m
from loomframe.session import cut, shuffle_width

WINDOW = 12
YEARS = 1  # difference in years that still is the same film
ROUNDS = 12
SETTLE = 1e-3


def imdb_number(c: str) -> Column:
    """Digits of an id in any notation, without leading zeros; fillers are null."""
    n = F.regexp_replace(F.regexp_extract(F.col(c), r"(\d{5,})", 1), "^0+", "")
    return F.when((n != "") & ~n.rlike("^(9+)$"), n)


def _person(c: str) -> Column:
    t = F.translate(F.lower(F.col(c)), m.ACCENTED, m.PLAIN)
    t = F.concat_ws(" ", F.array_sort(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return F.when(t != "", t)


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """(a, b) of records with enough evidence that they are one film.

    Records of the same titles and evidence are compared once, by their smallest key, and as soon as it has a partner
    (or they speak for each other) hang on it, so their number never multiplies. Equal names meet by an exact join.
    """
    base = df.where(F.col("rec_id").isNotNull()).dropDuplicates(["rec_id"]).select(
        F.col("rec_id").alias("key"), F.array_distinct(F.array_compact(F.array("title", "original_title", "title_fr"))).alias("titles"), F.year("release_date").alias("year"), F.col("release_date").alias("day"),
        F.when(F.col("runtime").between(1, 600), F.col("runtime")).alias("runtime"), _person("director").alias("person"), F.col("tmdb_id").cast("long").alias("tmdb"), imdb_number("imdb_id").alias("imdb"),
        F.when(F.col("revenue") > 0, F.col("revenue")).alias("revenue"), F.when(F.col("budget") > 1000, F.col("budget")).alias("budget"),
    )
    base = cut(base)
    words = base.select("key", F.explode("titles").alias("t")).select("key", m.title_words(F.col("t")).alias("words")).where(F.size("words") > 0)
    words = cut(words.withColumn("part", m.sequel(F.col("words"))))
    names = m.with_names(words.select("key", "words"))
    part = words.groupBy("key").agg(F.max("part").alias("part"), F.array_sort(F.collect_set("words")).alias("words"))
    facts = cut(base.drop("titles").join(part, "key"))
    members = cut(m.alike(facts, [c for c in facts.columns if c != "key"]))
    reps = members.groupBy(F.col("rep").alias("key")).agg((F.count("*") > 1).alias("several"))
    entry = names.join(facts.drop("words").join(reps, "key"), "key")
    tail = F.concat_ws("|", F.col("part").cast("string"), F.coalesce("person", F.lit("")), F.coalesce(F.col("day").cast("string"), F.lit("")))
    ids = F.array_compact(F.array(
        F.when(F.col("imdb").isNotNull(), F.struct(F.lit(4).alias("kind"), F.concat_ws("|", "imdb", "name").alias("sort"))),
        F.when(F.col("tmdb").isNotNull(), F.struct(F.lit(5).alias("kind"), F.concat_ws("|", F.col("tmdb").cast("string"), "name").alias("sort"))),
    ))
    entry = entry.select(F.struct("key", "name", "part", "year", "day", "runtime", "person", "tmdb", "imdb", "revenue", "budget", "several").alias("rec"), F.explode(F.concat(m.sort_keys(F.col("name"), tail), ids)).alias("k")).select("k.kind", "k.sort", "rec")
    entry = cut(entry)
    named = entry.where(F.col("kind") == 1)
    own = named.where("rec.several").select(F.col("rec").alias("x"), F.col("rec").alias("y"))
    p = m.near_names(entry, WINDOW).where(F.col("x.key") != F.col("y.key")).unionByName(m.equal_names(named, YEARS)).unionByName(own).where(F.col("x.part") == F.col("y.part"))
    p = p.withColumn("d", m.edits(F.col("x.name"), F.col("y.name"))).where(F.col("d").isNotNull())
    eq = lambda c: F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))
    dy, dr = F.abs(F.col("x.year") - F.col("y.year")), F.abs(F.col("x.runtime") - F.col("y.runtime"))
    person = F.levenshtein("x.person", "y.person")
    same_person, other_person = F.coalesce(person <= 2, F.lit(False)), F.coalesce(person > 4, F.lit(False))
    year_ok = F.coalesce(dy <= YEARS, F.lit(True))
    id_same = eq("tmdb") | eq("imdb")
    money = eq("revenue") | eq("budget")
    by_id = id_same & year_ok & (~other_person | (eq("tmdb") & eq("day")))
    by_person = same_person & year_ok & ((F.col("d") == 0) | eq("day") | (dy.isNotNull() & F.coalesce(dr <= 2, F.lit(True))) | money)
    exact_day = eq("day") & ~((F.month("x.day") == 1) & (F.dayofmonth("x.day") == 1))  # the first of January stands for a bare year
    by_facts = ~other_person & ((F.col("d") == 0) & F.coalesce(dy <= 1, F.lit(False)) | (exact_day & F.coalesce(dr <= 3, F.lit(True))) | ((F.col("d") == 0) & year_ok & (money | F.coalesce(dr <= 3, F.lit(False)))))
    p = p.where(F.when(F.col("d") <= 2, by_id | by_person | by_facts).otherwise(by_id | (same_person & eq("day") & F.coalesce(dr <= 2, F.lit(True)))))
    p = cut(p.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())
    met = p.select(F.col("a").alias("rep")).unionByName(p.select(F.col("b").alias("rep"))).distinct()
    copies = members.join(met, "rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return p.unionByName(copies).where(F.col("a") != F.col("b")).distinct()


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(rec_id, group): the smallest rec_id of each film's records, as far as pairs tell."""
    return _groups(df, duplicate_pairs(df))


def _groups(df: DataFrame, pairs: DataFrame) -> DataFrame:
    nodes = df.where(F.col("rec_id").isNotNull()).select(F.col("rec_id").alias("key"))
    return m.components(nodes, pairs).withColumnRenamed("key", "rec_id")


def merged_groups(df: DataFrame) -> DataFrame:
    """(rec_id, group) of the records that truth discovery bears out as one film.

    Year and director are found for each group of pairs; records that both contradict part from
    it, and what stays together on either side is grouped again. Reliability is per field, so the
    other fields need no part in this.
    """
    pairs = cut(duplicate_pairs(df))
    groups = cut(_groups(df, pairs))
    best = truth(claims(df, groups, ["release_date", "director"]))
    true = best.groupBy("group").pivot("field", ["release_date", "director"]).agg(F.first("value"))
    said = df.where(F.col("rec_id").isNotNull()).dropDuplicates(["rec_id"]).select("rec_id", F.year("release_date").alias("year"), _person("director").alias("person"))
    other = (F.abs(F.col("year") - F.year(F.col("release_date").cast("date"))) > YEARS) & (F.levenshtein("person", "director") > 4)
    out = cut(said.join(groups, "rec_id").join(true, "group").where(other).select("rec_id", F.lit(True).alias("out")))
    if out.isEmpty():
        return groups
    side = lambda c: out.select(F.col("rec_id").alias(c), F.col("out").alias(f"o_{c}"))
    kept = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.col("o_a").eqNullSafe(F.col("o_b"))).select("a", "b")
    return _groups(df, kept)


def claims(df: DataFrame, groups: DataFrame, trusted: list[str]) -> DataFrame:
    """(group, field, value, shown, source, at): what each source claims. value decides equality, shown is given out."""
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    plain = lambda c: F.concat_ws(" ", m.title_words(F.col(c)))
    number = lambda c, lo, hi: F.when(F.col(c).between(lo, hi), F.col(c).cast("long").cast("string"))
    imdb = F.when(imdb_number("imdb_id").isNotNull(), F.concat(F.lit("tt"), F.lpad(imdb_number("imdb_id"), 8, "0")))
    fields = {
        "title": (plain("title"), text("title")), "original_title": (text("original_title"), text("original_title")), "title_fr": (plain("title_fr"), text("title_fr")),
        "imdb_id": (imdb, imdb), "runtime": (number("runtime", 1, 600),) * 2, "budget": (number("budget", 1000, 500_000_000),) * 2, "revenue": (number("revenue", 1, 5_000_000_000),) * 2,
        "release_date": (F.col("release_date").cast("string"),) * 2, "director": (_person("director"), text("director")), "original_language": (F.lower(F.substring(text("original_language"), 1, 2)),) * 2,
    }
    cells = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value"), s.alias("shown")) for k, (v, s) in fields.items() if k in trusted])
    src = F.when(F.size(F.array_compact("sources")) > 0, F.array_distinct(F.array_compact("sources"))).otherwise(F.array(F.lit("unknown")))
    used = ["rec_id", "title", "original_title", "title_fr", "imdb_id", "runtime", "budget", "revenue", "release_date", "director", "original_language", "sources", "updated_at"]
    rows = df.select(*used).dropDuplicates(["rec_id"]).join(groups, "rec_id").select("group", F.col("updated_at").alias("at"), src.alias("sources"), F.explode(cells).alias("c"))
    return rows.select("group", "at", "sources", "c.*").where(F.col("value").isNotNull() & (F.col("value") != "")).select("group", "field", "value", "shown", "at", F.explode("sources").alias("source"))


def _look() -> Column:
    """Of spellings of one value, one in mixed case comes first, then the latest."""
    return F.struct(((F.col("shown") != F.lower("shown")) & (F.col("shown") != F.upper("shown"))).alias("mixed"), F.col("at").alias("at"), F.col("shown").alias("shown"))


FIELDS = ["title", "original_title", "title_fr", "imdb_id", "runtime", "budget", "revenue", "release_date", "director", "original_language"]


def truth(claimed: DataFrame, rounds: int = ROUNDS, settle: float = SETTLE) -> DataFrame:
    """(group, field, value, shown, support): the value with the greatest support of reliable sources.

    Claims are first counted per group, field, value and source, so a value claimed by a third of
    all rows is a few rows; they stay partitioned by group and field, so that a round is one pass
    over the fields with more than one value, and only sums per source and field are shuffled.
    Reliability starts at 0.8; it is the smoothed share of a source's claims that the present truth
    bears out, per field. One number per source and field is broadcast; beyond 10,000 of them
    the join is left to the planner.
    """
    cell = Window.partitionBy("group", "field")
    c = claimed.groupBy("group", "field", "value", "source").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max_by("shown", _look()).alias("shown"))
    c = c.repartition(shuffle_width(claimed.sparkSession), "group", "field").withColumn("open", F.min("value").over(cell) != F.max("value").over(cell)).withColumn("several", F.min("source").over(cell) != F.max("source").over(cell))
    c = cut(c)
    contested = cut(c.where("open"))
    agreed = F.sum(F.when(~F.col("open") & F.col("several"), F.col("n")).otherwise(0))
    trust = cut(c.groupBy("source", "field").agg(agreed.alias("agreed")).withColumn("trust", F.lit(0.8)))
    few = trust.count() <= 10_000
    best = Window.partitionBy("group", "field").orderBy(F.desc("support"), F.desc("at"), "value")

    def winners(claims_: DataFrame, trust: DataFrame) -> DataFrame:
        odds = F.log(F.col("trust") / (1 - F.col("trust"))) + 2.0
        t = trust.select("source", "field", "trust")
        votes = claims_.join(F.broadcast(t) if few else t, ["source", "field"]).groupBy("group", "field", "value").agg(F.sum(F.greatest(odds, F.lit(0.05)) * F.sqrt("n")).alias("support"), F.max("at").alias("at"), F.max_by("shown", _look()).alias("shown"))
        return votes.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == 1).drop("rn")

    for _ in range(rounds):
        won = contested.where("several").join(winners(contested, trust).select("group", "field", F.col("value").alias("won")), ["group", "field"])
        new = won.groupBy("source", "field").agg(F.sum(F.when(F.col("value") == F.col("won"), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("all"))
        z = lambda x: F.coalesce(x, F.lit(0))
        now = F.when(z("agreed") + z("all") > 0, F.least((z("agreed") + z("ok") + 4) / (z("agreed") + z("all") + 5), F.lit(0.98))).otherwise(F.col("trust"))
        new = cut(trust.join(new, ["source", "field"], "left").select("source", "field", "agreed", now.alias("trust"), F.abs(now - F.col("trust")).alias("moved")))
        moved = new.agg(F.max("moved")).first()[0] or 0.0
        trust = new.drop("moved")
        if moved < settle:
            break
    return winners(c, trust).select("group", "field", "value", "shown", "support")


def survivors(df: DataFrame) -> DataFrame:
    """One record per film: the smallest rec_id, number of records, and the best supported value of each field."""
    groups = cut(merged_groups(df))
    best = truth(claims(df, groups, FIELDS))
    wide = best.groupBy("group").pivot("field", FIELDS).agg(F.first("shown"))
    kinds = {"runtime": "int", "budget": "long", "revenue": "long", "release_date": "date"}
    size = groups.groupBy("group").agg(F.count("*").alias("records"))
    return size.join(wide, "group", "left").select(F.col("group").alias("rec_id"), "records", *[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])


def pairs_of_groups(groups: DataFrame) -> DataFrame:
    """Every pair (rec_a, rec_b) within a group."""
    several = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("group")
    g = groups.join(several, "group")
    return g.select("group", F.col("rec_id").alias("rec_a")).join(g.select("group", F.col("rec_id").alias("rec_b")), "group").where(F.col("rec_a") < F.col("rec_b")).select("rec_a", "rec_b")
