import datetime

from pyspark.sql import functions as F

from loomframe.functions import cleaning as c


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


def test_strings(spark):
    assert one(spark, c.clean_string, " \t a b\n") == "a b"
    assert one(spark, c.clean_string, " \n ") is None
    assert one(spark, c.clean_text, " No Overview ") is None
    assert one(spark, c.clean_text, "too short") is None
    assert one(spark, c.clean_text, " long enough text ") == "long enough text"
    assert one(spark, c.clean_language, " FR ") == "fr"
    assert one(spark, c.clean_language, "fra") is None
    assert [one(spark, c.null_token, x) for x in ("NA", "N/A", "null", "None", "", "x", None)] == [None] * 5 + ["x", None]


def test_numbers(spark):
    assert [one(spark, c.safe_int, x) for x in ("3", "-3", "3.9", "x", None, " 7 ")] == [3, 0, 0, 0, 0, 7]
    assert [one(spark, c.safe_positive, x) for x in ("3", "0", None)] == [3, None, None]
    assert one(spark, lambda x: c.safe_float(x, 1), "2.25") == 2.3
    assert one(spark, lambda x: c.safe_float(x, default=1.5), "bad") == 1.5
    assert one(spark, lambda x: c.in_range(x, 1, 600), 601, "int") is None


def test_dates(spark):
    d = datetime.date
    assert one(spark, c.iso_date, "2024-01-15") == d(2024, 1, 15)
    assert one(spark, c.iso_date, "20240115") == d(2024, 1, 15)
    assert [one(spark, c.iso_date, x) for x in ("1999", "2024-13-01", "x", None)] == [None] * 4
    assert one(spark, c.date_or_year, "1999") == d(1999, 1, 1)
    assert one(spark, c.date_or_year, "1899") is None


def test_critics(spark):
    assert one(spark, c.consensus, "Critics Consensus: A slow and careful ghost story.") == "A slow and careful ghost story."
    assert one(spark, c.consensus, "No consensus yet, but soon there will be") is None
    assert one(spark, c.consensus, "short") is None
    assert [one(spark, c.state, x) for x in ("Upright", "spilled", "Certified-Fresh", "odd", "", None)] == ["fresh", "rotten", "certified_fresh", "odd", None, None]
    assert one(spark, c.is_fresh, None, "int") is False


def test_slugs(spark):
    assert one(spark, c.slug, "The Devil's Backbone & Co. — Part-2") == "devils_backbone_and_co_part_2"
    assert one(spark, c.slug, "Été meurtrier") == "été_meurtrier"
    v = spark.createDataFrame([("The Ring II", 2005)], "t string, y int").select(c.url_variants(F.col("t"), F.col("y")).alias("v")).first()["v"]
    assert v == ["/m/ring_ii", "/m/ring_ii_2005", "/m/the_ring_ii", "/m/the_ring_ii_2005", "/m/ring__2"]
    assert one(spark, c.slug_of_url, "https://x/m/abc_def?x=1") == "abc_def"


def test_nested(spark):
    t = "array<struct<iso_639_1:string,iso_3166_1:string,data:struct<title:string,overview:string>>>"
    rows = [[("fr", "CH", ("no", "")), ("fr", "BE", (" ", "")), ("fr", "CA", (" Oui ", "x"))]]
    assert one(spark, lambda x: c.french(x, "title"), rows[0], t) == "Oui"
    assert one(spark, lambda x: c.french(x, "title"), None, t) is None
    a = "array<struct<iso_3166_1:string,title:string>>"
    assert one(spark, c.regional_titles, [("FR", " A "), ("US", "B"), ("LU", "A"), ("CH", "C")], a) == ["A", "C"]
    assert one(spark, c.top_cast, [("b", 2), ("n", None), ("a", 1)], "array<struct<name:string,order:int>>") == ["a", "b", "n"]
    crew = [("x", "Director"), ("y", "Writer"), ("z", "Director")]
    got = one(spark, lambda x: c.crew_of(x, ["Director"]), crew, "array<struct<name:string,job:string>>")
    assert [(r["display_order"], r["name"]) for r in got] == [(0, "x"), (1, "z")]


def test_queries(spark):
    assert one(spark, c.strip_noise, "Un film d'horreur à Paris") == "un paris"
    assert one(spark, c.strip_noise, "film") == "film"
    assert one(spark, c.fold_accents, "  Été   à\tLyon ") == "Ete a Lyon"
    assert one(spark, lambda x: c.looks_french(x, ["vampire"], ["le", "de"]), "le bout de bois") is True
    assert one(spark, lambda x: c.looks_french(x, ["vampire"], ["le", "de"]), "a piece") is False
    assert one(spark, lambda x: c.expand_query(x, ["film"], "film d'horreur"), "fantômes") == "fantômes film d'horreur"
    assert one(spark, lambda x: c.redact(x, ["email"]), {"Email": "a@b", "k": "v"}, "map<string,string>") == {"Email": "[REDACTED]", "k": "v"}


def test_score(spark):
    def score(v, t, i, k):
        df = spark.createDataFrame([(v, t, i, k)], "v double, t double, i double, k double")
        return df.select(c.film_score(F.col("v"), F.col("t"), F.col("i"), F.col("k")).alias("s")).first()["s"]

    assert score(8.0, None, None, None) == 8.0
    assert score(8.0, 60.0, None, None) == round((8 * 0.25 + 6 * 0.3) / 0.55, 2)
    assert score(None, None, None, None) == 0.0
    assert score(0.0, 0.0, None, None) == 0.0
    assert score(None, None, 12.0, None) == 10.0
