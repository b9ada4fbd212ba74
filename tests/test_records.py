import datetime
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomframe import session
from loomframe.functions import records as rec
from loomframe.operators import aggregates as g
from loomframe.operators import intent as it
from loomframe.operators import pipeline
from loomframe.operators import retrieval as r
from loomframe.sources import paged


def test_entities(spark, tmp_path):
    for kind, name in (("details", "1"), ("details", "2"), ("genres", "all")):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{name}.json").write_text(json.dumps({"id": name}), encoding="utf-8")
    spark.dataSource.register(paged.Entities)
    read = lambda **o: {x["id"]: x["body"] for x in spark.read.format("film_entities").options(path=str(tmp_path), **o).load().collect()}
    assert read(resource="details", ids="1,2,3", block="2") == {"1": '{"id": "1"}', "2": '{"id": "2"}', "3": None}
    assert read(resource="genres") == {"": '{"id": "all"}'}


def test_film_record_in_french(spark):
    rows = [(1, " Alpha ", "2001-02-03", None, 0, [("fr", "CH", ("x", "y")), ("fr", "CA", (" Alphe ", " texte "))], [("US", "no"), ("BE", " Aleph "), ("LU", "Aleph")]), (None, "lost", None, None, None, None, None)]
    schema = "id int, title string, release_date string, status string, runtime int, translations array<struct<iso_639_1: string, iso_3166_1: string, data: struct<title: string, overview: string>>>, alternative_titles array<struct<iso_3166_1: string, title: string>>"
    got = rec.film_records(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1
    x = got[0]
    assert (x["title"], x["title_fr"], x["overview_fr"], x["alternative_titles"]) == ("Alpha", "Alphe", "texte", ["Aleph"])
    assert (x["release_date"], x["runtime"], x["status"], x["budget"], x["adult"]) == (datetime.date(2001, 2, 3), None, "Unknown", 0, False)


def test_gates_count(spark):
    seen = Observation("gate")
    rows = [(1, "A", "1999", "7", None), (0, "B", None, None, ""), (2, " ", None, None, "x"), (3, "C", "junk", "-1", "")]
    raw = spark.createDataFrame(rows, "id int, title string, release_date string, vote_count string, status string").withColumns({c: F.lit(None).cast("string") for c in ("original_language", "overview", "popularity", "budget", "runtime")})
    got = {x["tmdb_id"]: x for x in rec.csv_records(raw, seen).collect()}
    assert set(got) == {1, 3} and seen.get == {"normalized": 2, "skipped": 2}
    assert (got[1]["release_date"], got[1]["vote_count"], got[1]["status"]) == (datetime.date(1999, 1, 1), 7, "Released")
    assert (got[3]["release_date"], got[3]["vote_count"]) == (None, 0)


def test_templates_and_phrases(spark):
    df = spark.createDataFrame([("conversational", "ok, bye!"), ("conversational", "hello"), ("needs_database", "x"), ("thanks", None)], "intent string, text string")
    said = [x[0] for x in df.select(it.template(F.col("intent"), F.col("text"), {"conversational": "hi", "farewell": "ciao", "thanks": "sure"})).collect()]
    assert said == ["ciao", "hi", None, "sure"]
    texts = spark.createDataFrame([("Thank   YOU so much",), ("this",), ("good morning",), ("bonjour, un film de zombie",)], "t string")
    assert [x[0] for x in texts.select(it.rule_intent(F.col("t"))).collect()] == ["thanks", None, "conversational", None]


def test_merging_merged_stats(spark):
    rows = spark.createDataFrame([(k, i % 3, i % 2) for i, k in enumerate(["inserted", "errors", "skipped", "updated", "inserted", "errors"])], "o string, a int, b int")
    once = g.merge_stats(g.partial_stats(rows, "o", ["a"])).first()
    twice = g.merge_stats(g.merge_stats(g.partial_stats(rows, "o", ["a", "b"]), ["a"]).select("a", *g.LOADED)).first()
    assert once == twice and (once["total"], once["success_rate"]) == (6, 66.67)
    empty = g.merge_stats(g.partial_stats(rows.limit(0), "o", ["a"])).first()
    assert (empty["total"], empty["success_rate"]) == (0, 100.0)


def test_refusal(spark):
    q = spark.createDataFrame([("a",), ("b",)], "q string")
    hits = spark.createDataFrame([("a", 7, 2, -4.0), ("a", 8, 1, None), ("b", 9, 1, -6.0)], "q string, doc int, rank int, rerank double")
    got = {x["q"]: (x["documents"], x["refusal"]) for x in r.answers(q, hits, "q", "doc", "sorry").collect()}
    assert got == {"a": ([8, 7], None), "b": ([], "sorry")}


def test_failing_stage(spark):
    out = pipeline.staged_run(spark.range(5), F.col("id") > 1, {"n": lambda d: d}, lambda d: d.select("missing"), None)
    assert (out["total_rows"], out["filtered"], out["normalized"], out["errors"], out["analytics"]) == (5, 3, 0, 1, {"n": 3})


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="share"):
        session.shared_folder(Session())
