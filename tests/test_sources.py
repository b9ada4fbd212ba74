import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomframe.functions.documents import film_documents, short_film
from loomframe.operators.pipeline import aggregate_films, bundle, run_steps, validated
from loomframe.sources import pages, paged, readers, writers


def test_csv(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('id,title,vote_average\n1,"A ""quoted""\nline",7.5\n2,NA,bad\n0,x,1\n,None,2\n')
    got = readers.lenient_csv(spark, str(p), {"id": "int", "vote_average": "double"})
    assert [tuple(r) for r in got.collect()] == [(1, 'A "quoted"\nline', 7.5), (2, None, None), (0, "x", 1.0), (None, None, 2.0)]
    seen = Observation()
    assert readers.valid_rows(got, seen).count() == 1
    assert seen.get == {"kept": 1, "skipped": 3}


def test_json_and_xml(spark, tmp_path):
    e = tmp_path / "e.json"
    e.write_text(json.dumps({"generated_at": "x", "films": [{"tmdb_id": 1, "title": "A"}, {"tmdb_id": 2, "title": "B", "more": 1}]}))
    assert readers.envelope(spark, str(e), "tmdb_id:int,title:string").count() == 2
    q = tmp_path / "q.jsonl"
    q.write_text('{"q": "a"}\n\n{"q": "b"}\n')
    assert readers.json_lines(spark, str(q), "q string").where("q is not null").count() == 2
    x = tmp_path / "j.xml"
    x.write_text('<testsuites><testsuite name="s"><testcase classname="c" name="a" time="0.5"/><testcase classname="c" name="b" time="1"><failure message="m">t</failure></testcase><testcase classname="c" name="d"><skipped/></testcase></testsuite></testsuites>')
    assert {r["name"]: r["status"] for r in readers.junit(spark, str(x)).collect()}.get("b") == "failed"


def test_sample_is_repeatable(spark):
    df = spark.range(100)
    a = {r[0] for r in readers.sample_rows(df, 10, "id").collect()}
    assert a == {r[0] for r in readers.sample_rows(df.repartition(7), 10, "id").collect()} and len(a) == 10


PAGE = """<html><script id="media-scorecard-json" type="application/json">{"criticsScore": {"score": "87", "certified": true, "reviewCount": 12, "averageRating": "7.4", "sentiment": "POSITIVE"}, "audienceScore": {"score": "60"}, "description": ""}</script>
<div class="x critics-consensus"><p>An uneasy blend &amp; a <b>long</b> night.</p><br></div><span data-qa="info-rating"> R </span></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("/m/a", PAGE), ("/m/b", "404 - Not Found media-scorecard-json"), ("/m/c", None)], "url string, html string")
    got = pages.film_fields(df, "html", "url").collect()
    assert len(got) == 1
    r = got[0]
    assert (r["tomatometer_score"], r["tomatometer_state"], r["certified_fresh"], r["audience_score"], r["rt_rating"]) == (87, "positive", True, 60, "R")
    assert r["critics_consensus"].startswith("An uneasy blend")
    s = '<search-page-media-row data-qa="data-row" releaseyear="1999"><a href="/m/z" data-qa="info-name"> Z <i>film</i></a></search-page-media-row><search-page-media-row data-qa="data-row"><a href="/tv/y">Y</a></search-page-media-row>'
    out = pages.search_results(spark.createDataFrame([(1, s)], "k int, html string"), "html", "k").collect()
    assert [(r["url"], r["title"], r["year"]) for r in out] == [("/m/z", "Z film", 1999)]


def test_paged_source(spark, tmp_path):
    for y in (2000, 2001):
        (tmp_path / str(y)).mkdir()
        for p in (1, 2):
            (tmp_path / str(y) / f"{p}.json").write_text(json.dumps({"page": p, "total_pages": 2, "results": [{"id": y * 10 + p}]}))
    spark.dataSource.register(paged.PagedFilms)
    df = spark.read.format("paged_films").option("year_min", 2000).option("year_max", 2002).load(str(tmp_path))
    assert sorted(json.loads(r["film"])["id"] for r in df.collect()) == [20001, 20002, 20011, 20012]


def test_throttle_and_retry():
    now, naps = [0.0], []

    def sleep(s):
        naps.append(s)
        now[0] += s

    t = paged.Throttle(2, 10.0, 0.5, lambda: now[0], sleep)
    for _ in range(3):
        t.wait()
    assert naps[0] == 0.5 and sum(naps) >= 10.0
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return {"ok": 1}

    assert paged.retry(flaky, sleep=lambda s: None) == {"ok": 1}
    with pytest.raises(TimeoutError):
        paged.retry(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=lambda s: None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, 50), (2, 7.0, None)], "id int, aggregated_score double, tomatometer_score int")
    assert writers.write_parquet(df, str(tmp_path / "p")) == 2
    head = writers.write_envelope(df, str(tmp_path / "e"))
    assert (head["total_films"], head["avg_score"], head["rt_coverage"]) == (2, 6.0, 50.0)
    assert spark.read.json(str(tmp_path / "e/films")).count() == 2
    got = []
    assert writers.deliver(df, got.append, 1) == 2 and len(got) == 2
    p = writers.Progress(spark, str(tmp_path / "s"))
    p.save("a/b", {"last": 3})
    assert p.load("a/b") == {"last": 3} and p.delete("a/b") and p.load("a/b") is None and not p.delete("a/b")


FILM = "tmdb_id int, title string, title_fr string, release_date string, overview string, overview_fr string, tagline string, genres array<string>, keywords array<string>, alternative_titles array<string>, director string, cast array<string>, runtime int, vote_average double, critics_consensus string"


def test_documents(spark):
    rows = [
        (1, "A", "B", "1999-01-02", " plot ", "intrigue", "tag", ["X", "Y"], ["k"], ["alt"], "D", ["c1", "c2"], 90, 5.0, "good film"),
        (2, "A", None, None, " ", None, None, None, None, None, None, None, None, None, None),
        (3, "short", None, None, "plot", None, None, None, None, None, None, None, 39, None, None),
        (4, "edge", None, None, "plot", "plot", None, None, None, None, "", None, 40, None, None),
    ]
    got = {(r["source_id"], r["source_type"]): r for r in film_documents(spark.createDataFrame(rows, FILM)).collect()}
    assert set(got) == {(1, "film_overview"), (1, "critics_consensus"), (2, "film_metadata"), (4, "film_overview")}
    assert got[1, "film_overview"]["content"] == "A / B (1999) - Genres: X, Y\nAlternative titles: alt\nKeywords: k\nDirector: D\nCast: c1, c2\nplot\nintrigue\nTagline: tag"
    assert got[1, "critics_consensus"]["content"].endswith("Cast: c1, c2\nCritique: good film")
    assert got[4, "film_overview"]["content"] == "edge () - Genres: \nplot"
    assert got[1, "film_overview"]["embed_text"] == "A / B (1999) - Genres: X, Y\nplot\nintrigue\nKeywords: k"
    assert spark.range(1).select(short_film(F.lit(0))).first()[0] is False


def test_pipeline(spark):
    audit = run_steps(spark, [("a", lambda: spark.range(3)), ("s", lambda: 1 / 0), ("b", lambda: 1 / 0), ("c", lambda: spark.range(1))], "r1", {"s"})
    assert [(r["step"], r["status"], r["rows"]) for r in audit.collect()] == [("a", "success", 3), ("s", "skipped", None), ("b", "failed", None)]
    base = spark.createDataFrame([(0, 1, "tt1", "Alpha", "2000-01-01", 8.0, ""), (1, 1, "tt9", "Other", "2001-01-01", 6.0, ""), (2, 2, None, "Alphaa", "2000-05-05", 6.0, "o")], "pos long, tmdb_id int, imdb_id string, title string, release_date string, vote_average double, overview string").withColumn("release_date", F.to_date("release_date"))
    s = "tmdb_id int, imdb_id string, pos int, "
    out = aggregate_films(base, spark.createDataFrame([(1, None, 1, 60)], s + "tomatometer_score int"), spark.createDataFrame([], s + "imdb_rating double"), spark.createDataFrame([], s + "overview string, kaggle_rating double"), spark.createDataFrame([], s + "spark_rating double"))
    assert [(r["pos"], r["aggregated_score"]) for r in out.orderBy("pos").collect()] == [(0, round((8 * 0.25 + 6 * 0.3) / 0.55, 2))]
    ok, bad = validated(base, {"title": F.length("title") == 5})
    assert ok.count() == 2 and bad.first()["errors"] == ["title"]
    raw = spark.createDataFrame([(1, [("g1", 1), ("g2", 2)]), (2, [("g1", 1)])], "film int, genres array<struct<name:string,id:int>>")
    parts = bundle(raw, "film", {"genre": "genres"})
    assert parts["genre"].count() == 3 and parts["ref_genre"].count() == 2 and parts["films"].columns == ["film"]
