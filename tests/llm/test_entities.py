import datetime
import random

import pytest

from loomframe.llm import entities as en
from loomframe.llm import matching as m
from loomframe.llm import survivors as sv

FILM = "id int, tmdb_id int, imdb_id string, title string, original_title string, title_fr string, alternative_titles array<string>, release_date date, runtime int, vote_count int, updated_at timestamp, extra string"
IMDB = "imdb_id string, tmdb_id int, title string, year int, runtime int, imdb_votes int, extra string"
RT = "rec_id long, tmdb_id int, rt_url string, extra string"
NOW = datetime.datetime(2024, 1, 1)


def film(i, title, year, runtime=90, fr=None, tmdb=None, orig=None):
    return (i, tmdb, None, title, orig or title, fr, None, year and datetime.date(year, 3, 1), runtime, 1, NOW, "x")


def found(spark, films, imdb, rt):
    got = en.match_films(spark.createDataFrame(films, FILM), spark.createDataFrame(imdb, IMDB), spark.createDataFrame(rt, RT))
    return {(r["key_a"], r["key_b"]) for r in got.collect()}


def test_matches(spark):
    films = [film(1, "The Well of Gadorimas", 1990), film(2, "The Well of Gadorimas", 2015), film(3, "Nobody Leaves Petuvokil II", 2001), film(4, "Return to Bosarigan", 2000, fr="Retour à Bosarigan"), film(5, None, None), film(6, "ゲキミダル", 1999, orig="Gekimidal")]
    imdb = [("tt1", None, "WELL OF GADORIMAS, THE", 1991, 91, 5, ""), ("tt2", None, "The Well of Gadormias [restored]", 2015, 90, 5, ""), ("tt3", None, "Nobody Leaves Petuvokil III", 2001, 90, 5, ""), ("tt4", None, "Retour à Bosarigan - the movie", None, 90, 5, ""), ("tt4", None, "Retour à Bosarigan", None, 90, 9, ""), ("tt6", None, "Gekimidal", 1999, None, 5, "")]
    rt = [(1, None, "https://x.test/m/the_well_of_gadorimas_2015?a=b", ""), (2, None, "/m/1234567-RETURN%20TO%20BOSARIGAN/reviews", ""), (3, None, None, ""), (4, None, "/m/nobody_leaves_petuvokil_iii", "")]
    assert found(spark, films, imdb, rt) == {
        ("film:1", "imdb:tt1"), ("film:2", "imdb:tt2"), ("film:4", "imdb:tt4"), ("film:6", "imdb:tt6"), ("film:2", "rt:1"), ("film:4", "rt:2"), ("imdb:tt2", "rt:1"), ("imdb:tt4", "rt:2"), ("imdb:tt3", "rt:4"),
    }


def test_many_scrapes_of_one_film(spark):
    """A film meets every scrape of it, with and without year, and through the film imdb does."""
    films = [film(1, "Nobody Leaves Petuvokil", 2001)]
    imdb = [("tt1", None, "Nobody Leaves Petuvokil", 2001, 90, 5, "")]
    rt = [(i, None, "/m/nobody_leaves_petuvokil" + "_2001" * (i % 2) + f"?a={i}", "") for i in range(100)] + [(100 + i, None, "/m/nobody_leaves_petuvokli", "") for i in range(30)]
    want = {("film:1", "imdb:tt1")} | {(k, f"rt:{i}") for k in ("film:1", "imdb:tt1") for i in range(130)}
    assert found(spark, films, imdb, rt) == want


def test_known_ids(spark):
    got = found(spark, [film(1, "Alpha", 1990, tmdb=7)], [("tt1", 7, None, None, None, None, "")], [(1, 7, None, "")])
    assert got == {("film:1", "imdb:tt1"), ("film:1", "rt:1"), ("imdb:tt1", "rt:1")}


def test_empty(spark):
    assert found(spark, [], [], []) == set()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_total(spark, seed):
    """Within epsilon per left of the best total, found by trying all assignments."""
    rng = random.Random(seed)
    w = {(f"l{i}", f"r{j}"): round(rng.random(), 3) for i in range(5) for j in range(5) if rng.random() < 0.6}
    got = m.assign(spark.createDataFrame([(a, b, c) for (a, b), c in w.items()], "l string, r string, conf double")).collect()
    assert len({r["l"] for r in got}) == len(got) == len({r["r"] for r in got})

    def best(ls, used):
        if not ls:
            return 0.0
        skip = best(ls[1:], used)
        return max([skip] + [w[ls[0], r] + best(ls[1:], used | {r}) for r in {b for a, b in w if a == ls[0]} - used])

    lefts = sorted({a for a, _ in w})
    assert sum(r["conf"] for r in got) >= best(lefts, frozenset()) - 0.01 * len(lefts) - 1e-9


@pytest.mark.parametrize("n", [4, 6, 50])
def test_assignment_goes_on_to_the_end(spark, n):
    """Many tied bids for few good rights take more rounds than the joint ones; no left stays free beside a free right."""
    w = [(f"l{i:02}", f"r{j:02}", 1.0 if j < n - 1 else 0.7) for i in range(n) for j in range(n)] + [("other", "single", 0.5)]
    got = m.assign(spark.createDataFrame(w, "l string, r string, conf double")).collect()
    assert len({r["l"] for r in got}) == len(got) == len({r["r"] for r in got}) == n + 1
    assert sum(r["conf"] for r in got) >= n - 1 + 0.7 + 0.5 - 0.01 * n - 1e-9


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "key long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (7, 6), (6, 5), (9, 8)], "a long, b long")
    got = {r["key"]: r["group"] for r in m.components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 10, 11: 11}


def test_hot_key_window(spark):
    """Equal keys only make a long run: pairs stay within the window, across blocks too."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.lit(1).alias("kind"), F.lit("same").alias("sort"), F.struct(F.col("id")).alias("rec"))
    n = m.neighbours(rows, 3)
    assert n.count() == 4999 + 4998 + 4997


AGG = "rec_id long, tmdb_id int, imdb_id string, title string, original_title string, title_fr string, release_date date, runtime int, original_language string, director string, budget long, revenue long, sources array<string>, updated_at timestamp, `group` int"


def agg(i, title, year, person="Orvel Branovan", tmdb=None, imdb=None, runtime=90, budget=None, sources=("tmdb",), day=1, fr=None):
    return (i, tmdb, imdb, title, title, fr, year and datetime.date(year, 3, 1), runtime, "en", person, budget, 0, list(sources), NOW + datetime.timedelta(days=day), 1)


def test_groups_and_truth(spark):
    rows = [
        agg(1, "The Lantern of Menuduno", 1960, tmdb=5, imdb="tt01029498", runtime=0, budget=9_000_000, sources=("rt",)),
        agg(2, "the lantern of menudnuo", 1960, "ORVEL BRANOVAN", imdb="/title/tt01029498/", runtime=115, budget=8_726_716, sources=("tmdb",)),
        agg(3, "Lantern of Menuduno, The", None, None, tmdb=5, imdb="N/A", runtime=115, budget=8_726_716, sources=("kaggle", "spark")),
        agg(4, "The Lantern of Menuduno II", 1963, tmdb=6, imdb="tt0000000"),
        agg(5, "The Lantern of Menuduno", 1999, "Liskel Zoludra", tmdb=9, imdb="tt0000000"),
        agg(6, None, None, None),
    ]
    df = spark.createDataFrame(rows, AGG)
    groups = {r["rec_id"]: r["group"] for r in sv.duplicate_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert sorted(tuple(r) for r in sv.pairs_of_groups(sv.duplicate_groups(df)).collect()) == [(1, 2), (1, 3), (2, 3)]
    best = {r["rec_id"]: r for r in sv.survivors(df).collect()}
    assert len(best) == 4 and best[1]["records"] == 3
    assert (best[1]["imdb_id"], best[1]["runtime"], best[1]["budget"], best[1]["release_date"]) == ("tt01029498", 115, 8_726_716, datetime.date(1960, 3, 1))
    assert best[4]["imdb_id"] is None and best[6]["title"] is None


def test_many_films_of_one_title(spark):
    """Records of one film meet however many of its name lie between; copies join, records that say nothing do not."""
    who = ["Abel", "Bruno", "Carla", "Doris", "Emil", "Frida", "Gustav", "Hanna", "Ivo", "Jonas", "Karla", "Lotte", "Mira", "Nils", "Olga", "Paul", "Rosa", "Sven", "Tilda", "Uwe"]
    rows = [agg(i, "Love", 1950 + 2 * i, None) for i in range(20)] + [agg(100 + i, "Love", 1950 + 2 * i, f"{w} Zoludra") for i, w in enumerate(who)]
    rows += [agg(200 + i, "Love", 1950, None) for i in range(30)] + [agg(300 + i, "Love", None, None, runtime=0) for i in range(2)]
    groups = {r["rec_id"]: r["group"] for r in sv.duplicate_groups(spark.createDataFrame(rows, AGG)).collect()}
    want = {i: i for i in range(20)} | {100 + i: i for i in range(20)} | {200 + i: 0 for i in range(30)} | {300: 300, 301: 301}
    assert groups == want


def test_reliability_decides(spark):
    """Of two sources against each other the one that others bear out elsewhere wins."""
    rows = [(g, "runtime", v, v, s, NOW) for g in range(30) for s, v in (("good", "90"), ("also", "90"), ("bad", "80"))] + [(99, "runtime", "100", "100", "good", NOW), (99, "runtime", "70", "70", "bad", NOW)]
    got = {r["group"]: r["shown"] for r in sv.truth(spark.createDataFrame(rows, "group long, field string, value string, shown string, source string, at timestamp")).collect()}
    assert got[99] == "100" and set(got[g] for g in range(30)) == {"90"}


def test_no_records(spark):
    df = spark.createDataFrame([], AGG)
    assert sv.duplicate_groups(df).count() == 0 and sv.survivors(df).count() == 0


def test_truth_parts_a_chain(spark):
    """A record without year and director joins a remake to the film; the truth of year and director parts the remake again."""
    film = [agg(i, "Alpha Rising", 1990, tmdb=1) for i in (1, 2, 3)] + [agg(4, "Alpha Rising", None, None, tmdb=1, runtime=120, budget=7_000_000)]
    remake = [agg(i, "Alpha Rising", 1999, "Liskel Zoludra", tmdb=2, runtime=120, budget=7_000_000) for i in (5, 6)]
    df = spark.createDataFrame(film + remake, AGG)
    assert {r["group"] for r in sv.duplicate_groups(df).collect()} == {1}
    assert {r["rec_id"]: r["group"] for r in sv.merged_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    best = {r["rec_id"]: (r["records"], r["director"]) for r in sv.survivors(df).collect()}
    assert best == {1: (4, "Orvel Branovan"), 5: (2, "Liskel Zoludra")}
