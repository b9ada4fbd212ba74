import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import language as lg

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return lg.train(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "films", "rag_queries")])


def langs(model, *texts):
    return [g[1] for g in lg.label(model, list(texts))]


def test_labels(spark):
    raw = ["en", " FR ", "fr-FR", "eng", "English", "日本語", "und", "mixed", "xx", "", None, "zz", "pt-BR"]
    want = ["en", "fr", "fr", "en", "en", "ja", None, None, None, None, None, None, "pt"]
    assert [lg.label_code(x) for x in raw] == want
    df = spark.createDataFrame([(x,) for x in raw], "l string")
    assert [r[0] for r in df.select(lg.label_column(F.col("l"))).collect()] == want


def test_one_language(model):
    got = langs(model, "what is the film where the dog leaves no footprints?", "quel est le film où le chien ne laisse pas de traces ?", "¿cuál es la película en la que nadie del pueblo admite conocerla?", "wie heißt der Film, in dem man sagt: die Glocken läuten von selbst?", "QUELS FILMS PARLENT DE MAISON HANTEE ?")
    assert got == [["en"], ["fr"], ["es"], ["de"], ["fr"]]


def test_no_language(model):
    assert langs(model, None, "", "  ", "1969", "???", "Vabukomel 2011 ?", "👻👻") == [[]] * 7


def test_mixed(model):
    text = "quel est le film où le maire marche vers la mer ? / what is the film where the oldest of the patients burns without smoke?"
    segs, both = lg.label(model, [text])[0]
    assert both == ["en", "fr"] and [s[2] for s in segs] == ["fr", "en"]
    assert all(0 <= s[0] < s[1] <= len(text) and 0 < s[3] <= 1 for s in segs)
    assert abs(segs[1][0] - text.index("what")) <= 2


def test_borrowed_and_quoted(model):
    assert langs(model, "je cherche quelque chose avec du found footage", "le film « The Silence of the Lantern » est trop long mais superbement filmé") == [["fr"], ["fr"]]


def test_held_out_accuracy(spark, model):
    """Documents that the sample did not take, under their own labels."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isNotNull() & (F.length("text") > 40))
    rows = d.select("text", "lang").distinct().collect()
    got = lg.label(model, [r["text"] for r in rows])
    right = sum(r["lang"] in g[1] for r, g in zip(rows, got, strict=True))
    assert right >= 0.97 * len(rows)


def test_code_lengths_are_probabilities(model):
    """Over all next bytes of any context the probabilities sum to one at most (escapes exclude nothing)."""
    for ctx in (b" th", b"des", b"zzz"):
        g = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint32)
        p = np.exp2(-model._known(g, 4)).sum(axis=0)
        assert (p > 0.2).all() and (p < 1.6).all()


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32))
    look = lg.Lookup(keys)
    assert (look.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32), keys)
    assert (look.find(other) == -1).all()
    assert (lg.Lookup(np.zeros(0, np.uint32)).find(other) == -1).all()


def test_repeated_and_empty_tables(spark, model):
    t = spark.createDataFrame([("the well",), ("the well",), (None,)], "text string")
    assert lg.label_texts(t, model).count() == 3
    assert lg.label_texts(t.limit(0), model).count() == 0


def test_untrained_model_gives_nothing():
    m = lg.Model({})
    assert [g[1] for g in lg.label(m, ["the well", None])] == [[], []]


def test_script_of_training_texts():
    assert lg.in_script("Привет The", "ru") and not lg.in_script("The Tide of Rinutumi", "ru")
    assert lg.in_script("映画 The", "ja") is False and lg.in_script("メヴェの映画", "ja")
    assert not lg.in_script("Зеркало", "en") and not lg.in_script("123", "en")


def test_short_rests_join_their_neighbour(model):
    text = "donne-moi cinq films de 1950 sur une maison hantée, give me five films from 2012 about zombies on an island"
    assert [s[2] for s in lg.label(model, [text])[0][0]] == ["fr", "en"]
