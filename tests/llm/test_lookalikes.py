from loomframe.llm import lookalikes as lk

SCHEMA = "doc_id long, text string, form string"


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    return {int(r["key"]): r for r in lk.consistent_forms(df, "doc_id", "text").collect()}


def ch(*points):
    return "".join(chr(p) for p in points)


ZW, NB, SHY, GRAVE = ch(0x200B), ch(0xA0), ch(0xAD), ch(0x300)
PLAIN = "the old choir sings a song at night"


def wide(s):
    return "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in s)


def test_same_reading(spark):
    disguised = [
        PLAIN.replace("o", ch(0x43E)), PLAIN.replace(" ", NB), PLAIN.replace("choir", "cho" + ZW + "ir"), wide(PLAIN), PLAIN.replace("g", ch(0x261)), PLAIN.replace("song", "s" + ch(0x3BF) + "ng"), PLAIN.replace("a ", ch(0x430) + " "), PLAIN + ch(0xFE0F),
    ]
    got = forms(spark, [PLAIN, *disguised])
    assert len({got[i]["reading"] for i in range(len(disguised) + 1)}) == 1
    assert {got[i]["form"] for i in range(len(disguised) + 1)} == {PLAIN}


def test_differences_that_count(spark):
    texts = [PLAIN, PLAIN.upper(), PLAIN.replace("e", "é"), PLAIN + ".", PLAIN + " now", PLAIN.replace(" ", "\n")]
    assert len({r["reading"] for r in forms(spark, texts).values()}) == len(texts)


def test_accents_and_kana(spark):
    e = "La Marée à Évora"
    decomposed = "La Mare" + ch(0x301) + "e a" + GRAVE + " E" + ch(0x301) + "vora"
    kana, half = ch(0x30C7, 0x30FC, 0x30BF), ch(0xFF83, 0xFF9E, 0xFF70, 0xFF80)
    got = forms(spark, [e, decomposed, kana, half])
    assert got[0]["form"] == got[1]["form"] == e and got[2]["form"] == got[3]["form"] == kana


def test_alphabet_of_the_text_wins(spark):
    russian = ch(0x43E, 0x43D, 0x430) + " " + ch(0x43F, 0x43E, 0x451, 0x442) + " " + ch(0x43D, 0x43E, 0x447, 0x44C, 0x44E)
    mixed = russian.replace(ch(0x43E), "o").replace(ch(0x430), "a")
    got = forms(spark, [russian, russian, mixed, PLAIN])
    assert got[2]["form"] == russian and got[0]["form"] == russian and got[2]["reading"] == got[0]["reading"]


def test_cases(spark):
    got = forms(spark, [None, "", "  ", ZW + NB, "x"])
    assert [got[i]["form"] for i in range(3)] == [None, "", "  "]
    assert [got[i]["reading"] is None for i in range(5)] == [True, True, True, True, False]
    assert lk.consistent_forms(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_pairs(spark):
    texts = [PLAIN, PLAIN, PLAIN.replace(" ", NB), "x" + ZW, "x", ZW, NB]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r["a"], r["b"]) for r in lk.same_reading(lk.consistent_forms(df, "doc_id", "text")).collect())
    assert got == [(0, 2), (1, 2), (3, 4)]


def test_trie_budget():
    t = lk.Trie()
    for w, n in (("choir", 5), ("chair", 9), ("choirs", 2)):
        t.add(w, n)
    assert t.find("ch" + ch(0x43E) + "ir") == [(0, -5, "choir")]
    assert t.find("choer") == []
    assert (1, -5, "choir") in t.find("choer", 1) and (1, -2, "choirs") in t.find("choir", 1)


def test_very_long_text(spark):
    long = (PLAIN + " ") * 4000
    got = forms(spark, [long, long.replace("o", ch(0x43E))])
    assert got[0]["reading"] == got[1]["reading"] and got[1]["form"] == long


def test_only_a_trie_tells(spark):
    """A stroke that may be an I or an l, and a letter near another shape: the vocabulary decides, the table cannot."""
    stroke, kappa, pe = ch(0x4C0), ch(0x3BA), ch(0x43F)
    texts = ["the whole world walks alone", "the whole wor" + stroke + "d walks alone", "the whole world wal" + kappa + "s alone", "the whole world walks alo" + pe + "e", "Island", stroke + "sland"]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    pairs = lambda: sorted((r["a"], r["b"]) for r in lk.same_reading(lk.consistent_forms(df, "doc_id", "text")).collect())
    assert pairs() == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5)]
    t = lk.Trie()
    t.add("world", 1)
    assert lk.spellings(t, "wor" + stroke + "d") == {"latin": "world", "": "world"} and lk.shape(lk.fold("wor" + stroke + "d")) != "world"


def test_clean_words_keep_their_letters(spark):
    """A clean word is never taken for one of near letters, only for one of equal shapes."""
    russian, greek = ch(0x442, 0x43E), ch(0x3C4, 0x3BF)
    got = forms(spark, ["to be", russian + " be", greek + " be", ch(0x441) + " be", "c be"])
    assert len({got[i]["reading"] for i in range(3)}) == 3 and got[3]["reading"] == got[4]["reading"]


def test_copies_of_one_text_pair_only_with_others(spark):
    rows = [(i, PLAIN, "") for i in range(300)] + [(300, PLAIN.replace("o", ch(0x43E)), "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lk.same_reading(lk.consistent_forms(df, "doc_id", "text")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(i, 300) for i in range(300)]
