import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from loomframe.llm import tokenize as tk

RANKS = tk.read_ranks()
REFERENCE = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def samples():
    rng = random.Random(1)
    yield from ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaa", "abababababab" * 50, "x" * 20_000, "<|endoftext|> is text", "L'été, l'homme… 映画は遅い。 한국어 Привет 👩‍🚀 ​﻿\x00", "  \n\n\t  x", "é" * 999]
    for _ in range(200):
        yield "".join(rng.choice("ab c\ndeéß'1映한Яx ") for _ in range(rng.randrange(1, 120)))


def test_ids_equal_the_reference():
    e = tk.Encoder(RANKS)
    for s in samples():
        assert e.encode(s) == REFERENCE.encode_ordinary(s)


def test_long_pretokens():
    e = tk.Encoder(RANKS)
    rng = random.Random(2)
    s = "".join(rng.choice("abcdeé") for _ in range(60_000))
    assert e.encode(s) == REFERENCE.encode_ordinary(s)


def test_queue_order():
    q = tk.RankQueue(100_000)
    rng = random.Random(3)
    items = [(rng.randrange(100_000), i) for i in range(2000)]
    for r, p in items:
        q.push(r, p)
    out = []
    while (got := q.pop()) is not None:
        out.append(got[0])
    assert out == sorted({r for r, _ in items}) and not q.buckets


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "the well", 0), (3, "the well", 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in tk.token_ids(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, REFERENCE.encode_ordinary("the well")), (3, REFERENCE.encode_ordinary("the well"))]
    assert sorted(r["n"] for r in tk.token_counts(df, "doc_id", "text").collect()) == [0, 0, 2, 2]
    assert tk.token_ids(df.where(F.lit(False)), "doc_id", "text").count() == 0


def test_cache_limit(monkeypatch):
    monkeypatch.setattr(tk, "CACHE", 3)
    e = tk.Encoder(RANKS)
    s = "one two three four five six one two three"
    assert e.encode(s) == REFERENCE.encode_ordinary(s)


@pytest.mark.parametrize("text", ["tail \x00 \ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")])
def test_odd_characters(text):
    assert tk.Encoder(RANKS).encode(text) == REFERENCE.encode_ordinary(text)
