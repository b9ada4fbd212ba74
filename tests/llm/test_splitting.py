import random
import unicodedata

import pytest

from loomframe.llm import splitting as sp

SCHEMA = "id string, content string, chunk_index string"


def check(text, pieces, limit=1200, overlap=120):
    pieces = sorted(pieces, key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in pieces] == list(range(len(pieces)))
    assert {r["chunk_total"] for r in pieces} == {len(pieces)}
    end = 0
    for i, r in enumerate(pieces):
        assert r["piece"] == text[r["start"] : r["end"]] and 0 < len(r["piece"]) <= limit
        assert r["start"] == 0 if i == 0 else overlap // 3 <= end - r["start"] <= 2 * overlap
        assert r["end"] > end
        end = r["end"]
    assert end == len(text)


def texts():
    rng = random.Random(3)
    words = ["night", "é", "l'homme", "映画は遅い。", "waits", "\n", "\n\n", "\r\n", "well. ", "Yes! ", "a" * 40]
    yield "x" * 5000
    yield "word " * 900
    yield "é" * 3000
    yield "👩‍🚀" * 900
    yield " " * 4000
    for _ in range(12):
        yield " ".join(rng.choice(words) for _ in range(rng.randrange(300, 3000)))


@pytest.mark.parametrize("size", [1 << 16, 2500, 1500])
def test_round_trip(spark, size):
    all_ = [t for t in texts() if len(t) > 1200]
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(all_)], SCHEMA)
    rows = sp.split_texts(df, "id", "content", range_chars=size).collect()
    for i, t in enumerate(all_):
        check(t, [r for r in rows if r["id"] == str(i)])


def test_cases(spark):
    assert sp.split_texts(spark.createDataFrame([], SCHEMA), "id", "content").count() == 0
    df = spark.createDataFrame([("a", None, ""), ("b", "", ""), ("c", "x" * 1200, ""), ("d", "x" * 1201, ""), ("d", "x" * 1201, "")], SCHEMA)
    assert [r["id"] for r in sp.split_texts(df, "id", "content").where("chunk_index = 0").collect()] == ["d", "d"]


def test_natural_cuts():
    text = ("A sentence of some length that ends here. " * 20 + "\n\n") * 6
    spans = sp.cut_region(text, 0, len(text), 1200, 120, True)
    assert all(text[e - 1].isspace() for _, e in spans)
    assert all(text[s - 1].isspace() for s, _ in spans[1:])


def test_no_parted_characters():
    text = "é" * 3000
    for s, e in sp.cut_region(text, 0, len(text), 1200, 120, True):
        assert not unicodedata.combining(text[s]) and (e == len(text) or not unicodedata.combining(text[e]))


def test_giant_file_by_ranges(spark, tmp_path):
    text = "".join(texts()) * 3
    p = tmp_path / "big.txt"
    p.write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = sp.split_files(spark, [str(p), str(tmp_path / "empty.txt")], range_bytes=16_000).collect()
    check(text, rows)
