"""Splitting oversized texts at natural boundaries, by ranges with halos.

A text (or file) is seen as ranges of fixed length. The border between two ranges is the best
natural boundary in a window just before the nominal one; both neighbours find the same border from
their own range and halo, so ranges are cut into pieces independently and no worker needs more than
one range. Piece numbers and offsets come from prefix sums over one small row per range.

Defined cases: null texts and texts within the limit give no pieces; a text without any boundary
is cut at the limit, never inside a combining sequence; repeated ids with equal texts give their
pieces once per row; an empty table gives no rows. Offsets and lengths count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.session import cut, shuffle_width

# Boundaries, strongest first: blank line, line end, sentence end, clause end, white space.
BOUNDARIES = [
    regex.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"),
    regex.compile(r"\r?\n[ \t]*"),
    regex.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+[」』”）]*\s*"),
    regex.compile(r"[;:,][\"'»”’)\]]*\s+|[、；，]\s*|\s[—–]\s"),
    regex.compile(r"\s+"),
]
START = regex.compile(r"(?:[.!?…]+[\"'»”’)\]]*\s+|[。！？]+|\n+|\s+)(?=\S)")


def _joined(text: str, i: int) -> bool:
    """Whether a cut at i would part a character from what modifies it."""
    if not 0 < i < len(text):
        return False
    c, p = text[i], text[i - 1]
    return bool(unicodedata.combining(c)) or c in "‍︎️゙゚ﾞﾟ" or p == "‍" or (p == "\r" and c == "\n") or 0x1F3FB <= ord(c) <= 0x1F3FF


def best_cut(text: str, lo: int, hi: int) -> int:
    """Where to cut in (lo, hi]: after the last of the strongest boundaries that end there, else at hi."""
    for kind, pat in enumerate(BOUNDARIES):
        end = 0
        for m in pat.finditer(text, lo, min(len(text), hi + 64)):
            if lo < m.end() <= hi:
                end = m.end()
            elif m.start() <= hi < m.end() and m.start() > lo:  # the white space may go on beyond the limit
                end = m.start() if kind in (0, 1, 4) else end
            elif m.start() > hi:
                break
        if end:
            return end
    i = hi
    while i > lo + 1 and _joined(text, i):
        i -= 1
    return i if i > lo + 1 else hi


def overlap_start(text: str, end: int, overlap: int, least: int) -> int:
    """Where the piece after a cut at `end` begins: near `overlap` characters before it, at a word if one begins there."""
    lo, hi = max(least, end - overlap - overlap // 3), max(least, end - overlap // 2)
    at = [m.end() for m in START.finditer(text, lo, min(len(text), hi + 1)) if lo <= m.end() <= hi]
    want = max(least, end - overlap)
    i = min(at, key=lambda x: (abs(x - want), x)) if at else want
    while i > least and _joined(text, i):
        i -= 1
    return i


def cut_region(text: str, begin: int, end: int, limit: int, overlap: int, first: bool) -> list[tuple[int, int]]:
    """Spans (start, end) in text that cover [begin, end), each of at most `limit` characters.

    Every span but the text's very first starts about `overlap` characters before the end of the
    one before it; so does the first of a later range, whose start lies in the left halo.
    """
    spans = []
    start, at = (begin if first else overlap_start(text, begin, overlap, 0)), begin
    while at < end:
        if end - start <= limit:
            stop = end
        else:  # near the end the rest is left long enough to be a piece
            short = end - start < limit + limit // 2
            hi = min(start + limit, end - limit // 3) if short else start + limit
            stop = best_cut(text, max(at, start + limit // (3 if short else 2)), hi)
        spans.append((start, stop))
        at = stop
        start = overlap_start(text, at, overlap, start + 1)
    return spans


def border(text: str, nominal: int, window: int) -> int:
    """The border of two ranges: the best boundary in the window before the nominal one.

    What follows the nominal border is not looked at, since the range before does not hold it.
    """
    i = best_cut(text[:nominal], max(0, nominal - window), nominal)
    if i == nominal and not text[i - 1].isspace():  # the next character may belong to the last one
        i -= 1
        while i > 0 and _joined(text, i):
            i -= 1
    return i


PIECES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("range_no", T.LongType()), T.StructField("ranges", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("count", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("piece", T.StringType()),
])


def _spans_of_range(part: str, base: int, at: int, upto: int, last: bool, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Spans of one range; part starts at offset `base`, the range is [at, upto), halo before it."""
    window = limit // 2
    begin = 0 if at == 0 else border(part, at - base, window)
    end = len(part) if last else border(part, upto - base, window)
    return [(base + s, base + e, part[s:e]) for s, e in cut_region(part, begin, end, limit, overlap, at == 0)]


def _ranges(size: int, halo: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = -(-len(text) // size)
                bases = [max(0, r * size - halo) for r in range(n)]
                parts = [text[base : (r + 1) * size] for r, base in enumerate(bases)]
                yield pa.record_batch([pa.array([i] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), pa.array(bases, pa.int64()), pa.array(parts, pa.string())], ["id", "r", "n", "base", "part"])

    return run


def _split(limit: int, overlap: int, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, r, n, base, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = _spans_of_range(part, base, r * size, (r + 1) * size, r == n - 1, limit, overlap)
                for q, (s, e, x) in enumerate(spans):
                    for o, v in zip(out, (i, r, n, q, len(spans), s, e, x), strict=True):
                        o.append(v)
            yield pa.record_batch([pa.array(o, pa.string() if k in (0, 7) else pa.int64()) for k, o in enumerate(out)], PIECES.names)

    return run


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds chunk_index and chunk_total to the pieces of texts of several ranges, by a prefix sum over ranges."""
    counts = pieces.where(F.col("seq") == 0).select("id", "range_no", "count")
    w = Window.partitionBy("id").orderBy("range_no")
    sums = counts.select("id", "range_no", (F.sum("count").over(w) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("id")).alias("chunk_total"))
    return pieces.join(sums, ["id", "range_no"]).select("id", (F.col("before") + F.col("seq")).alias("chunk_index"), "chunk_total", "start", "end", "piece")


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = 1200, overlap: int = 120, range_chars: int = 1 << 16) -> DataFrame:
    """(id, chunk_index, chunk_total, start, end, piece) of every text of more than `limit` code points.

    A text of up to `range_chars` is one range, numbered where it is. Longer ones become one row
    per range (with a halo of limit + overlap before it), in one pass over the text; only their pieces
    meet by (id, range). Range borders are cuts, so another `range_chars` may cut a longer text elsewhere.
    """
    halo = limit + overlap
    t = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > limit)
    run = _split(limit, overlap, range_chars)
    one = t.where(F.length("text") <= range_chars).select("id", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("base"), "text")
    one = one.mapInArrow(run, PIECES).select("id", F.col("seq").alias("chunk_index"), F.col("count").alias("chunk_total"), "start", "end", "piece")
    big = t.where(F.length("text") > range_chars).withColumn("row", F.monotonically_increasing_id()).select(F.concat_ws("\u0000", "id", F.col("row").cast("string")).alias("id"), "text")
    big = big.mapInArrow(_ranges(range_chars, halo), "id string, r long, n long, base long, part string")
    parts = cut(big.repartition("id", "r").mapInArrow(run, PIECES))
    many = _numbered(parts).withColumn("id", F.split_part("id", F.lit("\u0000"), F.lit(1)))
    return one.unionByName(many)


def _aligned(raw: bytes, i: int) -> int:
    """The first character start at or after i."""
    while i < len(raw) and raw[i] & 0xC0 == 0x80:
        i += 1
    return i


def _open(path: str):  # noqa: ANN202
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, local = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, local


SPANS = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("range_no", "chars", "seq", "count", "start", "end", "byte_start", "byte_end")]])


def _file_spans(limit: int, overlap: int, size: int):
    """The boundary table of each byte range: spans in characters from the range's begin and in bytes of the file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = 4 * (limit + overlap)
        for b in batches:
            out: list[list] = [[] for _ in SPANS.names]
            for path, r, n, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, local = _open(path)
                base, upto = max(0, r * size - halo), min(total, (r + 1) * size + 4)
                with system.open_input_file(local) as f:
                    raw = f.read_at(upto - base, base)
                lead = _aligned(raw, 0) if base else 0
                at, to = _aligned(raw, r * size - base), _aligned(raw, min(total, (r + 1) * size) - base)
                part = raw[lead:to].decode("utf-8", "surrogateescape")
                here = len(raw[lead:at].decode("utf-8", "surrogateescape"))
                window = limit // 2
                begin = 0 if r == 0 else border(part, here, window)
                end = len(part) if r == n - 1 else border(part, len(part), window)
                spans = cut_region(part, begin, end, limit, overlap, r == 0)
                points = sorted({x for span in spans for x in span})
                byte, last, where = base + lead, 0, {}
                for x in points:  # one pass from cut to cut
                    byte += len(part[last:x].encode("utf-8", "surrogateescape"))
                    last, where[x] = x, byte
                for q, (s, e) in enumerate(spans):
                    for o, v in zip(out, (path, r, end - begin, q, len(spans), s - begin, e - begin, where[s], where[e]), strict=True):
                        o.append(v)
            yield pa.record_batch([pa.array(o, pa.string() if k == 0 else pa.int64()) for k, o in enumerate(out)], SPANS.names)

    return run


def _emit(size: int):
    """Pieces read by their byte offsets; neighbouring ones come out of one read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, held, lo = None, None, b"", 0
        for b in batches:
            texts = []
            for p, s, e in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                if p != path:
                    if f is not None:
                        f.close()
                    system, local = _open(p)
                    path, f, held, lo = p, system.open_input_file(local), b"", 0
                if not lo <= s <= e <= lo + len(held):
                    lo, held = s, f.read_at(max(size, e - s), s)
                texts.append(re.sub("[\udc80-\udcff]", "\ufffd", held[s - lo : e - lo].decode("utf-8", "surrogateescape")))
            yield pa.record_batch([*[b.column(k) for k in range(5)], pa.array(texts, pa.string())], ["id", "chunk_index", "chunk_total", "start", "end", "piece"])
        if f is not None:
            f.close()

    return run


def split_files(spark: SparkSession, paths: list[str], limit: int = 1200, overlap: int = 120, range_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of giant UTF-8 files without loading a whole one: each task reads one byte range and its halo.

    First only boundaries are found, as characters and bytes; prefix sums over the ranges' lengths and
    counts number them, then pieces are read by their byte offsets. Each malformed byte becomes U+FFFD.
    Paths must be reachable by all executors; files within the limit give one piece, empty ones none.
    """
    rows = []
    for p in paths:
        system, local = _open(p)
        total = system.get_file_info(local).size
        if total:
            rows.append((p, total))
    files = spark.createDataFrame(rows, "path string, total long").withColumn("n", F.ceil(F.col("total") / range_bytes))
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("r"), "n", "total").repartition("path", "r")
    spans = cut(ranges.mapInArrow(_file_spans(limit, overlap, range_bytes), SPANS))
    w = Window.partitionBy("id").orderBy("range_no")
    heads = spans.where(F.col("seq") == 0).select("id", "range_no", (F.sum("chars").over(w) - F.col("chars")).alias("at"), (F.sum("count").over(w) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("id")).alias("chunk_total"))
    named = spans.join(heads, ["id", "range_no"]).select("id", (F.col("before") + F.col("seq")).alias("chunk_index"), "chunk_total", (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"), "byte_start", "byte_end")
    placed = named.repartitionByRange(shuffle_width(spark), "id", "byte_start").sortWithinPartitions("id", "byte_start")
    return placed.mapInArrow(_emit(1 << 20), "id string, chunk_index long, chunk_total long, start long, end long, piece string")
