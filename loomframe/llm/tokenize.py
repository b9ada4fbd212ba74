"""Encoding with a public byte-level BPE vocabulary by a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions of the linked list of symbols; three levels of bitmaps
say which buckets hold any, so the next rank is found by three find-first-set steps. Entries whose
pair has changed since are skipped. Work per merge does not depend on the length of the pre-token.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary
text; repeated rows are encoded each; only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 1 << 18  # pre-tokens remembered by a worker; beyond that it starts afresh, with equal results


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank, and bitmaps of 64-way fan-out over the buckets that hold any."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        n0 = ranks // 64 + 1
        self.low, self.mid, self.top = [0] * n0, [0] * (n0 // 64 + 1), 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(position)
            return
        self.buckets[rank] = [position]
        w, v = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[v] |= 1 << (w & 63)
        self.top |= 1 << v

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank that has entries, with them; None when there is none."""
        if not self.top:
            return None
        v = (self.top & -self.top).bit_length() - 1
        m = self.mid[v]
        w = (v << 6) + (m & -m).bit_length() - 1
        b = self.low[w]
        rank = (w << 6) + (b & -b).bit_length() - 1
        b &= b - 1
        self.low[w] = b
        if not b:
            m &= ~(1 << (w & 63))
            self.mid[v] = m
            if not m:
                self.top &= ~(1 << v)
        return rank, self.buckets.pop(rank)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.cache: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n, queue = len(raw), self.queue
        piece: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, places = got
            if len(places) > 1:
                places.sort()
            for i in places:
                left = piece[i]
                if left is None or (j := after[i]) >= n or ranks.get(whole := left + piece[j]) != rank:
                    continue  # stale
                piece[i], piece[j] = whole, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := ranks.get(whole + piece[k])) is not None:
                        queue.push(r, i)
                if (h := before[i]) >= 0 and (r := ranks.get(piece[h] + whole)) is not None:
                    queue.push(r, h)
        return [ranks[p] for p in piece if p is not None]

    def encode_into(self, text: str, out: list[int]) -> None:
        cache = self.cache
        for w in self.split(text):
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.merge(w.encode("utf-8", "replace"))
                if len(w) < 64:
                    cache[w] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            self.encode_into(text, out)
        return out


_KEPT: dict[str, Encoder] = {}  # of a worker process


def _ids(shared, key: str, counts: bool):  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _KEPT.get(key)
        if e is None:
            e = _KEPT[key] = Encoder(shared.value)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for text in b.column(1).to_pylist():
                if text:
                    e.encode_into(text, flat)
                ends.append(len(flat))
            if counts:
                second = pa.array(np.diff(np.array(ends, np.int64)))
            else:
                second = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.record_batch([b.column(0), second], ["key", "n" if counts else "ids"])

    return run


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, counts: bool) -> DataFrame:
    """The vocabulary (50k entries, fixed) is read by the driver and broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = dict(df.dtypes)[id_col]
    t = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return t.mapInArrow(_ids(shared, path, counts), f"key {kind}, " + ("n long" if counts else "ids array<int>"))


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids): token ids of each row's whole text."""
    return _encoded(df, id_col, text_col, path, False).withColumnRenamed("key", id_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id_col, n): the number of tokens of each row's text, without moving the ids."""
    return _encoded(df, id_col, text_col, path, True).withColumnRenamed("key", id_col)
