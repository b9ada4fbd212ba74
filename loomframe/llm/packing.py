"""Filling containers of fixed capacity by bulk-synchronous best fit.

Items sorted by size and gaps sorted by room are run-length encoded: sizes are whole numbers up to
the capacity, so both sides are at most `capacity` runs, however many rows there are. One superstep
takes all items of the largest size left, matches them with the smallest gaps that hold them (the
successor of the size among the gaps, run by run), gives items of one size to containers by rank,
and puts the narrowed gaps back; steps repeat to the smallest size. Only the plan (runs of ranks to
runs of containers) is made on the driver, from one count per size; items meet it by a join on
(size, rank), and ranks come from a range sort, so no size is ever in one task. The sweep itself is not
distributed: runs are at most some thousand, and sweeps as DataFrame steps over them took minutes and
more containers for the same sizes (README).

Defined cases: an item beyond the capacity is divided into full pieces and a rest, no other is;
items of size 0 or null get container 0; equal items are told apart by id and by repetition; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.session import cut, global_rank


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, end rank, first container, items per container), and the containers used."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first container, how many)
    rooms: list[int] = []
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                fit = capacity // size
                n = -(-left // fit)
                put(capacity, opened, n)
                opened += n
                continue
            room = rooms[at]
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            fit = room // size
            full = min(n, left // fit)
            if full:
                runs.append((size, rank, rank + full * fit, first, fit))
                put(room - fit * size, first, full)
                rank, left = rank + full * fit, left - full * fit
            if full < n and 0 < left < fit:
                runs.append((size, rank, rank + left, first + full, left))
                put(room - left * size, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, n - full)
    return runs, opened


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id_col, piece, size, container) for every item; piece counts the parts of a divided item from 0."""
    spark = sizes.sparkSession
    # written once: the range sort below would measure every text a second time for its sample
    s = cut(sizes.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("whole")))
    parts = F.greatest(F.ceil(F.col("whole") / capacity), F.lit(1))
    items = s.select("_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("piece"))
    items = items.select("_id", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("long").alias("size"))
    ranked = global_rank(items, ["size", "_id", "piece"], by="size")
    counts = {r["size"]: r["n"] for r in ranked.where(F.col("size") > 0).groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit_plan(counts, capacity)
    plan = spark.createDataFrame(runs, "_size long, _lo long, _hi long, _first long, _fit long")
    met = ranked.join(F.broadcast(plan), (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")), "left")
    where = F.coalesce(F.col("_first") + F.floor((F.col("rank") - F.col("_lo")) / F.col("_fit")), F.lit(0))
    return met.select(F.col("_id").alias(id_col), F.col("piece").cast("int").alias("piece"), "size", where.cast("long").alias("container"))
