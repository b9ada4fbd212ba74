"""Most similar vectors of every vector: a neighbour graph by NN-descent, and greedy search on it.

Rows of exactly equal vectors are one node, so copies never make hot buckets; vectors that merely
come near each other stay separate nodes. Candidate work sends a vector's direction with two signed
bytes per dimension, fine enough to order neighbours that differ by a thousandth; similarities of the
result come from the full vectors. The first graph comes from cross-polytope hash tables; rounds of
Spark joins then compare neighbours of neighbours, until few edges change.

Defined cases: a vector that is null, of another length, all zero or not finite is no node and has
no neighbours; an empty table gives no rows; repeated ids are separate rows; ties are broken by id.
Only the id and vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import cut, shuffle_width

CODE_ERROR = 0.001  # most that a similarity of codes may differ from that of the vectors
HEADS = 6  # ids kept of a group of copies: enough for five partners of each
REVERSE = 48  # nodes that point at a centre which meet there in one round, drawn anew in each; the edges all stay
HOT_GROUPS = 1000  # most groups of copies whose members are joined by broadcast


def _matrix(col: pa.Array, dim: int, kind: type) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, dim), kind)
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), dim)


def _unit(codes: np.ndarray, kind: type = np.float32) -> np.ndarray:
    x = codes.astype(kind)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _code(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    return np.rint(x / top * 32767).astype(np.int16)


def _encode(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim) + np.float32(0)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            vec = [r.tobytes() for r in x[ok]]
            same = [hashlib.blake2b(r, digest_size=16).digest() for r in vec]
            yield pa.record_batch([b.column(0).filter(pa.array(ok)), pa.array(same, pa.binary()), pa.array(vec, pa.binary())], ["id", "same", "vec"])

    return run


def vector_rows(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, same, vec) of the rows with a usable vector; `same` is a digest of the vector."""
    v = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    v = v.where((F.size("v") == dim) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return v.mapInArrow(_encode(dim), "id string, same binary, vec binary")


def _with_code(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index("vec")), dim, np.float32).astype(np.float64)
            yield pa.record_batch([*b.columns, _blobs(_code(x))], [*b.schema.names, "code"])

    return run


def coded(df: DataFrame, dim: int) -> DataFrame:
    """`df` with the code of its `vec`."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(_with_code(dim), kinds + ", code binary")


def copy_groups(rows: DataFrame, dim: int) -> DataFrame:
    """One node for each distinct vector: key, heads (the HEADS smallest ids), copies (its rows), same, vec and code.

    The ids are cut to HEADS within each map task (a group-limited window), the count is a
    partial aggregate: a vector that a third of all rows hold costs no more than others.
    """
    w = Window.partitionBy("same").orderBy("id")
    heads = rows.select("same", "id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= HEADS).groupBy("same").agg(F.array_sort(F.collect_list("id")).alias("heads"))
    sizes = rows.groupBy("same").agg(F.count("*").alias("copies"), F.first("vec").alias("vec"))
    return cut(coded(heads.join(sizes, "same"), dim).withColumn("key", F.monotonically_increasing_id()))


def _polytopes(dim: int, tables: int, buckets: int, seed: int) -> list[list[np.ndarray]]:
    """Random rotations per table; each gives 2 x columns values, together about `buckets`."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        left, parts = max(2.0, float(buckets)), []
        while left >= 2:
            d = int(min(dim, max(1, round(left / 2))))
            parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :d].astype(np.float32))
            left /= 2 * d
        out.append(parts)
    return out


def _hash(dim: int, tables: int, buckets: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs = _polytopes(dim, tables, buckets, seed)
        side = np.random.default_rng(seed + 1).standard_normal((dim, tables)).astype(np.float32)
        for b in batches:
            x = _unit(_matrix(b.column(1), dim, np.int16))
            at = np.arange(len(x))
            for t, parts in enumerate(tabs):
                h = np.full(len(x), t, np.int64)
                for r in parts:
                    p = x @ r
                    top = np.abs(p).argmax(axis=1)
                    h = h * (2 * r.shape[1]) + top * 2 + (p[at, top] > 0)
                yield pa.record_batch([pa.array(h), pa.array(x @ side[:, t]), b.column(0), b.column(1)], ["bucket", "side", "key", "code"])

    return run


def _close(codes: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j with a similarity of at least floor that are among the k best of i or of j.

    Where many are all but equal, single precision cannot order them and the products are taken again in double.
    """
    x = _unit(codes)
    s = x @ x.T
    n = len(x)
    if np.count_nonzero(s >= 0.999) > 3 * n:
        x = _unit(codes, np.float64)
        s = x @ x.T
    np.fill_diagonal(s, -2)
    if n > k + 1 and np.count_nonzero(s >= floor) > k * n:
        kth = np.partition(s, -k, axis=1)[:, -k]
        hit = (s >= floor) & ((s >= kth[:, None]) | (s >= kth[None, :]))
    else:
        hit = s >= floor
    i, j = np.nonzero(np.triu(hit, 1))
    return i, j, s[i, j].astype(np.float64)


def _grouped(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups of the first column (sorted); a group of over 64 x least rows is cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        g = t.column(0).to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if last == 0 and n < 64 * least:
            continue
        last = last or n
        yield t.slice(0, last)
        held, n = t.slice(last).to_batches(), t.num_rows - last
    if n:
        yield pa.Table.from_batches(held)


def _group_pairs(group: str, key: str, dim: int, floor: float, k: int, cap: int):  # noqa: ANN202
    """Close pairs within each group of rows (sorted by group), by matrix products of at most cap rows.

    A larger group is taken in windows of cap rows along its order; each half window meets the
    next, so that no row is left out and near rows of the order are met.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 8192):
            g, ids = t.column(group).to_numpy(), t.column(key).to_numpy()
            x = _matrix(t.column("code").combine_chunks(), dim, np.int16)
            cuts = np.r_[0, np.nonzero(np.diff(g))[0] + 1, len(g)]
            a, b, s = [], [], []
            step = max(1, cap // 2)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, max(lo + 1, hi - step), step):
                    end = min(hi, at + cap)
                    if end - at > 1:
                        i, j, v = _close(x[at:end], floor, k)
                        a.append(ids[at + i])
                        b.append(ids[at + j])
                        s.append(v)
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(s))], ["a", "b", "s"])

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Undirected pairs as directed edges, the k best of each node."""
    both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    e = pairs.select(both.alias("e"), "s").select("e.a", "e.b", "s").where(F.col("a") != F.col("b"))
    e = e.groupBy("a", "b").agg(F.max("s").alias("s"))
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def first_graph(nodes: DataFrame, dim: int, k: int, tables: int = 8, floor: float = -1.0, bucket_rows: int = 384, seed: int = 7) -> DataFrame:
    """Directed edges (a, b, s) of nodes that share a bucket of a hash table, the k best of each node.

    The number of buckets follows the number of nodes, with about `bucket_rows` nodes in one. A bucket
    beyond 4096 nodes is compared in overlapping windows along a random direction, over as many tasks
    as its range takes.
    """
    n, width = nodes.count(), shuffle_width(nodes.sparkSession)
    hashed = nodes.select("key", "code").mapInArrow(_hash(dim, tables, max(2, n // bucket_rows), seed), "bucket long, side float, key long, code binary")
    near = hashed.repartitionByRange(width, "bucket", "side", "key").sortWithinPartitions("bucket", "side", "key")
    return cut(_best(near.mapInArrow(_group_pairs("bucket", "key", dim, floor, k, 4096), "a long, b long, s double"), k))


def nn_descent(nodes: DataFrame, dim: int, k: int = 10, rounds: int = 3, floor: float = -1.0, settle: float = 0.002, **first) -> DataFrame:
    """Directed edges (a, b, s): the k most similar nodes found for each node, with s >= floor.

    nodes: (key long, code binary). Each of the `rounds` sends a node's code to the nodes next to it,
    where all met pairs are compared: its k neighbours and REVERSE of those it is a neighbour of, in
    the order of a hash that changes with the round, so a hub is no large group and keeps all its
    edges. It ends early when fewer than `settle` of the edges are new.
    """
    width = shuffle_width(nodes.sparkSession)
    codes = nodes.select("key", "code")
    edges = first_graph(nodes, dim, k, floor=floor, **first)
    for r in range(rounds):
        old = edges.count()
        forth = edges.select(F.col("a").alias("centre"), F.col("b").alias("member"))
        drawn = Window.partitionBy("centre").orderBy(F.xxhash64("member", "centre", F.lit(r)), "member")
        back = edges.select(F.col("b").alias("centre"), F.col("a").alias("member")).withColumn("rn", F.row_number().over(drawn)).where(F.col("rn") <= REVERSE).drop("rn")
        links = forth.unionByName(back).distinct()
        sent = links.join(codes.withColumnRenamed("key", "member"), "member").select("centre", "member", "code")
        met = sent.repartition(width, "centre").sortWithinPartitions("centre", "member").mapInArrow(_group_pairs("centre", "member", dim, floor, k, 4096), "a long, b long, s double")
        held = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
        new = cut(_best(met.unionByName(held), k))
        fresh = new.join(edges.select("a", "b"), ["a", "b"], "left_anti").count()
        edges = new
        if fresh <= settle * max(1, old):
            break
    return edges


def _cosines(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_matrix(b.column(c), dim, np.float32).astype(np.float64) for c in (2, 3))
            s = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s)], ["a", "b", "sim"])

    return run


def exact(pairs: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(a, b, sim): cosine of the nodes of each pair by their full vectors."""
    vec = lambda k, v: nodes.select(F.col("key").alias(k), F.col("vec").alias(v))
    return pairs.join(vec("a", "va"), "a").join(vec("b", "vb"), "b").select("a", "b", "va", "vb").mapInArrow(_cosines(dim), "a long, b long, sim double")


def _copy_pairs(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(p, q): each copy with the first k others of its vector by id; as many rows as k times the copies."""
    others = lambda heads, p: F.slice(F.filter(heads, lambda h: h != p), 1, k)
    few = nodes.where(F.col("copies").between(2, HEADS)).select(F.explode("heads").alias("p"), "heads")
    out = few.select("p", F.explode(others(F.col("heads"), F.col("p"))).alias("q"))
    total, most = nodes.agg(F.sum("copies"), F.max("copies")).first()
    if (most or 0) <= HEADS:
        return out
    many = nodes.where(F.col("copies") > HEADS).select("same", "heads", "copies")
    hot_from = max(10_000, total // HOT_GROUPS)
    hot = F.broadcast(many.where(F.col("copies") > hot_from).drop("copies"))  # at most HOT_GROUPS of them
    member = rows.select("same", F.col("id").alias("p"))
    both = member.join(hot, "same").unionByName(member.join(hot, "same", "left_anti").join(many.where(F.col("copies") <= hot_from).drop("copies"), "same"))
    return out.unionByName(both.select("p", F.explode(others(F.col("heads"), F.col("p"))).alias("q")))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, min_similarity: float = 0.85, slack: float = 0.2, **descent) -> DataFrame:
    """Pairs (id_a, id_b, similarity): cosine >= min_similarity, and one among the k best of the other.

    Edges down to min_similarity - slack are kept while the graph is built, as ways to others. The
    copies of one vector come first, by id.
    """
    if k >= HEADS:
        raise ValueError(f"k must be below {HEADS}")
    rows = vector_rows(df, id_col, vec_col, dim)
    nodes = copy_groups(rows, dim)
    edges = nn_descent(nodes, dim, k=2 * k, floor=min_similarity - slack, **descent)
    pairs = edges.where(F.col("s") >= min_similarity - CODE_ERROR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(exact(pairs, nodes, dim).where(F.col("sim") >= min_similarity))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "sim").select("e.*", "sim")
    meta = nodes.select("key", "heads", "copies")
    both = both.join(meta.select(F.col("key").alias("x"), F.col("heads").alias("hx"), F.col("copies").alias("nx")), "x").join(meta.select(F.col("key").alias("y"), F.col("heads").alias("hy"), F.col("copies").alias("ny")), "y")
    before = F.coalesce(F.sum("ny").over(Window.partitionBy("x").orderBy(F.desc("sim"), F.element_at("hy", 1)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumn("free", F.lit(k + 1) - F.col("nx") - before).where(F.col("free") > 0)
    across = both.select(F.explode("hx").alias("p"), F.slice("hy", 1, F.least(F.col("free"), F.lit(HEADS)).cast("int")).alias("q"), "sim").select("p", F.explode("q").alias("q"), "sim")
    same = _copy_pairs(rows, nodes, k).withColumn("sim", F.lit(1.0))
    return across.unionByName(same).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "sim").where(F.col("id_a") != F.col("id_b")).groupBy("id_a", "id_b").agg(F.max("sim").alias("similarity"))


def _score_search(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, x = (_unit(_matrix(b.column(c), dim, np.int16), np.float64) for c in (1, 3))
            yield pa.record_batch([b.column(0), b.column(2), pa.array((q * x).sum(axis=1))], ["query", "key", "s"])

    return run


def _enter(keys: list[int], codes: list[bytes], dim: int, beam: int):  # noqa: ANN202
    """The best of the entry nodes for each query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids = _unit(np.frombuffer(b"".join(codes), np.int16).reshape(-1, dim), np.float64), np.array(keys)
        for b in batches:
            s = _unit(_matrix(b.column(1), dim, np.int16), np.float64) @ x.T
            n = min(beam, len(ids))
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            rows = pa.array(np.repeat(np.arange(len(s)), n))
            yield pa.record_batch([b.column(0).take(rows), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], ["query", "key", "s"])

    return run


def greedy_search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, dim: int, k: int = 5, beam: int = 24, entries: int = 48, steps: int = 5) -> DataFrame:
    """(query, key, s): the k nodes found for each query by greedy search on the graph.

    All queries step at once. Each starts from its best of `entries` spread-out nodes (chosen by a hash
    of their keys), keeps its `beam` best nodes and, in each step, meets the neighbours of those
    not yet opened. queries: (query, code). It ends after `steps` or when nothing is left to open.
    """
    codes = nodes.select("key", "code")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    w = Window.partitionBy("query").orderBy(F.desc("s"), "key")
    score = lambda df: df.select("query", "qcode", "key", "code").mapInArrow(_score_search(dim), "query string, key long, s double")
    q = queries.select(F.col("query").cast("string").alias("query"), F.col("code").alias("qcode"))
    start = codes.orderBy(F.xxhash64("key"), "key").limit(entries).collect()  # `entries` rows
    enter = _enter([r["key"] for r in start], [bytes(r["code"]) for r in start], dim, beam)
    pool = cut(q.select("query", "qcode").mapInArrow(enter, "query string, key long, s double").withColumn("opened", F.lit(False)))
    for _ in range(steps):
        todo = pool.where(~F.col("opened"))
        if todo.isEmpty():
            break
        met = todo.join(both, todo["key"] == both["a"]).select("query", F.col("b").alias("key")).distinct().join(pool.select("query", "key"), ["query", "key"], "left_anti")
        got = score(met.join(codes, "key").join(q, "query")).withColumn("opened", F.lit(False))
        pool = pool.withColumn("opened", F.lit(True)).unionByName(got)
        pool = cut(pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= beam).drop("rn"))
    return pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query", "key", "s")
