import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import neighbours as nb

SF = "/root/testdata/sf0.001"


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        kth = np.sort(s[i])[-k]
        for j in np.nonzero((s[i] >= least) & (s[i] >= kth - 1e-9))[0]:
            out.add(tuple(sorted((ids[i], ids[j]))))
    return out


def clustered(rng, groups=60, each=4, noise=0.06, dim=16):
    c = rng.standard_normal((groups, dim))
    return np.concatenate([c + noise * rng.standard_normal(c.shape) for _ in range(each)] + [rng.standard_normal((200, dim))])


def test_recall_against_brute_force(spark):
    x = clustered(np.random.default_rng(2))
    ids = [f"v{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, r.tolist(), "clash") for i, r in zip(ids, x, strict=True)], "id string, e array<double>, key string")
    got = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(df, "id", "e", 16, 5, 0.85).collect()}
    want = brute(ids, x, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want) and not got - want


def test_unusable_and_empty(spark):
    s = "id string, e array<double>"
    assert nb.similar_pairs(spark.createDataFrame([], s), "id", "e", 4).count() == 0
    rows = [("a", None), ("b", [0.0] * 4), ("c", [1.0, 2.0]), ("d", [float("nan"), 1.0, 1.0, 1.0]), ("e", [1.0, None, 0.0, 0.0]), ("f", [1.0, 0.0, 0.0, 0.0]), ("g", [2.0, 0.0, 0.0, 0.0])]
    assert [tuple(r) for r in nb.similar_pairs(spark.createDataFrame(rows, s), "id", "e", 4).select("id_a", "id_b").collect()] == [("f", "g")]


@pytest.mark.parametrize(("each", "groups", "noise"), [(12, 60, 1e-3), (100, 8, 1e-3), (100, 8, 1e-2)])
def test_nearly_equal_vectors(spark, each, groups, noise):
    """Vectors that are almost copies keep their own five nearest ones."""
    rng = np.random.default_rng(each)
    c = rng.standard_normal((groups, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([c + noise * rng.standard_normal(c.shape) for _ in range(each)]).astype(np.float32).astype(float)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "id string, e array<float>")
    got = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(df, "id", "e", 64, 5, 0.85).collect()}
    want = brute(ids, x, 5, 0.85)
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)


def test_copies_meet_by_id(spark):
    """Each copy of a vector meets the five others of smallest id, at any size of the group."""
    rng = np.random.default_rng(1)
    rows = [(f"c{i:04d}", [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(f"r{i:03d}", rng.standard_normal(4).tolist()) for i in range(50)]
    got = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(spark.createDataFrame(rows, "id string, e array<double>"), "id", "e", 4).collect()}
    want = {tuple(sorted((f"c{i:04d}", f"c{j:04d}"))) for i in range(400) for j in [j for j in range(6) if j != i][:5]}
    assert {p for p in got if p[0] < "d" and p[1] < "d"} == want


def test_hub(spark):
    """A node that many point at keeps all its edges, and is met in bounded groups."""
    rng = np.random.default_rng(3)
    hub = np.zeros(64)
    hub[0] = 1.0
    spokes = np.stack([hub + 0.5 * r / np.linalg.norm(r) for r in rng.standard_normal((1500, 64))])
    x = np.concatenate([hub[None], spokes]).astype(np.float32).astype(float)
    ids = [f"v{i:05d}" for i in range(len(x))]
    got = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "id string, e array<float>"), "id", "e", 64, 5, 0.85).collect()}
    want = brute(ids, x, 5, 0.85)
    assert sum(p[0] == ids[0] for p in want) > 1000 and len(got & want) >= 0.99 * len(want)


def test_greedy_search_recall(spark):
    docs = spark.read.parquet(f"{SF}/rag_documents.parquet")
    p = docs.select("id", "embedding").toPandas()
    p = p[[e is not None and len(e) == 64 and np.abs(e).sum() > 0 for e in p["embedding"]]]
    x = np.stack(p["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = p["id"].to_numpy()
    from loomframe.llm.queries import p1_search

    got = p1_search(spark, SF).toPandas().groupby("id")["near_id"].apply(set).to_dict()
    asked = [i for i, v in enumerate(ids) if int(v.replace("-", ""), 16) % 20 == 0]
    assert set(got) == set(ids[asked])
    hit = 0
    for i in asked:
        s = x @ x[i]
        s[i] = -2
        hit += len(set(ids[np.argsort(-s)[:5]]) & got[ids[i]])
    assert hit >= 0.9 * 5 * len(asked)


def test_hot_bucket_windows(spark):
    """A bucket beyond the cap is compared in overlapping windows, none of its rows is left out."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((300, 8)) + 0.02 * rng.standard_normal((300, 8))])
    rows = [(i, np.rint(r / np.abs(r).max() * 32767).astype(np.int16).tobytes()) for i, r in enumerate(x)]
    nodes = spark.createDataFrame(rows, "key long, code binary")
    import pyarrow as pa

    batch = pa.record_batch([pa.array([7] * 300), pa.array(np.arange(300, dtype=np.float32)), pa.array(range(300)), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "side", "key", "code"])
    out = list(nb._group_pairs("bucket", "key", 8, 0.5, 5, 64)(iter([batch])))
    seen = set(out[0].column(0).to_pylist()) | set(out[0].column(1).to_pylist())
    assert seen == set(range(300)) and nodes.count() == 300


@pytest.mark.parametrize("k", [6, 9])
def test_too_many_neighbours(spark, k):
    with pytest.raises(ValueError, match="k must be"):
        nb.similar_pairs(spark.createDataFrame([], "id string, e array<double>"), "id", "e", 4, k)
