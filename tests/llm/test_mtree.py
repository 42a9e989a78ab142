import math

import numpy as np
import pytest

from plumbline.llm import mtree, routes


def brute(rows, ids, k=10):
    """rows: (id, vector)."""
    use = [(i, [math.floor(1024 * float(np.float64(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in use if i in ids}:
        s = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in use if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def got(spark, rows, ids, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank string, score string")
    out = mtree.top_k(df, df.where(df.vec_id.isin(list(ids))))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect())


def test_documents_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(routes, "SHARD", 100)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = mtree.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == brute(rows, {i for i, _ in rows if i % 100 == 0})


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)] + [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(150)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (None, [1.0] * 5)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, 4.0]), (0, rows[0][1]), (600, []), (601, [0.0] * 5)]
    ids = {0, 1, 200, 400, 401, 403, 500, 600, 601}
    assert got(spark, [(*r, "x", "y") for r in rows], ids) == brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], ids)
    assert got(spark, [], {1}) == []


def test_large_values_are_exact(spark):
    rows = [(i, [1e6 + i, -1e6, 3.0 * i]) for i in range(30)]
    assert got(spark, [(*r, "x", "y") for r in rows], {3, 4}, "double") == brute(rows, {3, 4})
    huge = [(i, [1e15 * (i + 1)], "x", "y") for i in range(4)]
    assert [r[3] for r in got(spark, huge, {0}, "double")] == [2**63 - 1] * 3


def scan(x, ids, q, own, k):
    each = sorted(((sum(int(a) * int(b) for a, b in zip(v, q)), int(i)) for v, i in zip(x, ids) if i != own), key=lambda t: (-t[0], t[1]))
    return each[:k]


@pytest.mark.parametrize("most", [4096, 3])
def test_routes_lose_nothing_and_spare_shards(spark, monkeypatch, most):
    """Clusters over many shards, one of them a third of all, and ties: exact, with few shards met."""
    monkeypatch.setattr(routes, "SHARD", 150)
    monkeypatch.setattr(routes, "BLOCK", 20)
    monkeypatch.setattr(routes, "ROUTES", most)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 3
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 30, 3000))
    rows = [(i, (centres[c] + rng.normal(size=8) * 0.02).tolist()) for i, c in enumerate(which.tolist())]
    rows += [(3000 + i, [1.0, 2.0]) for i in range(5)]
    ids = {i for i in range(0, 3005, 60)} | {3002}
    assert got(spark, [(*r, "x", "y") for r in rows], ids, "double") == brute(rows, ids)


def test_bounds_of_large_values_are_widened():
    """Products of over 2 ** 53 that differ by less than doubles can tell."""
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**40), 2**40, (3000, 4))
    x[:200] = x[0] + np.arange(200)[:, None] % 3
    ids = rng.permutation(3000)
    tree = mtree.MTree(x, ids)
    for i in (0, 5, 700, 2999):
        assert tree.search(x[i], int(ids[i]), 10) == scan(x, ids, x[i], int(ids[i]), 10)
    assert tree.computed < 4 * 3000


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_tree_matches_a_scan_and_prunes_clusters(spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 1000
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 1000 * spread)
    ids = rng.permutation(4000)
    tree = mtree.MTree(x, ids)
    for i in range(0, 4000, 400):
        want = scan(x, ids, x[i], int(ids[i]), 10)
        assert [(int(s), d) for s, d in tree.search(x[i], int(ids[i]), 10)] == want
    if spread < 0.1:
        assert tree.computed < 0.5 * 10 * len(x)
