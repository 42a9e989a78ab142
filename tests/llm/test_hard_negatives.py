import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as H
from plumbline.llm import queries, routes


def brute(rows, anchors, scale=256):
    """rows: (id, vector, label). The definition, pair by pair."""
    use = [(i, [math.floor(scale * float(c)) for c in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q, y in {(i, tuple(v), y) for i, v, y in use if i in anchors}:
        each = [(-sum(a * b for a, b in zip(q, v)), j, z) for j, v, z in use if j != i and len(v) == len(q)]
        for p, j, _ in sorted(e for e in each if e[2] == y)[:5]:
            hard = sorted((s, d) for s, d, z in each if z != y and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(i, j, r + 1, d, -p, -s) for r, (s, d) in enumerate(hard)]
    return sorted(out)


def got(spark, rows, anchors, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, rank string, anchor int")
    out = H.mine(df, F.col("vec_id").isin(list(anchors)))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def narrow(rows):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in rows]


@pytest.mark.parametrize("shard", [8192, 60])
def test_documents_match_brute_force(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(routes, "SHARD", shard)
    monkeypatch.setattr(H, "LEAF", 16)
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, {r[0] for r in rows if r[0] % 50 == 0})
    assert want and sorted(tuple(r) for r in queries.op12_ball_tree_negatives(spark, sf).collect()) == want


@pytest.mark.parametrize("most", [4096, 3])
def test_hot_label_and_hot_vector_over_many_shards(spark, monkeypatch, most):
    """A third of all rows have one vector, half one label; ties by id, few shards."""
    monkeypatch.setattr(routes, "SHARD", 100)
    monkeypatch.setattr(routes, "BLOCK", 7)
    monkeypatch.setattr(routes, "ROUTES", most)
    monkeypatch.setattr(H, "LEAF", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 2
    rows = []
    for i in rng.permutation(1200).tolist():
        c = 0 if rng.random() < 0.33 else int(rng.integers(1, 12))
        rows.append((i, (centres[c] + (rng.normal(size=6) * 0.3 if c else 0)).tolist(), 7 if rng.random() < 0.5 else int(rng.integers(0, 4))))
    anchors = {i for i in range(0, 1200, 40)}
    want = brute(rows, anchors)
    assert len(want) > 100 and got(spark, rows, anchors, "double") == want


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(90)] + [(200 + i, [1.0, 0.0, 0.0, 0.0], i % 2) for i in range(40)]
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [float("nan")] * 4, 1), (303, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (304, [1.0] * 4, None)]
    rows += [(400, [1.0, 2.0], 1), (401, [3.0, 4.0], 1), (402, [1.0, 1.5], 2), (0, rows[0][1], 0), (0, rows[5][1], 1), (600, [], 1), (601, [], 2), (700, [0.0] * 4, 0), (701, [-1.0] * 4, 2)]
    rows = narrow(rows)
    anchors = {0, 1, 200, 300, 304, 400, 600, 700, 701}
    assert got(spark, rows, anchors) == brute(rows, anchors)
    assert got(spark, [], {1}) == []


def test_large_values_are_exact(spark):
    rows = [(i, [1e6 + i, -1e6, 3.0 * i], i % 2) for i in range(30)] + [(100 + i, [0.6e6 + i, -1e6, 1.0], i % 3) for i in range(30)]
    assert got(spark, rows, {3, 4, 105}, "double") == brute(rows, {3, 4, 105}) != []


def naive(x, ids, labels, q, own, label, same, k, least, most):
    each = [(-sum(int(a) * int(b) for a, b in zip(v, q)), int(i)) for v, i, y in zip(x, ids, labels) if i != own and (y == label) == same]
    return [(i, -s) for s, i in sorted(e for e in each if (least is None or -e[0] >= least) and (most is None or -e[0] <= most))[:k]]


@pytest.mark.parametrize("size", [100, 2**40])
def test_tree_matches_a_scan_and_prunes_clusters(monkeypatch, size):
    monkeypatch.setattr(H, "LEAF", 32)
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.normal(size=(40, 8)) * size, 50, axis=0) + rng.normal(size=(2000, 8)) * size * 0.02).astype(np.int64)
    x[:300] = x[0]  # equal vectors, told apart by their ids
    ids, labels = rng.permutation(2000), rng.integers(0, 3, 2000)
    tree = H.BallTree.unpacked(H.BallTree(x, ids, labels).packed())
    ask = np.arange(0, 2000, 80)
    top = [max(sum(int(a) ** 2 for a in x[i]), 1) for i in ask]
    for same, low, high in ((True, None, None), (False, [t // 2 for t in top], [t * 95 // 100 for t in top])):
        tree.computed = 0
        row, d, s = tree.search(x[ask], ids[ask], labels[ask], same, 4, low, high)
        for i, a in enumerate(ask):
            want = naive(x, ids, labels, x[a], ids[a], labels[a], same, 4, low and low[i], high and high[i])
            assert [(int(b), int(c)) for b, c in zip(d[row == i], s[row == i])] == want
        assert tree.computed < 0.5 * len(ask) * len(x)
