"""The inverted file against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import vector_index as V
from plumbline.plans import catalog


def brute(rows, queries, k, keep=lambda i: True):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, v in queries:
        if v is None or not any(v):
            continue
        v = np.array(v, float)
        each = sorted((-round(float(v @ x / np.sqrt((v @ v) * (x @ x))), 9), i) for i, x in good if keep(i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(each[:k])]
    return sorted(out)


def got(df):
    return sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())


def near(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 2e-9 for x, y in zip(a, b))


def data(n=1500, dim=8, clusters=25, spread=0.05):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, dim))
    which = np.where(rng.random(n) < 0.3, 0, rng.integers(0, clusters, n))
    rows = [(i, (centres[c] + rng.normal(size=dim) * spread * (c > 0)).tolist()) for i, c in enumerate(which.tolist())]
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [1.0] * (dim - 1) + [None])]


def test_exact_search_equals_all_pairs_and_visits_few_cells(spark, tmp_path, monkeypatch):
    """Clusters, a hot vector of a third of all rows, ties, odd vectors, parts and blocks."""
    monkeypatch.setattr(V, "PART", 100)
    monkeypatch.setattr(V, "BLOCK", 7)
    rows = data()
    df = spark.createDataFrame([(i, v, i % 10) for i, v in rows], "id long, v array<double>, level int")
    index = V.build(df, f"{tmp_path}/index")
    queries = [(i, rows[i][1]) for i in range(0, 1500, 60)] + [(9001, [0.3] * 8), (9002, [0.0] * 8), (9003, None)]
    asked = spark.createDataFrame(queries, "qid long, qv array<double>")
    assert near(got(index.top(asked, 12)), brute(rows, queries, 12))
    again = V.opened(spark, f"{tmp_path}/index")
    assert near(got(again.top(asked, 5, where=F.col("level") < 3)), brute(rows, queries, 5, lambda i: i % 10 < 3))
    # Bounds leave most cells of clustered vectors alone.
    some = asked.where("qid < 9000").select("qid", "qv").withColumn("least", F.lit(0.99))
    assert again._sent(some, None).count() < 0.3 * 25 * again.cells.count()


def test_folders_of_other_cells_are_pruned(spark, tmp_path):
    index = V.build(spark.createDataFrame(data(), "id long, v array<double>"), f"{tmp_path}/index", cells=20)
    plan = index.lists.where(F.col("cell").isin([1, 2]))
    assert "PartitionFilters: [cell" in plan._jdf.queryExecution().toString() and len(index.lists.inputFiles()) >= 15
    sent = index._sent(spark.createDataFrame([(1, data()[0][1])], "qid long, qv array<double>"), 3)
    assert sent.count() == 3 and sent.select("cell").distinct().count() == 3


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_probes_keep_their_recall(spark, sf):
    """0.9 of the ten best at least, over vectors that hardly cluster."""
    q = catalog.queries()
    exact, found = (({(r.qid, r.id) for r in q[n](spark, sf).collect()}) for n in ("vector_index_topk", "vector_probe"))
    assert len(exact & found) >= 0.9 * len(exact)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, qv array<double>")
    assert V.build(none, f"{tmp_path}/a").top(asked).count() == 0
    index = V.build(spark.createDataFrame([(5, [1.0, 2.0])], "id long, v array<double>"), f"{tmp_path}/b")
    assert got(index.top(asked)) == [(1, 1, 5, 1.0)] and index.top(asked.where("false")).count() == 0
