import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from tests.llm.helpers import ODD, empty, odd


def brute_targets(sizes):
    """By repeated resharing. sizes: by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, shut = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in shut]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in shut)) / max(1, sum(w[s] for s in free))
        more = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in shut else level * w[s] for s in names}
        shut |= more
    return left


def check(rows, biggest):
    size, target, taken = {}, {}, defaultdict(int)
    for r in rows:
        size[r.s] = size.get(r.s, 0) + r.size
        target[r.s] = r.target
        taken[r.s] += r.n_copies * r.size
        assert 0 <= r.n_copies <= 3
    want = brute_targets(size)
    for s, t in want.items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= biggest[s] / 2 + 1e-6, (s, taken[s], t)


@pytest.mark.parametrize("power", [0.0, 0.5])
def test_documents_come_near_targets(spark, sf, power):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = mixing.copies(docs, power=power).select(F.col("doc.source").alias("s"), F.col("doc.doc_id").alias("i"), "size", "target", "n_copies")
    rows = made.collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    biggest = defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.i]))
        biggest[r.s] = max(biggest[r.s], r.size)
    check(rows, biggest)
    assert rows == made.collect() or sorted(rows) == sorted(made.collect())


def test_inclusion_is_unequal_by_source_and_size(spark):
    """Long documents are drawn more often with a power, and as often as others without."""
    rows = [(i, "w " * (1 if i % 2 else 9), "b") for i in range(4000)] + [(10_000 + i, "w " * 40, "a") for i in range(60)]
    rows += [(20_000 + i, "w w", "c") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for power, low, high in ((0.0, 0.9, 1.1), (1.0, 5.0, 13.0)):
        m = mixing.copies(docs, power=power).where("doc.source = 'b'").groupBy("size").agg(F.avg("n_copies").alias("n"))
        n = {r["size"]: r.n for r in m.collect()}
        whole = int(min(n.values()))
        assert low <= (n[9] - whole) / (n[1] - whole) <= high


def test_odd_rows_and_empty(spark):
    made = mixing.copies(odd(spark)).select(F.col("doc.source").alias("s"), F.col("doc.doc_id").alias("i"), "size", "target", "n_copies").collect()
    assert len(made) == len(ODD)
    biggest = defaultdict(int)
    for r in made:
        biggest[r.s] = max(biggest[r.s], r.size * (2 if r.i == 7 else 1))
    check(made, biggest)
    assert mixing.copies(empty(spark)).count() == 0
    out = mixing.mixed(odd(spark))
    assert out.columns == odd(spark).columns and out.count() == sum(r.n_copies for r in made)
