from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import filter_audit as A
from tests.llm.helpers import ODD, empty, odd

LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 1), (7, 1, None), (8, 1, 0), (99, 1, 1), (None, 1, 1)]


def fails(text, ids, doc):
    t = text or ""
    split = t.encode().split()
    return {
        "A": len(split) < 50, "B": 100 * len(set(split)) < 65 * len(split), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
        "E": doc is not None and any(i is not None and i < doc for i in ids),
    }


def brute(rows, labels):
    """rows: (doc_id, text, source). Every order is applied to the documents, one by one."""
    docs = []
    for doc, text, source in rows:
        good = doc is not None and any(d == doc and q == 1 for d, q, _ in labels)
        toxic = doc is not None and any(d == doc and t == 1 for d, _, t in labels)
        docs.append((source or "", fails(text, [d for d, t, _ in rows if (t or "") == (text or "")], doc), good, toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order):
                gone = [d for d in left if d[1][c]]
                left = [d for d in left if not d[1][c]]
                total[c] += len(gone)
                found.append(("".join(order), step + 1, c, len(left), len(gone), sum(d[1][c] for d in mine) - len(gone), sum(d[1][c] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(part, o, s, *rest, total[c]) for o, s, c, *rest in found]
    return sorted(out)


def test_odd_documents_equal_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    extra = [(20 + i, ["GO", "up # now " * 20, "one two three four five six seven eight nine ten eleven twelve", " ".join(f"w{k}" for k in range(60))][i % 4], "en", None if i % 3 else "a", 0) for i in range(12)]
    docs = odd(spark).unionByName(spark.createDataFrame([(*r, "x", "y", "z") for r in extra], odd(spark).schema))
    got = sorted(tuple(r) for r in A.audit(docs.withColumn("mask", F.lit(1)).withColumn("part", F.lit("no")), labels).collect())
    want = brute([(r[0], r[1], r[3]) for r in ODD + extra], LABELS)
    assert got == want and len(got) == 600 * len({r[3] or "" for r in ODD + extra})
    assert any(r[-1] for r in got) and any(r[7] for r in got) and any(r[8] for r in got)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty(spark), labels).count() == 0
    rows = A.audit(odd(spark), labels).collect()
    assert {r.good_lost for r in rows} == {0} and len(rows) == 600 * 4


def test_zeta_transform_equals_sums_over_subsets():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (3, 64))
    want = [[sum(c[m] for m in range(64) if not m & s) for s in range(64)] for c in counts]
    assert A.survivors(counts).tolist() == want


def test_other_filters(spark):
    """Three filters of one's own, without the rule on repeated texts."""
    docs = spark.createDataFrame([(i, "x" * i, "p") for i in range(10)], "doc_id long, text string, source string")
    n = F.length("text")
    rows = A.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), {"a": n < 3, "b": n % 2 == 0, "c": n > 8}, repeats=None).collect()
    assert len(rows) == 18
    last = {r.filter_order: r.kept for r in rows if r.step == 3}
    assert set(last.values()) == {3}
    step = next(r for r in rows if r.filter_order == "abc" and r.step == 2)
    assert (step.kept, step.removed, step.redundant, step.unique_fails) == (4, 3, 2, 3)
    a = next(r for r in rows if r.filter_order == "abc" and r.step == 1)
    assert (a.removed, a.good_lost, a.shapley) == (3, 1, 6 + 3 + 3)  # 1 in all orders, 0 and 2 where a stands before b
