import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import access, catalog, context, expansion, retrieval
from plumbline.sources import stores


def scores(spark, values):
    return spark.createDataFrame([(q, i, float(s), i) for q, ss in values.items() for i, s in enumerate(ss)], "qid int, id int, logit double, rank int")


def test_bm25_matches_the_formula(spark):
    texts = ["cat dog dog bird", "cat cat fish", "tree", "bird fish fish fish river", "river tree tree stone wood leaf"]
    docs = retrieval.build_index(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    q = spark.createDataFrame([(1, "fish fish river"), (2, "unknown")], "qid int, query string")
    got = {(r.qid, r.id): r.score for r in retrieval.bm25_top(docs, q, 4).collect()}
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    for (qid, i), s in got.items():
        want = sum(idf[t] * toks[i].count(t) * 2.5 / (toks[i].count(t) + 1.5 * (0.25 + 0.75 * len(toks[i]) / avg)) for t in ("fish fish river".split() if qid == 1 else []))
        assert s == pytest.approx(want)
    assert [i for q2, i in sorted(got) if q2 == 2] == [0, 1, 2, 3] and len(got) == 8


@pytest.mark.parametrize("values,want", [([1, 1, 1], [5, 5, 5]), ([0.7], [5]), ([0.0, 1000.0], [0, 10]), ([0.1, 0.2, 0.15], [0, 10, 0.0669])])
def test_calibration(spark, values, want):
    out = [r.rerank_score for r in retrieval.calibrate_exp(scores(spark, {1: values})).orderBy("id").collect()]
    assert out == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("values,kept", [([10, 8.1, 7.9, 2], 2), ([5, 3.6, 3.4], 2), ([5, 4.95, 4.8], 2), ([5.0], 1), ([], 0)])
def test_adaptive_threshold(spark, values, kept):
    df = scores(spark, {1: values}).withColumnRenamed("logit", "rerank_score")
    assert retrieval.adaptive_threshold(df).count() == kept


def test_context_selection(spark):
    rows = [(1, d, i, float(s), t) for i, (d, s, t) in enumerate([("a", 9, "x" * 5000), ("a", 8.9, "y" * 4000), ("b", 7.5, "z"), ("b", 7.0, "z"), ("c", 6.9, "w"), ("d", 7.2, "v")])]
    hits = spark.createDataFrame(rows, "qid int, doc_id string, id int, rerank_score double, text string")
    assert [(r.doc_id, r.n_chunks) for r in context.best_documents(hits).orderBy("doc_rank").collect()] == [("a", 2), ("b", 2)]
    kept = context.select_chunks(hits)
    assert [r.id for r in kept.where("doc_id = 'a'").collect()] == [0]
    assert kept.where("doc_id = 'b'").count() == 1
    out = context.without_repeats(hits, "qid", "id").orderBy("id").collect()
    assert [r.number for r in out] == [1, 2, 3, 4, 5] and 3 not in [r.id for r in out]


def test_expansion(spark):
    syn = expansion.synonyms(spark, expansion.SAMPLE)
    q = spark.createDataFrame([(1, "open source license"), (2, "API docs"), (3, "api server password")], "qid int, query string")
    plain = {r.qid: r.added for r in expansion.expand(q, syn).collect()}
    assert plain == {1: ["free software", "licence", "permit"], 2: [], 3: ["passphrase", "secret"]}
    assert {r.qid: r.added for r in expansion.expand(q, syn, fold=True).collect()}[2] == ["interface"]
    more = expansion.synonyms(spark, {"license": ["x"]})
    assert {r.qid: r.added for r in expansion.expand(q, expansion.with_added(syn, more)).collect()}[1] == ["free software", "x"]


@pytest.mark.parametrize("level", [1, 10, 50, 100])
def test_no_row_above_the_level(spark, sf, level):
    from plumbline.plans.tables import documents

    seen = access.visible(documents(spark, sf), level)
    assert seen.agg(F.max("access_level")).first()[0] <= level
    page = catalog.page(seen, [F.desc("id")], 1, 500)
    assert page.count() <= 100


def test_the_access_filter_is_below_the_ranking(spark, sf):
    from plumbline.plans.tables import documents

    plan = catalog.page(access.visible(documents(spark, sf), 50), [F.desc("id")], 1, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Limit") < plan.index("Filter")
    assert "Python" not in plan


def test_replace_document_leaves_no_orphans(spark):
    old = spark.createDataFrame([("d", i) for i in range(5)] + [("e", 0)], "document_id string, n int")
    new = spark.createDataFrame([("d", 9)], "document_id string, n int")
    assert sorted(map(tuple, catalog.replace_document(old, new).collect())) == [("d", 9), ("e", 0)]


def test_positions_of_hits_in_the_corpus(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-50, 10_000), 700)
    docs = spark.createDataFrame([(i, f"word{i % 9} text") for i in ids], "id long, text string").repartition(5)
    hits = spark.createDataFrame([(q, rng.choice(ids)) for q in range(60)], "qid long, id long")
    got = retrieval.with_positions(hits, retrieval.build_index(docs)).collect()
    want = {i: n + 1 for n, i in enumerate(sorted(ids))}
    assert len(got) == 60 and all(r.position == want[r.id] for r in got)


def test_scratch_tables_are_cleared(spark):
    df = stores.stored(spark.range(3), "three")
    assert df.count() == 3 and stores.listed(spark, stores.scratch_dir(spark))
    stores.clear_scratch(spark)
    assert stores.listed(spark, stores.scratch_dir(spark)) == [] and stores.stored(spark.range(2), "two").count() == 2
