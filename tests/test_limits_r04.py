"""Results at limits that are those of the SQL, and jobs that hold little at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import diagnostics, keywords, retrieval, segments
from plumbline.plans import tables


def test_a_mean_is_that_of_scores_added_by_rank(spark):
    n = 13 * 789
    score = lambda q, r: (q + 50 * r) % 13 / 3
    hits = spark.range(20 * n).select((F.col("id") % 20).alias("qid"), F.lit("a b").alias("query"), F.lit("a").alias("text"), F.floor(F.col("id") / 20).alias("rank"))
    hits = hits.withColumn("score", (F.col("qid") + 50 * F.col("rank")) % 13 / 3)
    want = {}
    for q in range(20):
        total = 0.0
        for r in range(n):
            total += score(q, r)
        want[q] = "low_mean" if total / n < 2 else ""
    assert set(want.values()) == {"low_mean", ""}
    assert {r.qid: r.issues for r in diagnostics.quality_issues(hits.repartition(7)).collect()} == want


def _in_blocks(monkeypatch, search, **limits):
    """What a search gives row by row, and what it gives in blocks."""
    rows = lambda: sorted(tuple(r) for r in search().select("qid", "id", "rank", F.round("score", 6)).collect())
    want = rows()
    with monkeypatch.context() as m:
        for name, value in ({"MOST_BROADCAST": 3} | limits).items():
            m.setattr(retrieval, name, value)
        m.setattr(retrieval, "bm25", None)
        return want, rows()


def test_a_posting_is_dealt_out_once_however_many_queries_there_are(spark, sf, monkeypatch):
    texts = tables.documents(spark, sf).select("id", "text")
    index = retrieval.build_index(texts)
    asked = texts.where("id % 9 < 2").select(F.concat(F.lit("q"), "id").alias("qid"), F.substring("text", 1, 200).alias("query"))
    asked = asked.unionByName(asked.select(F.concat("qid", F.lit("b")).alias("qid"), "query"))
    for limits in ({}, {"BLOCK": 13}, {"BLOCK": 50, "QUERIES": 5, "CELLS": 3, "DENSE": 0.3, "MOST_DENSE": 2}):
        want, got = _in_blocks(monkeypatch, lambda: retrieval.bm25_top(index, asked, 5), **limits)
        assert got == want, limits
    monkeypatch.setattr(retrieval, "BLOCK", 13)
    plan = retrieval.bm25_blocks(index, retrieval.asked_tokens(asked), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_blocks_pass_over_what_is_gone_or_above_the_level(spark, tmp_path, monkeypatch):
    row = lambda i: (i, f"word{i % 5} word{i % 3} other{i % 2} w{i}", i % 100)
    kept = segments.Segments(spark, str(tmp_path / "index"))
    frame = lambda ids: spark.createDataFrame([row(i) for i in ids], "id long, text string, access_level int")
    kept.append(frame(range(120)))
    kept.append(frame([3, 4, 130]))
    kept.append(spark.createDataFrame([(7, "word1 again", 5), (7, "word1 word2", 5)], "id long, text string, access_level int"))
    kept.delete(frame([5, 10]))
    index, _ = kept.view(40, now=1)
    asked = spark.createDataFrame([(i, f"word{i % 5} other{i % 2} w{i} again") for i in range(60)], "qid long, query string")
    want, got = _in_blocks(monkeypatch, lambda: retrieval.bm25_top(index, asked, 4), BLOCK=11)
    assert got == want and len(got) == 240


def test_blocks_of_tokens_that_count_against_a_text(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "aa bb cc"), (4, "aa")], "id long, text string")
    index = retrieval.build_index(texts)
    asked = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "bb cc"), (4, "zz yy")], "qid long, query string")
    assert index.tokens.where("idf < 0").count()
    want, got = _in_blocks(monkeypatch, lambda: retrieval.bm25_top(index, asked, 3))
    assert got == want


def test_a_block_without_living_texts_of_a_query():
    rows = [(1, 5, -1, 4), (1, 5, 0, 2), (1, 6, 1, 1), (2, 5, 1, 1), (1, 5, 0, 1)]
    texts = pa.table({c: pa.array(v, t) for c, v, t in zip(("seg", "id", "code", "tf"), zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int32()))})
    block = retrieval._Texts(texts, 1.5, 0.75, 4.0)
    ids, scores = block.best(np.array([1]), np.array([2.0]), 3)
    assert len(ids) == len(scores) == 0
    ids, scores = block.best(np.array([0, 1]), np.array([1.0, 2.0]), 3)
    assert ids.tolist() == [5] and scores.tolist() == [round(2 * 2.5 / 3.5 + 1 * 2.5 / 2.5, 9)]


def test_terms_that_cannot_be_candidates_are_not_dealt_out(spark, sf, monkeypatch):
    docs = tables.documents(spark, sf).select(F.concat(F.lit("d"), "id").alias("id"), "text")
    docs = docs.unionByName(spark.createDataFrame([("none", None), ("empty", ""), ("stop", "и в не"), ("one", "alone"), ("ties", " ".join(f"x{i} y{i}" for i in range(40)))], docs.schema))
    tf, n = keywords.ngrams(docs), docs.count()
    score = F.round(F.col("tf") * F.log((F.lit(n) + 1) / F.col("df")), 6)
    rated = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").select("id", "term", score.alias("score")).collect()
    by_text = {}
    for r in rated:
        by_text.setdefault(r.id, []).append((-r.score, r.term))
    want = {i: sorted(t, key=lambda x: (x[0], x[1].encode()))[:20] for i, t in by_text.items()}
    assert len(want["ties"]) == 20 and "stop" not in want
    for limits in ({}, {"FREQUENT": 50, "TOKENS": 3000, "SHARE": 20_000}):
        for name, value in limits.items():
            monkeypatch.setattr(keywords, name, value)
        found = keywords.candidates(docs)
        assert {r.id: [(x.s, x.term) for x in r.terms] for r in found.collect()} == want, limits
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "explode" not in plan and "Join" not in plan
