"""Results at limits that do not depend on the order or the grain of additions."""

from pyspark.sql import functions as F

from plumbline.functions import lemmas
from plumbline.operators import diagnostics, keywords, retrieval
from plumbline.plans import tables, text_queries
from plumbline.sources import files
from plumbline.streaming import answers


def test_rates_of_short_answers_are_those_of_the_sql(spark):
    asked = 1704067211172425
    ends = [asked + d for d in range(4001, 4400)]
    stamp = lambda us: F.timestamp_micros(F.lit(us))
    said = spark.createDataFrame(list(enumerate(ends)), "answer_id long, us long").select("answer_id", F.lit(0).alias("line_no"), F.lit("x").alias("token"), F.lit(True).alias("done"), F.timestamp_micros("us").alias("ts"))
    got = {r.answer_id: r.tokens_per_s for r in answers.timings(said, said.select("answer_id", stamp(asked).alias("asked_at"))).collect()}
    assert got == {i: round(1 / (us / 1e6 - asked / 1e6), 6) for i, us in enumerate(ends)}


def test_a_mean_at_the_limit_is_not_low(spark):
    n = 13 * 789
    hits = spark.range(20 * n).select((F.col("id") % 20).alias("qid"), F.lit("a b").alias("query"), F.lit("a").alias("text"), (F.floor(F.col("id") / 20) % 13 / 3).alias("score"), F.lit(9).alias("rank"))
    assert {r.issues for r in diagnostics.quality_issues(hits.repartition(7)).collect()} == {""}


def test_a_share_of_three_times_the_least_is_not_slow(spark):
    runs = spark.createDataFrame([(1, "a", 0.1), (1, "a", 0.2), (1, "b", 0.1)], "user_id long, operation string, duration double")
    assert {r.operation: (r.grade, r.share) for r in diagnostics.stage_share(runs, "user_id").collect()} == {"a": ("normal", 0.75), "b": ("normal", 0.25)}


def test_rows_of_a_long_table_are_limited_in_each_task(spark, sf):
    plan = text_queries.csv_row_text(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    rows = spark.createDataFrame([("a", i, f"v{i}") for i in range(1, 5)] + [(None, 1, "w"), ("c", 1, " ")], "g string, n int, x string")
    got = {r.g: r.text for r in files.csv_text(rows, "g", "n", ["x"], most=3).collect()}
    note = "... (файл содержит больше строк, показаны первые 3)"
    assert got == {"a": f"Заголовки: x\nСтрока 1: x: v1\nСтрока 2: x: v2\nСтрока 3: x: v3\n{note}", None: "Заголовки: x\nСтрока 1: x: w"}


def test_many_queries_are_scored_in_blocks(spark, sf, monkeypatch):
    texts = tables.documents(spark, sf).select("id", "text")
    index = retrieval.build_index(texts)
    asked = texts.where("id % 9 = 0").select(F.concat(F.lit("q"), "id").alias("qid"), F.substring("text", 1, 200).alias("query"))
    rows = lambda: sorted(tuple(r) for r in retrieval.bm25_top(index, asked, 5).select("qid", "id", "rank", F.round("score", 6)).collect())
    want = rows()
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 3)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    calls = []
    monkeypatch.setattr(retrieval, "bm25", lambda *a, **b: calls.append(a))
    assert rows() == want and not calls


def test_terms_of_a_text_are_counted_where_they_are(spark, sf):
    plan = keywords.ngrams(tables.documents(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_COL" in plan


def test_many_queries_of_one_token_need_no_blocks(spark, sf, monkeypatch):
    texts = tables.documents(spark, sf).select("id", "text")
    index = retrieval.build_index(texts)
    words = [r.token for r in index.tokens.orderBy(F.desc("n_docs_with"), "token").limit(40).collect()]
    asked = spark.createDataFrame([(w, w) for w in words] + [("twice", f"{words[3]} {words[3]}")], "qid string, query string")
    both = asked.unionByName(spark.createDataFrame([("two", f"{words[0]} {words[5]}")], asked.schema))
    rows = lambda q: sorted(tuple(r) for r in retrieval.bm25_top(index, q, 5).select("qid", "id", "rank", F.round("score", 6)).collect())
    want = rows(both)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 3)
    blocks, real = [], retrieval.bm25_blocks
    monkeypatch.setattr(retrieval, "bm25_blocks", lambda i, a, *x, **y: blocks.append({r.qid for r in a.collect()}) or real(i, a, *x, **y))
    assert rows(both) == want and blocks == [{"two"}]
    assert rows(asked) == [r for r in want if r[0] != "two"] and len(blocks) == 1


def test_texts_are_cut_into_lemmas_once(spark, sf):
    found = text_queries.lemma_frequency(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "explode" not in plan
    docs = spark.createDataFrame([(1, "cats cat the 12 cats"), (2, None), (3, "cats")], "id long, text string")
    got = {(r.id, r.token): r.n for r in lemmas.lemma_counts(docs, stop=("the",)).groupBy("id", "token").agg(F.sum("n").alias("n")).collect()}
    assert got == {(1, "cat"): 3, (3, "cat"): 1}
