"""Queries of diagnostics, profiles and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import diagnostics
from plumbline.plans.tables import load
from plumbline.streaming import jobs

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


#: Stages: a document is a hit of query doc_id % 7, at three stages with falling counts.
_STAGES = """st AS (SELECT doc_id % 7 AS qid, s.s AS stage, text, (doc_id % 101) / 10.0 AS score, doc_id FROM documents, (VALUES ('vector', 1), ('rerank', 3), ('final', 9)) AS s(s, m) WHERE (doc_id // 7) % s.m = 0),
h AS (SELECT *, contains(lower(text), 'license') OR contains(lower(text), 'the ') AS hit FROM st)"""


def _stages(spark, sf):
    d = load(spark, sf, "documents")
    each = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(m).alias("m")) for s, m in (("vector", 1), ("rerank", 3), ("final", 9))))
    df = d.select("doc_id", (F.col("doc_id") % 7).alias("qid"), "text", ((F.col("doc_id") % 101) / 10).alias("score"), F.inline(each))
    return df.where(F.floor(F.col("doc_id") / 7) % F.col("m") == 0).withColumn("keywords", F.array(F.lit("license"), F.lit("The ")))


@query(f"WITH {_STAGES} SELECT qid, stage, count(*) FILTER (hit) AS n_relevant, count(*) FILTER (NOT hit) AS n_irrelevant, round(count(*) FILTER (hit) / count(*), 6) AS ratio FROM h GROUP BY qid, stage")
def stage_relevance(spark, sf):
    return diagnostics.stage_relevance(_stages(spark, sf))


@query(f"""WITH {_STAGES}, b AS (SELECT qid, count(*) FILTER (lost) AS n_lost_stages FROM (SELECT qid, stage, count(*) FILTER (NOT hit) > count(*) FILTER (hit) AS lost FROM h GROUP BY qid, stage) GROUP BY qid),
f AS (SELECT qid, count(*) FILTER (stage = 'rerank' AND NOT hit AND score > 5) AS n_high_irrelevant, count(*) FILTER (stage = 'final' AND NOT hit) AS n_final_irrelevant,
  round(max(score) FILTER (stage = 'rerank') - min(score) FILTER (stage = 'rerank'), 6) AS score_range, round(min(score) FILTER (stage = 'final'), 6) AS lowest_final FROM h GROUP BY qid)
SELECT qid, n_high_irrelevant, n_final_irrelevant, score_range::DOUBLE AS score_range, lowest_final::DOUBLE AS lowest_final, n_lost_stages, CASE WHEN n_final_irrelevant > 0 THEN 'critical' WHEN n_high_irrelevant > 0 OR n_lost_stages > 0 THEN 'leak'
  WHEN coalesce(score_range, 0) < 1 OR coalesce(lowest_final, 0) < 3 THEN 'warning' ELSE 'ok' END AS summary FROM f JOIN b USING (qid)""")
def leak_report(spark, sf):
    return diagnostics.leak_report(_stages(spark, sf))


@query("""WITH h AS (SELECT doc_id % 50 AS qid, 'the licence' AS query, text, (doc_id % 13) / 3.0 AS score, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank FROM documents),
g AS (SELECT qid, max(score) AS best, avg(score) AS mean, max(score) - min(score) AS spread, count(*) FILTER (rank <= 3 AND NOT list_has_any(regexp_split_to_array(lower(query), '[ \\n]+'), regexp_split_to_array(lower(text), '[ \\n]+'))) AS missed FROM h GROUP BY qid)
SELECT qid, concat_ws(',', CASE WHEN best < 3 THEN 'low_max' END, CASE WHEN mean < 2 THEN 'low_mean' END, CASE WHEN spread < 0.5 THEN 'flat_scores' END, CASE WHEN missed > 0 THEN 'no_query_words' END) AS issues FROM g""")
def quality_issues(spark, sf):
    from pyspark.sql.window import Window

    d = load(spark, sf, "documents").select((F.col("doc_id") % 50).alias("qid"), "doc_id", F.lit("the licence").alias("query"), "text", ((F.col("doc_id") % 13) / 3).alias("score"))
    return diagnostics.quality_issues(d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size / 10.0 < 2 THEN 'rebuild_index' END, CASE WHEN p_size / 10.0 >= 2 AND p_size / 10.0 < 4 THEN 'rephrase' END, CASE WHEN p_partkey % 100 / 100.0 > 0.8 THEN 'threshold_too_strict' END,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'one_side_empty' END, CASE WHEN len(regexp_split_to_array(trim(p_type), '\\s+')) < 3 THEN 'query_too_short' END) AS advice FROM part""")
def recommendations(spark, sf):
    k = F.col("p_partkey")
    advice = diagnostics.recommendations(F.col("p_size") / 10, k % 100 / 100, k % 5, k % 7, F.col("p_type"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(advice, ",").alias("advice"))


@query("""WITH v AS (SELECT o_custkey % 20 AS qid, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey % 20 AS qid, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0)
SELECT v.qid, count(*) AS n_vector, count(b.id) AS n_both, round(count(b.id) / count(*), 6) AS ratio FROM v LEFT JOIN b ON v.qid = b.qid AND v.id = b.id GROUP BY v.qid""")
def retrieval_overlap(spark, sf):
    o = load(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("qid"), F.col("o_orderkey").alias("id"))
    return diagnostics.retrieval_overlap(o.where("id % 2 = 0"), o.where("id % 3 = 0"))


def _runs(spark, sf):
    return load(spark, sf, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string")).alias("operation"), F.col("value").alias("duration"), F.struct("ts", "event_id").alias("ts"), "user_id")


_RUNS = "r AS (SELECT event_type || '-' || (user_id % 4) AS operation, value AS duration, ts, event_id, user_id FROM events)"


@query(f"""WITH {_RUNS}, l AS (SELECT operation, arg_max(duration, (ts, event_id)) AS duration FROM r GROUP BY operation)
SELECT round(sum(duration), 6) AS total, count(*) AS n_operations, round(max(duration), 6) AS peak, (SELECT string_agg(operation, ',' ORDER BY duration DESC, operation DESC) FROM (SELECT * FROM l ORDER BY duration DESC, operation LIMIT 5)) AS slowest FROM l""")
def profiler_summary(spark, sf):
    return diagnostics.profiler_summary(_runs(spark, sf))


@query(f"WITH {_RUNS} SELECT operation, count(*) AS n_runs, round(avg(duration), 6) AS avg, round(min(duration), 6) AS min, round(max(duration), 6) AS max, round(stddev_pop(duration), 6) AS std FROM r GROUP BY operation")
def run_stats(spark, sf):
    return diagnostics.run_statistics(_runs(spark, sf))


@query(f"""WITH {_RUNS}, p AS (SELECT user_id, operation, sum(duration) AS spent FROM r GROUP BY user_id, operation),
s AS (SELECT *, spent / sum(spent) OVER (PARTITION BY user_id) AS share, spent / min(spent) OVER (PARTITION BY user_id) AS sl FROM p)
SELECT user_id, operation, round(spent, 4) AS spent, round(share, 6) AS share, share > 0.5 AS bottleneck, CASE WHEN sl > 10 THEN 'critical' WHEN sl > 3 THEN 'slow' ELSE 'normal' END AS grade FROM s""")
def stage_share(spark, sf):
    return diagnostics.stage_share(_runs(spark, sf), "user_id")


@query("SELECT count(*) AS n_processed, count(*) FILTER (event_type = 'view') AS n_cache_hits, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate, round(avg(value), 6) AS avg_duration FROM events")
def batch_stats(spark, sf):
    return diagnostics.batch_statistics(load(spark, sf, "events").select((F.col("event_type") == "view").alias("cached"), F.col("value").alias("duration")))


@query("""WITH c AS (SELECT event_id AS result, user_id AS k, floor(epoch(ts)) AS s FROM events WHERE event_type = 'purchase')
SELECT r.event_id, arg_max(c.result, (c.s, c.result)) AS result FROM events r LEFT JOIN c ON r.user_id = c.k AND floor(epoch(r.ts)) - c.s BETWEEN 0 AND 86399 GROUP BY r.event_id""")
def cached_results(spark, sf):
    """Every event asks for its user's last purchase of the day before."""
    e = load(spark, sf, "events").select("event_id", F.col("user_id").alias("cache_key"), "ts", "event_type")
    made = e.where("event_type = 'purchase'").select("cache_key", "ts", F.col("event_id").alias("result"))
    return jobs.cached(e.drop("event_type"), made, ttl_s=86400).select("event_id", "result")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1-%'")
def cache_invalidation(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cache_key"))
    return jobs.without_prefix(o, "1-").select("o_orderkey")


@query()
def rate_limit_exact(spark, sf):
    """Without SQL: whether an event is accepted depends on which were accepted before it."""
    return jobs.rate_limited(load(spark, sf, "events"), window=7 * 86400.0)
