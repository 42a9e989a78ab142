"""Where relevance is lost, and where time goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def relevant(body: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(F.lower(body), F.lower(k)))


def stage_relevance(stages: DataFrame) -> DataFrame:
    """stages: qid, stage, text, keywords, score. Relevant and irrelevant hits of each stage."""
    hit = relevant(F.col("text"), F.col("keywords"))
    out = stages.groupBy("qid", "stage").agg(F.count_if(hit).alias("n_relevant"), F.count_if(~hit).alias("n_irrelevant"))
    return out.withColumn("ratio", F.round(F.col("n_relevant") / (F.col("n_relevant") + F.col("n_irrelevant")), 6))


def leak_report(stages: DataFrame, high: float = 5.0, low: float = 3.0) -> DataFrame:
    """Findings of each query, and the gravest as summary."""
    hit, score = relevant(F.col("text"), F.col("keywords")), F.col("score")
    at = lambda s: F.col("stage") == s
    by_stage = stages.groupBy("qid", "stage").agg((F.count_if(~hit) > F.count_if(hit)).alias("lost"))
    lost = by_stage.groupBy("qid").agg(F.count_if("lost").alias("n_lost_stages"))
    found = stages.groupBy("qid").agg(
        F.count_if(at("rerank") & ~hit & (score > high)).alias("n_high_irrelevant"),
        F.count_if(at("final") & ~hit).alias("n_final_irrelevant"),
        F.round(F.max(F.when(at("rerank"), score)) - F.min(F.when(at("rerank"), score)), 6).alias("score_range"),
        F.round(F.min(F.when(at("final"), score)), 6).alias("lowest_final"),
    )
    df = found.join(lost, "qid")
    warn = (F.coalesce("score_range", F.lit(0.0)) < 1) | (F.coalesce("lowest_final", F.lit(0.0)) < low)
    summary = F.when(F.col("n_final_irrelevant") > 0, "critical").when((F.col("n_high_irrelevant") > 0) | (F.col("n_lost_stages") > 0), "leak").when(warn, "warning").otherwise("ok")
    return df.withColumn("summary", summary)


def quality_issues(hits: DataFrame) -> DataFrame:
    """hits: qid, query, text, score, rank."""
    w = lambda c: F.split(F.lower(c), r"[ \n]+")
    missed = (F.col("rank") <= 3) & ~F.arrays_overlap(w(F.col("query")), w(F.col("text")))
    s, order = F.col("score"), Window.partitionBy("qid").orderBy("rank", F.desc("score"))
    # Scores are added in the order of rank, of one rank the higher first, so that a mean at the limit
    # is the one that the SQL has over its ordered rows, however the hits are dealt out.
    rows = hits.select("qid", "rank", "score", missed.alias("missed"))
    rows = rows.withColumn("_mean", F.avg(s).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(order))
    out = rows.groupBy("qid").agg(F.max(s).alias("best"), F.max_by("_mean", "_n").alias("mean"), (F.max(s) - F.min(s)).alias("spread"), F.count_if("missed").alias("n_missed"))
    checks = [(F.col("best") < 3, "low_max"), (F.col("mean") < 2, "low_mean"), (F.col("spread") < 0.5, "flat_scores"), (F.col("n_missed") > 0, "no_query_words")]
    return out.select("qid", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks))), ",").alias("issues"))


def recommendations(best: Column, filtered_ratio: Column, n_vector: Column, n_words: Column, query: Column) -> Column:
    checks = [
        (best < 2, "rebuild_index"), ((best >= 2) & (best < 4), "rephrase"), (filtered_ratio > 0.8, "threshold_too_strict"),
        ((n_vector == 0) | (n_words == 0), "one_side_empty"), (F.size(F.split(F.trim(query), r"\s+")) < 3, "query_too_short"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))


def retrieval_overlap(vector: DataFrame, words: DataFrame) -> DataFrame:
    """Hits that both sides have, as a share of the vector side."""
    n = vector.groupBy("qid").agg(F.count("*").alias("n_vector"))
    both = vector.select("qid", "id").intersect(words.select("qid", "id")).groupBy("qid").agg(F.count("*").alias("n_both"))
    return n.join(both, "qid", "left").select("qid", "n_vector", F.coalesce("n_both", F.lit(0)).alias("n_both"), F.round(F.coalesce("n_both", F.lit(0)) / F.greatest("n_vector", F.lit(1)), 6).alias("ratio"))


def with_texts(trace: DataFrame, texts: DataFrame, queries: DataFrame, keywords: Column) -> DataFrame:
    """The hits of a traced search as stage_relevance() and leak_report() take them.
    keywords: an array over the query, those that tell a relevant text."""
    return trace.join(texts.select("id", "text"), "id").join(queries.select("qid", "query", keywords.alias("keywords")), "qid")


def diagnosis(trace: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each query of a traced search: what every stage kept, the range and the
    threshold of the reranked scores, the overlap of the sides, what is wrong with the final
    hits, and advice. trace: qid, stage, rank, id, score, read once for the counts."""
    at = lambda s: F.col("stage") == s
    n = {f"n_{s}": F.count_if(at(s)) for s in ("vector", "bm25", "fused", "rerank", "final")}
    scored = F.when(at("rerank"), F.col("score"))
    counts = trace.groupBy("qid").agg(*(c.alias(k) for k, c in n.items()), F.max(scored).alias("best"), F.min(scored).alias("worst"))
    both = trace.where(F.col("stage").isin("vector", "bm25")).groupBy("qid", "id").agg(F.count("*").alias("n")).groupBy("qid").agg(F.count_if(F.col("n") == 2).alias("n_both"))
    final = trace.where(at("final")).join(texts.select("id", "text"), "id").join(queries.select("qid", "query"), "qid")
    issues = quality_issues(final.select("qid", "query", "text", "score", "rank"))
    df = queries.select("qid", "query").join(counts, "qid", "left").join(both, "qid", "left").join(issues, "qid", "left").fillna(0, [*n, "n_both"])
    lost = F.when(F.col("n_rerank") > 0, 1 - F.col("n_final") / F.greatest("n_rerank", F.lit(1))).otherwise(0.0)
    spread = F.col("best") - F.col("worst")
    limit = F.when(spread > 2, F.col("best") * 0.8).when(spread > 1, F.col("best") * 0.7).otherwise(F.col("best") - 0.1)
    advice = recommendations(F.coalesce("best", F.lit(0.0)), lost, F.col("n_vector"), F.col("n_bm25"), F.col("query"))
    return df.select(
        "qid", *n, "n_both", F.round("best", 6).alias("best"), F.round(spread, 6).alias("spread"), F.round(limit, 6).alias("threshold"), F.round(lost, 6).alias("filtered_ratio"),
        F.coalesce("issues", F.lit("no_results")).alias("issues"), F.array_join(advice, ",").alias("advice"),
    )


def profiler_summary(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last measurement of each operation counts. One row, with the slowest n."""
    last = runs.groupBy("operation").agg(F.max_by("duration", "ts").alias("duration"))
    slow = last.orderBy(F.desc("duration"), "operation").limit(n)
    named = slow.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("duration", "operation")))), lambda s: s["operation"]), ",").alias("slowest"))
    total = last.agg(F.round(F.sum("duration"), 6).alias("total"), F.count("*").alias("n_operations"), F.round(F.max("duration"), 6).alias("peak"))
    return total.join(F.broadcast(named), F.lit(True))


def run_statistics(runs: DataFrame) -> DataFrame:
    d = F.col("duration")
    return runs.groupBy("operation").agg(F.count("*").alias("n_runs"), *(F.round(f(d), 6).alias(n) for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"), (F.stddev_pop, "std"))))


def stage_share(runs: DataFrame, by: str) -> DataFrame:
    """Each operation's share of its group's time; above a half it is the bottleneck.
    Against the fastest operation, above 10 is critical and above 3 slow."""
    # Sums are rounded, so that what lies at a limit does not depend on the order of addition.
    per = runs.groupBy(by, "operation").agg(F.round(F.sum("duration"), 9).alias("spent"))
    w = Window.partitionBy(by)
    df = per.withColumn("share", F.col("spent") / F.round(F.sum("spent").over(w), 9)).withColumn("slowdown", F.col("spent") / F.min("spent").over(w))
    grade = F.when(F.col("slowdown") > 10, "critical").when(F.col("slowdown") > 3, "slow").otherwise("normal")
    return df.select(by, "operation", F.round("spent", 4).alias("spent"), F.round("share", 6).alias("share"), (F.col("share") > 0.5).alias("bottleneck"), grade.alias("grade"))


def batch_statistics(requests: DataFrame) -> DataFrame:
    """requests: cached, duration."""
    hits = F.count_if("cached")
    return requests.agg(F.count("*").alias("n_processed"), hits.alias("n_cache_hits"), F.round(hits / F.count("*"), 6).alias("hit_rate"), F.round(F.avg("duration"), 6).alias("avg_duration"))


def keyword_summary(chunks: DataFrame, most: int = 15) -> DataFrame:
    """chunks: id, keywords. The commonest keywords of each document, ties by name."""
    counts = chunks.select("id", F.explode("keywords").alias("keyword")).groupBy("id", "keyword").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy(F.desc("n"), "keyword")
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    rows = F.array_sort(F.collect_list(F.struct("r", "keyword")))
    return kept.groupBy("id").agg(F.array_join(F.transform(rows, lambda x: x["keyword"]), ",").alias("keywords"))


def keyword_classes(chunks: DataFrame, classes: list[str], most: int = 15, total: int = 20) -> DataFrame:
    """chunks: id and an array of keywords for each class. Of each document the commonest
    `most` of each class, one class after the other, `total` at most."""
    each = F.array(*(F.struct(F.lit(i).alias("class"), F.col(c).alias("words")) for i, c in enumerate(classes)))
    rows = chunks.select("id", F.inline(each)).select("id", "class", F.explode("words").alias("keyword"))
    counts = rows.groupBy("id", "class", "keyword").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id", "class").orderBy(F.desc("n"), "keyword")
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    found = F.slice(F.array_sort(F.collect_list(F.struct("class", "r", "keyword"))), 1, total)
    return kept.groupBy("id").agg(F.array_join(F.transform(found, lambda x: x["keyword"]), ",").alias("keywords"))


#: Fixed value: memory, in MB, from which an operation is heavy.
HEAVY = 100


def memory_summary(runs: DataFrame) -> DataFrame:
    """operation, memory (of its last run), heavy, and the peak and the sum over operations."""
    last = runs.groupBy("operation").agg(F.max_by("memory", "ts").alias("memory"))
    total = last.agg(F.round(F.max("memory"), 6).alias("peak"), F.round(F.sum("memory"), 6).alias("total"))
    return last.join(F.broadcast(total), F.lit(True)).select("operation", F.round("memory", 6).alias("memory"), (F.col("memory") > HEAVY).alias("heavy"), "peak", "total")


def slowest(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n operations of the largest mean duration."""
    mean = runs.groupBy("operation").agg(F.avg("duration").alias("mean"))
    return mean.orderBy(F.desc("mean"), "operation").limit(n).select("operation", F.round("mean", 6).alias("mean"))


def pipeline_statistics(runs: DataFrame) -> DataFrame:
    """One row: how many runs, and the mean, least and largest sum of durations of a run."""
    total = runs.groupBy("run").agg(F.sum("duration").alias("total"))
    return total.agg(F.count("*").alias("n_runs"), *(F.round(f("total"), 6).alias(k) for f, k in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))))


def cache_statistics(entries: DataFrame, now: Column) -> DataFrame:
    """entries: key (its prefix before the first colon), written, ttl (both in seconds) and
    value. A row for each prefix, in one pass: keys, those alive at a given time, their oldest
    and mean age, the next expiry, and the bytes of their values. A key without a colon is its
    own prefix; null keys don't count."""
    age, left = now - F.col("written"), F.col("ttl") - (now - F.col("written"))
    alive = left > 0
    of = lambda c: F.when(alive, c)
    return entries.where(F.col("key").isNotNull()).groupBy(F.substring_index("key", ":", 1).alias("prefix")).agg(
        F.count("*").alias("n_keys"), F.count_if(alive).alias("n_alive"), F.max(of(age)).alias("oldest_s"), F.min(of(left)).alias("next_expiry_s"),
        F.round(F.avg(of(age)), 6).alias("mean_age_s"), F.coalesce(F.sum(of(F.octet_length("value")).cast("long")), F.lit(0)).alias("n_bytes"),
    )
