"""Mixing sources to target weights, by Pareto order sampling.

Every source gets a share of the words by its weight, at most MAX_COPIES times its
own words; what one source cannot take is shared again by weight. A source with
target t and size s takes whole copies of each document, floor(t / s) of them, with
certainty. The remaining r = t - floor(t / s) s words are a Pareto sample: document
i has a random u_i from a keyed digest of its id, an inclusion probability p_i, and
the rank

    q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i));

the documents of the smallest ranks are taken while the sum of their sizes, the next
one counted by half, stays within r. The sample size is thus fixed in words.
p_i is in proportion to size ** POWER, so that long documents come in more often than
short ones, but not as much more often as they are longer; documents whose p_i would
reach 1 are taken first. With power 0 each document counts alike.

The cut needs no sort of a source in one task: words are summed by source and by
BUCKETS ranges of rank, and only the one range that holds the cut is looked into. A
document is then taken or not by its own rank and one number of its source.

Defined results: a null text has size 0; a source of size 0 has target 0 and takes
nothing; null is a source, the last; rows that repeat an id share u and are taken
together; an empty table gives an empty result; columns pass through ``copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD, whole, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 4096
SEED = "mix-1"
POWER = 0.5


def size_of(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def numbered(sources: DataFrame) -> DataFrame:
    """sources with n, their place by code point, null last, from 1. They are dealt out by
    ranges, numbered within each, and moved on by the sizes of the ranges before."""
    ranges = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row for each range, whatever the number of sources.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn("n", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """sizes: a row for each source, with source and source_size. Adds target.

    All sources share by weight up to a level; those that the level fills are closed, and
    the rest shares again, until none is filled anew. Sums alone reach the driver, and the
    number of rounds is that of the levels, not of the sources."""
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    df = written(numbered(sizes).withColumn("weight", w).withColumn("most", most * F.col("source_size")).drop("n"), "weights")
    level, closed = 0.0, -1
    while True:
        full = F.col("most") < level * F.col("weight") if closed >= 0 else F.lit(False)
        open_weight = F.sum(F.when(~full, F.col("weight")))
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0))
        row = df.agg(F.count_if(full).alias("closed"), (left.cast("double") / open_weight).alias("level")).first()
        if row.level is None or row.closed == closed:
            break
        level, closed = row.level, row.closed
    return df.select("source", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def _rank(u: Column, p: Column) -> Column:
    """The Pareto rank, brought to (0, 1) without a change of order."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def pull(size: Column, power: float = POWER) -> Column:
    """What a document's inclusion is in proportion to, as an integer, so that sums are exact."""
    n = F.greatest(size, F.lit(1)).cast("double")
    return F.floor(16 * (F.sqrt(n) if power == 0.5 else F.pow(n, F.lit(power))))


def plan(slim: DataFrame, weights: tuple = WEIGHTS, power: float = POWER) -> tuple[DataFrame, Column]:
    """slim: source, size, u for each document. Gives a table with a row for each
    source (source, source_size, target, whole_copies, rate, cut), and the rank as a
    column over slim joined with it."""
    pulls = pull(F.col("size"), power)
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(pulls * F.col("size")).alias("pulled"))
    sums = written(sums, "sources")
    aimed = targets(sums.select("source", "source_size"), weights).withColumnRenamed("source", "_s")
    sources = sums.join(aimed.select("_s", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole_copies", times.cast("long")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole_copies") * F.col("source_size"))
    )
    rate = F.when(F.col("pulled") > 0, F.col("rest") / F.col("pulled")).otherwise(F.lit(0.0))
    sources = written(sources.withColumn("rate", rate).drop("pulled"), "targets")
    p = F.least(F.greatest(F.col("rate") * pulls, F.lit(1e-9)), F.lit(1 - 1e-9))
    rank = _rank(F.col("u"), p)
    ranked = _with_source(slim, sources).withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") * BUCKETS))
    by_bucket = written(ranked.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("n")), "buckets")
    run = Window.partitionBy("source").orderBy("bucket")
    by_bucket = by_bucket.withColumn("until", F.sum("n").over(run)).where(F.col("until") > F.col("rest"))
    at = by_bucket.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("until") - F.col("n")).alias("before")), "bucket").alias("c"))
    at = at.select(F.col("source").alias("_s"), F.col("c.bucket").alias("_b"), F.col("c.before").alias("_before"))
    near = ranked.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    near = near.groupBy("source", "rest", "_before", "_b", "rank").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("rank")
    over = F.col("_before") + F.sum("n").over(upto) - F.col("n") / 2 > F.col("rest")
    cuts = near.withColumn("over", over).groupBy("source").agg(
        F.min(F.when(F.col("over"), F.col("rank"))).alias("cut"), ((F.first("_b") + 1) / F.lit(BUCKETS)).alias("_end")
    )
    # Where the whole range fits by half of its last document, the cut is the range's end.
    cuts = cuts.select(F.col("source").alias("_s"), F.coalesce("cut", "_end").alias("cut"))
    sources = sources.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return written(sources.withColumn("cut", F.coalesce("cut", F.lit(2.0))), "cuts"), rank


def _with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins what is known of each source. The right side measures small for usual
    numbers of sources, so Spark broadcasts it by its size; else hot sources are split."""
    right = sources.withColumnRenamed("source", "_source")
    return df.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, power: float = POWER) -> DataFrame:
    """doc, the row as a struct, with size, source_size, target and n_copies."""
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), uniform(F.col(doc_id)).alias("u")
    )
    sources, rank = plan(written(rows.select("source", "size", "u"), "sizes"), weights, power)
    extra = (rank < F.col("cut")) & (F.col("rest") > 0) & (F.col("size") > 0)
    n = F.when(F.col("size") > 0, F.col("whole_copies")).otherwise(F.lit(0)) + extra.cast("long")
    return _with_source(rows, sources).select("doc", "size", "source_size", "target", F.least(n, F.lit(MAX_COPIES)).alias("n_copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it."""
    taken = copies(docs, doc_id, text, source).where("n_copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("_copy")).select("doc.*")
