"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, written


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star")
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "star")
    out = (
        links.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
    )
    return out, least


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b, of one ordered type. Gives (node, root) for each node
    other than its root, the smallest id that it reaches. Links with a null end, or
    from a node to itself, join nothing; repeated links count once; no links give no rows.

    The number of rounds grows with the logarithm of the longest path. After each,
    the links are written in the shared folder, and what the round was made of is
    deleted. Only a count and a checksum of the links reach the driver."""
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, before = written(ordered.distinct(), "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        large, one = _large_star(links)
        small, two = _small_star(large)
        old, links = links, written(small.distinct(), "links")
        dropped(old, one, two)
