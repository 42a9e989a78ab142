"""Who may see what. The access filter always stands below ranking and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least level of a user for each route.
ROUTE_LEVELS = [("upload", 10), ("list", 1), ("read", 1), ("stats", 1), ("chunks", 1), ("delete", 10), ("chunk_edit", 20), ("chunk_delete", 20), ("keyword_backfill", 90)]
LOWEST, HIGHEST = 1, 100


def visible(df: DataFrame, level: int, column: str = "access_level") -> DataFrame:
    """Rows at or below the user's level."""
    return df.where(F.col(column) <= F.lit(level))


def owner_or_admin(role: Column, user: Column, owner: Column) -> Column:
    return (role == "ADMIN") | (user == owner)


def gates(users: DataFrame, level: str = "access_level") -> DataFrame:
    """Each user with each route and whether the route is open to them. There are nine routes."""
    each = F.array(*(F.struct(F.lit(r).alias("route"), F.lit(n).alias("min_level")) for r, n in ROUTE_LEVELS))
    return users.select("*", F.inline(each)).withColumn("allowed", F.col(level) >= F.col("min_level"))


def may_reach(user_level: Column, wanted: Column) -> Column:
    return wanted.between(LOWEST, HIGHEST) & (wanted <= user_level)


def request_errors(message: Column, weight: Column, top_k: Column, rerank_top_k: Column, limit: Column) -> Column:
    """Names of the fields of a request that are out of bounds."""
    checks = [
        (~F.length(message).between(1, 2000) | message.isNull(), "message"),
        (~weight.between(0, 1), "weight"),
        (~top_k.between(1, 100), "top_k"),
        (~rerank_top_k.between(1, 50), "rerank_top_k"),
        (~limit.between(1, 100), "limit"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))


def upload_errors(title: Column, level: Column) -> Column:
    blank = (F.length(F.trim(title)) == 0) | title.isNull() | (F.length(title) > 255)
    return F.array_compact(F.array(F.when(blank, F.lit("title")), F.when(~level.between(LOWEST, HIGHEST), F.lit("level"))))


#: Fixed value: how many queries a batch has at most.
MOST_BATCH = 10


def batch_ok(n: Column) -> Column:
    return n.between(1, MOST_BATCH)


def own(df: DataFrame, owner: str, user: Column) -> DataFrame:
    """The rows of a user."""
    return df.where(F.col(owner) == user)
