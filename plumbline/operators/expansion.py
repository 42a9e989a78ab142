"""Query expansion by a dictionary of synonyms, which is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANY, FEW = 3, 2
TECHNICAL = ("api", "server", "database", "token", "код", "систем")
#: For tests; real dictionaries are read by read_synonyms().
SAMPLE = {"license": ["licence", "permit", "grant"], "password": ["passphrase", "secret"], "open source": ["free software"], "API": ["interface"]}


def synonyms(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(list(entries.items()), "term string, synonyms array<string>")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of term to list."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("term", "synonyms"))


def with_added(table: DataFrame, added: DataFrame) -> DataFrame:
    """Added terms replace those of the same name."""
    return table.join(added, "term", "left_anti").unionByName(added)


def terms(query: Column) -> Column:
    """Words of two letters or more, their pairs and triples."""
    w = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))

    def grams(n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.array_distinct(F.concat(w, grams(2), grams(3)))


def expand(queries: DataFrame, table: DataFrame, most: Column | int = FEW, fold: bool = False) -> DataFrame:
    """qid, query, added (sorted synonyms, `most` of each term that matches) and
    expanded. Terms are lower case, so keys that are not match only with fold."""
    most = F.lit(most) if isinstance(most, int) else most
    key = F.lower("term") if fold else F.col("term")
    each = queries.select("qid", most.alias("most"), F.explode(terms(F.col("query"))).alias("_t"))
    hits = each.join(table.select(key.alias("_t"), "synonyms"), "_t").select("qid", F.explode(F.slice("synonyms", F.lit(1), F.col("most"))).alias("s"))
    added = hits.groupBy("qid").agg(F.array_sort(F.collect_set("s")).alias("added"))
    out = queries.join(added, "qid", "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    return out.withColumn("expanded", F.concat_ws(" ", "query", F.array_join("added", " ")))


def expand_smart(queries: DataFrame, table: DataFrame, stems: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """More synonyms for queries with a technical stem."""
    technical = F.lower("query").rlike("|".join(stems))
    return expand(queries, table, F.when(technical, MANY).otherwise(FEW))


def statistics(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n_terms"), F.sum(F.size("synonyms")).alias("n_synonyms"), F.avg(F.size("synonyms")).alias("avg_synonyms"))


#: Parts of terms by category.
CATEGORIES = {"tech_terms": ["api", "база", "программ", "разработ"], "business_terms": ["клиент", "продаж", "маркетинг"], "design_terms": ["дизайн", "макет", "бренд"]}


def categories(table: DataFrame) -> DataFrame:
    """One row: how many terms have a part of each category."""
    return table.agg(*(F.count_if(F.col("term").rlike("|".join(parts))).alias(k) for k, parts in CATEGORIES.items()))
