"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import retrieval, structure, vector_index
from plumbline.operators.segments import Segments
from plumbline.sources.stores import exists, shared_dir, signature

LEVEL = 50
LONG_QUERY = "licensed under the terms of this password token and the license"
QUERIES = [(0, LONG_QUERY), (1, "la licence pour les données"), (2, "api key secret"), (3, "zzzz qqqq")]
#: The same in SQL.
Q_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ") AS q(qid, query)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, source, access_level (1..100), uploaded_by."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "source", "lang", (F.col("doc_id") % 100 + 1).alias("access_level"), (F.col("doc_id") % 10).alias("uploaded_by"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 100 + 1).alias("access_level"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query, and the vector of the row of the same number."""
    q = spark.createDataFrame(QUERIES, "qid long, query string")
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return q.join(v, "qid", "left")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width chunks of documents."""
    return structure.fixed_chunks(documents(spark, sf_dir), carry=("access_level",)).withColumn("chunk_id", F.concat_ws("_", "id", "chunk_index"))


def search_index(spark: SparkSession, sf_dir: str, level: int = LEVEL) -> retrieval.Index:
    """The stored index of the documents, for readers of a level: built by the first query
    of a state of the table, and opened by all others."""
    at = f"{sf_dir}/documents.parquet"
    kept = Segments(spark, f"{shared_dir(spark)}/bm25-{signature(spark, at)}")
    if not kept.version():
        kept.append(documents(spark, sf_dir))
    return kept.view(level, time.time())[0]


def stored_vectors(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The inverted-file index of the embeddings with their levels, kept like search_index()."""
    path = f"{shared_dir(spark)}/vectors-{signature(spark, f'{sf_dir}/embeddings.parquet')}"
    if exists(spark, f"{path}/cells/_SUCCESS"):
        return vector_index.opened(spark, path)
    return vector_index.build(vectors(spark, sf_dir), path)


#: Relations that several oracles share.
DOCS = "docs AS (SELECT doc_id AS id, text, source, lang, doc_id % 100 + 1 AS access_level, doc_id % 10 AS uploaded_by FROM documents)"
CHUNKS = DOCS + """,
nums AS (SELECT id, text, access_level, unnest(range(0, greatest(1, ceil((length(text) - 100) / 900.0)::BIGINT))) AS i FROM docs),
chunks AS (SELECT id, access_level, i::INT AS chunk_index, (i * 900)::INT AS start, least(i * 900 + 1000, length(text))::INT AS "end",
  substr(text, (i * 900 + 1)::BIGINT, 1000) AS text, id || '_' || i AS chunk_id FROM nums)"""
