"""Chunks in a Parquet store, and reports."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where
    that is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """Where tables lie that only cut the lineage of a result."""
    return f"{shared_dir(spark)}/scratch"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes them, once nobody reads a result that was made of them any more."""
    removed(spark, scratch_dir(spark))


def stored(df: DataFrame, name: str, path: str | None = None, *partitions: str) -> DataFrame:
    """df as a Parquet table, under path or in the scratch folder, and read again from it."""
    path = f"{path or scratch_dir(df.sparkSession)}/{name}" + ("" if path else f"-{uuid.uuid4().hex}")
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.getFileStatus(at).isDirectory()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, ascending; none if it is absent."""
    at, fs = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def signature(spark: SparkSession, path: str) -> str:
    """Tells one state of a table's files from another: their names, sizes and times."""
    at, fs = _file_system(spark, path)
    files = fs.listStatus(at)
    return hashlib.md5("\n".join(sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in files)).encode()).hexdigest()


def fresh() -> str:
    """A name that no other table has."""
    return uuid.uuid4().hex


def write_chunks(chunks: DataFrame, vectors: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Appends chunks with their vectors; keywords stay arrays. Refuses to write if a
    chunk has no vector or a vector no chunk. Returns the number of chunks. Both sides
    are read once: the join is written down, checked, and appended from there."""
    marked = vectors.select(F.col(key).alias("_key"), *(c for c in vectors.columns if c != key))
    both = stored(chunks.join(marked, F.col(key) == F.col("_key"), "full_outer"), "chunks")
    odd = both.where(F.col(key).isNull() | F.col("_key").isNull()).select(F.coalesce(key, "_key")).head()
    if odd is not None:
        raise ValueError(f"chunks and vectors differ, as in {odd[0]}")
    both.drop("_key").write.mode("append").parquet(path)
    return both.count()


def read_chunks(spark: SparkSession, path: str, level: int, *columns: str) -> DataFrame:
    """Visible chunks, with the filter and the columns pushed into the scan."""
    df = spark.read.parquet(path).where(F.col("access_level") <= level)
    return df.select(*columns) if columns else df


def for_flat_store(chunks: DataFrame, column: str = "keywords") -> DataFrame:
    """Arrays as comma-joined strings, for stores of flat values."""
    return chunks.withColumn(column, F.array_join(column, ","))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def audit(spark: SparkSession, required: list[str]) -> DataFrame:
    """name and present of the tables that are required."""
    have = {t.name for t in spark.catalog.listTables()}
    return spark.createDataFrame([(n, n in have) for n in required], "name string, present boolean")


def audit_folder(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """name, present and n_rows (null where absent) of the tables that a folder has to have."""
    have = [n for n in required if exists(spark, f"{folder}/{n}.parquet")]
    out = spark.createDataFrame([(n, False, None) for n in required if n not in have], "name string, present boolean, n_rows long")
    for n in have:
        rows = spark.read.parquet(f"{folder}/{n}.parquet").agg(F.count("*").alias("n_rows"))
        out = out.unionByName(rows.select(F.lit(n).alias("name"), F.lit(True).alias("present"), "n_rows"))
    return out
