"""What the training-data operators share: tables that cut lineage, and words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.stores import shared_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows reads that, so a
    lost executor costs no recomputation of what lies before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(whole(text), f"{SPACE}+"), lambda w: w != "")


def carried(row: str, carry: tuple[str, ...], made) -> list[Column]:
    """The columns named in carry out of the struct row. One that has the name of a
    result, in any case, gets the suffix _carried."""
    taken = {k.lower() for k in made}
    return [F.col(row)[c].alias(f"{c}_carried" if c.lower() in taken else c) for c in carry]


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; executors read it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)
