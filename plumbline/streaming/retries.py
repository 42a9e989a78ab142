"""Ingest that tries a file again, gives up after some attempts, and leaves nothing of it behind.

A folder holds, by batch, what came of it:

    chunks/batch=<n>    chunks of files that succeeded, with their path
    waiting/batch=<n>   files that failed and will be tried again, contents included
    dead/batch=<n>      path, attempts, error of files that were given up
    done/batch=<n>      path of files that were settled, whether they succeeded

Batch n takes its new files and those that wait since batch n - 1. Every table of a batch is
written under its number, the waiting ones last, so a batch that runs again replaces itself: at
least once, and nothing doubled. A failed file doesn't fail the others. Its chunks, of this
attempt, are not written, and ``living`` leaves out what earlier versions of a file that ended
in the dead letters had.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.stores import exists, listed, stored

#: Tries again after the first attempt, and seconds between them.
RETRIES, DELAY = 3, 60
FILES = "path string, content binary"
_WAITING = f"{FILES}, attempt int, due double, error string"
_DEAD = "path string, attempts int, error string"
_DONE = "path string, ok boolean"


@dataclass(frozen=True)
class Ingest:
    """process: from files (path, content, attempt) to rows of path, error and a chunk's columns: a
    row for each chunk, and one with an error for a file that failed, wherever that happened."""

    spark: SparkSession
    target: str
    process: Callable[[DataFrame], DataFrame]
    retries: int = RETRIES
    delay: float = DELAY

    def _table(self, name: str, number: int) -> str:
        return f"{self.target}/{name}/batch={number}"

    def last(self) -> int:
        """The last batch that is complete; -1 before the first."""
        done = [int(n.split("=")[1]) for n in listed(self.spark, f"{self.target}/waiting") if exists(self.spark, f"{self.target}/waiting/{n}/_SUCCESS")]
        return max(done, default=-1)

    def waiting(self, number: int | None = None) -> DataFrame:
        """Files that wait after a batch (the last one): path, content, attempt, due, error."""
        at = self.last() if number is None else number
        none = self.spark.createDataFrame([], _WAITING).where("false")  # seen to be empty before anything is joined with it
        return self.spark.read.schema(_WAITING).parquet(self._table("waiting", at)) if at >= 0 else none

    def step(self, files: DataFrame | None, number: int, now: float) -> None:
        """Batch number: new files (None: there are none), and those that wait and are due by now
        (seconds). New contents are written down once; those that wait are read where they lie."""
        before = max((n for n in range(number) if exists(self.spark, f"{self._table('waiting', n)}/_SUCCESS")), default=-1) if number else -1
        held = self.waiting(before)
        older, new = held, None
        if files is not None:
            new = stored(files.select("path", "content", F.lit(1).alias("attempt")), f"tried-{number}", f"{self.target}/scratch")
            # A file that came again takes the place of its older version.
            older = held.join(new.select("path"), "path", "left_anti")
        due = older.where(F.col("due") <= now).select("path", "content", (F.col("attempt") + 1).alias("attempt"))
        tried = due if new is None else new.unionByName(due)
        # Of a file that failed only its errors are written.
        marked = self.process(tried).withColumn("_failed", F.max(F.col("error").isNotNull()).over(Window.partitionBy("path")))
        out = stored(marked.where(F.col("error").isNotNull() | ~F.col("_failed")).drop("_failed"), f"made-{number}", f"{self.target}/scratch")
        errors = out.where(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("error"))
        failed = tried.join(errors, "path")
        gone = F.col("attempt") > self.retries
        out.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(self._table("chunks", number))
        failed.where(gone).select("path", F.col("attempt").cast("int").alias("attempts"), "error").write.mode("overwrite").parquet(self._table("dead", number))
        settled = tried.join(errors, "path", "left").where(F.col("error").isNull() | gone)
        settled.select("path", F.col("error").isNull().alias("ok")).write.mode("overwrite").parquet(self._table("done", number))
        again = failed.where(~gone).select("path", "content", F.col("attempt").cast("int").alias("attempt"), F.lit(now + self.delay).alias("due"), "error")
        later = older.where(F.col("due") > now).select("path", "content", "attempt", "due", "error")
        again.unionByName(later).write.mode("overwrite").parquet(self._table("waiting", number))

    def start(self, files: DataFrame, checkpoint: str, now: Callable[[], float]):
        """Starts the stream of files (path, content) that there are."""
        begin = self.last() + 1  # a stream that begins anew goes on after what there is
        resumed = exists(self.spark, f"{checkpoint}/offsets")

        def write(batch: DataFrame, number: int) -> None:
            self.step(batch, number if resumed or not begin else begin + number, now())

        return files.select("path", "content").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def drain(self, now: float) -> int:
        """A batch of waiting files alone. Gives how many wait after it."""
        self.step(None, self.last() + 1, now)
        return self.waiting().count()

    # -- what came of it -----------------------------------------------------------------

    def _all(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(f"{schema}, batch int")
        return reader.parquet(f"{self.target}/{name}")

    def dead(self) -> DataFrame:
        """Files whose last outcome is that they were given up."""
        last = self._outcomes().where("not ok")
        return self._all("dead", _DEAD).join(last.select("path", "batch"), ["path", "batch"]).select("path", "attempts", "error")

    def _outcomes(self) -> DataFrame:
        return self._all("done", _DONE).groupBy("path").agg(F.max_by("ok", "batch").alias("ok"), F.max("batch").alias("batch"))

    def living(self) -> DataFrame:
        """The chunks of each file's last version, unless that one was given up."""
        return self._all("chunks").join(self._outcomes().where("ok").drop("ok"), ["path", "batch"])
