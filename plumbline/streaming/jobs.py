"""Streams: ingest, rate limit, cached results."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from plumbline.sources.stores import stored

WINDOW_S, MOST = 60, 10


def ingest(files: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Starts a stream of files into a Parquet table of chunks. A batch is written under
    its number, so one that is run again replaces itself and nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Of documents that were ingested again, only the last batch's chunks."""
    last = chunks.groupBy(key).agg(F.max("batch").alias("_last"))
    return chunks.join(last, key).where(F.col("batch") == F.col("_last")).drop("_last")


def accepted(times: list[float], before: list[float], window: float = WINDOW_S, most: int = MOST) -> tuple[list[bool], list[float]]:
    """Of events in order, those accepted: fewer than `most` accepted ones lie within
    the window before them. Also the accepted times that still count."""
    recent, out = list(before), []
    for t in times:
        recent = [x for x in recent if t - x < window]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, recent


def _marked(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())])


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[ns]").astype("int64") / 1e9).tolist()


def rate_limited(events: DataFrame, user: str = "user_id", ts: str = "ts", order: str = "event_id", window: float = WINDOW_S, most: int = MOST) -> DataFrame:
    """Batch: user, event, ts and whether it is accepted. Acceptance feeds back, so events
    are gone through in order; where a user pauses for the window, nothing before counts,
    so users are dealt out by such sessions. Pauses are found in ranges of (user, time), so
    that no user's events meet in one task for it; a range knows of those before it only a
    user's last time and number of pauses. Tasks read sessions as a stream, and keep the
    accepted times that still count only, however long a session is. Rows without a user or
    a time are not accepted."""
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_s")
    names = [user, order, ts]
    good = F.col(user).isNotNull() & F.col(ts).isNotNull()
    df = events.select(*names, seconds)
    ranges = stored(df.where(good).repartitionByRange(user, "_s", order).withColumn("_range", F.spark_partition_id()), "ranges")
    by = Window.partitionBy(user, "_range").orderBy("_s", order)
    before = Window.partitionBy(user).orderBy("_range")
    ends = ranges.groupBy(user, "_range").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    opened = (F.col("_first") - F.lag("_last").over(before) >= window).alias("_opened")
    gap = F.coalesce((F.col("_s") - F.lag("_s").over(by) >= window).cast("int"), F.lit(0))
    within = ranges.withColumn("_session", F.sum(gap).over(by))
    inner = within.groupBy(user, "_range").agg(F.max("_session").alias("_n"))
    # A row for each user and range that has some of its events.
    known = ends.select(user, "_range", opened).join(inner, [user, "_range"])
    upto = F.sum(F.coalesce(F.col("_opened").cast("int"), F.lit(0))).over(before) + F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.select(user, "_range", upto.alias("_base"))
    df = within.join(known, [user, "_range"]).withColumn("_session", F.col("_session") + F.col("_base")).select(*names, "_s", "_session")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, recent = None, deque()
        for b in batches:
            out = []
            for key in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(3).to_pylist()):
                if key[:2] != at:
                    at = key[:2]
                    recent.clear()
                while recent and key[2] - recent[0] >= window:
                    recent.popleft()
                out.append(len(recent) < most)
                if out[-1]:
                    recent.append(key[2])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.bool_())], names=[*names, "accepted"])

    dealt = df.repartition(user, "_session").sortWithinPartitions(user, "_session", "_s", order)
    out = dealt.mapInArrow(run, _marked(events.select(*names)))
    return out.unionByName(events.select(*names).where(~good).withColumn("accepted", F.lit(False)))


def rate_limited_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", order: str = "event_id", window: float = WINDOW_S, most: int = MOST, late: str | None = None) -> DataFrame:
    """The same over a stream: the state of a user is the accepted times that still count.
    late: the delay of a watermark on ts; a user's state goes once the watermark has passed
    its last accepted time by the window. Without it, states stay."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values([ts, order])
        ok, recent = accepted(_seconds(pdf[ts]), list(state.get[0]) if state.exists else [], window, most)
        state.update((recent,))
        if late and recent:
            state.setTimeoutTimestamp(max(int((recent[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(accepted=ok)[[user, order, ts, "accepted"]]

    df = events.select(user, order, ts)
    df = df.withWatermark(ts, late) if late else df
    how = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return df.groupBy(user).applyInPandasWithState(run, _marked(events.select(user, order, ts)), "recent array<double>", "append", how)


def fresh_results(requests: DataFrame, key: str = "cache_key", ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Requests of a stream that no cached result answers: the first of a key in the time that a result lives."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def cached(requests: DataFrame, results: DataFrame, key: str = "cache_key", ts: str = "ts", ttl_s: int = 3600) -> DataFrame:
    """Batch: each request with the newest result that was not too old by then, if any.
    Requests and results of a key stand in one order of time, and each request takes the
    last result before it; no request meets more than that one. A key's time is cut into
    spans as long as a result lives, and a result stands in its own span and the next, so a
    hot key is dealt out by spans. A result of the same second counts as before the request.
    Of results of one second, the larger counts."""
    second = F.unix_timestamp(ts)
    span = F.floor(F.col("_s") / ttl_s)
    asked = requests.select(F.struct(*requests.columns).alias("_row"), F.col(key).alias("_key"), second.alias("_s"), F.lit(None).cast(results.schema["result"].dataType).alias("result"), F.lit(1).alias("_kind"))
    given = results.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), second.alias("_s"), "result", F.lit(0).alias("_kind"))
    asked = asked.withColumn("_span", span)
    given = given.withColumn("_span", F.explode(F.array(span, span + 1)))
    order = Window.partitionBy("_key", "_span").orderBy("_s", "_kind", "result").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_s", "result")), ignorenulls=True).over(order)
    found = asked.unionByName(given).withColumn("_last", last).where("_kind = 1")
    alive = F.col("_s") - F.col("_last._s") < ttl_s
    return found.select("_row.*", F.when(alive, F.col("_last.result")).alias("result"))


def without_prefix(results: DataFrame, prefix: str, key: str = "cache_key") -> DataFrame:
    """The cached results whose keys don't begin with the prefix, as a collection changed."""
    return results.where(F.col(key).isNull() | ~F.startswith(F.col(key), F.lit(prefix)))


def answers(queries: DataFrame, search: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Starts a stream of queries, answered batch by batch: qid, query, qv and kind. Each
    kind has a folder of its own under target; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        kinds = batch.select("qid", "kind")
        search(batch.drop("kind")).join(kinds, "qid").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(target)

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
