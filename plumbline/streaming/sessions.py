"""Sessions by their last activity, as a stream and as a table.

``activity_stream`` keeps the last activity of each session as state and gives a row whenever a
batch changes it, with how many messages the batch had; a session that was idle for long is
closed and its state goes. ``current`` folds such rows, from any number of batches and of lives
of a state, into a table; ``activity`` is the same from a table of messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(messages: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Batch: key, updated_at, n_messages. Messages without a session or a time don't count."""
    good = messages.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return good.groupBy(key).agg(F.max(F.col(ts).cast("timestamp")).alias("updated_at"), F.count("*").alias("n_messages"))


def activity_stream(messages: DataFrame, key: str = "session_id", ts: str = "ts", late: str = "1 hour", idle_s: float = 86_400) -> DataFrame:
    """key, updated_at, n_messages (of the batch) and closed. updated_at never goes back. Messages
    behind the watermark are passed over, as their session may be closed."""
    df = messages.select(key, F.col(ts).cast("timestamp").alias("ts")).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    kind = df.schema[key].dataType.simpleString()

    def run(at: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, "updated_at", "n_messages", "closed"]
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(at[0], pd.Timestamp(last), 0, True)], columns=columns)
            return
        (last,) = state.get if state.exists else (None,)
        last, n = (None if last is None else pd.Timestamp(last)), 0
        for pdf in parts:
            n += len(pdf)
            newest = pdf["ts"].max()
            last = newest if last is None else max(last, newest)
        state.update((last.to_pydatetime(),))
        state.setTimeoutTimestamp(max(int((last.timestamp() + idle_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(at[0], last, n, False)], columns=columns)

    out = f"{key} {kind}, updated_at timestamp, n_messages long, closed boolean"
    return df.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, out, "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def current(updates: DataFrame, key: str = "session_id") -> DataFrame:
    """key, updated_at, n_messages from what the stream gave so far."""
    return updates.groupBy(key).agg(F.max("updated_at").alias("updated_at"), F.sum("n_messages").alias("n_messages"))
