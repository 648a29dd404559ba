"""Streams of events into aligned buckets, late and repeated records dropped, and the life of monitored metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volumes(stream: DataFrame, ts: str, key: str, seconds: int, offset: int = 0) -> DataFrame:
    """key, bucket, volume: a bucket is given out once the watermark, one bucket's length behind, has passed its end."""
    return (
        stream.withWatermark(ts, f"{seconds} seconds")
        .groupBy(F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds"), F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("volume"))
        .select("key", F.unix_timestamp("window.start").alias("bucket"), "volume")
    )


def increasing(stream: DataFrame, key: str, ts: str, forget_after: str | None = None) -> DataFrame:
    """Only records later than all before them of their key, in order of their times within a micro-batch.

    With forget_after ("7 days"), what a key last saw is forgotten when it has been silent so long; such a query waits for
    silences, so it is for streams that go on, not for runs that end when all is read.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    silence = pd.Timedelta(forget_after).value // 1_000_000 if forget_after else None

    def keep(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        at = rows[ts].astype("datetime64[us]").astype("int64")
        late = at.cummax().shift(1)
        fresh = at > late.fillna(-(2**62)) if last is None else (at > last) & (at > late.fillna(-(2**62)))
        latest = int(at.max())
        state.update((max(latest, last) if last is not None else latest,))
        if silence:
            state.setTimeoutDuration(silence)
        yield rows[fresh.to_numpy()]

    return stream.groupBy(key).applyInPandasWithState(keep, kinds, "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout if silence else GroupStateTimeout.NoTimeout)


#: The states of a monitored metric, and how many records make a model of one that has no range of its own.
UNMONITORED, PENDING, CREATING, ACTIVE, ERROR = "unmonitored", "pending_data", "create_pending", "active", "error"
RECORDS_FOR_MODEL = 288


def lifecycle(rows: DataFrame, keys: list[str], needed: int = RECORDS_FOR_MODEL, ranges: DataFrame | None = None) -> DataFrame:
    """keys, n, status: a metric waits for enough records, unless its range (low, high) is given; equal bounds are an error."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if ranges is not None:
        counted = counted.join(ranges, keys, "full_outer")
    else:
        counted = counted.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    known = F.col("low").isNotNull() & F.col("high").isNotNull()
    n = F.coalesce("n", F.lit(0))
    status = F.when(known & (F.col("low") >= F.col("high")), ERROR).when(known & (n > 0), ACTIVE).when(known, CREATING).when(n == 0, UNMONITORED).when(n < needed, PENDING).otherwise(ACTIVE)
    return counted.select(*keys, n.alias("n"), status.alias("status"))


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, mode: str = "append"):
    """Starts a query that hands each micro-batch to write(df, number); it resumes from its checkpoint."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
