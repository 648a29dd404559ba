"""Volumes that catch up: every aligned bucket of a key in order, the empty ones too, as the watermark passes.

A key holds where it stands (the next bucket to give out) and the counts of buckets that are still open. A timer in event
time wakes it when the watermark passes the end of that bucket; it then gives out all buckets that have ended, zeros
included, and sets the next timer. Both kinds of state and the timers lie in the state store, so that a query that
restarts from its checkpoint goes on behind the last bucket it gave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Buckets that go out in one frame.
BUCKETS_AT_ONCE = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timers_enabled(spark: SparkSession) -> None:
    """State with timers needs the state store on disk; set before the query starts (a restart keeps its checkpoint's own)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _CatchUp(StatefulProcessor):
    """Counts of open buckets by key, given out when they have ended."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "bucket bigint")
        self.open = handle.getMapState("open", "bucket bigint", "volume bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else None
        counts: dict[int, int] = {}
        for frame in rows:
            if frame.empty:
                continue
            buckets, volumes = np.unique(frame["bucket"].to_numpy(), return_counts=True)
            for bucket, volume in zip(buckets.tolist(), volumes.tolist()):
                counts[bucket] = counts.get(bucket, 0) + volume
        for bucket, volume in counts.items():
            if at is None or bucket >= at:  # what was given out stays as it is
                known = self.open.getValue((bucket,)) if self.open.containsKey((bucket,)) else (0,)
                self.open.updateValue((bucket,), (known[0] + volume,))
        if at is None and counts:
            at = min(counts)
            self.next.update((at,))
            self.handle.registerTimer((at + self.seconds) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0]
        end = timerValues.getCurrentWatermarkInMs() // 1000 // self.seconds * self.seconds
        for first in range(at, end, self.seconds * BUCKETS_AT_ONCE):
            buckets = range(first, min(end, first + self.seconds * BUCKETS_AT_ONCE), self.seconds)
            volumes = []
            for b in buckets:
                held = self.open.containsKey((b,))
                volumes.append(self.open.getValue((b,))[0] if held else 0)
                if held:
                    self.open.removeKey((b,))
            yield pd.DataFrame({"key": [key[0]] * len(buckets), "bucket": list(buckets), "volume": volumes})
        at = max(at, end)
        self.next.update((at,))
        self.handle.registerTimer((at + self.seconds) * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        at = int(initialState["last"].iloc[0]) + self.seconds
        self.next.update((at,))
        self.handle.registerTimer((at + self.seconds) * 1000)

    def close(self) -> None:
        pass


def caught_up_volumes(stream: DataFrame, ts: str, key: str, seconds: int, late: str = "0 seconds", last: DataFrame | None = None) -> DataFrame:
    """key, bucket, volume: aligned buckets of a key, each once and in order, empty ones as 0, when the watermark passes their end.

    A key begins with its first bucket, or behind the last one that was given out before where last(key, last: a bucket's
    start, one row a key) knows it; such keys give out zeros from there on even if nothing comes. Rows of buckets that were
    given out are passed over, as are null keys' and times' rows. The watermark stays `late` behind the latest time.
    """
    timers_enabled(stream.sparkSession)
    bucket = F.floor(F.unix_timestamp(ts) / seconds) * seconds
    rows = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("ts"), bucket.cast("bigint").alias("bucket"))
    kind = stream.schema[key].dataType.simpleString()
    known = last.select("key", F.col("last").cast("bigint").alias("last")).groupBy("key") if last is not None else None
    return rows.groupBy("key").transformWithStateInPandas(_CatchUp(seconds), f"key {kind}, bucket bigint, volume bigint", "append", "EventTime", initialState=known)
