"""The life of a metric as a stream: a state machine a key, its transitions in order, and the last sample seen.

A metric without a range of its own waits for enough records, then a model is created for it and it is active; one whose
range is known is created at once and active with its first record; equal or swapped bounds are an error. A key's state has
several columns and may be forgotten after a silence. Of a micro-batch only as many rows of a key are held as its next
transitions need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.runs import numbered
from .emission import timers_enabled
from .windows import ACTIVE, CREATING, ERROR, PENDING, RECORDS_FOR_MODEL, UNMONITORED

_STATE = "status string, n bigint, last bigint, transitions int"


def _steps(low, high, needed: int) -> list[tuple[int, str]]:
    """(record at which, status then) of a metric's whole life; the record counts from 1, 0 is before the first."""
    if low is not None and high is not None:
        return [(0, ERROR)] if low >= high else [(0, CREATING), (1, ACTIVE)]
    return [(1, PENDING), (needed, CREATING), (needed, ACTIVE)] if needed > 1 else [(1, CREATING), (1, ACTIVE)]


class _Machine(StatefulProcessor):
    def __init__(self, needed: int, forget_after_ms: int | None):
        self.needed, self.forget = needed, forget_after_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("metric", _STATE, self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, n, last, done = self.state.get() if self.state.exists() else (UNMONITORED, 0, None, 0)
        earliest, count, steps = np.zeros(0, np.int64), 0, None
        for frame in rows:
            if frame.empty:
                continue
            steps = steps or _steps(*(None if pd.isna(x) else x for x in (frame["low"].iloc[0], frame["high"].iloc[0])), self.needed)
            at = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            count += len(at)
            last = int(max(at.max(), last)) if last is not None else int(at.max())
            wanted = max((r for r, _ in steps[done:]), default=0) - n
            if wanted > 0:  # the rows that the next transitions fall on are among the earliest of the batch
                earliest = np.sort(np.concatenate([earliest, at]))[:wanted]
        out = []
        for record, after in (steps or [])[done:]:
            if record <= n + count:
                when = int(earliest[max(record - n - 1, 0)]) if record > n and len(earliest) else int(last)
                out.append((key[0], len(out) + done, record, pd.Timestamp(when, unit="us", tz="UTC"), status, after))
                status = after
        self.state.update((status, n + count, last, done + len(out)))
        if out:
            frame = pd.DataFrame(out, columns=["key", "step", "record", "ts", "before", "after"])
            frame.loc[frame["record"] == 0, "ts"] = pd.NaT
            yield frame

    def close(self) -> None:
        pass


def transitions(stream: DataFrame, key: str, ts: str, needed: int = RECORDS_FOR_MODEL, ranges: DataFrame | None = None, forget_after_ms: int | None = None) -> DataFrame:
    """key, step, record, ts, before, after: each change of a metric's status, at which of its records (from 1; 0: before the first) and when.

    ranges(key, low, high) tells the metrics whose range is known. Records count in order of time within a micro-batch and
    by batch; rows with a null key or time are passed over. With forget_after_ms a metric that stays silent so long (in
    processing time) starts anew. Transitions before the first record have no time.
    """
    timers_enabled(stream.sparkSession)
    rows = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    none = F.lit(None).cast("double")
    known = rows.join(ranges.select("key", F.col("low").cast("double"), F.col("high").cast("double")), "key", "left") if ranges is not None else rows.withColumns({"low": none, "high": none})
    kind = stream.schema[key].dataType.simpleString()
    mode = "ProcessingTime" if forget_after_ms else "None"
    return known.groupBy("key").transformWithStateInPandas(_Machine(needed, forget_after_ms), f"key {kind}, step int, record bigint, ts timestamp, before string, after string", "append", mode)


def transitions_of(table: DataFrame, key: str, ts: str, order: str, needed: int = RECORDS_FOR_MODEL, ranges: DataFrame | None = None) -> DataFrame:
    """What transitions gives for a whole table at once; order breaks ties of time. A metric's records are numbered over all tasks."""
    rows = table.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).alias("order"))
    placed = numbered(rows, ["key"], ["ts", "order"], "place").where(F.col("place").isin(0, needed - 1)).select("key", (F.col("place") + 1).alias("record"), "ts")
    none = F.lit(None).cast("double")
    known = placed.join(ranges.select("key", F.col("low").cast("double"), F.col("high").cast("double")), "key", "left") if ranges is not None else placed.withColumns({"low": none, "high": none})
    ranged, wrong = F.col("low").isNotNull() & F.col("high").isNotNull(), F.col("low") >= F.col("high")
    first, ready = F.col("record") == 1, F.col("record") == needed
    change = lambda record, ts_, after: F.struct(record.cast("bigint").alias("record"), ts_.alias("ts"), F.lit(after).alias("after"))
    here, before = (F.col("record"), F.col("ts")), (F.lit(0), F.lit(None).cast("timestamp"))
    found = F.when(ranged & ~first, F.array().cast("array<struct<record:bigint,ts:timestamp,after:string>>")).when(ranged & wrong, F.array(change(*before, ERROR)))
    found = found.when(ranged, F.array(change(*before, CREATING), change(*here, ACTIVE))).when(ready, F.array(change(*here, CREATING), change(*here, ACTIVE))).otherwise(F.array(change(*here, PENDING)))
    listed = known.select("key", F.posexplode(found).alias("at", "change")).select("key", "change.*", "at")
    by = Window.partitionBy("key").orderBy("record", "at")
    return listed.select("key", (F.row_number().over(by) - 1).alias("step"), "record", "ts", F.coalesce(F.lag("after").over(by), F.lit(UNMONITORED)).alias("before"), "after")


def last_samples(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, ts, value: the latest sample of each key so far, for sinks in update or complete mode; of equal times, the larger value."""
    return stream.groupBy(F.col(key).alias("key")).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))).alias("last")).select("key", "last.ts", "last.value")
