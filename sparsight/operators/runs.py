"""Places of rows within keys, and what rests on them: merges of sorted lists in bounded parts, ranges of sliding windows.

Rows are range-partitioned by key and order, so that a key with most of the rows spans many tasks. A task numbers the rows
that it holds; where a key goes on from the task before, one row a task tells how many came before.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

_PART, _PLACE = "__part", "__place"


def _fresh(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; null is a key like others. last: the keys before the batch."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    out[0] = last is None or last != tuple(batch.column(k)[0].as_py() for k in keys)
    for k in keys:
        here, before = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(here, before), False)
        out[1:] |= pc.or_(differ, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
    return out


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows plus name: their places (0, 1, ...) among the rows of the same keys, by order, nulls first.

    Null keys are keys like others. Rows that tie in the order get some places of theirs. Spreads a key of any size, as long
    as its rows differ in the order. Key and order columns must be sortable; the other columns pass through.
    """
    sort = [*keys, *[c for c in order if c not in keys]]
    schema = T.StructType([T.StructField(_PART, T.IntegerType()), T.StructField(_PLACE, T.LongType()), *rows.schema.fields])
    names = rows.columns

    def place(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _fresh(batch, keys, last)
            starts = np.flatnonzero(fresh)
            at = np.arange(batch.num_rows)
            runs = np.searchsorted(starts, at, side="right")
            places = at - np.where(runs > 0, starts[np.maximum(runs - 1, 0)] if len(starts) else 0, -n)
            last, n = tuple(batch.column(k)[-1].as_py() for k in keys), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places), *batch.columns], names=[_PART, _PLACE, *names])

    held = written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(place, schema), "numbered")
    counts = held.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # a task's first key alone can go on from tasks before: no more rows than tasks
    going_on = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(_PART).alias("__in"), F.sum("__n").over(earlier).alias("__before")).where(F.col("__before").isNotNull())
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col(_PART) == F.col("__in"))
    return held.join(F.broadcast(going_on), same, "left").select(*names, (F.col(_PLACE) + F.coalesce("__before", F.lit(0))).alias(name))


def merged_lists(tables: list[tuple[DataFrame, str, str]], most: int) -> DataFrame:
    """key, part, list1 ... listN: the items of several tables (key column, item column of each) by key, in parts of most items.

    A key's items are those of the first table in order, then those of the second, and so on; part k holds the k-th run of
    `most` of them, side by side by table, with an empty list where a table has none in it. Null items are left out, null
    keys are a key. No list, and no task's share of a key, grows with the key: parts are cut from ranges of sorted rows.
    """
    kinds = [df.schema[item].dataType for df, _, item in tables]
    parts = []
    for i, (df, key, item) in enumerate(tables):
        items = [F.col(item).alias(f"item{j}") if j == i else F.lit(None).cast(kind).alias(f"item{j}") for j, kind in enumerate(kinds)]
        parts.append(df.where(F.col(item).isNotNull()).select(F.col(key).alias("key"), F.lit(i).alias("table"), *items))
    items = [f"item{j}" for j in range(len(tables))]
    rows = numbered(reduce(DataFrame.union, parts), ["key"], ["table", *items], "place")
    lists = [F.array_sort(F.collect_list(item)).alias(f"list{j}") for j, item in enumerate(items, 1)]
    return rows.groupBy("key", F.floor(F.col("place") / most).cast("bigint").alias("part")).agg(*lists)


def sliding_range(rows: DataFrame, keys: list[str], order: list[str], column: str, n: int) -> DataFrame:
    """rows plus low and high: the least and the most of a column among the last n rows of the same keys, the row included.

    Rows are numbered along the order and cut into blocks of n. A window of n rows is the end of one block and the start of
    the next, so it takes one running minimum in each direction and one join of a row with the row where its window begins;
    no window of n rows is held. Fewer than n rows count at a key's start; nulls of the column are passed over.
    """
    held = numbered(rows, keys, order, "__i").withColumn("__block", F.floor(F.col("__i") / n))
    by = Window.partitionBy(*keys, "__block").orderBy("__i")
    start, end = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    both = held.select("*", F.min(column).over(start).alias("__low_start"), F.max(column).over(start).alias("__high_start"))
    back = held.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__i") + (n - 1)).alias("__for"), F.min(column).over(end).alias("__low_back"), F.max(column).over(end).alias("__high_back"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__i") == F.col("__for"))
    joined = both.join(back, same, "left")
    return joined.select(*rows.columns, F.least("__low_start", "__low_back").alias("low"), F.greatest("__high_start", "__high_back").alias("high"))


def duty_cycles(rows: DataFrame, keys: list[str], order: list[str], column: str, period: int) -> DataFrame:
    """rows plus duty: after each record of a key, ((p - 1) * duty before + the column) / p, p being the record's number, at most the period.

    So it is the mean of the first `period` records, and a decaying one from then on. A record weighs 1 / period times a
    power of 1 - 1 / period, so that duties are sums: in blocks of 20 periods along the order, whose weights stay within a
    double's range, plus what the blocks before leave over; of these the last three count, as less than 1e-17 is left of
    others. Nulls of the column count as 0. No block's rows are held together, and only one row a block passes on.
    """
    decay, size = 1 - 1 / period, 20 * period
    t = F.col("__i") + 1
    held = numbered(rows, keys, order, "__i").withColumn("__block", F.floor(F.col("__i") / size))
    base = F.greatest(F.col("__block") * size, F.lit(period))
    x = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    if decay == 0:
        return held.select(*rows.columns, x.alias("duty"))
    power = lambda e: F.exp(e * float(np.log(decay)))
    weighted = x / period * power(base - F.greatest(t, F.lit(period)))
    by = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    local = held.select("*", F.sum(weighted).over(by).alias("__local"), F.sum(x).over(by).alias("__sum"), base.alias("__base"))
    ends = held.groupBy(*keys, "__block").agg(F.sum(weighted).alias("__s"), F.first(base).alias("__b"))
    ends = ends.withColumn("__left", F.col("__s") * power((F.col("__block") + 1) * size - F.col("__b")))
    earlier = Window.partitionBy(*keys).orderBy("__block")
    carried = sum((F.coalesce(F.lag("__left", k).over(earlier), F.lit(0.0)) * float(decay ** (size * (k - 1))) for k in (1, 2, 3)), F.lit(0.0))
    starts = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__at"), carried.alias("__carried"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__block") == F.col("__at"))
    duty = F.when(t <= period, F.col("__sum") / t).otherwise(F.col("__local") * power(t - F.col("__base")) + F.col("__carried") * power(t - F.col("__block") * size))
    return local.join(starts, same).select(*rows.columns, duty.alias("duty"))
