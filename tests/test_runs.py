"""Places within keys, merges in bounded parts, sliding ranges: small cases, ties, nulls, and keys that hold all rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparsight.operators import runs as U


def parted(lists, most):
    """What merged_lists gives for {key: [list1, list2, ...]}."""
    out = []
    for key, own in lists.items():
        run = [(j, x) for j, items in enumerate(own) for x in sorted(items)]
        for p in range(0, len(run), most):
            out.append((key, p // most, *[[x for i, x in run[p : p + most] if i == j] for j in range(len(own))]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r[1], *[list(x) for x in r[2:]]) for r in df.collect()), key=str)


def test_lists_of_several_tables_side_by_side(spark):
    a = spark.createDataFrame([(7, "x"), (12, "a"), (12, "b"), (16, "y"), (16, None), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(9, 1.5), (12, 3.0), (12, 3.0), (12, 1.0), (None, 2.0)], "j int, w double")
    lists = {7: [["x"], []], 12: [["a", "b"], [3.0, 3.0, 1.0]], 16: [["y"], []], 9: [[], [1.5]], None: [["n"], [2.0]]}
    for most in (1, 2, 100):
        assert got(U.merged_lists([(a, "k", "v"), (b, "j", "w")], most)) == parted(lists, most)
    assert U.merged_lists([(a.limit(0), "k", "v"), (b.limit(0), "j", "w")], 5).count() == 0


def test_a_key_that_holds_all_rows_spans_tasks(spark, monkeypatch):
    n, kept, written = 40_000, [], U.written
    monkeypatch.setattr(U, "written", lambda df, label: kept.append(written(df, label)) or kept[-1])
    rows = spark.range(n, numPartitions=6).select(F.lit(1).alias("k"), (n - F.col("id")).alias("v"))
    parts = U.merged_lists([(rows, "k", "v"), (rows.where("v % 2 = 0"), "k", "v")], 500)
    found = parts.orderBy("part").collect()
    assert len(found) == 120 and all(len(r.list1) + len(r.list2) == 500 for r in found)
    assert [x for r in found for x in r.list1] == list(range(1, n + 1)) and [x for r in found for x in r.list2] == list(range(2, n + 1, 2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        placed = U.numbered(rows, ["k"], ["v"], "i")
        assert placed.where("i <> v - 1").count() == 0
        held = [r["count"] for r in kept[-1].groupBy("__part").count().collect()]
        assert len(held) == 4 and max(held) < 0.5 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_follow_order_with_nulls_and_repeats(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    placed = U.numbered(spark.createDataFrame(data, "k string, o int, id int").repartition(7), ["k"], ["o", "id"], "place").collect()
    want = {}
    for key in ("a", "b", None):
        own = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i for i, r in enumerate(own)}
    assert {r.id: r.place for r in placed} == want


@pytest.mark.parametrize("n", [1, 2, 7, 50, 1000])
def test_ranges_of_sliding_windows(spark, n):
    rng = random.Random(n)
    data = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, *range(100)])) for i in range(400)]
    found = U.sliding_range(spark.createDataFrame(data, "k int, at int, v int").repartition(5), ["k"], ["at"], "v", n).collect()
    assert len(found) == 400
    for r in found:
        window = [v for k, at, v in data if k == r.k and at <= r["at"]][-n:]
        window = [v for v in window if v is not None]
        assert (r.low, r.high) == ((min(window), max(window)) if window else (None, None))


@pytest.mark.parametrize("period", [1, 2, 5, 40])
def test_duty_cycles_over_blocks(spark, period):
    rng = random.Random(period)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0, 1, 1, None])) for i in range(900)]
    found = U.duty_cycles(spark.createDataFrame(data, "k string, at int, on int").repartition(5), ["k"], ["at"], "on", period).collect()
    duty, n, want = {}, {}, {}
    for k, at, on in data:
        n[k] = n.get(k, 0) + 1
        p = min(period, n[k])
        duty[k] = want[at] = ((p - 1) * duty.get(k, 0.0) + (on or 0)) / p
    assert len(found) == 900 and all(abs(r.duty - want[r["at"]]) < 1e-12 for r in found)
