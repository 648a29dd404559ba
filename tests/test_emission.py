"""Streams against batches: volumes that catch up, lives of metrics; restarts from a checkpoint in between."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from sparsight.operators import stores
from sparsight.streaming import emission, lifecycle, windows

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "id long, ts timestamp, k string, v double"


@pytest.fixture()
def provider(spark):
    """The state store of the other streams is put back."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def files(spark, folder, batches):
    """Each batch of (minute, key) a file, read one a micro-batch."""
    n = 0
    for i, batch in enumerate(batches):
        rows = [(n + j, START + dt.timedelta(minutes=m) if m is not None else None, k, float(j)) for j, (m, k) in enumerate(batch)]
        n += len(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:03d}.parquet")


def run(spark, folder, make, out, checkpoint, mode="append"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    writer = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()


def test_volumes_catch_up_and_go_on_after_a_restart(spark, tmp_path, provider):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    early = [[(0, "a"), (3, "a"), (7, "b"), (None, "a"), (5, None)], [(64, "a"), (50, "a"), (61, "b")], [(300, "a")]]
    late = [[(310, "b"), (5, "a")], [(900, "a"), (630, "c")], [(1500, "z")]]
    files(spark, source, early)
    run(spark, source, lambda s: emission.caught_up_volumes(s, "ts", "k", 600, late="30 minutes"), out, checkpoint)
    first = {tuple(r) for r in spark.read.parquet(out).collect()}
    at = int(START.timestamp())
    assert {b for k, b, _ in first if k == "a"} == set(range(at, at + 270 * 60, 600)) and {r for r in first if r[0] == "z"} == set()
    files(spark, f"{source}/more", late)
    run(spark, source, lambda s: emission.caught_up_volumes(s, "ts", "k", 600, late="30 minutes"), out, checkpoint)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({(r.key, r.bucket) for r in rows}), "a bucket is given out once"
    # the same from the whole table: minute 5 of the second run came after its bucket had been given out
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source).where("k is not null and ts is not null")
    kept = table.where(~((F.col("k") == "a") & (F.col("ts") == F.lit(START + dt.timedelta(minutes=5)))))
    filled = stores.fill_volumes(stores.bucket_volumes(kept, "ts", "k", 600), 600)
    begin = kept.groupBy(F.col("k").alias("key")).agg(F.min(F.floor(F.unix_timestamp("ts") / 600) * 600).alias("begin"))
    end = at + (1500 - 30) * 60
    want = filled.join(begin, "key").where((F.col("bucket") >= F.col("begin")) & (F.col("bucket") + 600 <= end)).select("key", "bucket", "volume")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))


def test_volumes_begin_behind_what_was_given_out_before(spark, tmp_path, provider):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    at = int(START.timestamp())
    files(spark, source, [[(5, "a"), (15, "a")], [(60, "b")]])
    last = spark.createDataFrame([("a", at), ("quiet", at + 1200)], "key string, last long")
    run(spark, source, lambda s: emission.caught_up_volumes(s, "ts", "k", 600, last=last), out, checkpoint)
    found = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert found == [("a", at + 600, 1)] + [("a", b, 0) for b in range(at + 1200, at + 3600, 600)] + [("quiet", b, 0) for b in range(at + 1800, at + 3600, 600)]


def test_lives_of_metrics_as_streams_and_tables(spark, tmp_path, provider):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    batches = [[(1, "a"), (0, "a"), (9, "ranged"), (8, "wrong"), (None, "a"), (1, None)], [(20 + i, "a") for i in range(9, -1, -1)] + [(20, "b")], [(40, "b"), (41, "b"), (50, "wrong"), (51, "ranged"), (90, "a")]]
    ranges = spark.createDataFrame([("ranged", 0.0, 5.0), ("wrong", 2.0, 2.0), ("open", None, 1.0), ("b", None, 1.0)], "key string, low double, high double")
    files(spark, source, batches[:2])
    make = lambda s: lifecycle.transitions(s, "k", "ts", needed=5, ranges=ranges)
    run(spark, source, make, out, checkpoint)
    assert {(r.key, r.after) for r in spark.read.parquet(out).collect()} == {("a", "pending_data"), ("a", "create_pending"), ("a", "active"), ("ranged", "create_pending"), ("ranged", "active"), ("wrong", "error"), ("b", "pending_data")}
    files(spark, f"{source}/more", batches[2:])
    run(spark, source, make, out, checkpoint)
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    for needed in (5, 1):
        got = sorted(map(tuple, (spark.read.parquet(out) if needed == 5 else spark.read.parquet(out).limit(0)).select("key", "step", "record", "ts", "before", "after").collect()), key=str)
        want = sorted(map(tuple, lifecycle.transitions_of(table, "k", "ts", "id", needed, ranges).collect()), key=str)
        assert needed != 5 or got == want
        assert needed != 1 or {w[5] for w in want if w[0] == "a"} == {"create_pending", "active"}
    counted = windows.lifecycle(table.where("k is not null and ts is not null").withColumnRenamed("k", "key"), ["key"], 5, ranges).where("n > 0")
    ends = {r.key: r.after for r in spark.read.parquet(out).orderBy("step").collect()}
    assert {r.key: r.status for r in counted.collect()} == ends


def test_metrics_may_be_forgotten(spark, tmp_path, provider):
    """Such a query waits for silences, so it doesn't end when all is read: it is stopped."""
    source = f"{tmp_path}/in"
    files(spark, source, [[(1, "a"), (2, "a")], [(3, "a"), (4, "b")]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    got = []
    rows = lifecycle.transitions(stream, "k", "ts", needed=3, forget_after_ms=3_600_000)
    query = rows.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.time() + 60
    while len(got) < 4 and query.isActive and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert sorted((r.key, r.record, r.after) for r in got) == [("a", 1, "pending_data"), ("a", 3, "active"), ("a", 3, "create_pending"), ("b", 1, "pending_data")]


def test_last_samples_follow_the_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    files(spark, source, [[(5, "a"), (3, "a")], [(4, "a"), (9, "b")]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = lifecycle.last_samples(stream, "k", "ts", "v").writeStream.format("memory").queryName("last_samples").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.key, r.value) for r in spark.table("last_samples").collect()) == [("a", 0.0), ("b", 1.0)]
