"""Sources in parts: record files as batch and stream with a restart, databases in even parts."""

import random

import pytest
from pyspark.sql import functions as F

from sparsight.sources import databases, observed
from sparsight.sources import records as R

HEADER = "key,name,size\nint,string,float\nS,,\n"


def stream(spark, folder, out, checkpoint, **options):
    rows = observed.observed_stream(spark, str(folder), **options)
    rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(out)).orderBy("file", "at").select("key", "name", "size").collect()]


def test_parts_give_every_line_once(tmp_path):
    rng = random.Random(2)
    lines = ["x" * rng.choice([0, 1, 5, 30]) + str(i) for i in range(200)]
    for end in ("\n", ""):
        text = HEADER + "\n".join(lines) + end
        (tmp_path / "a.csv").write_bytes(text.encode())
        folder = observed._Folder(str(tmp_path))
        for split in (1, 2, 7, 64, 10_000):
            parts = folder.parts(("", 0), ("a.csv", len(text)), split)
            found = [(a, x) for p in parts for b in observed.lines_of(p) for a, x in zip(b.column("at").to_pylist(), b.column("line").to_pylist())]
            assert [x for _, x in found] == lines and all(text[a : a + len(x)] == x for a, x in found)


def test_a_folder_as_batch(spark, tmp_path):
    (tmp_path / "0.csv").write_text("﻿" + HEADER + "1,a,1.5\r\n2,b,x\n")
    (tmp_path / "1.csv").write_text("3,c,\n4,Ünï,2")
    (tmp_path / "_skipped").write_text("9,z,9\n")
    rows = observed.observed(spark, f"file://{tmp_path}", split_bytes=3).orderBy("rec_no").collect()
    assert [(r.rec_no, r.key, r.name) for r in rows] == [(0, 1.0, "a"), (1, 2.0, "b"), (2, 3.0, "c"), (3, 4.0, "Ünï")]
    assert rows[0].size == 1.5 and rows[1].size != rows[1].size and rows[3].size == 2.0
    assert R.read(spark, "observed", path=str(tmp_path)).count() == 4
    with pytest.raises(ValueError):
        observed.observed(spark, str(tmp_path / "none"))


def test_a_folder_as_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, checkpoint = (tmp_path / n for n in ("in", "out", "checkpoint"))
    source.mkdir()
    header = R.Header.parse(HEADER.split("\n"))
    spark_options = {"header": header, "split_bytes": 5}
    observed_stream = observed.observed_stream(spark, str(source), header)
    assert observed_stream.isStreaming and observed_stream.columns == ["file", "at", "key", "name", "size"]
    (source / "0.csv").write_text(HEADER + "1,a,1\n2,b,2\n3,par")
    first = stream(spark, source, out, checkpoint, **spark_options)
    assert first == [(1.0, "a", 1.0), (2.0, "b", 2.0)], "the last line isn't whole yet"
    with (source / "0.csv").open("a") as f:
        f.write("t,3\n")
    (source / "1.csv").write_text("4,d,4\n")
    assert stream(spark, source, out, checkpoint, **spark_options)[2:] == [(3.0, "part", 3.0), (4.0, "d", 4.0)]
    again = stream(spark, source, tmp_path / "again", tmp_path / "other", **spark_options)
    assert again == stream(spark, source, out, checkpoint, **spark_options), "a replay gives the same records, and nothing new comes twice"


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_ranges_of_keys_are_even(spark, parts):
    keys = [*range(100), *[7] * 60, *range(0, 100, 2), None]
    random.Random(parts).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(3)
    found = databases.key_ranges(df, "k", parts).orderBy("part").collect()
    known = sorted(k for k in keys if k is not None)
    assert sum(r.n for r in found) == len(known) and all(a.high < b.low for a, b in zip(found, found[1:]))
    for r in found:
        assert r.n == sum(r.low <= k <= r.high for k in known) and r.part == known.index(r.low) * parts // len(known)
    assert databases.key_ranges(df.limit(0), "k", parts).count() == 0


def test_a_database_in_even_parts(spark, sf, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 50 > 0, F.pow(F.col("o_custkey"), 2).cast("long")).alias("k"), "o_totalprice")
    rows.coalesce(1).write.jdbc(url, "orders_copy", properties=driver)
    read = databases.even_parts(spark, url, "orders_copy", '"k"', 6, **driver)
    sizes = [r[1] for r in read.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()]
    total = rows.count()
    assert len(sizes) == 6 and sum(sizes) == total and max(sizes) < 2 * total / 6
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    plan = read.where("o_totalprice > 1000").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(O_TOTALPRICE" in plan.upper().replace("GREATERTHAN", "GreaterThan") and "o_orderkey" not in plan.lower().split("readschema")[-1]
    assert databases.predicates([], "k") == ["1 = 1"] == databases.predicates([3], "k")
    spark.createDataFrame([], "k long").write.jdbc(url, "nothing", properties=driver)
    assert databases.even_parts(spark, url, "nothing", '"k"', 4, **driver).count() == 0
