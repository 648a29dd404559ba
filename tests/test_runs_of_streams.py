"""Progress, completion, errors and halts of streams that are written batch by batch."""

import pytest
from pyspark.sql import functions as F

from sparsight.streaming import runs


@pytest.fixture()
def source(spark, tmp_path):
    for i in range(4):
        spark.range(10 * i, 10 * i + 10, numPartitions=2).select(F.col("id").alias("rec_no"), (F.col("id") * 2).alias("v")).write.parquet(f"{tmp_path}/in/{i}.parquet")
    return spark.readStream.schema("rec_no long, v long").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_a_failed_batch_names_its_record_and_the_next_run_goes_on(spark, source, tmp_path):
    bad, told = {"at": 23}, []
    checked = lambda df: df.withColumn("v", runs.required(F.col("v"), F.col("rec_no") != bad["at"], F.col("rec_no"), "value out of range"))
    write = lambda df, n: checked(df).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    make = lambda: runs.Run(source, write, f"{tmp_path}/c", on_next=lambda p: told.append(("next", p.last)), on_complete=lambda p: told.append(("complete", p.records)), on_error=lambda e: told.append(("error", e.record)))
    with pytest.raises(runs.RunFailed) as failed:
        make().start().wait()
    held = {r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("rec_no").collect()}
    first = failed.value
    assert first.record == 23 and first.first <= 23 <= first.last and "value out of range" in first.reason and 23 not in held
    assert told[-1] == ("error", 23) and len(held) % 10 == 0
    bad["at"] = None
    bad["at"] = -1
    progress = make().start().wait()
    assert progress.records == 40 - len(held) and told[-1] == ("complete", 40 - len(held))
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("rec_no").collect()) == list(range(40))
    assert make().start().wait().records == 0, "nothing is written twice"


def test_a_writer_that_fails_without_a_record(source, tmp_path):
    def write(df, n):
        raise ValueError("no space")

    with pytest.raises(runs.RunFailed, match="records 0 to|records 20 to|records 10 to|records 30 to") as failed:
        runs.Run(source, write, f"{tmp_path}/c").start().wait()
    assert failed.value.record is None and "no space" in failed.value.reason


def test_a_run_that_goes_on_can_be_halted(source, tmp_path):
    told = []
    run = runs.Run(source, lambda df, n: df.count(), f"{tmp_path}/c", on_complete=lambda p: told.append(p.records)).start(available_now=False)
    run.query.processAllAvailable()
    run.halt()
    assert run.wait().records == 40 and told == [40] and not run.query.isActive
