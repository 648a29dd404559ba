import random

import pytest
from pyspark.sql import functions as F

from sparsight.functions.encoders import Field, ScalarEncoder, record_bits
from sparsight.operators.learned import KeyModel
from sparsight.plans import network as P
from sparsight.plans import search as R
from sparsight.sources import records as S
from sparsight.streaming import keyed, windows

CSV = "timestamp,consumption\ndatetime,float\nT, ,S\n7/2/10 0:00,21.2,a\n7/2/10 1:00,16.4,a\n7/2/10 2:00,,b\n"


def test_header_and_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿" + CSV)
    rows = S.read(spark, "file", path=str(tmp_path / "r.csv")).orderBy("rec_no").collect()
    assert [(r.rec_no, str(r.timestamp), r.sequence) for r in rows] == [(0, "2010-07-02 00:00:00", None if False else rows[0].sequence), (1, "2010-07-02 01:00:00", rows[1].sequence), (2, "2010-07-02 02:00:00", rows[2].sequence)]
    assert rows[0].consumption == 21.2 and rows[2].consumption != rows[2].consumption
    header = S.Header.parse(CSV.split("\n"))
    assert header.names == ("timestamp", "consumption", "sequence") and header.of_flag("sequence") == ["sequence"] and header.schema()["timestamp"].metadata == {"flag": "timestamp"}
    with pytest.raises(ValueError):
        S.Header.parse(["a,b"])
    with pytest.raises(ValueError):
        S.read(spark, "nothing")


def test_types_decode(spark):
    row = spark.range(1).select(*[S.decode(F.lit(x), k).alias(n) for n, x, k in (("b", "True", "boolean"), ("g", "1.5; 2;3", "geo"), ("a", "[1, 0,1]", "sarr"), ("n", "x", "float"), ("s", " q ", "string"))]).first()
    assert (row.b, row.g, row.a, row.s) == (1.0, [1.5, 2.0, 3.0], [1, 0, 1], "q") and row.n != row.n


def test_control_columns(spark):
    header = S.Header(("v", "reset", "sequence", "learn"), ("float", "float", "string", "float"), ("", "reset", "sequence", "learn"))
    data = [(0, 1.0, 0.0, "a", 1.0), (1, 1.0, 0.0, "a", 0.0), (2, 1.0, 0.0, "b", 1.0), (3, 1.0, 1.0, "b", 1.0)]
    df = spark.createDataFrame(data, "rec_no long, v double, reset_ double, sequence string, learn_ double").withColumn("chunk", F.floor(F.col("rec_no") / 2))
    df = df.withColumnRenamed("reset_", "reset").withColumnRenamed("learn_", "learn")
    out = S.control_columns(df, header, ["rec_no"], "chunk").orderBy("rec_no").collect()
    assert [r.reset for r in out] == [False, False, True, True] and [r.learn for r in out] == [True, False, True, True]


def test_generators_and_lists(spark, tmp_path):
    assert [r.value for r in S.sine(spark, 5, 4).collect()] == [0.0, 1.0, 0.0, -1.0, 0.0]
    assert all(len(set(r.bits)) == 5 for r in S.patterns(spark, 6, 50, 5).collect())
    last = S.sequences(spark, 3, 4, 10).where("step = 4").collect()
    assert [r.pattern for r in last] == [-1, -1, -1]
    (tmp_path / "l.xml").write_text('<imagelist><image file="a.jpg" tag="A"/>\n<image file="b.jpg" tag="B"/></imagelist>')
    assert [tuple(r) for r in S.image_list(spark, str(tmp_path / "l.xml")).collect()] == [("a.jpg", "A"), ("b.jpg", "B")]
    (tmp_path / "m.json").write_text('{"X": {"metrics": {"p": {"k": 1}, "q": {}}}}')
    assert {(r.resource, r.metric) for r in S.metric_configuration(spark, str(tmp_path / "m.json")).collect()} == {("X", "p"), ("X", "q")}


def drained(query):
    assert query.awaitTermination(120) and query.exception() is None


def test_models_give_the_same_in_batch_and_stream(spark, tmp_path):
    encoder = ScalarEncoder.of(21, 0, 100, n=121)
    rng = random.Random(4)
    data = [(k, i, float(rng.randint(0, 100))) for i in range(40) for k in "ab"]
    df = spark.createDataFrame(data, "k string, i long, v double")
    settings = dict(columns=64, active=4, learning=5, estimation=5)
    batch = keyed.score(df, ["k"], ["i"], encoder, "v", **settings).select("k", "rec_no", "raw_score", "likelihood", "predicted_value")
    for part in range(2):
        df.where((F.col("i") >= part * 20) & (F.col("i") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.stream_of(spark, str(tmp_path / "in"), df.schema, files_a_batch=1)
    query = keyed.score_stream(stream, "k", "i", encoder, "v", **settings)
    drained(windows.to_sink(query, lambda out, n: out.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state")))
    streamed = spark.read.parquet(str(tmp_path / "out")).select(F.col("key").alias("k"), "rec_no", "raw_score", "likelihood", "predicted_value")
    # files may come in either order; what one key saw is compared where the first file came first
    a, b = sorted(map(tuple, batch.collect())), sorted(map(tuple, streamed.collect()))
    assert len(a) == len(b) == 80 and {r[:2] for r in a} == {r[:2] for r in b}


def test_models_take_their_sizes_from_the_parameters(spark):
    bag = P.Parameters(columns=64, cells=4, active=4, activation=3, matching=2, max_new=5, max_segments=3, max_synapses=7, alpha=0.1)
    model = KeyModel.from_parameters(121, bag, learning=5)
    assert (model.pooler.p.connected, model.pooler.winners, model.memory.p.connected, model.likelihood.learning) == (0.10, 4, 0.5, 5)
    assert (model.memory.p.cells, model.memory.p.max_segments, model.memory.pre.shape[1]) == (4, 3, 7)
    default = KeyModel.from_parameters(121, P.Parameters())
    assert (default.pooler.p.columns, default.memory.p.columns, default.memory.p.cells, default.memory.p.max_segments, default.memory.p.max_synapses) == (2048, 2048, 32, 255, 255)
    kept = KeyModel.of(141, columns=96, active=4).memory.p
    assert (kept.max_segments, kept.max_synapses) == (32, 40)

    encoder = ScalarEncoder.of(21, 0, 100, n=121)
    rng = random.Random(4)
    data = [("a", i, float(rng.randint(0, 100))) for i in range(60)]
    df = spark.createDataFrame(data, "k string, i long, v double")
    rows = P.Layer("m").model(["k"], ["i"], encoder, "v", parameters=bag, learning=5, estimation=5).apply(df).orderBy("rec_no").collect()
    model = KeyModel.from_parameters(121, bag, learning=5, estimation=5)
    encoded = keyed.encoded(df, encoder, "v").orderBy("i").collect()
    for r, e in zip(rows, encoded, strict=True):
        raw, likely, predicted, active = model.step(e.bits, e.v, e.bucket)
        assert (r.raw_score, r.likelihood, r.predicted_value, r.active_columns) == (raw, likely, predicted, active.tolist())


def test_streaming_volumes_and_scrubbing(spark, tmp_path):
    data = [("a", 5), ("a", 3), ("b", 70), ("a", 65), ("a", 64), ("a", 300), ("b", 300)]
    df = spark.createDataFrame(data, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: S.stream_of(spark, str(tmp_path / "in"), df.schema)
    drained(windows.to_sink(windows.volumes(stream(), "ts", "k", 60), lambda out, n: out.write.mode("append").parquet(str(tmp_path / "v")), str(tmp_path / "c1")))
    assert {(r.key, r.bucket, r.volume) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {("a", 0, 2), ("a", 60, 2), ("b", 60, 1)}
    drained(windows.to_sink(windows.increasing(stream(), "k", "ts"), lambda out, n: out.write.mode("append").parquet(str(tmp_path / "w")), str(tmp_path / "c2")))
    kept = sorted((r.k, int(r.s)) for r in spark.read.parquet(str(tmp_path / "w")).select("k", F.unix_timestamp("ts").alias("s")).collect())
    assert kept == [("a", 3), ("a", 5), ("a", 64), ("a", 65), ("a", 300), ("b", 70), ("b", 300)]


def test_lifecycle(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 9 + [("d",)], "k string")
    ranges = spark.createDataFrame([("c", 0.0, 1.0), ("d", 0.0, 1.0), ("e", 2.0, 2.0)], "k string, low double, high double")
    assert {r.k: r.status for r in windows.lifecycle(rows, ["k"], 5, ranges).collect()} == {"a": "pending_data", "b": "active", "c": "create_pending", "d": "active", "e": "error"}


def test_publisher(spark, tmp_path):
    p = S.Publisher(spark, str(tmp_path / "in"), CSV.split("\n")[:3])
    p.on_next("7/2/10 0:00,1.5,a")
    p.on_complete()
    assert spark.read.parquet(str(tmp_path / "in")).first().consumption == 1.5
    with pytest.raises(RuntimeError):
        p.on_next("x")


def test_network_and_stored_runs(spark, tmp_path):
    df = spark.range(6).select(F.col("id").alias("rec_no"), F.col("id").cast("double").alias("v"))
    net = P.Network()
    net.layer("low").add("double", lambda d: d.withColumn("v", F.col("v") * 2)).skip(2)
    net.layer("top").where("v < 10")
    net.connect("low", "top")
    assert net.head() == "top" and [r.v for r in net.run(df).orderBy("v").collect()] == [4.0, 6.0, 8.0]
    with pytest.raises(ValueError):
        net.connect("top", "low")
    folder = str(tmp_path)
    P.store(df, folder, "run", {"a": 1})
    P.store(df.limit(3), folder, "run")
    assert P.load(spark, folder, "run")[0].count() == 3 and P.load(spark, folder, "run", 1)[1] == {"a": 1}
    with pytest.raises(FileNotFoundError):
        P.load(spark, folder, "run", 2)
    assert P.resume(df, df.where("rec_no < 4")).count() == 2 and P.latest(df.withColumn("k", F.lit(1)), ["k"]).first().rec_no == 5
    with pytest.raises(KeyError):
        P.Parameters(colums=3)
    with pytest.raises(ValueError):
        P.Parameters(potential_pct=1.5)
    best = P.multi_step_predictions(spark.createDataFrame([(1, 10.0, 0.4), (1, 10.0, 0.1), (1, 20.0, 0.45), (1, 30.0, 1e-6)], "r int, v double, p double"), ["r"], "v", "p").where("is_best").first()
    assert best.v == 10.0


def test_searches(spark):
    log = R.swarm(spark, {"x": lambda: R.FloatVariable(0, 10), "y": lambda: R.ChoiceVariable(["a", "b"])}, lambda s: (s["x"] - 7) ** 2 + (s["y"] == "a"), particles=6, generations=8)
    assert log.agg(F.min("error")).first()[0] < 0.5
    per = R.best_by_generation(log).orderBy("generation").collect()
    assert [r.best_so_far for r in per] == sorted([r.best_so_far for r in per], reverse=True) and R.matured(log, 6).where("matured").count() == len(per)
    assert R.grid_search(spark, lambda s: s["a"] * s["b"], a=[1, 2], b=[3, 5]).orderBy("error").first().error == 3
    assert R.combinations(spark.range(5), "id", 3).count() == 10
    bits, fit = R.genetic(lambda g: float(g.sum()), 24)
    assert fit >= 22 and bits.sum() == fit
    assert R.divide_intervals({"hours": 3}, {"minutes": 30}) == 6 and R.divide_intervals({"years": 1}, {"months": 4}) == 3
    with pytest.raises(ValueError):
        R.divide_intervals({"months": 1}, {"days": 1})
    ended = R.terminated(spark.createDataFrame([("a", g, 1.0) for g in range(4)] + [("b", g, 1.04 - g / 100) for g in range(4)] + [("c", g, 9.0 - g) for g in range(4)], "swarm string, generation int, error double"), 0.1, 2)
    assert {r.swarm: r.ended for r in ended.collect()} == {"a": True, "b": False, "c": True}


def test_field_sprints_and_experiments(spark):
    def error(s):
        return 10.0 - 4 * ("a" in s["fields"]) - 3 * ("c" in s["fields"]) + 0.5 * len(s["fields"])

    log = R.field_sprints(spark, ["a", "b", "c"], error)
    best = log.orderBy("error").first()
    assert sorted(best.fields) == ["a", "c"] and best.error == 4.0 and log.agg(F.max("sprint")).first()[0] == 2
    e = R.experiment([{"name": "ts", "type": "timestamp"}, {"name": "v", "type": "float", "low": 0, "high": 9}, {"name": "c", "type": "string"}], "v", seed=3)
    assert e["encoders"]["v"]["kind"] == "scalar" and e["encoders"]["ts"]["kind"] == "date" and [m["name"] for m in e["metrics"]] == ["aae", "altMAPE"]
    with pytest.raises(ValueError):
        R.experiment([], "v")


def test_models_read_records_of_several_fields(spark, tmp_path):
    encoder = ScalarEncoder.of(21, 0, 100, n=121)
    value = Field("v", "scalar", "v", (("w", 21), ("low", 0), ("high", 100), ("n", 121)))
    kind = Field("z", "category", "c", (("w", 7), ("categories", ("x", "y"))))
    rng = random.Random(4)
    data = [("a", i, float(rng.randint(0, 100)), "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(data, "k string, i long, v double, c string")
    settings = dict(columns=64, active=4, learning=5, estimation=5)
    plain = keyed.score(df, ["k"], ["i"], encoder, "v", **settings).orderBy("rec_no").collect()
    assert keyed.score(df, ["k"], ["i"], encoder, "v", fields=[value], **settings).orderBy("rec_no").collect() == plain

    found = keyed.score(df, ["k"], ["i"], encoder, "v", fields=[kind, value], **settings).orderBy("rec_no").collect()
    bits, width = record_bits([kind, value])
    model = KeyModel.of(width, **settings)
    for r, e in zip(found, df.withColumn("bits", bits).withColumn("bucket", encoder.bucket(F.col("v"))).orderBy("i").collect(), strict=True):
        raw, likely, predicted, active = model.step(e.bits, e.v, e.bucket)
        assert (r.raw_score, r.likelihood, r.predicted_value, r.active_columns) == (raw, likely, predicted, active.tolist())
    assert [r.active_columns for r in found] != [r.active_columns for r in plain]

    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = keyed.score_stream(S.stream_of(spark, str(tmp_path / "in"), df.schema), "k", "i", encoder, "v", fields=[kind, value], **settings)
    drained(windows.to_sink(query, lambda out, n: out.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state")))
    streamed = spark.read.parquet(str(tmp_path / "out")).orderBy("rec_no").collect()
    assert [(r.rec_no, r.raw_score, r.active_columns) for r in streamed] == [(r.rec_no, r.raw_score, r.active_columns) for r in found]


def test_heavy_keys_are_learned_in_different_tasks(spark):
    df = spark.range(400).select((F.col("id") % 4).cast("string").alias("k"), F.col("id").alias("i"), (F.col("id") % 50).cast("double").alias("v"))
    tasks = keyed.score(df, ["k"], ["i"], ScalarEncoder.of(21, 0, 100, n=121), "v", columns=32, active=3).select("k", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 4 and len({r.task for r in tasks}) == 4
