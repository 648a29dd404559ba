"""What queries of the encoder registry, record inputs and learned prototypes leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.functions import encoders as E
from sparsight.functions import likelihood as L
from sparsight.operators import neighbours as N
from sparsight.plans import network


def test_every_kind_of_encoder_gives_bits_within_its_width(spark):
    rows = spark.createDataFrame([(1.5, "a", True, 10, 20, [1, 0, 1], [0, 2], 8.5, 47.3)], "v double, c string, b boolean, x long, y long, dense array<int>, sparse array<int>, lon double, lat double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    scalar = (("w", 21), ("low", 0), ("high", 10), ("n", 60))
    fields = [
        *[E.Field(k, k, "v", scalar) for k in ("scalar", "adaptive-scalar", "delta")],
        E.Field("log", "log", "v", (("n", 50),)), E.Field("category", "category", "c", (("w", 3), ("categories", ("a", "b")))), E.Field("sdr", "sdr-category", "c", (("w", 5), ("n", 100))),
        E.Field("random", "random-scalar", "v", (("resolution", 0.5), ("offset", 0.0), ("radius", 20))), E.Field("date", "date", "ts"), E.Field("place", "coordinate", "x,y", (("radius", 2), ("w", 5), ("n", 64))),
        E.Field("geo", "geospatial", "lon,lat,v", (("w", 5), ("n", 64))), E.Field("dense", "pass-through", "dense", (("n", 3), ("dense", True))), E.Field("sparse", "sparse-pass-through", "sparse", (("n", 3),)),
        E.Field("own", "sdr-pass-through", "sparse", (("n", 3), ("w", 2))), E.Field("flag", "boolean", "b", (("w", 3),)),
    ]
    assert {f.kind for f in fields} == set(E.KINDS)
    bits, width = E.record_bits(fields)
    found = rows.select(bits.alias("b")).first().b
    assert len(found) == len(set(found)) and 0 <= min(found) and max(found) < width
    with pytest.raises(ValueError):
        E.record_bits([E.Field("f", "none", "v")])
    assert (E.scalar_space("absolute"), E.scalar_space("delta")) == ("adaptive-scalar", "delta")
    with pytest.raises(ValueError):
        E.scalar_space("relative")


def test_near_buckets_of_the_random_kind_share_bits(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (1000.0,), (None,)], "v double")
    bits, _ = E.KINDS["random-scalar"]({"resolution": 0.5, "offset": 0.0, "radius": 25}, ["v"])
    a, b, far, clipped, none = (set(r.b) for r in rows.select(bits.alias("b")).collect())
    assert len(a & b) == 20 and len(a & far) <= 2 and len(clipped) == 21 and none == set()


def test_patterns_that_are_learned_lie_apart(spark):
    rng = np.random.default_rng(6)
    for dims, least in ((1, 3.0), (2, 4.0), (5, 9.0)):
        x = rng.integers(0, 40, (150, dims)).astype(float)
        kept = []
        for i, v in enumerate(x):
            if all(np.sqrt(((v - x[j]) ** 2).sum()) >= least for j in kept):
                kept.append(i)
        rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, x array<double>, category int")
        assert sorted(r.id for r in N.learn(rows, distance_threshold=least).collect()) == kept


def test_long_chains_of_patterns_are_decided_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "ROUNDS", 2)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.arange(60.0), rng.integers(0, 90, 60).astype(float)])
    kept = []
    for i, v in enumerate(x):
        if all(abs(v - x[j]) >= 2.0 for j in kept):
            kept.append(i)
    rows = spark.createDataFrame([(i, [float(v)], 0) for i, v in enumerate(x)], "id long, x array<double>, category int")
    assert sorted(r.id for r in N.learn(rows, distance_threshold=2.0).collect()) == kept


def test_inputs_modes_and_classifiers_by_name(spark):
    rows = spark.createDataFrame([("1, 0,1", [5, 2], {"a": "b"}, 1.0)], "t string, s array<int>, m map<string,string>, d double")
    r = rows.select(*[network.as_input(rows, c).alias(c) for c in ("t", "s", "m")]).first()
    assert (r.t.bits, r.s.bits, r.m.record, r.t.kind) == ([0, 2], [2, 5], {"a": "b"}, "digits")
    with pytest.raises(ValueError):
        network.as_input(rows, "d")
    with pytest.raises(ValueError):
        L.anomaly("none", F.lit(1), F.lit(1))
    found = network.classifier_of({"a": "sdr", "b": "cla", "c": None}, a={"alpha": 0.2})
    assert set(found) == {"a", "b"}
    with pytest.raises(ValueError):
        network.classifier_of({"a": "knn"})
    with pytest.raises(ValueError):
        network.record_dict(rows, ["_reset"], F.lit(0).cast("timestamp"), F.lit(0))


def test_nulls_are_encoded_as_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (3.0,)], "v double")
    scalar, log = E.ScalarEncoder.of(21, 0, 10, n=60), E.LogEncoder.of(n=50)
    found = rows.select(scalar.bits(F.col("v")).alias("s"), scalar.bucket(F.col("v")).alias("b"), log.bucket(F.col("v")).alias("l")).collect()
    assert found[0].s == [] and found[1].s == [] and len(found[2].s) == 21
    assert found[0].b is None and found[1].b is None and found[0].l is None and found[2].l is not None
