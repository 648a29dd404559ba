import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.functions import encoders as E
from sparsight.functions import likelihood as L
from sparsight.functions import sdr as A


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lit(*values, kind="array<double>"):
    return F.array(*map(F.lit, values)).cast(kind)


def test_scalar_encoder_bits(spark):
    e = E.ScalarEncoder.of(3, 1, 8, n=14, forced=True)
    assert e.resolution == pytest.approx(7 / 11)
    p = E.ScalarEncoder.of(3, 1, 8, radius=1.5, periodic=True, forced=True)
    assert (p.n, p.resolution) == (14, 0.5)
    for x, bits in ((3, [3, 4, 5]), (3.1, [3, 4, 5]), (3.5, [4, 5, 6]), (3.6, [4, 5, 6]), (4, [5, 6, 7]), (1, [0, 1, 13]), (7.9, [0, 12, 13]), (float("nan"), [])):
        assert one(spark, p.bits(F.lit(float(x)))) == bits, x


def test_scalar_encoder_checks():
    for bad in (dict(w=4, low=0, high=1, n=20), dict(w=5, low=0, high=1, n=20), dict(w=21, low=1, high=1, n=50), dict(w=21, low=0, high=1, n=50, radius=2), dict(w=21, low=0, high=1, n=21)):
        with pytest.raises(ValueError):
            E.ScalarEncoder.of(**bad)


def test_values_outside(spark):
    e = E.ScalarEncoder.of(21, 0, 100, n=121)
    f = E.ScalarEncoder.of(21, 0, 100, n=121, clip=False)
    assert one(spark, e.bits(F.lit(-5.0)))[0] == 0 and one(spark, e.bits(F.lit(500.0)))[-1] == 120
    assert one(spark, f.bits(F.lit(-5.0))) == [] and one(spark, f.bits(F.lit(None).cast("double"))) == []


def test_decoding(spark):
    e = E.ScalarEncoder.of(21, 0, 100, n=121)
    rows = spark.range(0, 101, 7).select("id", e.bits(F.col("id").cast("double")).alias("bits"))
    assert all(abs(r.value - r.id) <= e.resolution / 2 for r in e.decode(rows, "bits", "id").collect())
    low, high = one(spark, e.runs(e.bits(F.lit(40.0))))[0]
    assert low == high == pytest.approx(40, abs=1)
    assert len(one(spark, e.runs(F.array_union(e.bits(F.lit(10.0)), e.bits(F.lit(90.0)))))) == 2


def test_log_encoder(spark):
    e = E.LogEncoder.of(5, 1, 10000, radius=1)
    same = one(spark, e.bits(F.lit(1e6)), e.bits(F.lit(1e4)))
    assert same[0] == same[1] and one(spark, e.closeness(F.lit(10.0), F.lit(1000.0))) == pytest.approx(0.5)


def test_random_encoder_keeps_the_overlap_rule():
    e = E.RandomScalarEncoder(resolution=1.0, w=21, n=400)
    t = e.table(radius=40)
    for i in t:
        assert len(set(t[i])) == 21
        for j in t:
            if i < j:
                assert e._allowed(i, j, t[i], t[j])


def test_all_buckets_of_the_random_encoder_keep_the_overlap_rule(spark):
    for e in (E.RandomScalarEncoder(1.0), E.RandomScalarEncoder(1.0, w=9, n=90, seed=3, max_buckets=200)):
        t = e.table()
        sets = [set(t[k]) for k in range(e.max_buckets)]
        for i in range(e.max_buckets):
            for j in range(i + 1, e.max_buckets):
                shared = len(sets[i] & sets[j])
                assert shared == e.w - (j - i) if j - i < e.w else shared <= e.max_overlap
        got = spark.createDataFrame([(0,), (e.max_buckets - 1,), (77,), (None,)], "b long").select("b", e.bits(F.col("b")).alias("bits")).collect()
        assert all(r.bits == (t[r.b] if r.b is not None else []) for r in got)
        assert e.table(radius=3) == {k: t[k] for k in range(e.max_buckets // 2 - 3, e.max_buckets // 2 + 4)}
    with pytest.raises(ValueError):
        E.RandomScalarEncoder(1.0, w=21, n=127).sequence()


def test_random_bits_and_categories(spark):
    a, b, again = one(spark, E.random_bits(F.lit("a"), 21, 400), E.random_bits(F.lit("b"), 21, 400), E.random_bits(F.lit("a"), 21, 400))
    assert a == again != b and len(set(a)) == 21 and max(a) < 400 and a == sorted(a)


def test_encodings_find_their_categories_by_shared_bits(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "category string").withColumn("bits", E.random_bits(F.col("category"), 21, 400))
    rows = known.withColumn("bits", F.slice("bits", 1, 19)).union(known.where("category = 'b'").withColumn("bits", F.slice("bits", 1, 10))).withColumnRenamed("category", "true")
    found = E.categories_of(rows.union(rows), "bits", known, 21, 400).select("true", "category").collect()
    assert sorted(map(tuple, found)) == sorted([(x, x) for x in "abc"] * 2)


def test_coordinates_share_bits_with_neighbours(spark):
    at = lambda x, y: E.coordinate_bits(F.lit(x), F.lit(y), F.lit(3), 21, 1000)
    here, near, far = one(spark, at(100, 100), at(100, 101), at(500, 500))
    assert len(set(here) & set(near)) > 9 > len(set(here) & set(far))


def test_dates(spark):
    ts = F.lit("2010-11-04 14:55:00").cast("timestamp")
    assert one(spark, E.season(ts), E.weekday(ts), E.seconds_of_day(ts), E.is_weekend(ts)) == (307, 3, 14 * 3600 + 55 * 60, 0)
    for text, ramp in (("2011-12-25 10:00:00", 1.0), ("2011-12-24 12:00:00", 0.5), ("2011-12-26 12:00:00", 0.5), ("2011-12-28 00:00:00", 0.0)):
        assert one(spark, E.holiday_ramp(F.lit(text).cast("timestamp"))) == pytest.approx(ramp)
    assert str(one(spark, E.parse_timestamp(F.lit("7/2/10 0:00"), "yyyy-MM-dd", "M/d/yy H:mm"))) == "2010-07-02 00:00:00"


def test_pass_through_and_multi(spark):
    bits = lambda *b: lit(*b, kind="array<int>")
    assert one(spark, E.pass_through(bits(5, 1), 9, 2)) == [1, 5] and one(spark, E.pass_through(bits(5, 9), 9)) is None and one(spark, E.pass_through(bits(5), 9, 2)) is None
    assert one(spark, E.multi([("b", bits(0, 1), 4), ("a", bits(2), 3)])) == [2, 3, 4]


def test_array_kernels(spark):
    a, b = lit(3, 1, 2), lit(1, 0, 5)
    assert one(spark, A.divide(a, b)) == [3, 1, 0.4] and one(spark, A.rounded_divide(a, lit(3, 3, 3), 2)) == [1, 0.33, 0.67]
    assert one(spark, A.to_dense(lit(0, 3, kind="array<int>"), 5)) == [1, 0, 0, 1, 0] and one(spark, A.to_sparse(lit(1, 0, 1))) == [0, 2]
    assert one(spark, A.argsort(lit(2, 1, 2))) == [1, 0, 2] and one(spark, A.argmin(a), A.argmax(a)) == (1, 0)
    assert one(spark, A.contains_all(lit(1), lit().cast("array<double>"))) and one(spark, A.interleave(a, b)) == [3, 1, 1, 0, 2, 5]
    assert one(spark, A.reshape(lit(1, 2, 3, 4, 5), 2)) == [[1, 2], [3, 4], [5]] and one(spark, A.product(a), A.mean(a)) == (6, 2)
    assert one(spark, A.raise_by(a, 1.0, lit(0, kind="array<int>"))) == [4, 1, 2] and one(spark, A.minimum(a, b)) == [1, 0, 2]
    assert one(spark, A.coordinates(F.lit(11), [3, 4]), A.flat_index(lit(2, 3, kind="array<int>"), [3, 4])) == ([2, 3], 11)
    assert one(spark, A.digits_to_bits(F.lit("1, 0,1"))) == [1, 0, 1] and one(spark, A.clip(a, 1.5, 2.5)) == [2.5, 1.5, 2]


def test_raw_scores_and_their_moving_average(spark):
    bits = lambda b: lit(*b, kind="array<int>")
    cases = [([], [], 0), ([2, 3, 6], [3, 5, 7], 2 / 3), ([2, 3, 6], [2, 3, 6], 0), ([2, 3, 6], [], 1), ([], [3, 5], 0)]
    for active, predicted, score in cases:
        assert one(spark, L.raw_score(bits(active), bits(predicted))) == pytest.approx(score)
    scores = [0, 0, 1 / 3, 2 / 3, 1, 1, 1, 0, 0]
    assert [round(float(np.mean(scores[max(0, i - 2) : i + 1])), 9) for i in range(9)] == [round(x, 9) for x in (0, 0, 1 / 9, 3 / 9, 2 / 3, 8 / 9, 1, 2 / 3, 1 / 3)]


def test_normal_tail(spark):
    for i in range(41):
        assert L.TAIL[i] == pytest.approx(0.5 * math.erfc(i / 10 / math.sqrt(2)), rel=1e-4)
    t = lambda x: one(spark, L.normal_tail(F.lit(float(x)), F.lit(0.0), F.lit(1.0)))
    assert t(0) == 0.5 and t(1) == pytest.approx(0.1587, abs=1e-4) and t(-1) == pytest.approx(0.8413, abs=1e-4) and t(7.2) == 0 and t(-7.2) == 1


def test_softmax_and_closeness(spark):
    p = one(spark, L.softmax(lit(1, 2, 3)))
    assert sum(p) == pytest.approx(1) and p == pytest.approx((np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()).tolist())
    assert one(spark, E.closeness(F.lit(8.0), F.lit(10.0))) == pytest.approx(0.8)
    lon, lat = E.inverse_mercator(*E.mercator(F.lit(12.5), F.lit(-45.25)))
    assert one(spark, lon, lat) == (pytest.approx(12.5), pytest.approx(-45.25))


def test_equal_encodings_are_decoded_once(spark, sf):
    from sparsight.plans import patterns, series

    e = E.ScalarEncoder.of(21, 0, 500, n=421)
    found = e.decode(spark.range(5000).select("id", e.bits((F.col("id") % 7 * 50).cast("double")).alias("bits")), "bits", "id")
    assert {(r.id % 7 * 50, r.n) for r in found.groupBy("id", "value").count().withColumnRenamed("count", "n").collect()} == {(k * 50, 1) for k in range(7)} and found.count() == 5000
    text = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    # rows are never grouped by their key, which would need a row for each bit and bucket of theirs
    assert "Aggregate [id" not in text(found)
    # no event is encoded: the scan of events leads to the join without hashes
    assert "xxhash64" not in text(series.category_decode(spark, sf))
    # places are distinct before they are encoded
    plan = text(patterns.geo_bits(spark, sf))
    assert plan.index("md5") < plan.index("Aggregate [lon")
