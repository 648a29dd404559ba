import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
from pyspark.sql import functions as F

from sparsight.llm import sharding as S
from sparsight.llm.sharding import communication_matrix, exact_sizes, op1_hypergeometric_shards, shuffle_to_shards


def test_matrix_has_the_asked_sums():
    counts, sizes = [5, 0, 17, 3, 9], exact_sizes(34, 4)
    m = communication_matrix(counts, sizes, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([communication_matrix([6, 4], [5, 5], s)[0, 0] for s in range(4000)])
    law = np.array([1, 3]) / 1  # support starts at 1: P(1)=C(5,1)C(5,5)/C(10,6)
    assert draws.min() >= law[0] and abs(draws.mean() - 3) < 0.06 and abs(draws.var() - 6 * 0.25 * 4 / 9) < 0.06


def test_documents_fill_gapless_shards(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_hypergeometric_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert max(c := Counter(r.shard for r in rows).values()) - min(c) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r["size"] == len(docs[r.doc_id].encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_same_result_whatever_the_partitions(spark):
    a = spark.range(500).withColumnRenamed("id", "k")
    one, two = (shuffle_to_shards(a.repartition(n), 7, "k").collect() for n in (1, 9))
    assert set(one) == set(two) and len({(r.shard, r.slot) for r in one}) == 500
    assert [r.slot for r in sorted(one, key=lambda r: r.k)][:5] != list(range(5))


def test_odd_rows_and_clashing_names(spark, odd, odd_dir, empty_dir):
    rows = op1_hypergeometric_shards(spark, odd_dir).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r.doc_id in (1, 2)} == {1}
    assert op1_hypergeometric_shards(spark, empty_dir).count() == 0
    out = shuffle_to_shards(odd.withColumn("shard", F.lit("x")).withColumn("a.b", F.lit(1)), 3, "doc_id")
    assert dict(out.dtypes)["shard"] == "int" and "a.b" in out.columns and out.count() == odd.count()


def test_large_populations_follow_the_same_law():
    rng = np.random.default_rng(5)
    small = [S._hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    # the inversion for large populations, held against the exact law of a small one
    class Uniform:
        def __init__(self, u):
            self.u = u

        def random(self):
            return self.u

    good, bad, taken = 3 * 10**9, 7 * 10**9, 20
    law = [comb(20, k) * 0.3**k * 0.7 ** (20 - k) for k in range(21)]  # the populations are so large that it is binomial
    for k in range(21):
        u = sum(law[:k]) + law[k] / 2
        assert S._hypergeometric(Uniform(u), good, bad, taken) == k
    assert abs(np.mean(small) - 6) < 0.2
    wide = np.array([S._hypergeometric(rng, 2 * 10**9, 6 * 10**9, 4_000_000) for _ in range(400)])
    deviation = (4_000_000 * 0.25 * 0.75) ** 0.5
    assert abs(wide.mean() - 10**6) < 5 * deviation / 20 and 0.8 < wide.std() / deviation < 1.2
    # all rows but a few are taken: the rest decides
    assert S._hypergeometric(rng, 10**9, 10**9, 2 * 10**9 - 1) in (10**9, 10**9 - 1)
    m = communication_matrix([10**9, 2 * 10**9, 5], exact_sizes(3 * 10**9 + 5, 4), 3)
    assert m.sum(axis=1).tolist() == [10**9, 2 * 10**9, 5] and m.sum(axis=0).tolist() == exact_sizes(3 * 10**9 + 5, 4)


def test_rows_that_repeat_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_BLOCK", 50)
    same = spark.range(0, 2000, 1, 8).select(F.lit(None).cast("long").alias("k"), F.lit("x").alias("t"))
    rows = same.union(spark.range(500).select(F.col("id").alias("k"), F.lit("y").alias("t")))
    out = shuffle_to_shards(rows, 4, "k").collect()
    assert Counter(r.shard for r in out) == {s: 625 for s in range(4)} and len({(r.shard, r.slot) for r in out}) == 2500
    assert Counter(r.t for r in out) == {"x": 2000, "y": 500}


def test_order_follows_neither_ids_nor_columns(spark):
    rows = shuffle_to_shards(spark.range(3000).select(F.lit(7).alias("k"), F.col("id").alias("n")), 3, "k").collect()
    for s in range(3):
        n = np.array([r.n for r in sorted(rows, key=lambda r: r.slot) if r.shard == s], dtype=float)
        assert len(n) == 1000 and abs(np.corrcoef(n, np.arange(1000))[0, 1]) < 0.12
    assert 420 < np.mean([r.slot for r in rows if r.n < 1500]) < 580
