from fractions import Fraction
from math import floor

import numpy as np
from pyspark.sql import functions as F

from sparsight.llm import search as S


def brute(vectors, k, asks):
    out = []
    for q, x in vectors:
        if asks(q):
            scored = sorted((-int(np.dot(x, y)), c) for c, y in vectors if c != q)[:k]
            out += [(q, i, c, -s) for i, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def test_maxscore_is_exact_with_ties_and_prunes():
    rng = np.random.default_rng(4)
    for d, n in ((1, 40), (3, 300), (16, 3000)):
        rows = rng.integers(-3 if d < 16 else -80, 4 if d < 16 else 80, (n, d))
        rows[n // 2] = rows[0]
        ids = rng.permutation(n) * 7
        asked = slice(0, n, 11)
        stats = {}
        q, score, row = S.maxscore(rows[asked], ids[asked], rows, ids, 5, stats)
        got = sorted((int(ids[asked][a]), int(r), int(s)) for a, s, r in zip(q, score, row))
        vectors = [(int(i), x) for i, x in zip(ids, rows)]
        want = sorted((a, c, s) for a, _, c, s in brute(vectors, 5, set(ids[asked].tolist()).__contains__))
        assert got == want
        if d == 16:
            assert stats["probed"] < 0.6 * stats["pairs"] and stats["traversed"] < stats["terms"]


def test_wide_numbers_stay_exact():
    rows = np.array([[2**23, 1], [2**23, 2], [2**23 - 1, 2**23], [-(2**23), 5]])
    q, score, row = S.maxscore(rows, np.arange(4), rows, np.arange(4), 3)
    assert sorted(zip(q.tolist(), row.tolist(), score.tolist())) == sorted((a, c, s) for a, _, c, s in brute(list(enumerate(rows)), 3, lambda _: True))


def test_embeddings_over_many_cells(spark, sf, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_SHARD", 70)
    monkeypatch.setattr(S, "QUERIES_PER_BLOCK", 4)
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, dtype=float)).astype(int)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, S.op6_maxscore_neighbours(spark, sf).collect())) == brute(rows, 5, lambda i: i % 50 == 0)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    data = [(0, [1.0, 2.0], "x"), (1, [1.0, 1.0], "x"), (2, None, None), (3, [1.0, None], None), (4, [float("nan"), 1.0], None), (5, [float("inf"), 1.0], None), (None, [9.0, 9.0], None), (6, [1.0], None), (7, [], None)]
    df = spark.createDataFrame(data, schema)
    rows = S.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 1, 1, 256 * 256 * 3), (0, 2, 6, 256 * 256), (0, 3, 7, 0)]
    assert S.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_components_of_any_size_take_part(spark):
    schema = "vec_id long, embedding array<double>"
    values = [(0, [1.0, 2.0]), (1, [70000.0, 0.0]), (2, [-70000.5, 1.0]), (3, [3.0, 3.0]), (4, [1e25, 1.0]), (5, [-1e300, 0.0]), (50, [1e9, 1e9]), (6, [1.7e308, -1.0]), (150, [1.7e308, 3.0]), (7, [-8.5e307, 1.0]), (100, [1e25, -1.0])]
    got = sorted(map(tuple, S.top_k(spark.createDataFrame(values, schema), F.col("vec_id") % 50 == 0, 5).collect()))
    whole = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in values]
    want = []
    for q, x in whole:
        if q % 50 == 0:
            scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c) for c, y in whole if c != q)[:5]
            want += [(q, n, c, -score) for n, (score, c) in enumerate(scores, 1)]
    assert got == sorted(want)
