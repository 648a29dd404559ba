import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from sparsight.llm import codes as C


def brute(rows, parts=8, entries=16, rounds=6):
    """rows(id, vector, label), whole numbers throughout, every entry's whole distance."""
    kept = [(i, [Fraction(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, [floor(4096 * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    span = width // parts
    cut = lambda v, p: v[p * span : (p + 1) * span]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + min(error, C.LONGEST)
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(error, C.LONGEST), label))
    return sorted(((i, c, e, min(sums[label], C.LONGEST), sha) for i, c, e, label in out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partial_distances_find_the_nearest_and_drop_terms():
    rng = np.random.default_rng(1)
    for d, n, reach in ((1, 50, 3), (2, 200, 4), (8, 500, 3), (8, 2000, 4096), (0, 4, 1)):
        rows, book = rng.integers(-reach, reach, (n, d)), rng.integers(-reach, reach, (16, d))
        book[7] = book[3]
        distances = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        stats = {}
        for r, b in ((rows, book), (rows.astype(object), book)):
            index, distance = C.nearest(r, b, stats)
            assert index.tolist() == distances.argmin(axis=1).tolist() and distance.tolist() == distances.min(axis=1).tolist()
        if d == 8:
            assert stats["summed"] < 0.92 * stats["terms"]  # noise without clusters is the worst case
    centres = rng.integers(-4096, 4096, (16, 8))
    rows, stats = centres[rng.integers(0, 16, 1000)] + rng.integers(-99, 99, (1000, 8)), {}
    C.nearest(rows, centres, stats)
    assert stats["summed"] < 0.35 * stats["terms"]
    assert [len(x) for x in C.nearest(rows[:0], centres)] == [0, 0]


def test_embeddings_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(C.op12_partial_distance_codes(spark, sf)) == brute(rows)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string, code int, v string, none int, `a.b` int"
    rng = np.random.default_rng(3)
    data = [(int(i), rng.normal(size=9).tolist(), "a" if i % 3 else None) for i in rng.integers(0, 30, 60)]
    data += [data[0], data[0], (None, [1.0, 2.0], None), (None, None, "a"), (3, [1.0, None], "b"), (4, [float("nan")], "b"), (5, [float("-inf")], None), (6, [], "c"), (7, [0.25], "c")]
    df = lambda rows: spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    assert got(C.compress(df(data))) == brute(data)
    few = [(2, [1.5] * 8, None), (1, [-1.5] * 8, None)]
    assert got(C.compress(df(few))) == brute(few)
    assert got(C.compress(df([]))) == [] == got(C.compress(df([(1, None, None)])))
    assert got(C.compress(df([(1, [], None), (2, [], "a")]))) == brute([(1, [], None), (2, [], "a")])


@pytest.mark.parametrize("top", [300.0, 1e12, 1e30, 1.7e308])
def test_components_of_any_size_are_exact(spark, top):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=8) * (top / 4 if i % 5 == 0 else 1)).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert got(C.compress(df)) == brute(data)
