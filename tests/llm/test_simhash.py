import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparsight.llm import simhash as S


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    prints, parent = [slow_fingerprint(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, f"{prints[i]:016x}", least.get(root(i))) for i, (k, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def clusters(rng, centres, copies, flips):
    """Points around centres, each with up to so many flipped bits."""
    out = []
    for c in rng.integers(0, 2**63, centres).tolist():
        for _ in range(copies):
            out.append(c ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, flips + 1))}))
    return np.unique(np.array(out, dtype=np.uint64))


def slow_roots(points, bits):
    root = list(range(len(points)))
    table = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
    changed = True
    while changed:
        new = [min(root[j] for j in np.flatnonzero(row)) for row in table]
        changed, root = new != root, new
    return root


@pytest.mark.parametrize("shape", [(1, 1, 0), (400, 1, 0), (40, 30, 3), (3, 500, 6), (1, 900, 4), (60, 12, 2)])
@pytest.mark.parametrize("bits", [0, 2, 4])
def test_trees_find_all_links(shape, bits, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 16)
    points = clusters(np.random.default_rng(2), *shape)
    assert S.linked(points, bits).tolist() == slow_roots(points, bits)


def test_pairs_meet_in_some_shard_and_trees_prune():
    points = clusters(np.random.default_rng(3), 700, 5, 4)
    tree = S.grow(points[::7], 32, 2)
    shards = [set(at.tolist()) for _, at in S.leaves(tree, points, 2)]
    assert len(shards) > 8 and max(map(len, shards)) < len(points) / 3
    table = np.bitwise_count(points[:, None] ^ points[None, :])
    for i, j in zip(*np.nonzero((table <= 2) & (table > 0))):
        assert any(i in s and j in s for s in shards)
    stats = {}
    S.linked(points, 2, stats)
    assert stats["distances"] < 0.4 * len(points) ** 2


def test_long_texts_and_the_engines_hash(spark):
    rng = random.Random(1)
    text = " ".join(f"W{rng.randint(0, 99)}" for _ in range(3000))
    assert S.fingerprint(text) == slow_fingerprint(text)
    many = S.shingle_hashes(" ".join(f"x{i}" for i in range(S.HASHES_AT_ONCE + 5)), 3)
    assert S.bit_counts(many).tolist() == [int((many >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    shingle = "oneé two three"
    assert spark.range(1).select(F.xxhash64(F.lit(shingle))).first()[0] == int(S.shingle_hashes(shingle, 3).view(np.int64)[0])


def test_planted_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 40)
    monkeypatch.setattr(S, "SAMPLED", 8)
    rng, docs = random.Random(8), []
    for _ in range(60):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 9, 60, 400]))]
        for _ in range(rng.choice([1, 2, 9])):
            edited = list(words)
            edited[rng.randrange(len(words))] = "x"
            docs.append(" ".join(rng.choice([words, edited])))
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.near_copies(df)) == brute(rows)


def test_odd_rows(spark, odd, odd_dir, empty_dir):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(S.op13_vantage_point_copies(spark, odd_dir)) == brute(rows)
    assert S.op13_vantage_point_copies(spark, empty_dir).count() == 0
    clashing = odd.select("*", *[F.lit(1).alias(c) for c in ("f", "id", "component", "fingerprint", "a.b")])
    assert got(S.near_copies(clashing)) == brute(rows)


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(S.op13_vantage_point_copies(spark, sf)) == brute(rows)
