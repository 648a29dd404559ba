import random

import numpy as np
import pytest

from sparsight.llm import jaccard as J
from sparsight.llm.graph import components


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(docs, rule):
    sets, parent = [shingles(t, rule.width) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if rule.den * both >= rule.num * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(docs)), key=str)


def seen(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def edited(rng, words, share):
    return [rng.choice("xyz") + str(rng.randint(0, 9)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("rule", [J.SHINGLES_4_AT_85, J.SHINGLES_5_AT_80])
def test_planted_copies_against_brute_force(spark, rule):
    rng = random.Random(8)
    docs, line = [], "a line that many of the texts share from end to end"
    for base in range(14):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 9, 15, 40, 120, 400]))]
        for copy in range(rng.choice([1, 2, 5, 12])):
            docs.append(f"{line if base % 3 == 0 else ''} {' '.join(edited(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.05])))}")
    docs += ["", None, "  \n ", "one two", "ONE two", line]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert seen(J.similar_groups(df, rule).collect()) == brute(rows, rule)


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_CLASSES", 7)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, words, 0.01))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert seen(J.similar_groups(df, J.SHINGLES_4_AT_85).collect()) == brute(rows, J.SHINGLES_4_AT_85)


def test_slices_and_rounds_give_the_same_groups(spark, monkeypatch):
    """Keys and pairs of blocks are shuffled in parts, each written before the next one starts."""
    labels, write = [], J.written
    monkeypatch.setattr(J, "written", lambda df, label: (labels.append(label), write(df, label))[1])
    for name, value in (("SLICED_FROM", 0), ("BLOCK_CLASSES", 7), ("ROUND_TIMES", 1)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, words if i < 50 else words[:40], 0.01))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert seen(J.similar_groups(df, J.SHINGLES_4_AT_85).collect()) == brute(rows, J.SHINGLES_4_AT_85)
    assert labels.count("lists") == J.SLICES and labels.count("links") > 2


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert seen(J.op2_count_vector_join(spark, sf).collect()) == brute(rows, J.SHINGLES_4_AT_85)


def test_odd_rows(spark, odd, odd_dir, empty_dir):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert seen(J.op2_count_vector_join(spark, odd_dir).collect()) == brute(rows, J.SHINGLES_4_AT_85)
    assert J.op2_count_vector_join(spark, empty_dir).count() == 0


def test_tree_finds_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.05], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(90)]
    counts = np.stack([np.bincount((s % np.uint64(32)).astype(int), minlength=32) for s in sets])
    sizes = np.array(list(map(len, sets)))
    rule = J.SHINGLES_4_AT_85
    got = {(a, b) for x, y in J.CountTree(counts, sizes, rule).pairs(counts, sizes) for a, b in zip(x.tolist(), y.tolist())}
    linked = {(a, b) for a in range(90) for b in range(90) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - n)}
    assert linked <= got
    forest = J.links_forest(sets, None, rule)
    assert all((a, b) in linked for a, b in forest)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(9)
    rule = J.SHINGLES_4_AT_85
    for n in (7, 12, 30, 100, 400, 1500):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = max(d for d in range(n) if rule.den * (n - d) >= rule.num * (n + d))
            b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), most, replace=False)), rng.integers(0, 2**63, most).astype(np.uint64)]))
            frequent = np.sort(rng.choice(a, len(a) * rng.integers(0, 11) // 10, replace=False))
            values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            text, key = J.group_keys(values, bounds, rule, frequent)
            assert set(key[text == 0].tolist()) & set(key[text == 1].tolist()), n
            p = J.parities(values, bounds)
            assert J._may_link(rule, len(a), len(b), p[0], p[1])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_links_do_not_depend_on_the_frequent_shingles(spark, sf, monkeypatch):
    from sparsight.llm import jaccard

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    groups = lambda: sorted(map(tuple, jaccard.similar_groups(docs, jaccard.SHINGLES_5_AT_80).select("doc_id", "n_shingles", "component_id").collect()))
    found = groups()
    every = np.unique(jaccard.shingle_sets([r.text for r in docs.collect()], 5)[0])
    for answer in (np.zeros(0, np.uint64), every, every[::2].copy()):
        monkeypatch.setattr(jaccard, "frequent_shingles", lambda *_, answer=answer: answer)
        assert groups() == found
