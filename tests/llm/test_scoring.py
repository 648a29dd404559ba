import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparsight.llm import scoring as S


def brute(docs):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]

    held = {i: k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for i, (k, _) in enumerate(docs)}
    one, two = Counter(), Counter()
    for i, (_, t) in enumerate(docs):
        if not held[i]:
            w = words(t)
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    q = lambda a, b: (two[a, b] + S.PRIOR * p(b)) / (one[a] + S.PRIOR)
    out = []
    for i, (k, t) in enumerate(docs):
        w = words(t)
        out.append((k, held[i], len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), sum(math.log10(q(a, b)) for a, b in zip([None, *w], w))))
    return out


def same(rows, want):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    for r, w in zip(rows, want):
        assert r[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and r[6] == pytest.approx(w[6], rel=2e-3, abs=1e-6)


def test_documents_against_brute_force(spark, sf, odd_dir, empty_dir):
    for folder in (sf, odd_dir):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        same(S.op10_trie_scores(spark, folder).collect(), brute(docs))
    assert S.op10_trie_scores(spark, empty_dir).count() == 0


def test_the_model_predicts_held_out_text_better_than_single_words(spark, sf):
    rows = [r for r in S.op10_trie_scores(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn_from(spark):
    docs = [(3, "a b a")] if zlib.crc32(b"3") % 5 == 1 else [(k, "a b a") for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:1]
    rows = S.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), S.in_fold("doc_id", 5, 1)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(4, 0, 0, 0.0)]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], [2**40], list(range(50)), sorted(rng.integers(0, 2**45, 1000).tolist()), sorted(rng.integers(0, 30, 400).tolist())):
        blob = b"xyz" + S.EliasFano.encode(np.array(values, dtype=np.uint64)) + b"tail"
        held = S.EliasFano(blob, 3)
        assert held.decode().tolist() == values and blob[held.end :] == b"tail"
    many = np.sort(rng.integers(0, 2**40, 10_000).astype(np.uint64))
    assert len(S.EliasFano.encode(many)) < 10_000 * (2.5 + math.log2(2**40 / 10_000)) / 8


def test_trie_from_a_memory_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique((rng.integers(0, 300, 5000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 2**32, 5000).astype(np.uint64))
    counts = rng.integers(1, 10**6, len(pairs))
    (tmp_path / "trie").write_bytes(S.Trie.build(pairs, counts))
    trie = S.Trie(np.memmap(tmp_path / "trie", mode="r"))
    assert np.allclose(S.LEVELS[trie.lookup(pairs)], counts, rtol=0.001) and (trie.lookup(pairs + np.uint64(1))[~np.isin(pairs + np.uint64(1), pairs)] == 0).all()
    assert (trie.lookup(np.array([2**63, 0], dtype=np.uint64)) == 0).all()
    small = S.quantise(np.arange(16385))
    assert S.LEVELS[small].tolist() == list(range(16385))
    empty = S.Trie(S.Trie.build(pairs[:0], counts[:0]))
    assert empty.lookup(pairs[:3]).tolist() == [0, 0, 0]


def test_elias_fano_is_read_in_place():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 2**40), (7, 3), (500, 90), (500, 2**62), (5000, 10**6), (3, 0)):
        values = np.sort(rng.integers(0, top, n, endpoint=True).astype(np.uint64))
        ef = S.EliasFano(S.EliasFano.encode(values))
        assert (ef.decode() == values).all() and (ef[rng.integers(0, n, 50)] >= 0).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2 * top + 2, 300, dtype=np.uint64)])
        assert (ef.search(asked) == np.searchsorted(values, asked)).all()
    empty = S.EliasFano(S.EliasFano.encode(np.zeros(0, np.uint64)))
    assert empty.n == 0 and empty.search(np.array([5], np.uint64)).tolist() == [0]
