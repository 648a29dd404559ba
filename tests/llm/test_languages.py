import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparsight.llm import languages as L


def brute_phrases(text, training):
    """Longest matches by substring search, over the whole text."""
    letters = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split(" ")).split()
    s, count = " ".join(letters), 0
    i = 0
    while i < len(s):
        j = i + 1
        while j < len(s) and s[i : j + 1] in training:
            j += 1
        count, i = count + 1, j
    return count, len(s)


def test_phrase_counts_against_substring_search(monkeypatch):
    monkeypatch.setattr(L, "LANE", 7)
    rng = random.Random(2)
    words = ["the", "then", "and", "of", "ofthe", "été", "über", "a"]
    training = "\n".join(" ".join(rng.choices(words[:6], k=60)) for _ in range(3))
    parser = L.Parser((("x", training), ("y", "zzz\nyy z")))
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(40)] + ["", None, "!!", "q", "qq q", " The   AND--of\n", "t" * 50, "ofthe" * 40, "the then " * 30]
    counts, sizes = parser.phrases(texts)
    for t, row, n in zip(texts, counts, sizes):
        for got, own in zip(row, (training, "zzz\nyy z")):
            assert (got, n) == brute_phrases(t or "", own), t


def test_automaton_holds_exactly_the_substrings():
    s = np.array([0, 1, 1, 0, 1, 0, 0, 1, 1])
    states = L.suffix_automaton(s, 2)
    held = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for n in range(1, 6):
        for k in range(2**n):
            word, state, ok = [k >> i & 1 for i in range(n)], 0, True
            for c in word:
                state = states[state, c]
                ok &= bool(state)
                if not ok:
                    break
            assert ok == (tuple(word) in held)


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op7_cross_parsing(spark, sf).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.letters >= 60]
    assert len(judged) > 40 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in judged]) > 0.97


def test_odd_rows(spark, odd, odd_dir, empty_dir):
    rows = L.op7_cross_parsing(spark, odd_dir).collect()
    assert len(rows) == 12 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 8)} == {"und"}
    assert L.op7_cross_parsing(spark, empty_dir).count() == 0
    none = L.training_samples(odd.where(F.lit(False)))
    assert none == () and odd.select(L.language_of(F.col("text"), none).lang.alias("l")).distinct().collect()[0].l == "und"


def test_texts_in_no_known_language_are_not_known(spark):
    samples = (("x", "abc abd abe abc abd\nbca bcd"),)
    df = spark.createDataFrame([("日本語の文章はこのように書かれています本当に長い文章",), ("abc abd",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(L.is_known(L.language_of(F.col("t"), samples))).collect()] == [False, True, False, False]


def test_large_alphabets_are_whole_and_their_texts_are_known(spark):
    rng = random.Random(6)
    scripts = {"zh": [chr(0x4E00 + i) for i in range(3000)], "ko": [chr(0xAC00 + i) for i in range(1200)], "en": list("abcdefghijklmnopqrstuvwxyz")}
    words = {k: ["".join(rng.choices(v, k=rng.choice((1, 2, 2, 3)))) for _ in range(2000)] for k, v in scripts.items()}
    weight = [1 / (i + 3) for i in range(2000)]
    text = lambda k, n: ("" if k == "zh" else " ").join(rng.choices(words[k], weight, k=n))
    samples = tuple((k, "\n".join(text(k, 500)[:900] for _ in range(12))) for k in sorted(scripts))
    parser = L.Parser(samples)
    texts = [text(k, 60)[:120] for k in scripts for _ in range(3)]
    counts, sizes = parser.phrases(texts)
    for t, row, n in zip(texts, counts, sizes):
        assert [(c, n) for c in row] == [brute_phrases(t, own) for _, own in samples]
    rows = [(k, text(k, 200)) for k in scripts for _ in range(10)] + [("und", "".join(chr(0x0400 + rng.randrange(32, 80)) for _ in range(300)))]
    found = spark.createDataFrame(rows, "k string, t string").select("k", L.language_of(F.col("t"), samples).alias("l")).select("k", "l.lang", L.is_known(F.col("l")).alias("known")).collect()
    assert all(r.known == (r.k != "und") and (r.k == "und" or r.lang == r.k) for r in found)


def test_long_rows_take_part_where_there_are_no_others(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 4)
    monkeypatch.setattr(L, "SAMPLE_CHARS", 30)
    rows = [(n, "short text", "xx") for n in range(40)] + [(100 + n, "short text" * 50, "xx") for n in range(40)] + [(200 + n, "zig zag " * 100 + "end", "yy") for n in range(40)]
    samples = dict(L.training_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert samples["xx"].split("\n") == ["short text"] * 4
    assert all(t in "zig zag " * 100 + "end" and 26 <= len(t) <= 30 for t in samples["yy"].split("\n")) and len(set(samples["yy"].split("\n"))) > 1


def test_lanes_change_no_result(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choices(["one", "two", "three", "there", "tone", "onetwo", "é"], k=4000))
    training = " ".join(rng.choices(["one", "two", "three", "there", "tone"], k=500))
    parser = L.Parser((("x", training), ("y", "a" * 300)))
    texts = [text, "a" * 5000, "b" * 700 + "a" * 999]
    results = []
    for lane in (3, 100, 512, 100_000):
        monkeypatch.setattr(L, "LANE", lane)
        results.append(parser.phrases(texts)[0].tolist())
    assert results[0] == results[1] == results[2] == results[3]
    assert results[0][1][1] == -(-5000 // 300)
