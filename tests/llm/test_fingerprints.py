import hashlib
import random
import re

from pyspark.sql import functions as F

from sparsight.llm import fingerprints as P


def units(text):
    whole = [u for u in re.split(r"\n|(?<=[.!?]) ", text or "") if u]
    return {part for u in whole for part in (re.findall(r"(?s).{64,512}?(?<=[aeiou]) |.{1,512}", u) if len(u) > 512 else [u])}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    """docs: (doc_id, text), null ids last."""
    out = []
    for i, (k, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(units(text), units(edited)), 9), round(jaccard(units(text), units(after)), 9)))
    return out


def seen(rows):
    return [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]


def test_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 7)
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = P.op3_iblt_fingerprints(spark, sf).collect()
    assert sorted(seen(rows)) == sorted(brute(docs))
    prints = {}
    for r in rows:
        assert prints.setdefault(dict(docs)[r.doc_id], r.fingerprint) == r.fingerprint


def test_peeling_recovers_the_difference(spark):
    left, right = [f"line {i}" for i in range(40)], [f"line {i}" for i in range(3, 43)]
    df = spark.createDataFrame([("\n".join(left), "\n".join(right))], ["a", "b"])
    for sketch_cells in (P.CELLS, 48):
        a, b = P.digests(F.col("a")), P.digests(F.col("b"))
        found = df.select(P.reconcile(a, b, P.sketch(P._signed(a, 1), P.CELLS), P.sketch(P._signed(b, 1), P.CELLS)).alias("f"), a.alias("da"), b.alias("db")).first()
        assert found.f.done and set(found.f.only_left) == set(found.da) - set(found.db) and set(found.f.only_right) == set(found.db) - set(found.da)
        assert sketch_cells and len(found.f.only_left) == 3


def test_overfull_sketch_fails_and_is_retried_larger(spark):
    df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(500)), "\n".join(f"r{i}" for i in range(300)))], ["a", "b"])
    a, b = P.digests(F.col("a")), P.digests(F.col("b"))
    sa, sb = P.sketch(P._signed(a, 1), P.CELLS), P.sketch(P._signed(b, 1), P.CELLS)
    r = df.select(P.peel(P.subtract(sa, sb), P.CELLS).done.alias("small"), P.reconcile(a, b, sa, sb).alias("f")).first()
    assert not r.small and r.f.done and len(r.f.only_left) == 500 and len(r.f.only_right) == 300


def test_odd_rows(spark, odd_dir, empty_dir):
    rows = P.op3_iblt_fingerprints(spark, odd_dir).collect()
    assert len(rows) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert P.op3_iblt_fingerprints(spark, empty_dir).count() == 0


def test_single_row_follows_itself(spark):
    rows = P.fingerprint_versions(spark.createDataFrame([(5, "one. two.")], "doc_id long, text string")).collect()
    assert seen(rows) == brute([(5, "one. two.")])


def test_null_ids_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 3)
    texts = [f"text {n}. of {n % 4}" for n in range(17)] + ["same"] * 5
    rows = spark.createDataFrame([(None, t) for t in texts] + [(3, "a. b"), (9, "b. c")], "doc_id long, text string")
    hashed = rows.where("doc_id is null").select("text", F.xxhash64(F.lit(3), "text").alias("h")).collect()
    order = [(9, "b. c"), (3, "a. b")] + [(None, r.text) for r in sorted(hashed, key=lambda r: r.h)]
    key = lambda r: str(r)
    assert sorted(seen(P.fingerprint_versions(rows).collect()), key=key) == sorted(brute(order), key=key)


def test_what_no_attempt_can_peel_is_compared(spark, monkeypatch):
    monkeypatch.setattr(P, "RETRIES", (3,))
    df = spark.createDataFrame([("\n".join(f"line {i}" for i in range(200)), "\n".join(f"line {i}" for i in range(50, 300)))], ["a", "b"])
    a, b = P.digests(F.col("a")), P.digests(F.col("b"))
    r = df.select(P.reconcile(a, b, P.sketch(P._signed(a, 1), P.CELLS), P.sketch(P._signed(b, 1), P.CELLS)).alias("f"), a.alias("a"), b.alias("b")).first()
    assert r.f.done and sorted(r.f.only_left) == sorted(set(r.a) - set(r.b)) and sorted(r.f.only_right) == sorted(set(r.b) - set(r.a))


def test_a_megabyte_of_lines_and_a_long_line(spark):
    import time

    lines = "\n".join(f"this is line {i}, with a few words more" for i in range(25_000))
    rng = random.Random(2)
    one = " ".join("".join(rng.choices("aeiourstln", k=rng.randint(2, 9))) + str(i) * (i % 3 == 0) for i in range(3000))
    moved = one[:9000] + "an insertion " + one[9000:]
    docs = [(3, lines), (2, lines[:600_000]), (1, one), (0, moved)]
    began = time.time()
    rows = P.fingerprint_versions(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert time.time() - began < 90
    assert sorted(seen(rows)) == sorted(brute(docs))
    near = {r.doc_id: r for r in rows}
    assert near[1].near_next > 0.8 and near[1].near_edited > 0.3
