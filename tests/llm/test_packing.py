import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparsight.llm.packing import assemble, op4_matched_packing, pack, plan, token_pieces


def bins_of(counts, capacity):
    bins = defaultdict(list)
    for r in plan(counts, capacity):
        for rank in range(r.first, r.last):
            b, at = divmod(rank - r.first, r.per_sequence)
            bins[r.base + b].append((r.used + at * r.length, r.length, rank))
    return bins


def first_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        for i, g in enumerate(gaps):
            if g >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_is_valid_and_tight():
    rng = random.Random(3)
    for trial in range(300):
        capacity = rng.choice([10, 30, 100])
        lengths = [min(capacity, max(1, int(rng.expovariate(rng.choice([3, 8]) / capacity)) + 1)) for _ in range(rng.randint(0, 200))]
        counts = Counter(lengths)
        bins = bins_of(counts, capacity)
        placed = Counter(x for b in bins.values() for _, x, _ in b)
        assert placed == counts
        for n in counts:
            assert sorted(r for b in bins.values() for _, x, r in b if x == n) == list(range(counts[n]))
        for b in bins.values():
            at = 0
            for offset, n, _ in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity and sum(3 * n > capacity for _, n, _ in b) <= 2
        assert sorted(bins) == list(range(len(bins)))
        assert len(bins) <= first_fit(lengths, capacity) * 1.03 + 1, trial


def test_pieces_and_sequences_hold_the_tokenizers_ids(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs}
    rows = op4_matched_packing(spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(ids)
    for doc_id, parts in by_doc.items():
        at = 0
        for j, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            own = np.array(ids[doc_id][r.start : r.start + r.length], dtype="<u4")
            assert (r.piece, r.start) == (j, at) and r.ids_crc32 == zlib.crc32(own) and (j == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids[doc_id])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= 1.01 * sum(map(len, ids.values())) / 1024 + 1


def test_added_tokens_in_texts_have_the_tokenizers_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x{end}y\n{end}\n", f"{end} and {end[:-1]} and |{end}>", "<|endoftext| >", "word " * 3000 + end + " word" * 3000, (f"{end}  é ☃ " * 400).strip()]
    ids = {n: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for n, t in enumerate(texts)}
    rows = token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    for n, own in ids.items():
        parts = sorted((r for r in rows if r.doc_id == n), key=lambda r: r.piece)
        assert [i for r in parts for i in r.ids] == own, texts[n][:40]
        for r in parts:
            piece = np.array(own[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(piece) and r.length == len(piece)
    assert 50256 in ids[0]


def test_odd_rows_and_clashing_names(spark, odd, odd_dir, empty_dir):
    rows = op4_matched_packing(spark, odd_dir).collect()
    assert sum(r.piece == 0 for r in rows) == 12 and {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert op4_matched_packing(spark, empty_dir).count() == 0
    pieces = token_pieces(odd.withColumn("offset", F.lit("x")), ["doc_id", "offset"]).cache()
    packed = pack(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    assert dict(packed.dtypes)["offset"] == "bigint"
    whole = assemble(packed).collect()
    assert sum(len(r.ids) for r in whole) == pieces.agg(F.sum("length")).first()[0] and max(len(r.ids) for r in whole) <= 1024
