import base64
import functools
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from sparsight.llm.tokens import bpe_decode, bpe_encode, encode, encoding, op5_bpe_roundtrip, safe_pieces

TEXT = st.text(st.one_of(st.sampled_from(" \n\t'sxé1.,ñ \u0085 "), st.characters(codec="utf-8")), max_size=300)


@functools.cache
def of_the_json_file():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_safe_cuts_change_no_token(text):
    pieces = list(safe_pieces(text, 7))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in encoding().encode_ordinary(p)] == encoding().encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_ids_equal_those_of_the_tokenizer_file(text):
    tokenizer = of_the_json_file()
    for t in (text, f"a<|endoftext|>{text}"):
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check(spark, folder):
    bpe, docs = plain(), spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = []
    for r in docs:
        ids = bpe.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, op5_bpe_roundtrip(spark, folder).collect()))) == sorted(map(repr, want))


def test_documents(spark, sf, odd_dir, empty_dir):
    check(spark, sf)
    check(spark, odd_dir)
    assert op5_bpe_roundtrip(spark, empty_dir).count() == 0


def test_ids_of_any_bytes_decode(spark):
    rows = spark.createDataFrame([(1, "né \U0001f600"), (2, None), (3, "")], "k int, t string").select("k", bpe_encode(F.col("t")).alias("ids"))
    assert {r.k: bytes(r.raw).decode() for r in rows.select("k", bpe_decode(F.col("ids")).alias("raw")).collect()} == {1: "né \U0001f600", 2: "", 3: ""}
    half = spark.createDataFrame([([encode("é")[0].item()],), (None,)], "ids array<int>").select(bpe_decode(F.col("ids"))).collect()
    assert bytes(half[0][0]) in "é".encode() and bytes(half[1][0]) == b""
