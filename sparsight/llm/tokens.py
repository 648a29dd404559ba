"""Byte-level BPE by the tiktoken library and a local rank file, as Arrow column functions.

Long texts are cut before encoding at safe boundaries: in front of a space or line feed that follows a letter, a digit
or ASCII punctuation. No match of the split pattern contains white space after another character, and no alternative
looks back, so such a cut never changes a token. What has no boundary stays in one piece, whatever its length.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_memory_back, table, text_of

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
#: Characters from which a text is cut, and about how many a cut piece holds.
PIECE_CHARS = 65_536
_SAFE = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ!-/:-@\[-`{-~])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str | None = None, pattern: str | None = None):
    """The tiktoken encoding of a rank file (a line each: base64 bytes, rank), without special tokens; one per worker process."""
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts text at safe boundaries into pieces of about size characters, longer where no boundary is near."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids of one text. The encoding has no special tokens, so all of the text is ordinary."""
    bpe = encoding(ranks_path)
    if len(text) <= PIECE_CHARS:
        return bpe.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([bpe.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text)])


@functools.lru_cache(maxsize=4)
def added_tokens(json_path: str | None = None) -> dict[str, int]:
    """Content and id of the tokens that a tokenizer's JSON file adds to its vocabulary; they are found in texts as they stand."""
    with open(json_path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that depend on what is around them")
    return {t["content"]: t["id"] for t in added}


def encode_with_added(text: str, added: dict[str, int], ranks_path: str | None = None) -> np.ndarray:
    """The ids of one text in which added tokens stand for themselves, the longest first; what lies between is encoded on its own."""
    if not any(t in text for t in added):
        return encode(text, ranks_path)
    parts = re.split(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})", text)
    ids = [np.array([added[part]], dtype=np.uint32) if n % 2 else encode(part, ranks_path) for n, part in enumerate(parts)]
    return np.concatenate(ids)


def int_lists(rows: list, dtype=np.int32) -> pa.Array:
    """Lists of integers as one Arrow list array, by offsets."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, dtype=dtype) for r in rows]) if rows else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoded(texts: pa.Array, ranks_path: str | None) -> pa.ListArray:
    give_memory_back()
    return int_lists([encode(t.as_py(), ranks_path) if t.is_valid else () for t in texts])


def _decoded(ids: pa.ListArray, ranks_path: str | None) -> pa.Array:
    bpe, flat, bounds = encoding(ranks_path), ids.values.to_numpy(), ids.offsets.to_numpy()
    # numbers become Python's a text at a time
    return pa.array((bpe.decode_bytes(flat[a:b].tolist()) for a, b in zip(bounds, bounds[1:])), pa.binary(), size=len(ids))


def bpe_encode(column: Column, ranks_path: str | None = None) -> Column:
    """array<int> of a text column's ids; the empty array for an empty text and for null."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _encoded(texts, ranks_path)

    # an optimizer that took it for cheap would run it again inside of what uses its result
    return ids.asNondeterministic()(column)


def bpe_decode(column: Column, ranks_path: str | None = None) -> Column:
    """The raw bytes that ids stand for (no replacement characters where they aren't UTF-8); empty for null."""

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        return _decoded(ids, ranks_path)

    return raw(column)


def bpe_roundtrip(column: Column, ranks_path: str | None = None) -> Column:
    """struct(ids, raw): a text's ids, and the bytes that these decode to, in one pass through Python."""

    @F.arrow_udf("struct<ids: array<int>, raw: binary>")
    def both(texts: pa.Array) -> pa.Array:
        ids = _encoded(texts, ranks_path)
        return pa.StructArray.from_arrays([ids, _decoded(ids, ranks_path)], names=["ids", "raw"])

    return both.asNondeterministic()(column)


def op5_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests; null texts count as empty, an empty table gives none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", bpe_roundtrip(text_of()).alias("b"))
    return rows.select(
        "doc_id",
        F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("b.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("b.raw", 256).alias("decoded_sha256"),
    )
