"""From raw documents to packed training sequences: language ID, near-duplicate removal, secret masking, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns that they
were given. Null texts, empty tables, repeated rows and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm.common import table, text_of, written
from sparsight.llm.jaccard import SHINGLES_5_AT_80, similar_groups
from sparsight.llm.languages import is_known, language_of, training_samples
from sparsight.llm.packing import pack, token_pieces
from sparsight.llm.secrets import redact


def _whole(docs: DataFrame):
    """All columns of a row in one, whatever their names; what a stage computes beside it can clash with none of them."""
    return F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _unpacked(rows: DataFrame, docs: DataFrame, changed: dict) -> DataFrame:
    """The columns of docs from rows(row, ...), the changed ones by their new values."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; lang becomes the language found. Others go: no text, no letters, unlike any."""
    found = docs.select(_whole(docs), language_of(F.col("text"), training_samples(docs)).alias("found"))
    return _unpacked(found.where(is_known(F.col("found"))), docs, {"lang": F.col("found.lang")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts (5-word shingles, 80 of 100) stays: the one with the smallest id, ids before none.

    Of rows that repeat in id and text, one stays. Documents without words are in no group and stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash"))
    kind = f"struct<none:boolean,id:{docs.schema['doc_id'].dataType.simpleString()},hash:bigint>"  # as it comes back from the groups
    keyed = docs.select(_whole(docs), key.cast(kind).alias("key"))
    groups = similar_groups(keyed.select("key", F.col("row.text").alias("text")), SHINGLES_5_AT_80, "key")
    stay = groups.where(F.col("key") == F.col("component_id")).select(F.col("key").alias("stays")).distinct()
    # keys are never null, and null ids inside them compare as equal; by plain equality and a merge join the
    # rows stay where they were dealt by key, so that whole rows are shuffled once
    chosen = keyed.join(stay.hint("merge"), F.col("key") == F.col("stays"), "left_semi")
    return _unpacked(chosen.dropDuplicates(["key"]), docs, {})


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; n_chars follows the text."""
    masked = docs.select(_whole(docs), redact(F.col("text")).alias("masked"))
    return _unpacked(masked, docs, {"text": F.col("masked"), "n_chars": F.char_length("masked").cast("long")})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 1024 ids."""
    pieces = token_pieces(docs, ["doc_id"], keep_ids=False).drop("ids")
    return pack(written(pieces, "pieces"), "length", ["doc_id", "piece", "ids_crc32", "start"])


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: The stages' tokenizer, automata and shingle hashes have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
