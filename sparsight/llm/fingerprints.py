"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs, all in DataFrame expressions.

A text's units are its lines, cut further at sentence ends, and long sentences at word ends that their own letters choose,
so that an edit moves only the cuts around it; a unit's digest is a 64-bit hash. A sketch is an array of
cells (count, xor of digests, xor of their checks); each digest goes to one cell in each of three subtables. Two
sketches of the same shape subtract cell by cell; cells left with a single digest give it away and are peeled until
nothing is left, which recovers exactly the digests that only one version has. Where peeling gets stuck, the digests
are sorted into blocks by their hash, and each block is sketched and peeled again, larger on each failure; should the last
attempt fail, the block's digests are compared as they are. The work grows with a text's length times its logarithm.

Every step works inside one row: no shuffle beyond the one that brings a document and its successor together.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table, text_of

#: Cells of the sketch that is the fingerprint; a multiple of three.
CELLS = 24
#: Where that fails: digests a block on average, and the cells of a block at each further attempt.
PER_BLOCK = 8
RETRIES = (24, 48, 96, 192, 768, 3072)
#: Parallel peeling takes a few rounds; a sketch that isn't done after these counts as failed.
ROUNDS = 16
#: Where a line is cut into sentences.
SENTENCE_END = "\n|(?<=[.!?]) "
#: Sentences longer than LONG_UNIT characters are cut: behind a vowel and a space from 64 characters on, or after 512.
LONG_UNIT = 512
LONG_PARTS = "(?s).{64,512}?(?<=[aeiou]) |.{1,512}"
ROWS_PER_BUCKET = 250
MAX_BUCKETS = 100_000


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's units; none for an empty text."""
    sentences = F.filter(F.split(text, SENTENCE_END), lambda u: u != "")
    units = F.flatten(F.transform(sentences, lambda u: F.when(F.char_length(u) > LONG_UNIT, F.regexp_extract_all(u, F.lit(LONG_PARTS), F.lit(0))).otherwise(F.array(u))))
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(u)))


def _check(digest: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), digest), F.lit(2**31 - 1)).cast("int")


def _signed(found: Column, sign: int) -> Column:
    return F.transform(found, lambda d: F.struct(F.lit(sign).alias("n"), d.alias("k"), _check(d).alias("c")))


def sketch(items: Column, cells: int | Column) -> Column:
    """Cells of struct(n, k, c) that hold the items (of the same type: sign, digest, check)."""
    width = F.lit(cells // 3) if isinstance(cells, int) else (cells / 3).cast("int")

    def subtable(placed: Column, part: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.aggregate(
                F.filter(placed, lambda x: x[part] == i),
                F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("c")),
                lambda a, x: F.struct((a.n + x.n).alias("n"), a.k.bitwiseXOR(x.k).alias("k"), a.c.bitwiseXOR(x.c).alias("c")),
            ),
        )

    def place(x: Column) -> Column:
        return let(
            F.xxhash64(width, x.k),
            lambda h: F.struct(
                x.n.alias("n"), x.k.alias("k"), x.c.alias("c"),
                *[F.pmod(F.shiftright(h, s), width).cast("int").alias(p) for p, s in (("p0", 0), ("p1", 20), ("p2", 40))],
            ),
        )

    return let(F.transform(items, place), lambda placed: F.concat(*[subtable(placed, p) for p in ("p0", "p1", "p2")]))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct((a.n - b.n).alias("n"), a.k.bitwiseXOR(b.k).alias("k"), a.c.bitwiseXOR(b.c).alias("c")))


def _is_empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c.n == 0) & (c.k == 0) & (c.c == 0))


def peel(difference: Column, cells: int | Column) -> Column:
    """struct(done, only_left, only_right) of a subtracted sketch: whether all was recovered, and the digests so far."""
    no_digests = F.array().cast("array<bigint>")

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state.cells, lambda c: (F.abs(c.n) == 1) & (_check(c.k) == c.c)))
        return let(
            pure,
            lambda p: F.when(F.size(p) == 0, state).otherwise(
                F.struct(
                    subtract(state.cells, sketch(p, cells)).alias("cells"),
                    F.concat(state.only_left, F.transform(F.filter(p, lambda c: c.n == 1), lambda c: c.k)).alias("only_left"),
                    F.concat(state.only_right, F.transform(F.filter(p, lambda c: c.n == -1), lambda c: c.k)).alias("only_right"),
                )
            ),
        )

    start = F.struct(difference.alias("cells"), no_digests.alias("only_left"), no_digests.alias("only_right"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        step,
        lambda s: F.struct(_is_empty(s.cells).alias("done"), s.only_left.alias("only_left"), s.only_right.alias("only_right")),
    )


def _by_blocks(left: Column, right: Column) -> Column:
    """What peel gives, from sketches of blocks of digests, each retried larger until it is done, and in the end compared."""
    failed = F.struct(F.lit(False).alias("done"), F.array().cast("array<bigint>").alias("only_left"), F.array().cast("array<bigint>").alias("only_right"))

    def compared(items: Column) -> Column:
        own, other = (F.transform(F.filter(items, lambda x: x.n == sign), lambda x: x.k) for sign in (1, -1))
        return F.struct(F.lit(True).alias("done"), F.array_except(own, other).alias("only_left"), F.array_except(other, own).alias("only_right"))

    def block(items: Column) -> Column:
        # the last attempt, 0, is the comparison
        return F.aggregate(F.array(*map(F.lit, (*RETRIES, 0))), failed, lambda s, m: F.when(s.done, s).when(m == 0, compared(items)).otherwise(peel(sketch(items, m), m)))

    def dealt(items: Column) -> Column:
        """The items of each block that isn't empty, cut from one sorted array."""
        blocks = F.greatest(F.lit(1), F.ceil(F.size(items) / PER_BLOCK)).cast("int")
        by_block = F.array_sort(F.transform(items, lambda x: F.struct(F.pmod(F.shiftright(x.k, 8), blocks).alias("b"), x.n.alias("n"), x.k.alias("k"), x.c.alias("c"))))

        def cut(placed: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: (i == 0) | (F.get(placed, i).b != F.get(placed, i - 1).b))
            return let(first, lambda f: F.transform(f, lambda at, j: F.slice(placed, at + 1, F.coalesce(F.get(f, j + 1), F.size(placed)) - at)))

        return let(by_block, lambda placed: F.when(F.size(placed) > 0, cut(placed)).otherwise(F.array(placed)))

    return let(
        let(F.concat(_signed(left, 1), _signed(right, -1)), lambda items: F.transform(dealt(items), block)),
        lambda r: F.struct(
            F.lit(True).alias("done"),
            F.flatten(F.transform(r, lambda x: x.only_left)).alias("only_left"),
            F.flatten(F.transform(r, lambda x: x.only_right)).alias("only_right"),
        ),
    )


def reconcile(left: Column, right: Column, left_sketch: Column, right_sketch: Column) -> Column:
    """struct(done, only_left, only_right): the digests that one side lacks, by the sketches alone where they suffice; always done.

    left and right are the digest arrays, read only where the subtracted fingerprints can't be peeled.
    """
    return let(peel(subtract(left_sketch, right_sketch), CELLS), lambda p: F.when(p.done, p).otherwise(_by_blocks(left, right)))


def likeness(found: Column, left_size: Column, right_size: Column) -> Column:
    """Jaccard similarity of the two sets of units, from what peeling recovered; 1 for two empty texts."""
    union = left_size + F.size(found.only_right)
    return F.when(union == 0, 1.0).otherwise((left_size - F.size(found.only_left)) / union)


def as_string(cells: Column) -> Column:
    """A sketch as text: count, digest xor and check xor of each cell in hexadecimal."""
    return F.concat_ws(",", F.transform(cells, lambda c: F.concat_ws(".", c.n.cast("string"), F.hex(c.k), F.hex(c.c))))


def _with_successor(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rows(id, text) plus `__next`, the text after it by descending id (nulls last, then by the text's hash and the text); the first follows the last.

    One shuffle: rows go to ranges of ids, rows without one to ranges of their texts' hashes, and a copy of the first row of
    a range joins the range before it. The range bounds of ids are approximate quantiles (any bounds give the same result);
    bounds and first values, at most MAX_BUCKETS of each, are all that the driver sees. Rows that share an id, or have none
    and equal texts, are ordered within one task.
    """
    ids = rows.select(F.col(id_column).cast("long").alias("id"))
    total, nulls = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("id").isNull(), 1))).first()
    buckets, null_buckets = (max(1, min(MAX_BUCKETS, -(-n // ROWS_PER_BUCKET))) for n in (total - nulls, nulls))
    bounds: list[int] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(ids.agg(F.percentile_approx("id", at, F.lit(max(10_000, 4 * buckets)))).first()[0] or []))
    hash_ = F.xxhash64(F.lit(3), F.col("text"))
    share = (F.col("hash").cast("double") / 2.0**63 + 1) / 2  # from 0 to 1, rising with the hash
    by_hash = (-1 - F.least(F.floor(share * null_buckets), F.lit(null_buckets - 1))).cast("int")
    rows = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), hash_.alias("hash"))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), by_hash).otherwise(_bucket(F.col("id").cast("long"), bounds)))
    heads = {r[0]: r[1] if r[0] >= 0 else r[2] for r in rows.groupBy("bucket").agg(F.max("id"), F.min("hash")).collect()}
    # buckets in the order of rows: ids fall, then the hashes of rows without one rise with the negative numbers' size
    chain = sorted((b for b in heads if b >= 0), reverse=True) + sorted((b for b in heads if b < 0), reverse=True)
    before = {b: chain[i - 1] for i, b in enumerate(chain)}  # cyclically
    guest = F.lit(None).cast("int")
    if heads:
        own = F.from_json(F.lit(json.dumps({str(b): [int(heads[b]), before[b]] for b in chain})), "map<string,array<bigint>>")
        mine = F.element_at(own, F.col("bucket").cast("string"))
        guest = F.when(F.coalesce(F.col("id").cast("long"), F.col("hash")) == mine[0], mine[1].cast("int"))
    both = rows.withColumn("__to", F.explode(F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("b"), F.lit(1).alias("guest")))))))
    window = Window.partitionBy("b").orderBy("guest", F.col("id").desc_nulls_last(), "hash", "text")
    return (
        both.select("id", "text", "hash", "__to.b", "__to.guest")
        .withColumn("__units", digests(F.col("text")))
        .withColumn("__next", F.lead(F.struct("text", "__units")).over(window))
        .where("guest = 0")
        .drop("b", "guest", "hash")
    )


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below value, by binary search."""
    if not bounds:
        return F.lit(0)
    table_ = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")

    def step(s: Column, _: Column) -> Column:
        return let(
            ((s.lo + s.hi) / 2).cast("int"),
            lambda m: F.when(s.lo >= s.hi, s)
            .when(F.get(table_, m) < value, F.struct((m + 1).alias("lo"), s.hi.alias("hi")))
            .otherwise(F.struct(s.lo.alias("lo"), m.alias("hi"))),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda s: s.lo)


def fingerprint_versions(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text against its edited version (second half replaced by as much of the next text's start) and the next text.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the recovered
    digests: edited_removed and edited_added. Null texts count as empty; two empty texts are alike (1.0). Equal texts
    have equal fingerprints; rows that repeat are kept. An empty table gives an empty result. Of the input, only the id
    and the text are read.
    """
    plain = rows.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("__next.text", F.lit(1), half))
    sketched = (
        _with_successor(plain, "id", "text")
        .select("id", size.cast("long").alias("n_chars"), "__units", F.col("__next.__units").alias("__next_units"), edited.alias("__edited"))
        .select("*", F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"), digests(F.col("__edited")).alias("__edited_units"))
        .drop("__edited")
        .select("*", *[sketch(_signed(F.col(u), 1), CELLS).alias(f"{u}_sketch") for u in ("__units", "__next_units", "__edited_units")])
        .select("*", *[reconcile(F.col("__units"), F.col(u), F.col("__units_sketch"), F.col(f"{u}_sketch")).alias(f"{u}_found") for u in ("__edited_units", "__next_units")])
    )
    near = lambda u: likeness(F.col(f"{u}_found"), F.size("__units"), F.size(u))
    return sketched.select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256",
        as_string(F.col("__units_sketch")).alias("fingerprint"), as_string(F.col("__edited_units_sketch")).alias("edited_fingerprint"),
        near("__edited_units").alias("near_edited"), near("__next_units").alias("near_next"),
        F.col("__edited_units_found.only_left").alias("edited_removed"), F.col("__edited_units_found.only_right").alias("edited_added"),
    )


def op3_iblt_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every whole text against its edited text and the next document; see fingerprint_versions for the edge cases."""
    return fingerprint_versions(table(spark, sf_dir, "documents")).drop("edited_removed", "edited_added")
