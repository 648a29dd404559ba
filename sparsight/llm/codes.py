"""Product codes of integer vectors: codebooks by rounds of assignment and means, assignment by partial-distance search.

Components become whole numbers, a vector is cut into equal parts, and each part position has a codebook of its own.
A task assigns the parts of its rows by partial-distance search: dimensions go in falling order of the codebook's variance,
the entry nearest in the first of them gets its complete distance, and masks then drop an entry of a row as soon as what
has accumulated strictly exceeds the row's best complete distance; ties survive to the end, where the lower index wins. A
round sends one row a task, part, entry and dimension, with sums as limbs that add up exactly; Spark adds them, and the new
codebooks (parts x entries x width numbers, whatever the number of rows) go back with the next round's tasks. Vectors are
read anew in each round, so that a lost executor costs its share of one round.
"""

from __future__ import annotations

import hashlib
from math import frexp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .search import usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows (of a part) that are searched at once; bits of a limb of a sum.
ROWS_AT_ONCE, LIMB = 16_384, 40
LONGEST = 2**63 - 1


def narrow(width: int) -> int:
    """Components below this are held as longs, which hold squared distances over the whole width exactly. Others are whole numbers of any size."""
    return 1 << ((60 - width.bit_length()) // 2)


class Books(NamedTuple):
    """Codebooks: for each part, its entries as tuples of whole numbers."""

    parts: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.parts for entry in part for x in entry).encode()).hexdigest()


def _arrays(books: Books, width: int) -> list[np.ndarray]:
    """Each part's entries, as longs where all are narrow, else as Python's own numbers."""
    wide = [np.array(part, dtype=object).reshape(len(part), width // len(books.parts)) for part in books.parts]
    return [b.astype(np.int64) if all(abs(x) < narrow(width) for x in b.flat) else b for b in wide]


def nearest(rows: np.ndarray, book: np.ndarray, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, by partial-distance search."""
    n, d = rows.shape
    if rows.dtype != book.dtype:
        rows, book = rows.astype(object), book.astype(object)
    if not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    spread = [len(book) * sum(int(x) ** 2 for x in book[:, j]) - sum(int(x) for x in book[:, j]) ** 2 for j in range(d)]
    order = sorted(range(d), key=lambda j: -spread[j])
    rows, book = rows[:, order], book[:, order]
    first = (rows[:, :1] - book[:, 0]) ** 2
    guess = np.argmin(first, axis=1)
    best = ((rows - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    if stats is not None:
        stats["terms"] = stats.get("terms", 0) + n * len(book) * d
        stats["summed"] = stats.get("summed", 0) + first.size + n * d
    for j in range(1, d):
        if stats is not None:
            stats["summed"] += len(row)
        so_far = so_far + (rows[row, j] - book[entry, j]) ** 2
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    # the guess itself survives, so that each row has a run of entries, in rising order
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
    least = np.minimum.reduceat(so_far, starts) if n else so_far
    at = np.flatnonzero(so_far == least[row]) if n else np.zeros(0, np.int64)
    _, winner = np.unique(row[at], return_index=True)
    return entry[at[winner]].astype(np.int64), least


def _quantised(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(SCALE * x) of all components, shorter vectors ending in zeros: narrow rows as longs, then the others and their numbers."""
    sizes = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(lists), width))
    x[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = (np.abs(x) >= narrow(width) / SCALE - 1).any(axis=1)
    return np.floor(np.where(wide[:, None], 0.0, x) * SCALE).astype(np.int64), np.array([[_whole(v) for v in r] for r in x[wide]], dtype=object).reshape(int(wide.sum()), width), np.flatnonzero(wide)


def _whole(x: float) -> int:
    """floor(SCALE * x), exactly, for any finite double."""
    mantissa, exponent = frexp(x)
    whole, shift = int(mantissa * 2**53) * SCALE, exponent - 53
    return whole << shift if shift >= 0 else whole >> -shift


def _blocks(batch: pa.RecordBatch, width: int):
    """(row numbers, vectors) of a batch: blocks of narrow rows as longs, then the wide rows as whole numbers of any size."""
    lists = batch.column("v")
    narrow, wide, at = _quantised(lists, width)
    if len(at):
        keep = np.setdiff1d(np.arange(len(narrow)), at)
        yield at, wide
    else:
        keep = np.arange(len(narrow))
    for a in range(0, len(keep), ROWS_AT_ONCE):
        yield keep[a : a + ROWS_AT_ONCE], narrow[keep[a : a + ROWS_AT_ONCE]]


def _limbs(value: int):
    """(place, limb) of a whole number: value is the sum of limb << (LIMB * place)."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest or not place:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        place += 1


def _round(rows: DataFrame, books: Books, width: int) -> Books:
    """New codebooks: each entry the floor of the mean of the parts that it is nearest to; unused ones stay."""
    arrays = _arrays(books, width)
    span = width // len(arrays)

    def add_up(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, vectors in _blocks(batch, width):
                for p, book in enumerate(arrays):
                    own = vectors[:, p * span : (p + 1) * span]
                    index, _ = nearest(own, book)
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    for e, part, n in zip(used.tolist(), np.add.reduceat(own[order], starts, axis=0).tolist(), np.diff(np.append(starts, len(order))).tolist()):
                        known = sums.get((p, e))
                        sums[p, e] = [n, part] if known is None else [known[0] + n, [int(a) + int(b) for a, b in zip(known[1], part)]]
        found = [(p, e, j, place, limb) for (p, e), (n, part) in sums.items() for j, x in enumerate([n, *part]) for place, limb in _limbs(int(x))]
        columns = list(zip(*found)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "dim", "place", "limb"])

    partial = rows.select("v").mapInArrow(add_up, "part bigint, entry bigint, dim bigint, place bigint, limb bigint")
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in partial.groupBy("part", "entry", "dim", "place").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb")).collect():
        sums = total.setdefault((r.part, r.entry), {})
        sums[r.dim] = sums.get(r.dim, 0) + (int(r.limb) << (LIMB * r.place))
    return Books(tuple(
        tuple(tuple(total[p, e][j + 1] // total[p, e][0] for j in range(span)) if (p, e) in total else entry for e, entry in enumerate(part))
        for p, part in enumerate(books.parts)
    ))


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of rows(id, v): from the vectors of the smallest ids, after so many rounds over all rows."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    span = width // parts
    whole = [[_whole(float(x)) for x in r.v] + [0] * (width - len(r.v)) for r in first]
    books = Books(tuple(tuple(tuple(v[p * span : (p + 1) * span]) for v in whole) for p in range(parts)))
    for _ in range(rounds):
        after = _round(rows, books, width)
        if after == books:
            break  # settled: further rounds give the same
        books = after
    return books


def encode(rows: DataFrame, books: Books, width: int) -> DataFrame:
    """rows(id, v, label) as (id, label, code, error): entries' indexes as two hex digits each, and summed squared distances."""
    arrays = _arrays(books, width)
    span = width // len(arrays)

    def assign(batches):
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(arrays)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for at, vectors in _blocks(batch, width):
                total = 0
                for p, book in enumerate(arrays):
                    index, distance = nearest(vectors[:, p * span : (p + 1) * span], book)
                    codes[at, p] = index
                    total = total + distance
                errors[at] = np.minimum(total, LONGEST).astype(np.int64)
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), code, pa.array(errors)], names=["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.select("id", "v", "label").mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row of vectors.

    Null vectors and vectors with null or non-finite components are dropped. Shorter vectors, and widths that the parts
    don't divide, count as padded with zeros. Of equal ids the smaller vector comes first; null ids come last and are
    encoded like others. With fewer rows than entries, codebooks have as many entries as there are rows. Any finite
    component is taken exactly; errors (and their sums over a label) beyond a long count as its end. Repeated rows are rows
    of their own. An empty table gives an empty result. Other columns are not read, whatever their names. At most 256 entries.
    """
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"), F.col(f"`{label_column}`").alias("label")).where(usable(F.col("v")))
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-widest // parts) * parts
    books = train(rows, width, parts, entries, rounds)
    coded = encode(rows, books, width)
    # two columns make the join null-safe and leave it to Spark how it runs; a hot label's rows can be split, as the other side has one row a label
    key = [F.col("label").isNull().alias("none"), F.coalesce("label", _zero(rows, "label")).alias("of")]
    sums = coded.groupBy(*key).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return coded.select("*", *key).join(sums, ["none", "of"]).select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


def _zero(rows: DataFrame, column: str) -> Column:
    """Some value of the column's type, for nulls; the mark beside it tells them apart."""
    return F.lit("0").cast(rows.schema[column].dataType)


def op12_partial_distance_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of 8 parts, 16 entries, 6 rounds over all embeddings; see compress for the edge cases."""
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same rounds in SQL: one table of parts, and for each round the nearest entries and their floored means."""
    steps = [f"""
kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) AS r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS (SELECT vec_id, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.p, x.v, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts x JOIN b{k} b ON x.p = b.p) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS v FROM (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY p, e, j) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    steps.append(f"""
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


ORACLE = _oracle()
