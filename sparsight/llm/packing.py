"""Best-fit packing of token pieces into sequences, with large pieces matched first.

A document's ids and its closing id are cut only where they exceed a sequence: into full pieces, the first one shorter
if need be. What packs is the count of pieces of each length (at most `capacity` numbers, whatever the input), so the
driver packs all pieces exactly, in three steps: pieces above a third of the capacity go at most two to a sequence, the
largest first with the largest partner that fits; the rest, in descending order, go to the fullest sequence with room;
what finds no room opens new sequences. The plan says, for each length, which ranks go to which sequences and offsets.
Pieces are ranked within their length, in salted groups so that one length that many documents share is no hot group.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, give_memory_back, table, text_of, written
from .tokens import added_tokens, encode, encode_with_added, int_lists

CAPACITY = 1024
#: The id that closes every document.
CLOSING_ID = 2
ROWS_PER_SALT = 500_000
SALTS = (16, 4096)


class Run(NamedTuple):
    """Pieces of one length, ranks from first to before last, per_sequence to a sequence from sequence base on, behind `used` ids."""

    length: int
    first: int
    last: int
    base: int
    per_sequence: int
    used: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where all pieces go, given how many there are of each length from 1 to capacity."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = {n: c for n, c in counts.items() if c > 0}
    ranked: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first sequence, how many)]
    sequences = 0

    def put(length: int, pieces: int, base: int, per: int, used: int) -> None:
        runs.append(Run(length, ranked[length], ranked[length] + pieces, base, per, used))
        ranked[length] += pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        partner = large[at] if at >= 0 else None
        if partner is None or partner == n and left[n] < 2:
            pairs = left.pop(n) if partner is None else 1
            if partner is not None:
                # one piece stays over; it may still pair with a smaller large one
                smaller = large[at - 1] if at > 0 else None
                left[n] -= 1
                put(n, 1, sequences, 1, 0)
                if smaller is not None:
                    put(smaller, 1, sequences, 1, n)
                    left[smaller] -= 1
                    open_[capacity - n - smaller].append((sequences, 1))
                    if not left[smaller]:
                        large.remove(smaller)
                else:
                    open_[capacity - n].append((sequences, 1))
            else:
                put(n, pairs, sequences, 1, 0)
                open_[capacity - n].append((sequences, pairs))
            sequences += pairs
            large.pop()
            continue
        pairs = left[n] // 2 if partner == n else min(left[n], left[partner])
        put(n, pairs, sequences, 1, 0)
        put(partner, pairs, sequences, 1, n)
        left[n] -= pairs
        left[partner] -= pairs
        open_[capacity - n - partner].append((sequences, pairs))
        sequences += pairs
        large = [x for x in large if left[x] > 0]

    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        todo = left[n]
        for gap in range(n, capacity):  # the fullest sequences first
            while todo and open_.get(gap):
                base, bins = open_[gap].pop()
                per = gap // n
                whole = min(bins, todo // per)
                if whole:
                    put(n, whole * per, base, per, capacity - gap)
                    open_[gap - per * n].append((base, whole))
                    todo -= whole * per
                if whole < bins and todo and todo < per:
                    put(n, todo, base + whole, todo, capacity - gap)
                    open_[gap - todo * n].append((base + whole, 1))
                    todo, whole = 0, whole + 1
                if whole < bins:
                    open_[gap].append((base + whole, bins - whole))
                    break
        per = capacity // n
        for pieces, size in ((todo // per * per, per), (todo % per, todo % per)):
            if pieces:
                put(n, pieces, sequences, size, 0)
                open_[capacity - size * n].append((sequences, pieces // size))
                sequences += pieces // size
    return runs


def _place(length: Column, rank: Column, runs: list[Run]) -> Column:
    """struct(sequence_id, offset) of a piece by its length and its rank among pieces of that length."""
    shift = np.int64(1) << np.int64(48)
    rows = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    keys = rows[:, 0] * shift + rows[:, 1]
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        give_memory_back()
        n, r = lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(n):
            return pa.array([], kind)
        run = rows[np.searchsorted(keys, n * shift + r, side="right") - 1]
        bin_, at = np.divmod(r - run[:, 1], run[:, 4])
        return pa.StructArray.from_arrays([pa.array(run[:, 3] + bin_), pa.array(run[:, 5] + at * n)], fields=list(kind))

    return place(length, rank)


def pack(pieces: DataFrame, length_column: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces plus sequence_id and offset; every sequence holds at most capacity ids, without gaps.

    pieces is read twice, so it should be a table (`common.written`), not a long computation. Equal results for any
    partitioning: ranks follow the columns in `order`. Null or out-of-range lengths are an error; an empty table gives an
    empty result; columns named sequence_id or offset are replaced, others pass through.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = list(pieces.columns)
    length = F.col(f"`{length_column}`")
    ordered = [F.col(f"`{c}`") for c in order]
    counts = {r[0]: r[1] for r in pieces.groupBy(length.alias("n")).count().collect()}  # at most `capacity` rows
    if None in counts:
        raise ValueError("a piece has no length")
    salts = min(max(-(-sum(counts.values()) // ROWS_PER_SALT), SALTS[0]), SALTS[1])
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*ordered), F.lit(salts)).cast("int"))
    before = Window.partitionBy("__n").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(length.alias("__n"), "__salt").count().select("__n", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    ranked = (
        salted.withColumn("__n", length)
        .withColumn("__rank", F.row_number().over(Window.partitionBy("__n", "__salt").orderBy(*ordered)) - 1)
        .join(starts, ["__n", "__salt"])
        .withColumn("__to", _place(F.col("__n"), F.col("__rank") + F.col("__start"), plan(counts, capacity)))
    )
    return ranked.select(*[F.col(f"`{c}`") for c in names], "__to.sequence_id", "__to.offset")


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"


def token_pieces(docs: DataFrame, keep: list[str], text_column: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, ranks_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """A row per piece of each document: the columns in keep, then piece, start, length, ids_crc32 and ids.

    Null and empty texts are the closing id alone. `keep` may not name a piece column. Without keep_ids, ids are null.
    Ids come from the rank file, which holds the same vocabulary and merges as the tokenizer's JSON file; without a rank
    file of the caller's, the JSON file's added tokens are found in the texts as the tokenizer finds them.
    """
    clash = {c.split()[0] for c in PIECES.split(", ")} & set(keep)
    if clash:
        raise ValueError(f"columns that pieces have themselves: {sorted(clash)}")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text_column).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    added = added_tokens() if ranks_path is None else {}

    def cut(batches):
        give_memory_back()
        for batch in batches:
            for part in by_size(batch, len(keep)):
                yield pieces_of(part)

    def pieces_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, columns, ids = [], [[], [], [], []], []
        for text in batch.column(len(keep)):
            own = np.append(encode_with_added(text.as_py(), added, ranks_path), closing_id).astype("<u4")
            bounds = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
            counts.append(len(bounds) - 1)
            for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
                for column, value in zip(columns, (j, a, b - a, zlib.crc32(own[a:b]))):
                    column.append(value)
            if keep_ids:
                ids += [own[a:b] for a, b in zip(bounds, bounds[1:])]
        source = pa.array(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
        kept_columns = [c.take(source) for c in batch.columns[:-1]]
        numbers = [pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        tokens = int_lists(ids) if keep_ids else pa.nulls(len(source), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*kept_columns, *numbers, tokens], names=[*batch.schema.names[:-1], "piece", "start", "length", "ids_crc32", "ids"])

    return rows.mapInArrow(cut, f"{kept}{', ' if kept else ''}{PIECES}")


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from packed pieces with ids; a sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))


def op4_matched_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids; see token_pieces and pack for the edge cases."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), ["doc_id"], keep_ids=False).drop("ids")
    return pack(written(pieces, "pieces"), "length", ["doc_id", "piece", "ids_crc32", "start"])
