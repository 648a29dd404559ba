"""Uniform shuffle of rows into shards of exact size, through a hypergeometric communication matrix.

Rows are dealt to source blocks. The driver draws, from the blocks' row counts alone, how many rows of each block go
to each shard: a matrix with the blocks' counts as row sums and the shards' exact sizes as column sums, drawn from the
multivariate hypergeometric law, which is the law of these counts under a uniform permutation of all rows. Each block
is then permuted and cut at the cumulative counts, rows go to their shards, and each shard is permuted again.

Only blocks x shards counts reach the driver. Both permutations are rankings within bounded groups (a block; a slice
of a shard by random key), so no task holds a whole shard. The random keys come from all columns of a row, so repeated
or null ids make no hot group; where rows that repeat as a whole would, the partition that a row was read in has a say too.
What is read is written once with its keys, so that both passes over it, and a lost task's second run, see the same keys.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

#: Rows that a source block or a slice of a shard is meant to hold at most, and the least and most of each.
ROWS_PER_BLOCK = 2_000_000
BLOCKS = (256, 8192)
SLICES = (16, 1024)
#: How many times its share of the rows a finest block holds where rows that repeat as a whole must be spread.
HOT = 8


def exact_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(block_counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """blocks x shards: row counts drawn without replacement; rows sum to block_counts and columns to shard_sizes."""
    if sum(block_counts) != sum(shard_sizes):
        raise ValueError("blocks and shards must hold the same number of rows")
    draw, left = np.random.default_rng(seed), np.array(shard_sizes, dtype=np.int64)
    matrix = np.zeros((len(block_counts), len(shard_sizes)), dtype=np.int64)
    for b, n in enumerate(block_counts):
        pool = int(left.sum())
        for s in range(len(shard_sizes)):
            pool -= int(left[s])
            k = _hypergeometric(draw, int(left[s]), pool, n)
            matrix[b, s], n = k, n - k
        left -= matrix[b]
    return matrix


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of `taken` rows, drawn without replacement, are among the good ones; one law at every size.

    Numpy's sampler takes fewer than 1e9 of each kind. Beyond that the same law is inverted: its weights follow from the
    mode by the exact ratios of neighbours, on both sides until they no longer count in double precision.
    """
    if taken == 0 or good == 0:
        return 0
    if bad == 0:
        return taken
    if good < 10**9 and bad < 10**9:
        return int(draw.hypergeometric(good, bad, taken))
    least, most = max(0, taken - bad), min(good, taken)
    mode = min(max((taken + 1) * (good + 1) // (good + bad + 2), least), most)

    def side(count: int, step: int) -> np.ndarray:
        """Weights from the mode's neighbour on, the mode's own being 1."""
        parts, last, at = [], 1.0, 0
        while at < count and last > 1e-25:
            i = np.arange(at, min(count, at + 4096), dtype=np.float64)
            k = mode + step * i
            up = (good - k) * (taken - k) / ((k + 1) * (bad - taken + k + 1)) if step > 0 else k * (bad - taken + k) / ((good - k + 1) * (taken - k + 1))
            parts.append(last * np.cumprod(up))
            last, at = parts[-1][-1], at + len(i)
        return np.concatenate(parts) if parts else np.zeros(0)

    below, above = side(mode - least, -1), side(most - mode, 1)
    weights = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(weights, draw.random() * weights[-1], side="right"))


def _between(n: int, limits: tuple[int, int]) -> int:
    return min(max(n, limits[0]), limits[1])


def shuffle_to_shards(rows: DataFrame, shards: int, id_column: str, seed: int = 17) -> DataFrame:
    """rows plus `shard` (0 to shards-1, sizes at most one apart) and `slot` (0, 1, ... in each shard), a uniform shuffle.

    Rows with a null id, and rows that repeat an id, are dealt like any others; among rows equal in every column it can't
    matter which is which. The order follows the seed and the rows, whatever the partitions (but for hot repeated rows). An empty input gives an
    empty result. Columns other than the new ones pass through; one named shard or slot is replaced.
    """
    rows = rows.drop("shard", "slot")
    names = list(rows.columns)
    mixed = [F.col(f"`{id_column}`"), *[F.col(f"`{c}`") for c, kind in rows.dtypes if c != id_column and "map<" not in kind and kind != "variant"]]
    random = lambda n: F.xxhash64(F.lit(seed + n), *mixed)
    keys = [F.pmod(random(0), F.lit(BLOCKS[1])).cast("int").alias("__finest"), random(1).alias("__k1"), random(2).alias("__k2"), F.spark_partition_id().alias("__part")]
    keyed = written(rows.select("*", *keys), "keyed")
    counted = {r[0]: r[1] for r in keyed.groupBy("__finest").count().collect()}  # at most BLOCKS[1] rows
    total = sum(counted.values())
    slices = _between(-(-total // (shards * ROWS_PER_BLOCK)), SLICES)
    blocks = BLOCKS[0]
    while blocks < BLOCKS[1] and blocks * ROWS_PER_BLOCK < total:
        blocks *= 2  # a power of two, so that it divides the finest blocks
    hot = [f for f, n in counted.items() if n > max(ROWS_PER_BLOCK, HOT * total // BLOCKS[1])]
    if hot:  # rows equal in every column fill a block: there, the partition that a row was read in has a say in its keys
        spread = F.col("__finest").isin(hot)
        for n, name in ((3, "__k1"), (4, "__k2")):
            keyed = keyed.withColumn(name, F.when(spread, F.xxhash64(F.lit(seed + n), name, "__part")).otherwise(F.col(name)))
        keyed = keyed.withColumn("__finest", F.when(spread, F.pmod(F.xxhash64(F.lit(seed + 5), "__k1", "__k2"), F.lit(BLOCKS[1])).cast("int")).otherwise(F.col("__finest")))
        counted = {r[0]: r[1] for r in keyed.groupBy("__finest").count().collect()}
    counts = [sum(counted.get(f, 0) for f in range(b, BLOCKS[1], blocks)) for b in range(blocks)]
    bounds = communication_matrix(counts, exact_sizes(sum(counts), shards), seed).cumsum(axis=1)
    cuts = rows.sparkSession.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(bounds.tolist())), "array<array<bigint>>")).alias("__block", "__cuts")
    )

    local = Window.partitionBy("__block").orderBy("__k1", "__k2")
    placed = (
        keyed.withColumn("__block", F.pmod("__finest", F.lit(blocks)))
        .withColumn("__rank", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "__block")  # blocks x shards longs, both bounded above
        .withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__rank"))))
        .withColumn("__slice", F.pmod(F.col("__k2"), F.lit(slices)).cast("int"))
        .drop("__cuts", "__rank", "__finest", "__block", "__part")
    )
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__slice").count().select("shard", "__slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__slice").orderBy("__k2", "__k1")
    return (
        placed.withColumn("__at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "__slice"])  # shards x slices rows
        .withColumn("slot", F.col("__at") + F.col("__start"))
        .select(*[F.col(f"`{c}`") for c in names], "shard", "slot")
    )


def op1_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards, counts at most one apart (law `rows`); see shuffle_to_shards for the edge cases."""
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
    )
    return shuffle_to_shards(narrow, 16, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
