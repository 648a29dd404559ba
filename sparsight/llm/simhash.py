"""SimHash near-duplicates: exact links between fingerprints that differ in few bits, by vantage-point trees.

1. Every text becomes a 64-bit fingerprint: a bit is set if more than half of the text's shingle hashes have it.
2. Distinct fingerprints are dealt to shards by the upper levels of a vantage-point tree. A node has a vantage point and a
   radius: what lies within goes inside, the rest outside. Two fingerprints that link differ in their distances from the
   vantage by no more than the link's bits (triangle inequality), so if a node parts them, the inner one lies in the
   radius's outermost band; fingerprints of that band go outside as well. Each pair that links so meets in some shard. The
   upper levels are grown on a sample; any sample gives the same links, a good one gives even shards.
3. A shard goes on with such nodes down to small leaves, where all distances are counted. Of the links found, a shard
   returns one edge a fingerprint at most, to the smallest that its links reach.
4. Components of these edges; then the smallest id of each component.

Exact copies, and texts with equal fingerprints, are one point from step 2 on, however many there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, give_memory_back, table, text_of, written
from .graph import components
from .scoring import words

WIDTH, BITS, SEED = 3, 2, 42
#: Hashes whose bits are spread out at once.
HASHES_AT_ONCE = 2**17
#: Fingerprints a shard should hold, the most shards there are, and sampled fingerprints a shard (so at most 1,600,000 in all).
SHARD_POINTS, MOST_SHARDS, SAMPLED = 20_000, 50_000, 32
#: Points of a leaf; vantage points that a node chooses from; points that the choice looks at.
LEAF, CHOICES, LOOKED_AT = 128, 12, 2000
#: Rows of a table of distances counted at once.
DISTANCES_AT_ONCE = 2**22


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a text, repeats included; of the whole sequence where it is shorter."""
    import xxhash

    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(own) - width + 1)
    last = ends[min(width, len(own)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, the lowest first."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[a : a + HASHES_AT_ONCE].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The text's fingerprint, as an unsigned number; zero without words."""
    hashes = shingle_hashes(text, width)
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


class Node(NamedTuple):
    """Points within the radius of the vantage go inside; the others, and those of the outermost band, outside. None is a leaf."""

    vantage: int
    radius: int
    inside: Node | None
    outside: Node | None


def split(points: np.ndarray, bits: int) -> tuple[int, int] | None:
    """(vantage, radius) of the split whose larger side is smallest; None where no split makes the sides notably smaller."""
    looked = points[:: max(1, len(points) // LOOKED_AT)]
    best, chosen = 0.9 * len(looked), None
    for vantage in points[:: max(1, len(points) // CHOICES)][:CHOICES]:
        upto = np.cumsum(np.bincount(distance(looked, vantage), minlength=65))
        shifted = np.concatenate([np.zeros(bits, np.int64), upto])[:65]  # points nearer than the band: at most radius - bits
        larger = np.maximum(upto, len(looked) - shifted)
        radius = int(np.argmin(larger))
        if larger[radius] < best:
            best, chosen = larger[radius], (int(vantage), radius)
    return chosen


def sides(points: np.ndarray, vantage: int, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the points that go inside and outside."""
    d = distance(points, np.uint64(vantage))
    return d <= radius, d > radius - bits


def grow(points: np.ndarray, most: int, bits: int) -> Node | None:
    """The upper levels of a tree over a sample: leaves hold at most so many of its points, or can't be split."""
    chosen = split(points, bits) if len(points) > most else None
    if chosen is None:
        return None
    inside, outside = sides(points, *chosen, bits)
    return Node(*chosen, grow(points[inside], most, bits), grow(points[outside], most, bits))


def leaves(tree: Node | None, points: np.ndarray, bits: int):
    """(leaf number, numbers of the points that go there), for all leaves that get any."""
    stack, number = [(tree, np.arange(len(points)))], 0
    while stack:
        node, at = stack.pop()
        if node is None:
            if len(at):
                yield number, at
            number += 1
            continue
        inside, outside = sides(points[at], node.vantage, node.radius, bits)
        stack += [(node.outside, at[outside]), (node.inside, at[inside])]


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each point's smallest point that it hangs together with, after edges (u, v) were added to what root joins."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, deeper := root[root]):
            root = deeper


def linked(points: np.ndarray, bits: int = BITS, stats: dict | None = None) -> np.ndarray:
    """For distinct points, in rising order: the number of the smallest point that links reach from each.

    A vantage-point tree is descended to its leaves, whose distances are counted in tables of bounded size; where points
    can't be split, the tables cover more of them.
    """
    root = np.arange(len(points))
    stack = [root.copy()]
    while stack:
        at = stack.pop()
        chosen = split(points[at], bits) if len(at) > LEAF else None
        if chosen is not None:
            inside, outside = sides(points[at], *chosen, bits)
            stack += [at[inside], at[outside]]
            continue
        step = max(1, DISTANCES_AT_ONCE // max(1, len(at)))
        for a in range(0, len(at), step):
            rows = at[a : a + step]
            i, j = np.nonzero(distance(points[rows][:, None], points[at][None, :]) <= bits)
            below = rows[i] < at[j]
            root = _joined(root, rows[i][below], at[j][below])
            if stats is not None:
                stats["distances"] = stats.get("distances", 0) + len(rows) * len(at)
    return root


def fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """rows(id, text) as (id, f): fingerprints as signed longs."""

    def measure(batches):
        give_memory_back()
        for batch in batches:
            for part in by_size(batch, "text"):
                found = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], names=["id", "f"])

    return rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, f bigint")


def _edges(points: DataFrame, total: int, bits: int) -> DataFrame:
    """Edges (u, v) between points(f): as many as connect what links connect."""
    shard_points = max(SHARD_POINTS, -(-total // MOST_SHARDS))
    sampled = points.where(F.pmod(F.xxhash64(F.lit(13), "f"), F.lit(max(1, shard_points // SAMPLED))) == 0) if total > shard_points else points.limit(0)
    sample = np.sort(np.array([r.f for r in sampled.collect()], dtype=np.int64).view(np.uint64))
    tree = grow(sample, SAMPLED, bits)

    def deal(batches):
        for batch in batches:
            f = batch.column("f").to_numpy()
            for leaf, at in leaves(tree, f.view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), pa.array(f[at])], names=["shard", "f"])

    def meet(group: pa.Table) -> pa.Table:
        give_memory_back()
        own = np.unique(group.column("f").to_numpy().view(np.uint64))
        root = linked(own, bits)
        at = np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"u": pa.array(own[at].view(np.int64)), "v": pa.array(own[root[at]].view(np.int64))})

    return points.mapInArrow(deal, "shard bigint, f bigint").groupBy("shard").applyInArrow(meet, "u bigint, v bigint")


def near_copies(docs: DataFrame, width: int = WIDTH, bits: int = BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per row of docs: id, fingerprint (16 lowercase hex digits), component_id (the smallest id that links reach, its own included).

    Texts are whole; a null text is empty, and texts without words have the fingerprint zero, which links like any other.
    Rows that repeat, and ids with several texts, are rows of their own. A null id never becomes a component_id unless the
    whole component has none. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    rows = written(fingerprints(docs.select(F.col(f"`{id_column}`").alias("id"), text_of(f"`{text_column}`").alias("text")), width), "fingerprints")
    points = written(rows.groupBy("f").agg(F.min("id").alias("least")), "points")
    found = components(_edges(points.select("f"), points.count(), bits))
    named = points.join(found.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("component", "f").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select("f", "component_id")
    digits = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return rows.join(ids, "f").select(F.col("id").alias(id_column), digits.alias("fingerprint"), "component_id")


def op13_vantage_point_copies(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints of 3-word shingles differ in at most 2 bits; see near_copies for the edge cases."""
    return near_copies(table(spark, sf_dir, "documents"))
