"""Jaccard join of documents on word n-grams: exact components of near-equal texts.

1. Every text becomes a set of 64-bit shingle hashes; texts with equal sets are one class from here on.
2. Candidates. Linked sets differ in few elements, at most r. A set's elements are dealt to more than r groups by hash, so
   two linked sets agree in the whole content of a group that isn't empty; classes that share a (group, content) key are
   candidates. The number of groups follows the size, by classes of sizes between which links reach one class up only.
   Shingles that a bounded sample of texts shows to be frequent are left out of the contents first: whichever they are,
   two linked sets still differ in at most r groups. Sets that have no more than 2 r groups without them send keys of
   their full contents too, so where one of two linked sets needs those, both have them. Keys travel packed by shard, in
   slices of the shards one after the other;
   the parities of 128 group counts of each set then rule out what differs in more places than linked sets may.
3. Candidates that hang together are searched by a count-vector R-tree: elements hash into 32 groups, a set's group counts
   are a point, and a node's box bounds the overlap of a set with all of its points by the summed minima of coordinates.
   Pairs that survive are verified on the sets, unless links found before already join them. Large groups are cut into
   blocks, which meet in pairs; a block pair returns a forest of links, never all pairs. Many pairs meet in rounds, each
   with a bounded part of the shuffle.
4. Components of the verified links.

A link can only be missed if the hash leaves a set no more than r groups that count; the spare groups keep the chance of
such an accident near 1e-8 a pair, and with other pairs of the same component usually no component changes by it.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_memory_back, table, text_of, written
from .graph import components
from .scoring import words


class Rule(NamedTuple):
    """Sets of distinct shingles of `width` words link when den * intersection >= num * union."""

    width: int
    num: int
    den: int

    def overlap(self, total):
        """Least intersection of two sets of that total size that link."""
        return -(-self.num * total // (self.num + self.den))

    def differences(self, total: int) -> int:
        """Most elements that only one of two linked sets of that total size has."""
        return total * (self.den - self.num) // (self.den + self.num)


SHINGLES_4_AT_85 = Rule(4, 85, 100)
SHINGLES_5_AT_80 = Rule(5, 80, 100)
#: Groups beyond the differences, and the least number of groups. From so many differences on (sets of about 250 shingles),
#: only groups of two shingles or more count, of which larger numbers of groups hold enough.
SPARE, LEAST_GROUPS = 12, 24
PAIRED_FROM, PAIRED_TIMES, PAIRED_SPARE = 40, 1.35, 10
#: Groups of the count vectors; points of an R-tree's leaf.
COUNT_GROUPS = 32
LEAF = 16
#: Rows of documents to a shard of keys; most classes, and most shingles, of a block in step 3; classes that small groups share a task by.
ROWS_PER_SHARD = 2500
BLOCK_CLASSES, BLOCK_SHINGLES = 1000, 500_000
CLASSES_PER_TASK = 2000
#: Where blocks that meet in pairs would make what is shuffled more than so many times all sets, pairs meet in rounds.
ROUND_TIMES = 2
#: From more shards than this on, keys travel in so many slices of the shards, one after the other: a slice's shuffle files go
#: before the next slice's come.
SLICED_FROM, SLICES = 16, 2
#: 64-bit words of the bitmap that tells which ids may be members of a candidate group (8 MB, whatever the input).
BITMAP_WORDS = 2**20
#: Documents (about) of the sample that tells frequent shingles, and in how many different sets of it one is frequent.
SAMPLE_DOCUMENTS, FREQUENT = 4000, 4
#: Documents whose sets are computed at once, and the code points that end a batch of them.
BATCH_CHARS = 4_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, one after the other, and where each text's begin (one more for the end)."""
    import xxhash

    give_memory_back()
    sizes = np.zeros(len(texts), dtype=np.int64)
    hashed = [np.zeros(0, np.uint64)]
    for i, text in enumerate(texts):
        own = words(text) if text else []
        hashed.append(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
        sizes[i] = len(own)
    hashes = np.concatenate(hashed)
    del hashed
    starts = np.cumsum(sizes) - sizes
    n_words = np.minimum(sizes, width)
    counts = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    values = n_words[owner].astype(np.uint64)
    for k in range(width):
        has = k < n_words[owner]
        part = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else values
        values = np.where(has, _mix(values * _MULTIPLIERS[k % 4] + part), values)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        values[a:b].sort()
    kept = np.ones(len(values), bool)
    kept[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[kept], owner[kept]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, as signed; sums of mixed elements, mixed again with the size."""
    sizes = np.diff(bounds)
    totals = np.concatenate([[np.uint64(0)], np.cumsum(_mix(values + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return _mix((totals[bounds[1:]] - totals[bounds[:-1]]) * _MULTIPLIERS[0] + sizes.astype(np.uint64)).astype(np.int64)


def size_limits(rule: Rule, most: int) -> np.ndarray:
    """Where the classes of sizes begin: a linked set is at most one class up."""
    limits = [1]
    while limits[-1] <= most:
        limits.append(max(limits[-1] + 1, -(-limits[-1] * rule.den // rule.num)))
    return np.array(limits)


def group_keys(values: np.ndarray, bounds: np.ndarray, rule: Rule, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of each non-empty group of every set, in its own class of sizes and the next one.

    Contents are those without the frequent (sorted) hashes, and also the full ones where twice the allowed differences
    could touch all groups that are left.
    """
    sizes = np.diff(bounds)
    limits = size_limits(rule, int(sizes.max(initial=1)))
    own_class = np.searchsorted(limits, sizes, side="right") - 1
    tops = np.append(limits[1:], [max(limits[-1] + 1, -(-limits[-1] * rule.den // rule.num))]) - 1
    differ = np.array([rule.differences(2 * int(t)) for t in np.append(tops, -(-(int(tops[-1]) + 1) * rule.den // rule.num))])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(values), bool)
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] != values
    out_text, out_key = [], []
    for up in (0, 1):
        level = own_class + up
        r = differ[np.minimum(level, len(differ) - 1)]
        paired = r >= PAIRED_FROM
        groups = np.where(paired, (r * PAIRED_TIMES).astype(np.int64) + PAIRED_SPARE, np.maximum(LEAST_GROUPS, r + SPARE))
        groups = np.where((sizes > 0) & (r > 0), groups, 0)
        few = groups > 0
        for full in (False, True):
            used = few[owner] if full else (groups[owner] > 0) & rare
            own = np.where(few, groups, 0) if full else groups
            base = np.cumsum(own) - own
            who, x = owner[used], _mix(values[used] ^ _MULTIPLIERS[2])
            at = base[who] + (x % own[who].astype(np.uint64)).astype(np.int64)
            content = np.zeros(int(own.sum()), dtype=np.uint64)
            np.add.at(content, at, _mix(x + np.uint64(0x9E3779B9)))
            text = np.repeat(np.arange(len(sizes)), own)
            held = np.bincount(at, minlength=len(content)) > paired[text]
            group = np.arange(len(content)) - base[text]
            key = _mix(content + group.astype(np.uint64) * _MULTIPLIERS[1] + (2 * level[text] + full).astype(np.uint64) * _MULTIPLIERS[3])
            out_text.append(text[held])
            out_key.append(key[held])
            if not full:
                left = np.bincount(text[held], minlength=len(sizes))
                few &= left <= 2 * r
    return np.concatenate(out_text), np.concatenate(out_key)


def _batches(batches, column: str):
    """Record batches again, cut so that each holds a bounded amount of text (or one document)."""
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch.column(column).to_pylist()], dtype=np.int64)
        part = np.cumsum(sizes) // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _classes(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows(id, text) as (id, n, digest, p, q): size, digest and parities of each set."""

    def measure(batches):
        for batch in _batches(batches, "text"):
            values, bounds = shingle_sets(batch.column("text").to_pylist(), rule.width)
            parity = parities(values, bounds).view(np.int64)
            columns = [batch.column("id"), *map(pa.array, (np.diff(bounds), set_digests(values, bounds), parity[:, 0].copy(), parity[:, 1].copy()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "p", "q"])

    return rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, digest bigint, p bigint, q bigint")


def frequent_shingles(rows: DataFrame, rule: Rule, total: int) -> np.ndarray:
    """Sorted hashes of shingles that FREQUENT different sets of a sample hold. Any answer gives the same links; a good one, fewer candidates.

    The sample is bounded (about SAMPLE_DOCUMENTS rows, by the hash of id and text), and so is what is found in it.
    """
    parts = max(1, total // SAMPLE_DOCUMENTS)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(parts)) == 0)

    def sets(batches):
        for batch in _batches(batches, "text"):
            values, bounds = shingle_sets(batch.column("text").to_pylist(), rule.width)
            packed = [values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(packed), pa.int32()), pa.array(set_digests(values, bounds)), pa.array(packed, pa.binary())], names=["all", "digest", "shingles"])

    def count(group: pa.Table) -> pa.Table:
        _, first = np.unique(group.column("digest").to_numpy(), return_index=True)
        packed = group.column("shingles").to_pylist()
        values, counts = np.unique(np.concatenate([np.frombuffer(packed[i], "<u8") for i in first]), return_counts=True)
        return pa.table({"frequent": pa.array([values[counts >= FREQUENT].tobytes()], pa.binary())})

    found = sample.select("text").mapInArrow(sets, "all int, digest bigint, shingles binary").groupBy("all").applyInArrow(count, "frequent binary").collect()
    return np.frombuffer(found[0].frequent, "<u8") if found else np.zeros(0, np.uint64)


def parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 group counts of each set modulo 2, as the bits of two words: two sets differ in at least as many elements as bits."""
    group = _mix(values ^ _MULTIPLIERS[0]) >> np.uint64(57)
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    for half in (0, 1):
        bit = np.where(group >> np.uint64(6) == half, np.uint64(1) << (group & np.uint64(63)), np.uint64(0))
        sums = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bit)])
        out[:, half] = sums[bounds[1:]] ^ sums[bounds[:-1]]
    return out


def _may_link(rule: Rule, n, m, p, q) -> np.ndarray:
    """Whether sets of sizes n and m with parities p and q can link, by size and by the differences that parities show."""
    fits = (n * rule.den >= m * rule.num) & (m * rule.den >= n * rule.num)
    return fits & (np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64) * (rule.den + rule.num) <= (n + m) * (rule.den - rule.num))


def _meet(key: np.ndarray, node: np.ndarray, sizes: np.ndarray, parity: np.ndarray, rule: Rule) -> np.ndarray:
    """Edges that connect, for each key, the nodes with it that a chain of possible links connects. Nodes index sizes and parity."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[fresh], node[fresh]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(key)))
    least = np.repeat(node[start], count)
    good = _may_link(rule, sizes[node], sizes[least], parity[node], parity[least])
    edges = [np.stack([node, least], axis=1)[good & (node != least)]]
    # keys under which not all may link to the first: the chains of possible links, from one node to the next
    bad = np.flatnonzero((np.add.reduceat((~good).astype(np.int64), start) > 0) & (count > 2)) if len(start) else []
    for b in bad:
        rest = node[start[b] : start[b] + count[b]]
        front = rest[:1]
        rest = rest[1:]
        while len(rest):
            if not len(front):
                front, rest = rest[:1], rest[1:]
                continue
            at, front = front[0], front[1:]
            near = _may_link(rule, sizes[rest], sizes[at], parity[rest], parity[at])
            if near.any():
                edges.append(np.stack([rest[near], np.full(int(near.sum()), at)], axis=1))
                front, rest = np.concatenate([front, rest[near]]), rest[~near]
    return np.unique(np.concatenate(edges), axis=0)


def _candidates(rows: DataFrame, classes: DataFrame, rule: Rule, shards: int, frequent: np.ndarray) -> DataFrame:
    """Edges (u, v) between digests: of the classes that share a group, those that chains of possible links connect.

    A shard finds the keys that several classes have, and lists their members; a list that several keys have is kept once.
    Members then meet again by list, with their sizes and parities. What takes the disk is the keys on their way to the
    shards: a key travels with the lower half of its class's digest, by which a member is every class that has it, and
    slices of the shards travel one after the other, each hashing the texts again. Linked classes that agree in that half
    (a chance of 2^-32 a pair) would not meet by their keys.
    """

    def keys(batches, part: int, slices: int):
        for batch in _batches(batches, "text"):
            values, bounds = shingle_sets(batch.column("text").to_pylist(), rule.width)
            digests = set_digests(values, bounds)
            _, first = np.unique(digests, return_index=True)
            once = np.zeros(len(digests), bool)
            once[first] = True  # a class of the batch sends its keys once
            text, key = group_keys(values, bounds, rule, frequent)
            text, key = text[once[text]], key[once[text]]
            shard = (key >> np.uint64(32)) % np.uint64(shards)
            own = shard % np.uint64(slices) == part
            text, key, shard = text[own], key[own], shard[own]
            order = np.argsort(shard, kind="stable")
            key, half = key[order].astype("<u4"), digests.astype("<i4")[text[order]]  # the lower halves of digests
            edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            out = [(s, key[a:b].tobytes(), half[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            s, k, h = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(h, pa.binary())], names=["shard", "keys", "halves"])

    def meet(group: pa.Table) -> pa.Table:
        give_memory_back()
        key = np.concatenate([np.frombuffer(k, "<u4") for k in group.column("keys").to_pylist()])
        half = np.concatenate([np.frombuffer(h, "<i4") for h in group.column("halves").to_pylist()])
        both = np.unique(key.astype(np.uint64) << np.uint64(32) | half.view("<u4"))
        key, half = both >> np.uint64(32), both.astype(np.uint32)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        # a list's number is a hash of its members, so that lists of other shards compare
        sums = np.add.reduceat(_mix(half.astype(np.uint64)), start)
        number = _mix(sums * _MULTIPLIERS[1] + count.astype(np.uint64)).view(np.int64)
        _, first = np.unique(number, return_index=True)
        once = np.zeros(len(start), bool)
        once[first] = True
        kept = np.repeat(once & (count > 1), count)
        return pa.table({"list": pa.array(np.repeat(number, count)[kept]), "half": pa.array(half[kept].view(np.int32))})

    def chains(group: pa.Table) -> pa.Table:
        digests, first, node = np.unique(group.column("digest").to_numpy(), return_index=True, return_inverse=True)
        parity = np.stack([group.column(p).to_numpy()[first].view(np.uint64) for p in ("p", "q")], axis=1)
        edges = digests[_meet(group.column("list").to_numpy(), node, group.column("n").to_numpy()[first], parity, rule)]
        return pa.table({"u": pa.array(edges[:, 0].copy()), "v": pa.array(edges[:, 1].copy())})

    def lists(part: int, slices: int) -> DataFrame:
        sent = rows.select("text").mapInArrow(lambda batches: keys(batches, part, slices), "shard int, keys binary, halves binary")
        return sent.groupBy("shard").applyInArrow(meet, "list bigint, half int")

    if shards > SLICED_FROM:
        found = functools.reduce(DataFrame.union, [written(lists(part, SLICES), "lists") for part in range(SLICES)])
    else:
        found = lists(0, 1)
    known = classes.groupBy("digest").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("q").alias("q"))
    known = known.withColumn("half", F.shiftright(F.call_function("shiftleft", "digest", F.lit(32)), 32).cast("int"))
    members = found.distinct().join(known, "half").select("list", "digest", "n", "p", "q").withColumn("part", F.pmod("list", F.lit(shards)))
    return members.groupBy("part").applyInArrow(chains, "u bigint, v bigint")


class CountTree:
    """R-tree over group-count points of sets, bulk-loaded by halving along the widest coordinate."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.counts, self.sizes, self.rule = counts, sizes, rule
        self.root = self._load(np.arange(len(sizes)))

    def _load(self, members: np.ndarray):
        counts, sizes = self.counts[members], self.sizes[members]
        node = {"high": counts.max(axis=0), "least": int(sizes.min()), "most": int(sizes.max()), "members": members}
        if len(members) > LEAF:
            spans = np.append(node["high"] - counts.min(axis=0), node["most"] - node["least"])
            by = int(np.argmax(spans))
            order = members[np.argsort(sizes if by == counts.shape[1] else counts[:, by], kind="stable")]
            node["parts"] = [self._load(order[: len(order) // 2]), self._load(order[len(order) // 2 :])]
        return node

    def pairs(self, counts: np.ndarray, sizes: np.ndarray):
        """(asking point, point of the tree) for all pairs whose summed minima allow a link, node by node."""
        stack = [(self.root, np.arange(len(sizes)))]
        while stack:
            node, asking = stack.pop()
            own = sizes[asking]
            can = (own * self.rule.den >= node["least"] * self.rule.num) & (node["most"] * self.rule.den >= own * self.rule.num)
            bound = np.minimum(counts[asking], node["high"]).sum(axis=1)
            asking = asking[can & (bound >= self.rule.overlap(own + node["least"]))]
            if not len(asking):
                continue
            if "parts" in node:
                stack += [(part, asking) for part in node["parts"]]
                continue
            m = node["members"]
            for a in range(0, len(asking), 512):
                q = asking[a : a + 512]
                bound = np.minimum(counts[q][:, None, :], self.counts[m][None, :, :]).sum(axis=2)
                qi, mi = np.nonzero(bound >= self.rule.overlap(sizes[q][:, None] + self.sizes[m][None, :]))
                yield q[qi], m[mi]


def links_forest(left: list[np.ndarray], right: list[np.ndarray] | None, rule: Rule) -> list[tuple[int, int]]:
    """Links that join all sets that links join: within left, or between left and right (numbered on after left).

    Sets are sorted distinct hashes. Of each connected part a spanning forest is returned.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    counts = np.stack([np.bincount((s % np.uint64(COUNT_GROUPS)).astype(np.int64), minlength=COUNT_GROUPS) for s in sets]) if sets else np.zeros((0, COUNT_GROUPS), np.int64)
    n = len(left)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    if not n or right is not None and not right:
        return found
    inside = slice(0, n) if right is None else slice(n, None)
    offset = 0 if right is None else n
    tree = CountTree(counts[inside], sizes[inside], rule)
    for asking, held in tree.pairs(counts[:n], sizes[:n]):
        for a, b in zip(asking.tolist(), (held + offset).tolist()):
            if right is None and a >= b:
                continue
            x, y = root(a), root(b)
            if x == y:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if rule.den * common >= rule.num * (int(sizes[a]) + int(sizes[b]) - common):
                parent[x] = y
                found.append((a, b))
    return found


def _verified(rows: DataFrame, classes: DataFrame, hanging: DataFrame, rule: Rule) -> DataFrame:
    """Edges (u, v) between digests that link: a forest of each group of candidates hanging(node, component)."""
    one = classes.groupBy("digest").agg(F.first("n").alias("n"), F.min("id").alias("id"))
    members = written(one.join(hanging.withColumnRenamed("node", "digest"), "digest"), "members")
    weights = members.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    tasks = max(1, -(-members.count() // CLASSES_PER_TASK))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    wanted = members.join(weights, "component").select("digest", "component", "blocks", block.alias("block"))
    # which ids may be members, as a bitmap of fixed size: what it lets through by chance, the join drops
    place = F.pmod(F.xxhash64("id"), F.lit(64 * BITMAP_WORDS))
    words_ = members.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bitmap = np.zeros(BITMAP_WORDS, dtype=np.uint64)
    if words_:
        bitmap[[r.w for r in words_]] = np.array([r.b for r in words_], dtype=np.int64).view(np.uint64)

    def sets(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            may = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            chosen = batch.take(pa.array(np.flatnonzero(may)))
            for part in _batches([chosen], "text"):
                values, bounds = shingle_sets(part.column("text").to_pylist(), rule.width)
                packed = pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(values, bounds)), packed], names=["digest", "shingles"])

    once, sent = (int(x or 0) for x in members.join(weights, "component").agg(F.sum("n"), F.sum(F.col("n") * F.col("blocks"))).first())
    rounds = max(1, -(-sent // max(1, ROUND_TIMES * once)))
    found = rows.select("text", place.alias("place")).mapInArrow(sets, "digest bigint, shingles binary")
    held = found.join(wanted.hint("merge"), "digest")  # one plan at every size, which Spark can split where a key is hot
    held = written(held, "sets") if rounds > 1 else held
    small = F.col("blocks") == 1
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = held.select("*", other.alias("other")).select(
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")).alias("task"),
        F.when(small, -1).otherwise(F.least("block", "other")).alias("i"), F.when(small, -1).otherwise(F.greatest("block", "other")).alias("j"),
        "component", "block", "digest", "shingles",
    )

    def search(group: pa.Table) -> pa.Table:
        give_memory_back()
        component, own, digest = (group.column(c).to_numpy() for c in ("component", "block", "digest"))
        packed = group.column("shingles").to_pylist()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        out = []
        order = np.lexsort((digest, own, component))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(component[order]) != 0, [True]]))
        for a, b in zip(edges, edges[1:]):
            part = order[a:b]
            part = part[np.concatenate([[True], np.diff(digest[part]) != 0])] if i == j else part  # rows that repeat
            if i == j:
                lefts, rights = part, None
            else:
                lefts, rights = part[own[part] == i], part[own[part] == j]
            read = lambda rows_: [np.frombuffer(packed[r], "<u8") for r in rows_]
            who = part if rights is None else np.concatenate([lefts, rights])
            out += [(digest[who[x]], digest[who[y]]) for x, y in links_forest(read(lefts), None if rights is None else read(rights), rule)]
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = lambda some: some.groupBy("task", "i", "j").applyInArrow(search, "u bigint, v bigint")
    if rounds == 1:
        return links(cells)
    turn = F.pmod(F.xxhash64("task", "i", "j"), F.lit(rounds))
    return functools.reduce(DataFrame.union, [written(links(cells.where(turn == k)), "links") for k in range(rounds)])


def similar_groups(docs: DataFrame, rule: Rule, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the smallest id that links reach, its own included), and the set's digest.

    Texts are whole; null and empty texts, and texts without words, have no shingles and link with nothing. Rows that
    repeat, and ids with several texts, are rows of their own. A null id never becomes a component_id unless the whole
    component has none. An empty table gives an empty result. Only the id and the text are read.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    classes = written(_classes(rows, rule), "classes")
    total = classes.count()
    shards = max(16, -(-total // ROWS_PER_SHARD))
    hanging = components(_candidates(rows, classes, rule, shards, frequent_shingles(rows, rule, total)))
    linked = components(_verified(rows, classes.where("n > 0"), hanging, rule))
    least = classes.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"))
    named = least.join(linked.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "least", F.coalesce("component", "digest").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select("digest", "component_id")
    with_words = classes.where("n > 0").join(ids, "digest")
    alone = classes.where("n = 0").select("digest", "id", "n", F.col("id").alias("component_id"))
    return with_words.select("digest", "id", "n", "component_id").union(alone).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "digest")


def op2_count_vector_join(spark, sf_dir: str) -> DataFrame:
    """Components of near-equal documents by 4-word shingles at 85 of 100; see similar_groups for the edge cases."""
    return similar_groups(table(spark, sf_dir, "documents"), SHINGLES_4_AT_85).drop("digest")
