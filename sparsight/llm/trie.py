"""Prefix trie of conversations: what shared beginnings hold, and what is saved when they are computed once.

1. Turns are sorted by conversation and order over all tasks, so that a long conversation spans several of them; a task
   numbers its own rows, and one number a task tells where the conversation that goes on from the task before stands.
2. Conversations are rebuilt (see prefix_trie). The first d turns have a 128-bit digest: hashes of the turns with their
   places, combined by exclusive or, which running aggregates in chunks of a conversation compute.
3. Equal digests are a node. A node's smallest member and its depth name it. Nodes under which many rows lie are heavy;
   they are closed upward. What hangs below them are light subtrees of bounded size, dealt to prefix shards.
4. A shard is a succinct trie: a LOUDS bitvector and label arrays in level order, built by numpy. Parents are found in the
   bitvector; rollups go through the levels in reverse, each adding into its parents.
5. The heavy upper levels merge by themselves. Each conversation brings what it owns there, the nodes of which it is the
   smallest member and the light subtrees below those, to all heavy nodes above; along its own nodes it is a running sum.
6. Ids of conversations that end at a node are sorted over all tasks and packed; their texts are hashed in a stream.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, give_memory_back, table, text_of, written

#: Conversations that take the beginning of one: so many in a row of ids; turns that they take at most.
FAMILY, HEADS = 20, 3
#: Rows below a node from which it is heavy; about the nodes of a shard.
HEAVY_ROWS = 20_000
#: Turns of a conversation that are summed up at once; ids in a packed row.
CHUNK, IDS_TOGETHER = 4096, 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Louds(NamedTuple):
    """A forest under a root of its own, in level order: a one for each child and a zero for each node's end, the root's first."""

    order: np.ndarray
    bits: np.ndarray
    levels: np.ndarray

    @classmethod
    def of(cls, parent: np.ndarray, label: np.ndarray) -> Louds:
        """From each node's parent (-1: the root) and a label that orders siblings. order holds the nodes, levels where each level begins."""
        by_parent = np.lexsort((label, parent))
        degree = np.bincount(parent + 1, minlength=len(parent) + 1)
        start = np.cumsum(degree) - degree  # of the children of the root, and of each node, among by_parent
        level, order, levels = by_parent[: degree[0]], [], [0]
        while len(level):
            order.append(level)
            levels.append(levels[-1] + len(level))
            own = degree[level + 1]
            level = by_parent[np.repeat(start[level + 1] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        own = np.concatenate([degree[:1], degree[order + 1]])
        bits = np.ones(int(own.sum()) + len(own), dtype=bool)
        bits[np.cumsum(own + 1) - 1] = False
        return cls(order, bits, np.array(levels))

    def parents(self) -> np.ndarray:
        """Of each node, its parent's place in level order: the zeros before the node's one, without the root's."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        """Of each node, how many children it has: the ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (in level order) over each node's subtree, by the levels in reverse."""
        total, parent = values.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:0:-1]):
            np.add.at(total, parent[a:b], total[a:b])
        return total


def _places(batches):
    """Rows (conv, a, b, words) sorted by conversation: place in the part of the conversation that the task holds."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        ends = np.append(starts[1:], len(conv))
        place = np.arange(len(conv)) - np.repeat(starts, ends - starts)
        if conv[0] == last:
            place[: ends[0]] += n
        last, n = conv[-1], int(place[-1]) + 1
        columns = [pa.array(np.full(len(conv), part)), batch.column("conv"), pa.array(place), *[batch.column(c) for c in ("a", "b", "words")]]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "conv", "place", "a", "b", "words"])


def _numbered(turns: DataFrame) -> DataFrame:
    """turns(conv, turn, a, b, words) with i, the turn's number in its conversation from 1 on."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "a", "b", "words")
    numbered = written(dealt.mapInArrow(_places, "part bigint, conv bigint, place bigint, a bigint, b bigint, words bigint"), "turns")
    counts = numbered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation goes on from one task's rows to the next one's: no more rows than tasks
    going_on = counts.select("conv", "part", F.sum("n").over(before).alias("before")).where(F.col("before").isNotNull())
    joined = numbered.join(F.broadcast(going_on), ["conv", "part"], "left")
    return joined.select("conv", (F.col("place") + F.coalesce("before", F.lit(0)) + 1).alias("i"), "a", "b", "words")


def _conversations(numbered: DataFrame) -> DataFrame:
    """conv, source, h, lead (turns taken from the source), length (of the rebuilt conversation)."""
    own = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv").cast("string")) % (HEADS + 1)
    known = own.select("conv", "own", (F.col("conv") - F.col("conv") % FAMILY).alias("source"), h.alias("h"))
    sources = own.select(F.col("conv").alias("source"), F.col("own").alias("there"))
    lead = F.least("h", F.coalesce("there", F.lit(0)))
    return known.join(sources, "source", "left").select("conv", "source", "h", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _running_xor(steps: DataFrame, columns: list[str]) -> DataFrame:
    """steps(conv, depth, length, ...) with the named columns as exclusive ors from the conversation's first turn on."""
    chunk = F.floor(F.col("depth") / CHUNK)
    local = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunked = steps.withColumn("chunk", chunk)
    totals = chunked.where(F.col("length") >= CHUNK).groupBy("conv", "chunk").agg(*[F.bit_xor(c).alias(c) for c in columns])
    carried = totals.select("conv", "chunk", *[F.bit_xor(c).over(before).alias(f"{c}_before") for c in columns])
    rest = [c for c in steps.columns if c not in columns]
    here = chunked.select(*rest, "chunk", *[F.bit_xor(c).over(local).alias(c) for c in columns])
    out = here.join(carried, ["conv", "chunk"], "left")
    return out.select(*rest, *[F.col(c).bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in columns])


def _paths(turns: DataFrame) -> DataFrame:
    """A row for every beginning of every rebuilt conversation: conv, depth, digest (a, b), the digest one turn before (pa, pb), words of the last turn, turns that follow."""
    numbered = _numbered(turns)
    known = written(_conversations(numbered), "conversations")
    own = numbered.join(known, "conv").where(F.col("i") > F.col("h")).select("conv", (F.col("i") - F.col("h") + F.col("lead")).alias("depth"), "length", "a", "b", "words")
    heads = numbered.where((F.col("i") <= HEADS) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "source")
    lent = heads.join(known.where("lead > 0"), "source").where(F.col("i") <= F.col("lead")).select("conv", F.col("i").alias("depth"), "length", "a", "b", "words")
    salted = [F.xxhash64("a", "b", "depth").alias("x"), F.xxhash64(F.lit(3), "b", "a", "depth").alias("y")]
    steps = own.union(lent).select("conv", "depth", "length", "words", *salted)
    run = _running_xor(steps.select("*", F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"])
    below = (F.col("length") - F.col("depth")).alias("below")
    taken = run.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words", below)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    return taken.union(known.select("conv", zero, zero, zero, none, none, zero, "length"))


def _shard(group: pa.Table) -> pa.Table:
    """The light subtrees of a shard with their rollups; tops are the nodes whose parent is heavy, or absent."""
    give_memory_back()
    a, b, conv, n, words = (group.column(c).to_numpy() for c in ("a", "b", "conv", "n_convs", "words"))
    top = group.column("depth").to_numpy() == group.column("cut").to_numpy()
    pa_, pb = (np.where(top, 0, group.column(c).fill_null(0).to_numpy()) for c in ("pa", "pb"))
    both = np.concatenate([a, pa_]), np.concatenate([b, pb])
    order = np.lexsort(both[::-1])
    fresh = np.concatenate([[True], (np.diff(both[0][order]) != 0) | (np.diff(both[1][order]) != 0)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    node = np.full(len(order), -1)
    node[number[: len(a)]] = np.arange(len(a))
    trie = Louds.of(np.where(top, -1, node[number[len(a) :]]), a)
    at, parent, children = trie.order, trie.parents(), trie.degrees()
    leaves, saved = trie.rolled_up((children == 0).astype(np.int64)), trie.rolled_up((n[at] - 1) * words[at])
    found = {c: group.column(c).take(pa.array(at)) for c in ("a", "b", "conv", "depth", "pa", "pb", "n_convs")}
    owner = pa.array(conv[at][np.maximum(parent, 0)] if len(at) else conv, mask=parent < 0)
    return pa.table({**found, "parent_conv": owner, "n_children": children, "n_leaves": leaves, "saved": saved, "top": pa.array(parent < 0)})


_SHARD_SCHEMA = "a bigint, b bigint, conv bigint, depth bigint, pa bigint, pb bigint, n_convs bigint, parent_conv bigint, n_children bigint, n_leaves bigint, saved bigint, top boolean"
_RESULT = ["a", "b", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved"]


def _suffix_sums(items: DataFrame, columns: list[str]) -> DataFrame:
    """items(conv, depth, ...) with the named columns summed from the row to the conversation's deepest one."""
    down = Window.partitionBy("conv", "chunk").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunked = items.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    totals = chunked.groupBy("conv", "chunk").agg(*[F.sum(c).alias(c) for c in columns])
    carried = totals.select("conv", "chunk", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in columns])
    rest = [c for c in items.columns if c not in columns]
    here = chunked.select(*rest, "chunk", *[F.sum(c).over(down).alias(c) for c in columns])
    return here.join(carried, ["conv", "chunk"]).select(*rest, *[(F.col(c) + F.col(f"{c}_after")).alias(c) for c in columns])


def _upper(heavy: DataFrame, tops: DataFrame, paths: DataFrame) -> DataFrame:
    """Results of the heavy nodes, from the light subtrees' tops and the heavy nodes' own values. paths: those not deeper than heavy nodes."""
    up = ["pa", "pb"]
    kids = tops.select(*up).union(heavy.where("depth > 0").select(*up)).groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    known = heavy.join(kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = written(known.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "heavy")
    sums = ["n_leaves", "saved"]
    items = known.select("conv", "depth", *sums, "a", "b", F.lit(True).alias("heavy")).union(tops.select("conv", "depth", *sums, "a", "b", F.lit(False)))
    owned = items.groupBy("conv").agg(F.min("depth").alias("first"), *[F.sum(c).alias(c) for c in sums])
    above = paths.select("conv", "depth", "a", "b").join(owned, "conv").where(F.col("depth") < F.col("first")).groupBy("a", "b").agg(*[F.sum(c).alias(f"{c}_others") for c in sums])
    own = _suffix_sums(items, sums).where("heavy").select("a", "b", *sums)
    total = [(F.col(c) + F.coalesce(f"{c}_others", F.lit(0))).alias(c) for c in sums]
    return known.drop(*sums).join(own, ["a", "b"]).join(above, ["a", "b"], "left").select("a", "b", "conv", "depth", *up, "n_convs", "n_children", *total)


def _packed_ids(batches):
    """Rows (a, b, conv) in order: (a, b, first id, ids as text), rows of at most IDS_TOGETHER ids of a node."""
    for batch in batches:
        a, b, conv = (batch.column(c).to_numpy() for c in ("a", "b", "conv"))
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else []
        cuts = [c for s, e in zip(starts, np.append(starts[1:], len(a))) for c in range(s, e, IDS_TOGETHER)] if len(a) else []
        ids = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(cuts, [*cuts[1:], len(a)])]
        yield pa.RecordBatch.from_arrays([*[pa.array(x[cuts] if len(cuts) else x) for x in (a, b, conv)], pa.array(ids, pa.string())], names=["a", "b", "conv", "ids"])


def _hashed_ids(batches):
    """Packed rows in order of node and first id: (a, b, ends), the hash of all ids of a node. Only a row's ids are held at once."""
    node, digest = None, None
    for batch in batches:
        found = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) != node:
                found += [(*node, digest.hexdigest())] if node else []
                node, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _hash_rows(found)
    yield _hash_rows([(*node, digest.hexdigest())] if node else [])


def _hash_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, h = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())], names=["a", "b", "ends"])


def _ends(paths: DataFrame) -> DataFrame:
    """a, b, ends: hashes of the ids of the conversations that end at a node, where any does."""
    order = ["a", "b", "conv"]
    ends = paths.where("below = 0").select(*order)
    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed_ids, "a bigint, b bigint, conv bigint, ids string")
    return packed.repartition("a", "b").sortWithinPartitions(*order).select("a", "b", "ids").mapInArrow(_hashed_ids, "a bigint, b bigint, ends string")


def prefix_trie(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Every node of the trie of rebuilt conversations: its smallest member and depth, its parent, and what it and its subtree hold.

    A conversation c is rebuilt from the first h turns of the conversation c - c % 20 (the remainder has c's sign), fewer
    if there are fewer, and c's own turns after its first h, h being the CRC-32 of c's decimal digits modulo 4. A node is a
    distinct sequence of first turns, role and text; the root has none. Turns are ordered by turn, null first; ties by a
    hash of role and text, so that the order of the rows doesn't matter. Null roles and texts are empty. Rows without a
    conversation are left out; repeated rows are turns of their own. An empty table gives no rows, not even the root. Other
    columns are not read, whatever their names. Sequences are told apart by 128 bits.
    """
    role, text = text_of(f"`{role_column}`"), text_of(f"`{text_column}`")
    turns = rows.select(F.col(f"`{conv_column}`").cast("bigint").alias("conv"), F.col(f"`{turn_column}`").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    paths = written(_paths(turns.where("conv is not null")), "paths")
    below = F.col("below")
    nodes = written(
        paths.groupBy("a", "b", "depth").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), *[F.first(c).alias(c) for c in ("pa", "pb", "words")], F.sum(below + 1).alias("weight"),
        ), "nodes",
    )
    total, deepest = nodes.agg(F.count(F.lit(1)), F.max(F.when(F.col("weight") > HEAVY_ROWS, F.col("depth")))).first()
    shards = max(1, -(-total // HEAVY_ROWS))
    light, heavy = nodes.where(F.col("weight") <= HEAVY_ROWS), nodes.where(F.col("weight") > HEAVY_ROWS)
    if deepest is None:
        placed = light.withColumns({"cut": F.lit(0).cast("bigint"), "shard": F.lit(0)})
    else:
        near = paths.where(F.col("depth") <= deepest + 1)
        marks = near.join(heavy.select("a", "b", "depth"), ["a", "b", "depth"]).groupBy("conv").agg(F.count(F.lit(1)).alias("cut"))
        cuts = near.select("conv", "depth", "a", "b").join(marks, "conv").where(F.col("depth") == F.col("cut")).select("conv", "cut", F.pmod(F.xxhash64("a", "b"), F.lit(shards)).alias("shard"))
        placed = light.join(cuts, "conv")
    columns = ["shard", "cut", "a", "b", "conv", "depth", "pa", "pb", "n_convs", "words"]
    lower = placed.select(*columns).groupBy("shard").applyInArrow(_shard, _SHARD_SCHEMA)
    if deepest is None:
        found = lower.select(*_RESULT)
    else:
        lower = written(lower, "subtrees")
        upper = written(_upper(heavy.select("a", "b", "conv", "depth", "pa", "pb", "n_convs", "words"), lower.where("top"), paths.where(F.col("depth") <= deepest)), "upper")
        owners = upper.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv"))
        hanging = lower.where("top").drop("parent_conv").select(*upper.columns).union(upper)
        found = lower.where("not top").select(*_RESULT).union(hanging.join(owners, ["pa", "pb"], "left").select(*_RESULT))
    return found.join(_ends(paths), ["a", "b"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op11_louds_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations; see prefix_trie for the edge cases."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a number's decimal digits in SQL: each digit comes in, then eight shifts follow (-1 stands for one).
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own, CAST({_CRC} AS BIGINT) % {HEADS + 1} AS h FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, list_concat(coalesce(f.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, d, len(seq) AS l, seq[1:d] AS k, CASE WHEN d > 0 THEN seq[1:d - 1] END AS pk,
    CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].text, '{WORD}')) ELSE 0 END AS w FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT k, any_value(pk) AS pk, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = l), '')) AS ends_sha256 FROM p GROUP BY k),
kids AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sums AS (SELECT p.k, CAST(sum(CAST(m.n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves, CAST(sum((m.n_convs - 1) * m.w) AS BIGINT) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.depth GROUP BY p.k)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums USING (k) LEFT JOIN n u ON u.k = m.pk
"""
