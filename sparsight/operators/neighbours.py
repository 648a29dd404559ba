"""Nearest prototypes: distances, votes, partitions, sparsified patterns, principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sdr import dot, total
from ..shared import written as _settled
from .runs import numbered

#: Prototypes that a query block may be compared with at once: the table is cut into so many rows a block.
PROTOTYPES_PER_BLOCK = 4096
#: Rows of a cell of the grid, in which a block of queries meets a block of prototypes; distances that are held at once.
CELL_QUERIES, CELL_PROTOTYPES, HELD = 16_384, 8192, 2**18
#: Patterns of a block of the triangular grid that seeks near pairs.
CELL_PATTERNS = 8192


def distance(method: str, x: Column, p: Column, power: int = 2) -> Column:
    """Of a query from a prototype, both dense: norm, raw_overlap, pct_input, pct_prototype or pct_larger (overlaps count binary inputs)."""
    if method == "norm":
        if power not in (1, 2):
            raise ValueError("only the norms 1 and 2 are defined")
        gap = F.zip_with(x, p, lambda a, b: F.abs(a - b) if power == 1 else (a - b) * (a - b))
        return total(gap) if power == 1 else F.sqrt(total(gap))
    shared, mine, theirs = dot(x, p), total(x), total(p)
    if method == "raw_overlap":
        return mine - shared
    over = {"pct_input": mine, "pct_prototype": theirs, "pct_larger": F.greatest(mine, theirs)}[method]
    return F.when(over > 0, 1 - shared / over).otherwise(1.0)


def distances(queries: DataFrame, prototypes: DataFrame, method: str = "norm", power: int = 2, exclude_partition: bool = False) -> DataFrame:
    """query_id, proto_id, category, dist of a stated set of queries (id, x) against all prototypes (id, x, category).

    Prototypes are spread over blocks and queries visit each block, so the pairs of a block are one task's work; with
    exclude_partition, prototypes of the query's own `partition` don't count. Queries are a stated, small set.
    """
    blocks = max(1, -(-prototypes.count() // PROTOTYPES_PER_BLOCK))
    visit = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = prototypes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    q, p = visit.alias("q"), held.alias("p")
    on = F.col("q.block") == F.col("p.block")
    if exclude_partition:
        on &= F.col("q.partition") != F.col("p.partition")
    return q.join(p, on).select(F.col("q.id").alias("query_id"), F.col("p.id").alias("proto_id"), F.col("p.category").alias("category"), distance(method, F.col("q.x"), F.col("p.x"), power).alias("dist"))


def _whole(*tables: np.ndarray) -> float | None:
    """The largest absolute value where all numbers are whole, so that sums of products are exact in any order; else None."""
    most = 0.0
    for x in tables:
        if not np.isfinite(x).all() or (x != np.floor(x)).any():
            return None
        most = max(most, float(np.abs(x).max(initial=0.0)))
    return most


def _in_order(q: np.ndarray, p: np.ndarray, part) -> np.ndarray:
    """Sums of part(q[i], p[j]) by coordinate, added in the coordinates' order as the column expressions do."""
    found = np.zeros((len(q), len(p)), q.dtype)
    for k in range(q.shape[1]):
        found += part(q[:, k, None], p[None, :, k])
    return found


def distance_table(method: str, q: np.ndarray, p: np.ndarray, power: int = 2) -> np.ndarray:
    """What `distance` gives, for all rows of q with all rows of p (both n x width), to the last bit."""
    most, width = _whole(q, p), q.shape[1]
    exact = most is not None and 4 * width * most * most < 2**53
    if method == "norm":
        if power not in (1, 2):
            raise ValueError("only the norms 1 and 2 are defined")
        if power == 1:
            if most is not None and 2 * width * most < 2**24:
                q, p = q.astype(np.float32), p.astype(np.float32)
            return _in_order(q, p, lambda a, b: np.abs(a - b)).astype(np.float64)
        if exact:
            return np.sqrt((q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (q @ p.T))
        return np.sqrt(_in_order(q, p, lambda a, b: (a - b) * (a - b)))
    one = np.ones((1, width))
    shared = q @ p.T if exact else _in_order(q, p, lambda a, b: a * b)
    mine, theirs = _in_order(q, one, lambda a, b: a * b), _in_order(one, p, lambda a, b: a * b)
    if method == "raw_overlap":
        return mine - shared
    over = {"pct_input": mine, "pct_prototype": theirs, "pct_larger": np.maximum(mine, theirs)}[method]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(over > 0, 1 - shared / over, 1.0)


def _matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, n x width table) for each width of the vectors in an Arrow column; vectors that are or hold null are left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    found = []
    for width in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        flat = lists.take(pa.array(rows)).flatten()
        holds = np.zeros(len(rows), bool) if not width else flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), width).any(axis=1)
        table = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
        found.append((rows[~holds], table[~holds]))
    return found


def _codes(left, right) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two Arrow columns of a type, equal where the values are; -1 for null."""
    both = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (left, right)])
    numbers = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return numbers[: len(left)], numbers[len(left) :]


def _first_k(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k smallest keys of each row, ties to the smaller place; NaN is no key."""
    if not key.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit = np.partition(key, k - 1, axis=1)[:, k - 1, None] if k < key.shape[1] else np.full((len(key), 1), np.nan)
    row, at = np.nonzero(~np.isnan(key) & ((key <= limit) | np.isnan(limit)))
    order = np.lexsort((at, key[row, at], row))
    row, at = row[order], at[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return row[rank < k], at[rank < k]


def closest(queries: DataFrame, prototypes: DataFrame, k: int, method: str = "norm", power: int = 2, exclude_partition: bool = False, exclude_self: bool = False, by_category: bool = False) -> DataFrame:
    """The rows of `distances` that can be among the k nearest of a query (with by_category, of a query and category), ties to the smaller id.

    Blocks of queries meet blocks of prototypes in the cells of a grid. A cell computes its distances as a table, a bounded
    part at a time, and returns k rows for each query, so that pairs never become rows. All queries meet all prototypes.
    Distances are those of `distance` to the last bit; null ones come last. exclude_self leaves out pairs of equal ids.
    """
    across, down = (max(1, -(-rows.count() // most)) for rows, most in ((prototypes, CELL_PROTOTYPES), (queries, CELL_QUERIES)))
    parts = 3 * across * down  # more partitions than cells, so that few share one; a stated number isn't merged
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731 - the sides may share columns, and a cogroup needs them apart
    columns = [F.col("x").cast("array<double>").alias("x"), *named("id", *(["partition"] if exclude_partition else []))]
    asking = queries.select(*columns, every(across).alias("j")).withColumn("cell", block(down) * across + F.col("j")).drop("j")
    held = prototypes.select(*columns, *named("category"), every(down).alias("i")).withColumn("cell", F.col("i") * across + block(across)).drop("i")
    kind = lambda rows, c: rows.schema[c].dataType.simpleString()

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        p = p.sort_by("id")
        q_ids, p_ids = _codes(q.column("id"), p.column("id"))
        q_part, p_part = _codes(q.column("partition"), p.column("partition")) if exclude_partition else (None, None)
        kinds = _codes(p.column("category"), p.column("category"))[0]
        groups = [np.flatnonzero(kinds == c) for c in np.unique(kinds)] if by_category else [np.arange(len(kinds))]
        p_tables = {t.shape[1]: (rows, t) for rows, t in _matrices(p.column("x"))}
        q_of = np.full(len(q_ids), -1)  # the width of each query, and its row in the table of that width
        q_at, q_tables = np.zeros(len(q_ids), np.int64), {}
        for rows, t in _matrices(q.column("x")):
            q_of[rows], q_at[rows], q_tables[t.shape[1]] = t.shape[1], np.arange(len(rows)), t
        q_sum, p_sum = np.full(len(q_ids), np.nan), np.full(len(p_ids), np.nan)
        for width, t in q_tables.items():
            q_sum[q_of == width] = t.sum(axis=1)
        for rows, t in p_tables.values():
            p_sum[rows] = t.sum(axis=1)
        step = max(1, HELD // max(1, len(p_ids)))
        out = []
        order = np.argsort(q_of, kind="stable")
        for a in range(0, len(order), step):
            asked = order[a : a + step]
            dist = np.full((len(asked), len(p_ids)), np.nan)
            known = np.zeros(dist.shape, bool)
            for width in set(q_of[asked].tolist()) & set(p_tables):
                mine, (rows, t) = np.flatnonzero(q_of[asked] == width), p_tables[width]
                dist[np.ix_(mine, rows)] = distance_table(method, q_tables[width][q_at[asked[mine]]], t, power)
                known[np.ix_(mine, rows)] = True
            if method.startswith("pct_") and not known.all():  # what has nothing to be a share of is 1 away, with and without vectors
                mine, theirs = q_sum[asked][:, None], p_sum[None, :]
                over = {"pct_input": mine, "pct_prototype": theirs, "pct_larger": np.fmax(mine, theirs)}[method]
                none = ~known & ~(np.broadcast_to(over, dist.shape) > 0)
                dist[none], known[none] = 1.0, True
            key = np.where(np.isnan(dist), np.inf, dist)
            if exclude_self:
                key[(q_ids[asked][:, None] == p_ids) | (p_ids < 0)] = np.nan
            if exclude_partition:
                key[(q_part[asked][:, None] == p_part) | (q_part[asked][:, None] < 0) | (p_part < 0)] = np.nan
            for group in groups:
                row, at = _first_k(key if not by_category else key[:, group], k)
                out.append((asked[row], group[at], dist[row, group[at]], ~known[row, group[at]]))
        at_q, at_p, dist, unknown = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64, bool)))
        return pa.table({"query_id": q.column("id").take(pa.array(at_q)), "proto_id": p.column("id").take(pa.array(at_p)), "category": p.column("category").take(pa.array(at_p)), "dist": pa.array(dist, mask=unknown)})

    both = asking.repartition(parts, "cell").groupBy("cell").cogroup(held.repartition(parts, "cell").groupBy("cell"))
    return both.applyInArrow(meet, f"query_id {kind(queries, 'id')}, proto_id {kind(prototypes, 'id')}, category {kind(prototypes, 'category')}, dist double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest prototypes of each query, ties to the smaller id; null distances come last."""
    w = Window.partitionBy("query_id").orderBy(F.col("dist").asc_nulls_last(), "proto_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(found: DataFrame, k: int) -> DataFrame:
    """query_id, winner, share: the commonest category among the k nearest, first category of equals."""
    votes = nearest(found, k).groupBy("query_id", "category").count()
    return votes.groupBy("query_id").agg(F.max_by("category", F.struct("count", -F.col("category"))).alias("winner"), (F.max("count") / F.sum("count")).alias("share"))


def category_distance(found: DataFrame) -> DataFrame:
    """The distance to each category's nearest prototype, clipped to [0, 1]."""
    return found.groupBy("query_id", "category").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("dist"))).alias("dist"))


def closest_of_category(found: DataFrame, category: int) -> DataFrame:
    return nearest(found.where(F.col("category") == category), 1)


def sparsify(x: Column, threshold: float, relative: bool = False, winners: int = 0, binarise: bool = False) -> Column:
    """Keeps x with x |x| over a threshold (or over a share of the largest), then only the largest winners, then perhaps as ones."""
    limit = F.lit(threshold) * F.array_max(F.transform(x, lambda v: F.abs(v))) if relative else F.lit(threshold)
    kept = F.transform(x, lambda v: F.when(v * F.abs(v) > limit, v).otherwise(0.0))
    if winners:
        ranked = F.slice(F.array_sort(F.transform(kept, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, winners)
        at = F.transform(ranked, lambda s: s.i)
        kept = F.transform(kept, lambda v, i: F.when(F.array_contains(at, i), v).otherwise(0.0))
    return F.transform(kept, lambda v: F.when(v != 0, 1.0).otherwise(0.0)) if binarise else kept


def learn(training: DataFrame, distance_threshold: float = 0.0, replace_duplicates: bool = False, capacity: int = -1) -> DataFrame:
    """Prototypes of training patterns (id, x, category): one of equal patterns (the first, or the last where duplicates replace), the latest `capacity`.

    With a distance threshold above zero a pattern is learned, in order of ids, where no pattern learned before lies nearer.
    """
    if distance_threshold > 0:
        kept = apart(training, distance_threshold)
    else:
        pick = F.max_by if replace_duplicates else F.min_by
        same = ["x"] if replace_duplicates else ["x", "category"]
        kept = training.groupBy(*same).agg(pick(F.struct("id", "x", "category"), F.col("id")).alias("p")).select("p.*")
    if capacity > 0:
        return kept.orderBy(F.col("id").desc()).limit(capacity)
    return kept


#: Rounds in which patterns wait for one another before blocks of them are decided in order.
ROUNDS = 10
BLOCK = 2000


def _near_pairs(patterns: DataFrame, least: float) -> DataFrame:
    """u, v: the ids, u < v, of all patterns that lie nearer than `least` to each other.

    Blocks of patterns meet in the cells of a triangular grid; a cell computes its distances as tables of bounded size and
    returns near pairs only. Distances are those of `distance` to the last bit; patterns of other lengths are never near.
    """
    blocks = max(1, -(-patterns.count() // CELL_PATTERNS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = patterns.select("id", F.col("x").cast("array<double>").alias("x"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = rows.select("id", "x", "own", (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("cell"))
    kind = patterns.schema["id"].dataType.simpleString()

    def search(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group.column("id")))
        own = group.column("own").to_numpy()
        low, high = own.min(), own.max()
        out = []
        for rows_, t in _matrices(group.column("x")):
            left, right = (np.flatnonzero(own[rows_] == o) for o in (low, high))
            step = max(1, HELD // max(1, len(right)))
            for a in range(0, len(left), step):
                part = left[a : a + step]
                beyond = right[right > part[0]] if low == high else right  # a pair of a block is met from its smaller id
                i, j = np.nonzero(distance_table("norm", t[part], t[beyond]) < least)
                i, j = rows_[part[i]], rows_[beyond[j]]
                out.append(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, i < j] if low == high else np.stack([np.minimum(i, j), np.maximum(i, j)]))
        u, v = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        ids = group.column("id")
        return pa.table({"u": ids.take(pa.array(u)), "v": ids.take(pa.array(v))})

    # more partitions than cells, so that few share one; a stated number isn't merged
    return cells.repartition(3 * blocks * (blocks + 1) // 2, "cell").groupBy("cell").applyInArrow(search, f"u {kind}, v {kind}").where("u < v")


def apart(training: DataFrame, least: float) -> DataFrame:
    """The patterns (id, x, ...) that are kept, in order of their distinct ids, where none kept before lies nearer than `least`.

    Of equal patterns only the first can be kept, so only firsts are compared, all with all in cells of distance tables.
    A pattern is decided as soon as those before it that lie near are: kept if all of them are dropped. Each round is one
    join and decides all that can be; its table is written, so that lineage doesn't grow. Chains that are longer than the
    rounds are left to blocks of ids, which always end. Patterns that are or hold null, or hold what isn't finite, are
    near none.
    """
    plain = F.coalesce(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))
    odd = training.where(~plain)
    training_, training = training, _settled(training.where(plain).groupBy("x").agg(F.min("id").alias("id")).select("id", "x"), "firsts")
    kept = _first_apart(training, least)
    return training_.join(kept.union(odd.select("id")), "id", "left_semi")


def _first_apart(training: DataFrame, least: float) -> DataFrame:
    """The ids of `apart` for different patterns (id, x)."""
    pairs = _near_pairs(training, least)
    pairs = _settled(pairs, "near")
    kept = training.select("id").join(pairs.select(F.col("v").alias("id")), "id", "left_anti")  # none before them is near
    dropped = None
    for _ in range(ROUNDS):
        kept = _settled(kept.select("id"), "kept")
        gone = pairs.join(kept.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        dropped = _settled(gone, "dropped")
        known = kept.select("id").union(dropped.select("id"))
        open_ = pairs.join(dropped.select(F.col("id").alias("u")), "u", "left_anti").select(F.col("v").alias("id"))
        more = training.select("id").join(known, "id", "left_anti").join(open_, "id", "left_anti").distinct()
        if more.isEmpty():
            return kept.select("id")
        kept = kept.union(more)
    known = _settled(known, "known")
    waiting = pairs.join(known.select(F.col("id").alias("u")), "u", "left_anti").join(known.select(F.col("id").alias("v")), "v", "left_anti")
    late = _in_blocks(training.select("id").join(known, "id", "left_anti").distinct(), _settled(waiting, "waiting"))
    return kept.select("id").union(late)


def _in_blocks(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which of ids are kept, in their order, where none that pairs(u, v), u < v, puts before them is: one block of ids after the other.

    What a block's patterns have before them is known when it comes; inside it, its own pairs decide, at most BLOCK squared.
    """
    placed = _settled(numbered(ids, [], ["id"], "i").select("id", F.floor(F.col("i") / BLOCK).alias("block")), "blocks")
    first, last = placed.agg(F.min("block"), F.max("block")).first()
    met = pairs.join(placed.select(F.col("id").alias("u"), F.col("block").alias("u_block")), "u").join(placed.select(F.col("id").alias("v"), F.col("block").alias("v_block")), "v")
    met = _settled(met, "met")

    def decide(group: pa.Table) -> pa.Table:
        dropped, before = set(), {}
        for u, v in zip(group.column("u").to_pylist(), group.column("v").to_pylist()):
            before.setdefault(v, []).append(u)
        for v in sorted(before):
            if any(u not in dropped for u in before[v]):
                dropped.add(v)
        return pa.table({"id": pa.array(sorted(dropped), group.schema.field("v").type)})

    kept = None
    for block in range(first, last + 1) if first is not None else ():
        own = placed.where(F.col("block") == block).select("id")
        if kept is not None:
            gone = met.where((F.col("v_block") == block) & (F.col("u_block") < block)).join(kept.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id"))
            own = _settled(own.join(gone, "id", "left_anti"), "own")
        inside = met.where((F.col("v_block") == block) & (F.col("u_block") == block)).join(own.select(F.col("id").alias("u")), "u", "left_semi").join(own.select(F.col("id").alias("v")), "v", "left_semi")
        dropped = inside.groupBy("v_block").applyInArrow(decide, f"id {ids.schema['id'].dataType.simpleString()}")
        now = own.join(dropped, "id", "left_anti")
        kept = _settled(now if kept is None else kept.union(now), "late")
    return ids if kept is None else kept


def forget(prototypes: DataFrame, ids: DataFrame) -> DataFrame:
    """Prototypes without the rows whose ids are in a table."""
    return prototypes.join(ids, "id", "left_anti")


def principal_axes(rows: DataFrame, column: str, dims: int | None = None, fraction: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (rows) of the mean-centred patterns of equal length, by the moments of all rows.

    Each partition sends one d x d table of sums; dims fixes how many axes stay, else those whose singular values are a
    fraction of the largest.
    """

    def moments(batches):
        total = None
        for batch in batches:
            lists = batch.column(0).drop_null()
            if len(lists):
                x = lists.flatten().to_numpy().reshape(len(lists), -1)
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "s"])

    sums = rows.select(F.col(column).cast("array<double>")).mapInArrow(moments, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # (d + 1)^2 rows
    if not sums:
        raise ValueError("there are no patterns")
    width = int(round(len(sums) ** 0.5))
    table = np.zeros(width * width)
    for r in sums:
        table[r["at"]] = r.s
    table = table.reshape(width, width)
    n, mean = table[-1, -1], table[-1, :-1] / table[-1, -1]
    values, vectors = np.linalg.eigh(table[:-1, :-1] - n * np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    singular = np.sqrt(np.maximum(values[order], 0))
    keep = dims or int((singular > fraction * singular[0]).sum())
    return mean, vectors[:, order[:keep]].T


def project(x: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    centred = F.zip_with(x, F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m)
    return F.array(*[dot(centred, F.array(*map(F.lit, axis.tolist()))) for axis in axes])


def exact_match(queries: DataFrame, training: DataFrame, on: str, category: str, order: str) -> DataFrame:
    """queries plus the category first stored for an identical pattern; null where there is none."""
    first = training.groupBy(on).agg(F.min_by(category, order).alias("match"))
    return queries.join(first, on, "left")
