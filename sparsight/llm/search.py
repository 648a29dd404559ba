"""Exact top-k search by integer inner product, with MaxScore pruning inside shards.

Vectors are quantised to integers; a dimension is a term and a shard's columns are its postings. The queries and the rows
to search form a grid of bounded blocks; a cell searches one block of rows for one block of queries and keeps k rows a
query, and the cells' rows are merged. Inside a cell, each term has a score bound from the extremes of its postings. Terms
with the smallest bounds are non-essential as long as their sum cannot lift a row over the k-th score so far. Queries
that weigh terms alike are taken together and share their essential terms. The postings of these alone are traversed; the
other terms are probed, in falling order of bounds, only for rows whose score so far plus what is left can still compete.
All arithmetic is exact: vectors with components too wide for it in floats are scored apart, in whole numbers of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SCALE = 256
ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 1024
#: Rows of a shard that are scored before the first threshold, and at a time from then on.
FIRST_ROWS, STEP_ROWS = 256, 2048
#: Share of the threshold that the bounds of the non-essential terms may sum up to; 1 is the most that is exact.
NON_ESSENTIAL_SHARE = 0.35
#: Queries that share their essential terms.
TOGETHER = 32
#: From this on a component is wide: its vector is scored apart. A score is at most as large as a long holds.
WIDE = 2**24
LONGEST = 2**63 - 1  # also below zero, so that a score has a negative
PAIRS_AT_ONCE = 200_000


def _exact_kind(left: np.ndarray, right: np.ndarray):
    """The narrowest float type in which every partial inner product is an exact integer; None if there is none."""
    reach = max(1, left.shape[1]) * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else None


def _best(q: np.ndarray, score: np.ndarray, row_id: np.ndarray, k: int):
    """The k best of each query: by score down, then by id up."""
    order = np.lexsort((row_id, -score, q))
    q, score, row_id = q[order], score[order], row_id[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    kept = rank < k
    return q[kept], score[kept], row_id[kept]


def maxscore(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, stats: dict | None = None):
    """(query number, score, row id) of the k best rows of each query, a row with the query's own id excepted.

    Vectors hold whole numbers, in any numeric type. Scores beyond a long's range count as its bounds.
    """
    wide_queries, wide_rows = (np.abs(x).max(axis=1, initial=0) >= WIDE for x in (queries, rows))
    q = np.flatnonzero(~wide_queries)
    found = [(np.zeros(0, np.int64),) * 3]
    if len(q) and not wide_rows.all():
        number, score, ids = _pruned(queries[q], query_ids[q], rows[~wide_rows], row_ids[~wide_rows], k, stats)
        found.append((q[number], score, ids))
    for asked, held in ((q, wide_rows), (np.flatnonzero(wide_queries), np.ones(len(rows), bool))):
        for a in range(0, int(held.sum()), STEP_ROWS):
            at = np.flatnonzero(held)[a : a + STEP_ROWS]
            for i in asked:
                score = _whole(queries[i : i + 1], rows[at])[0]
                other = row_ids[at] != query_ids[i]
                found.append(_best(np.full(int(other.sum()), i), score[other], row_ids[at][other], k))
    return _best(*(np.concatenate(x) for x in zip(*found)), k)


def _whole(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products in whole numbers of any size, brought into a long's range."""
    exact = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array([[int(x) for x in r] for r in rows], dtype=object).T if queries.shape[1] else np.zeros((len(queries), len(rows)), object)
    return np.clip(exact, -LONGEST, LONGEST).astype(np.int64)


def _pruned(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, stats: dict | None = None):
    """What maxscore gives, for vectors whose products are exact in floats or, if there are very many terms, in longs."""
    kind = _exact_kind(queries, rows) or np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    m, d = queries.shape
    none = np.zeros(0, np.int64)
    top = (none, none, none)
    heavy = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :2]
    alike = np.lexsort(heavy.T[::-1]) if d else np.arange(m)
    groups = [alike[a : a + TOGETHER] for a in range(0, m, TOGETHER)]
    at = 0
    while at < len(rows):
        end = min(len(rows), at + (STEP_ROWS if at else FIRST_ROWS))
        postings, ids = np.ascontiguousarray(rows[at:end].T), row_ids[at:end]
        at = end
        lowest = np.full(m, -np.inf)
        full = np.bincount(top[0], minlength=m) >= k
        if len(top[0]):
            last = np.flatnonzero(np.append(top[0][1:] != top[0][:-1], True))
            lowest[top[0][last]] = top[1][last]
        threshold = np.where(full, lowest, -np.inf)
        high, low = postings.max(axis=1).astype(np.float64), postings.min(axis=1).astype(np.float64)
        found = []
        for g in groups:
            weights, least = queries[g], threshold[g]
            bound = np.maximum(weights * high, weights * low).astype(np.float64)
            order, n_low = np.arange(d), 0
            if kind is not np.int64 and d and least.min() > 0:
                share = (bound / least[:, None]).max(axis=0)  # a term's largest part of a threshold
                order = np.argsort(share, kind="stable")
                n_low = int((np.cumsum(np.maximum(share[order], 0)) <= NON_ESSENTIAL_SHARE).sum())
            essential = order[n_low:]
            left = bound[:, order[:n_low]].sum(axis=1)
            score = weights[:, essential] @ postings[essential]
            if stats is not None:
                for name, value in (("pairs", score.size), ("traversed", len(essential) * postings.shape[1] * len(g)), ("terms", d * postings.shape[1] * len(g))):
                    stats[name] = stats.get(name, 0) + value
            q, r = np.nonzero(score + left[:, None] >= least[:, None])
            so_far = score[q, r]
            if stats is not None:
                stats["probed"] = stats.get("probed", 0) + len(q)
            # probes: the larger half of the non-essential bounds first, the rest for rows that still compete
            for probed, rest in ((order[n_low // 2 : n_low], order[: n_low // 2]), (order[: n_low // 2], order[:0])):
                if not len(probed):
                    continue
                some, part = weights[:, probed], np.ascontiguousarray(postings[probed].T)
                for a in range(0, len(q), PAIRS_AT_ONCE):
                    b = slice(a, a + PAIRS_AT_ONCE)
                    so_far[b] += np.einsum("ij,ij->i", some[q[b]], part[r[b]])
                alive = so_far + bound[:, rest].sum(axis=1)[q] >= least[q]
                q, r, so_far = q[alive], r[alive], so_far[alive]
            own = ids[r] == query_ids[g][q]
            found.append((g[q[~own]], so_far[~own].astype(np.int64), ids[r[~own]]))
        top = _best(*(np.concatenate(x) for x in zip(top, *found)), k)
    return top


def usable(column: Column) -> Column:
    """Whether a vector takes part: it isn't null and holds no null or non-finite component."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of all components, as doubles, which hold it exactly, or as whole numbers where some are too large; shorter vectors end in zeros."""
    lists = vectors.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    held = np.arange(width)[None, :] < sizes[:, None]
    x = lists.flatten().to_numpy().astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    large = np.flatnonzero(~np.isfinite(scaled))
    if len(large):  # beyond a double's range, where x is whole
        out, scaled = out.astype(object), scaled.astype(object)
        scaled[large] = [int(v) * SCALE for v in x[large]]
    out[held] = scaled
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows, ties to the smaller id; fewer where there are fewer.

    Null vectors, vectors with a null or non-finite component, and rows without an id take no part. Shorter vectors count as padded with zeros. A score
    beyond a long's range counts as the range's end. Rows with a query's own id are not its candidates; a repeated row counts
    as often as it occurs. An empty table gives an empty result. Only the id and the vector are read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    total, asking, width = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.size("v"))).first()
    shards, blocks = max(1, -(-total // ROWS_PER_SHARD)), max(1, -(-asking // QUERIES_PER_BLOCK))
    width = width or 0
    hashed = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").select("id", "v", hashed(blocks, 1).alias("block"), each(shards).alias("shard"))
    candidates = rows.select("id", "v", hashed(shards, 2).alias("shard"), each(blocks).alias("block"))

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            ids = score = row_id = np.zeros(0, np.int64)
        else:
            query_ids = asked.column("id").to_numpy()
            q, score, row_id = maxscore(_matrix(asked.column("v"), width), query_ids, _matrix(held.column("v"), width), held.column("id").to_numpy(), k)
            ids = query_ids[q]
        return pa.table({"query_id": ids.astype(np.int64), "vec_id": row_id.astype(np.int64), "score": score.astype(np.int64)})

    found = queries.groupBy("block", "shard").cogroup(candidates.groupBy("block", "shard")).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_maxscore_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every vector whose id is divisible by 50; see top_k for the edge cases."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
