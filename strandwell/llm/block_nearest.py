"""Exact nearest neighbours by a block matrix join on int8 codes.

Queries and candidates are dealt into blocks by a hash of their ids; every pair of a query block and a candidate block is
a tile. In a tile the int8 codes are multiplied as matrices. With q = q' + e and c = c' + f (codes times scale, plus rest),
|q.c - q'.c'| <= |q'||f| + |e||c|, so each product has a lower and an upper bound. A candidate survives if its upper bound reaches the
k-th largest lower bound of its query; survivors are computed again in double precision, component by component, and heaps
keep the k best, first by tile and then over the tiles of a query.

A tile holds a bounded number of rows, whatever the data: `QUERY_BLOCK` and `BLOCK` on average, as repeated ids are reduced to one row
before they are dealt. Surviving pairs are computed GATHERED components at a time, so ties take no more memory. Queries travel once to each candidate block,
candidates once to each query block; nothing else is repeated, and no pair leaves its tile unless it is among the k best there.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id; rows of
one id count once, the smallest vector standing for them; vectors of different lengths are not compared; fewer than k
candidates give fewer rows; no rows give no rows. Columns beyond the id and the vector are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
BLOCK = 8192
#: Partial results of queries that one merging group holds, on average.
MERGED = 100_000
#: Rows of a tile's matrix that are worked on at once.
ROWS_AT_ONCE = 128
#: Components of surviving pairs that are gathered at once.
GATHERED = 2 << 20
# Products of int8 codes add up exactly in single precision up to this many components.
EXACT_SINGLE = (1 << 24) // (127 * 127)

FOUND = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and the lengths of the coded rows and of what the codes leave out (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(coded, axis=1) * up, np.linalg.norm(x - coded, axis=1) * up + 1e-300


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best_of(pairs: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The k largest scores as (-score, id), ties to the smaller id."""
    return heapq.nsmallest(k, pairs)


def search_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """query_id, vec_id and score of the k nearest of each query in the tile."""
    q_codes, q_scale, q_length, q_rest = quantise(queries)
    c_codes, c_scale, _, c_rest = quantise(vectors)
    c_full = np.linalg.norm(vectors, axis=1) * (1 + 1e-9)
    kind = np.float32 if vectors.shape[1] <= EXACT_SINGLE else np.float64
    right = c_codes.T.astype(kind)
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for at in range(0, len(query_ids), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        near = (q_codes[part].astype(kind) @ right).astype(np.float64) * q_scale[part, None] * c_scale
        gap = q_length[part, None] * c_rest + q_rest[part, None] * c_full
        gap += 1e-12 * np.abs(near)
        low, high = near - gap, near + gap
        own = query_ids[part, None] == ids
        low[own], high[own] = -np.inf, -np.inf
        if low.shape[1] > k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            floor = np.full(len(low), -np.inf)
        row, col = np.nonzero((high >= floor[:, None]) & ~own)
        exact, some = np.empty(len(row)), max(1, GATHERED // vectors.shape[1])
        for k_at in range(0, len(row), some):  # where many rows tie, all pairs survive
            at_once = slice(k_at, k_at + some)
            exact[at_once] = inner(queries[part][row[at_once]], vectors[col[at_once]])
        edges = np.searchsorted(row, np.arange(len(low) + 1))
        for i in range(len(low)):
            these = slice(edges[i], edges[i + 1])
            for score, vec_id in best_of(list(zip((-exact[these]).tolist(), ids[col[these]].tolist(), strict=True)), k):
                out[0].append(int(query_ids[at + i]))
                out[1].append(vec_id)
                out[2].append(-score)
    return out


def _matrix(table: pa.Table, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors, one for each id."""
    ids = table.column(f"{prefix}vec_id").to_numpy()
    flat = table.column(f"{prefix}vector").combine_chunks().flatten().to_numpy()
    x = flat.reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], np.ascontiguousarray(x[first])


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def nearest(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product for each row that `is_query` (over vec_id) holds for."""
    rows = usable(table, vec_id, vector)
    size = rows.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)).alias("q")).first()
    if size["ids"] < size["n"]:
        # Rows of one id would all lie in one block: of each length the least vector stands for them.
        rows = rows.groupBy("vec_id", F.size("vector").alias("d")).agg(F.min("vector").alias("vector")).drop("d")
    n_blocks, n_query_blocks = max(1, -(-size["n"] // block)), max(1, -(-size["q"] // query_block))
    dealt = rows.withColumn("dim", F.size("vector"))
    block_of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = dealt.filter(is_query).withColumn("qb", block_of(n_query_blocks, 1)).withColumn("cb", numbers(n_blocks))
    candidates = dealt.withColumn("cb", block_of(n_blocks, 2)).withColumn("qb", numbers(n_query_blocks))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            found = search_tile(*_matrix(left, ""), *_matrix(right, "c_"), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["dim", "qb", "cb"]
    # Both sides stem from one table; new names give the second one columns of its own.
    others = candidates.select(*[F.col(c).alias(f"c_{c}") for c in (*keys, "vec_id", "vector")])
    partial = queries.groupBy(*keys).cogroup(others.groupBy(*[f"c_{c}" for c in keys])).applyInArrow(tile, FOUND)
    groups = max(1, -(-size["q"] * n_blocks * k // MERGED))

    def merge(group: pa.Table) -> pa.Table:
        by_query: dict[int, list[tuple[float, int]]] = {}
        for query, vec, score in zip(*(group.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
            by_query.setdefault(query, []).append((-score, vec))
        rows = [(q, r, v, -s) for q, pairs in by_query.items() for r, (s, v) in enumerate(best_of(pairs, k), 1)]
        kinds = (("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.table({name: pa.array([x[i] for x in rows], kind) for i, (name, kind) in enumerate(kinds)})

    gathered = partial.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    return gathered.groupBy("group").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
