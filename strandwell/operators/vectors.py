"""A stored index of unit vectors, and exact search in it by block products.

Rows are written in blocks around pivots: each row goes to the pivot (a vector of the table, drawn by a hash of its id) that is nearest by angle,
and of every block the widest angle to its pivot is kept. A search first visits, for each query, the blocks of its nearest pivots until there can be
k rows, and then only the blocks that may hold a row at least as near as the k-th found: no row of a block is nearer than the angle between query
and pivot less the block's own. Blocks are partitions of the files, so those left out are never read.

Within a task, blocks of rows meet all queries in one matrix product. Its k best and whatever lies within rounding of them are computed again in
order of components, so scores and ties are those of a plain sum; a task sends k rows for each query at most.

The number of queries that meet at once is bounded (`MOST_QUERIES`); more are searched one part after the other. Pivots are MOST_BLOCKS at most, so
the driver holds that many vectors; with more rows, blocks grow.

Defined results: vectors that are null, of no length or hold null or non-finite components are not stored; vectors of different lengths are never compared;
equal scores rank by uid, null first; repeated uids are rows of their own; fewer than k rows give fewer; an empty table gives an empty index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwell.operators.dense import finite, norm

BLOCK_ROWS = 8192
MOST_BLOCKS = 4096
MOST_QUERIES = 10_000
#: Cells of one product.
CELLS = 4 << 20
#: More than what products and sums in another order can differ by, for vectors of length 1.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pivots_of(rows: DataFrame, dims: dict[int, int], block_rows: int) -> dict[int, np.ndarray]:
    """For each length, as many vectors as there are to be blocks."""
    found: dict[int, np.ndarray] = {}
    for dim, n in sorted(dims.items()):
        blocks = min(MOST_BLOCKS, max(1, -(-n // block_rows)))
        drawn = rows.filter(F.size("unit") == dim).orderBy(F.xxhash64("uid"), "unit").limit(blocks).select("unit").toArrow()
        found[dim] = _matrix(drawn.column(0).combine_chunks())
    return found


def write(rows: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Stores `rows` (uid, unit, and columns to keep) by block, and of each block the pivot, the number of rows and the least cosine to the pivot."""
    spark = rows.sparkSession
    dims = {r["dim"]: r["n"] for r in rows.groupBy(F.size("unit").alias("dim")).agg(F.count("*").alias("n")).collect()}
    pivots = pivots_of(rows, dims, block_rows)
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))
    schema = T.StructType([*rows.schema.fields, T.StructField("near", T.DoubleType()), T.StructField("block", T.IntegerType())])
    at = rows.columns.index("unit")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                step = max(1, CELLS // len(pivots[dim]))
                for start in range(0, part.num_rows, step):
                    some = part.slice(start, step)
                    near = _matrix(some.column(at)) @ pivots[dim].T
                    best = near.argmax(axis=1)
                    columns = [*some.columns, pa.array(near[np.arange(len(best)), best]), pa.array((best + first[dim]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    # Large blocks are divided by Spark, small ones put together.
    rows.mapInArrow(assign, schema).hint("rebalance", "block").write.partitionBy("block").option("maxRecordsPerFile", 1 << 18).parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    sizes = {r["block"]: r for r in stored.groupBy("block").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()}
    bounds = [(first[dim] + i, dim, sizes[b]["n"], sizes[b]["near"], p.tolist()) for dim, ps in pivots.items() for i, p in enumerate(ps) if (b := first[dim] + i) in sizes]
    spark.createDataFrame(bounds, "block int, dim int, n long, near double, pivot array<double>").coalesce(1).write.parquet(f"{path}/bounds")
    spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/about_rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their block."""
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/about_rows").first()["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


@dataclass(frozen=True)
class Bounds:
    """Blocks of one length: their numbers, sizes, pivots and widest angles."""

    block: np.ndarray
    n: np.ndarray
    pivot: np.ndarray
    angle: np.ndarray

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """The largest cosine that a row of each block can have with each query."""
        to_pivot = np.arccos(np.clip(queries @ self.pivot.T, -1, 1))
        return np.cos(np.maximum(0, to_pivot - self.angle)) + SLACK


def bounds_of(spark: SparkSession, path: str) -> dict[int, Bounds]:
    found = spark.read.parquet(f"{path}/bounds").toArrow().to_pylist()
    out = {}
    for dim in {r["dim"] for r in found}:
        mine = sorted((r for r in found if r["dim"] == dim), key=lambda r: r["block"])
        columns = [np.array([r[c] for r in mine]) for c in ("block", "n", "pivot", "near")]
        out[dim] = Bounds(*columns[:3], np.arccos(np.clip(columns[3] - SLACK, -1, 1)))
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _cut(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query and group."""
    codes = [pc.rank(table.column(c).combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy() for c in ("query", "in_group", "uid")]
    score = table.column("score").to_numpy()
    order = np.lexsort((codes[2], -score, codes[1], codes[0]))
    key = codes[0][order].astype(np.int64) * (len(order) + 1) + codes[1][order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
    return table.take(pa.array(order[place < k]))


def _scan(rows: DataFrame, vectors: dict[int, np.ndarray], places: dict[int, np.ndarray], wanted: dict[int, np.ndarray], k: int, group: str | None, same: tuple[str, list] | None) -> DataFrame:
    """query (place), in_group, uid, score: the k best rows of each query, and group, in each task.

    `vectors` and `places` are the queries of each length; `wanted` says for each block which of them it concerns."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("in_group", kinds[group] if group else T.IntegerType()), T.StructField("uid", kinds["uid"]), T.StructField("score", T.DoubleType())])
    columns = ["uid", "unit", "block", *({group} if group else ()), *({same[0]} if same else ())]
    columns = list(dict.fromkeys(columns))
    # Where a query asks for rows of its own value, values become numbers that both sides know.
    codes = {v: i for i, v in enumerate(dict.fromkeys(same[1]))} if same else {}
    asked = np.array([codes[v] for v in same[1]]) if same else None

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = {c: batch.column(i) for i, c in enumerate(columns)}
            lengths, blocks = table["unit"].value_lengths().to_numpy(zero_copy_only=False), table["block"].to_numpy()
            group_codes = pc.rank(table[group], sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy() if group else np.zeros(len(blocks), dtype=int)
            for dim in np.unique(lengths).tolist():
                if dim not in vectors:
                    continue
                for block in np.unique(blocks[lengths == dim]).tolist():
                    queries = np.flatnonzero(wanted[block])
                    for g in np.unique(group_codes[(lengths == dim) & (blocks == block)]).tolist():
                        mine = np.flatnonzero((lengths == dim) & (blocks == block) & (group_codes == g))
                        step = max(1, CELLS // max(1, len(queries)))
                        for start in range(0, len(mine) if len(queries) else 0, step):
                            some = mine[start : start + step]
                            x = _matrix(table["unit"].take(pa.array(some)))
                            q = vectors[dim][queries]
                            near = x @ q.T
                            if same:
                                value = np.array([codes.get(v, -1) for v in table[same[0]].take(pa.array(some)).to_pylist()])
                                near[value[:, None] != asked[places[dim][queries]]] = -np.inf
                            floor = np.partition(near, len(near) - k, axis=0)[len(near) - k] if len(near) > k else np.full(len(queries), -np.inf)
                            row, col = np.nonzero((near >= floor - SLACK) & (near > -np.inf))
                            for at in range(0, len(row), CELLS // dim + 1):
                                r, c = row[at : at + CELLS // dim + 1], col[at : at + CELLS // dim + 1]
                                score = dots(x[r], q[c])
                                rows_at = pa.array(some[r])
                                in_group = table[group].take(rows_at) if group else pa.nulls(len(r), pa.int32())
                                held.append(_cut(pa.table({"query": pa.array(places[dim][queries[c]]), "in_group": in_group, "uid": table["uid"].take(rows_at), "score": pa.array(score)}), k))
            if sum(t.num_rows for t in held) > 1 << 18:
                held = [_cut(pa.concat_tables(held), k)]
        if held:
            yield from _cut(pa.concat_tables(held), k).to_batches()

    return rows.select(*columns).mapInArrow(best, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, group: str | None = None, same: tuple[str, str] | None = None) -> DataFrame:
    """query_id, rank, uid, score (and the group): the k nearest stored rows of each query (query_id, target of length 1).

    With `group`, a kept column, the k nearest within each of its values; with `same` = (kept column, column of the queries), only rows
    of a query's own value. The filter comes before the cut, so k rows are found where there are k."""
    asked = queries.select("query_id", "target", *({same[1]} if same else ()))
    n = asked.count()
    if n > MOST_QUERIES:
        parts = -(-n // MOST_QUERIES) * 2
        cut = asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        found = None
        for part in range(parts):
            one = search(spark, path, cut.filter(F.col("_part") == part).drop("_part"), k, group, same)
            found = one if found is None else found.unionByName(one)
        return found
    table = asked.toArrow()
    targets = table.column("target").combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
    lengths = targets.value_lengths().to_numpy(zero_copy_only=False)
    places = {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths)}
    vectors = {d: _matrix(targets.take(pa.array(p))) for d, p in places.items()}
    limits = bounds_of(spark, path)
    places, vectors = ({d: x[d] for d in x if d in limits} for x in (places, vectors))
    alike = (same[0], table.column(same[1]).to_pylist()) if same else None
    rows = read(spark, path)

    def scan(wanted: dict[int, np.ndarray]) -> DataFrame:
        here = [b for b, mask in wanted.items() if mask.any()]
        return _scan(rows.filter(F.col("block").isin(here)), vectors, places, wanted, k, group, alike)

    reach = {d: limits[d].reach(vectors[d]) for d in vectors}
    least = {d: np.full(len(p), -np.inf) for d, p in places.items()}
    if not group and any(len(limits[d].block) > 2 for d in vectors):
        # The blocks that reach furthest for a query, until they hold k rows; within them the k-th score is a floor for all others.
        near = {}
        for d in vectors:
            order = np.argsort(-reach[d], axis=1, kind="stable")
            before = np.cumsum(limits[d].n[order], axis=1) - limits[d].n[order]
            mask = np.zeros_like(reach[d], dtype=bool)
            np.put_along_axis(mask, order, before < k, axis=1)
            near |= {int(b): mask[:, i] for i, b in enumerate(limits[d].block)}
        kth = scan(near).groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).filter(F.size("s") >= k)
        score = {r["query"]: r["kth"] for r in kth.select("query", F.get("s", F.lit(k - 1)).alias("kth")).collect()}
        least = {d: np.array([score.get(int(q), -np.inf) for q in p]) for d, p in places.items()}
    wanted = {int(b): reach[d][:, i] >= least[d] - SLACK for d in vectors for i, b in enumerate(limits[d].block)}
    ids = spark.createDataFrame(pa.table({"query": pa.array(np.arange(n)), "query_id": table.column("query_id")}))
    found = scan(wanted).join(F.broadcast(ids), "query").drop("query")
    order = Window.partitionBy("query_id", *(["in_group"] if group else [])).orderBy(F.col("score").desc(), "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", *([F.col("in_group").alias(group)] if group else []), "rank", "uid", "score")


def shard_violations(shards: DataFrame, dim: int, kind: str = "float", within: float = 1e-3) -> DataFrame:
    """shard, code, n of shards of vectors (shard, row, vector) that break their form, by shard.

    EMPTY vectors (null or without entries), SHAPE (another length), NOT_FINITE, NORM (not of length 1 within `within`), ROWS (numbers that aren't 0 to
    n - 1, each once) and TYPE (entries of another type, for the whole table)."""
    v = F.col("vector").cast("array<double>")
    there = F.coalesce(F.size("vector") > 0, F.lit(False))
    good = there & finite(v)
    codes = F.array(
        F.when(~there, "EMPTY"), F.when(there & (F.size("vector") != dim), "SHAPE"), F.when(there & ~finite(v), "NOT_FINITE"), F.when(good & (F.abs(norm(v) - 1) > within), "NORM")
    )
    each = shards.select("shard", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")).groupBy("shard", "code").agg(F.count("*").alias("n"))
    # Numbers are 0 to n - 1 exactly if they are n different ones, the least 0 and the greatest n - 1.
    numbers = shards.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("row").alias("d"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    broken = ~((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))
    odd = numbers.filter(F.coalesce(broken, F.lit(True))).select("shard", F.lit("ROWS").alias("code"), "n")
    found = each.unionByName(odd)
    entry = shards.schema["vector"].dataType.elementType.simpleString()
    return found.unionByName(numbers.select("shard", F.lit("TYPE").alias("code"), "n")) if entry != kind else found
