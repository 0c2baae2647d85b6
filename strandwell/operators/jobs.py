"""Batch jobs as tables: shards, resumption, merging, and upserts.

Defined results: rows with a null key are numbered first and are never done, so they stay pending; a repeated item is expected once and handled as often as it stands there;
of equal versions the new row stays; no rows give no rows, and a check of no items is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dense_index(table: DataFrame, key: str, parts: int = 64, name: str = "idx") -> DataFrame:
    """The rows numbered from 0 in order of `key` (numbers, distinct), without one task that sorts all.

    Quantiles cut the keys into `parts` ranges; ranges are counted, and rows are numbered within their range from its start on. Rows without a
    key come first, in order of a hash of their columns, which also deals them to ranges of their own."""
    cuts = sorted(set(table.approxQuantile(key, [k / parts for k in range(1, parts)], 0.001))) if parts > 1 else []
    part = sum(((F.col(key) > c).cast("int") for c in cuts), F.lit(0)) if len(cuts) < 16 else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(key) > c))
    none = F.xxhash64(*[c for c, kind in table.dtypes if not kind.startswith("map")])
    ranged = table.withColumn("_h", none).withColumn("_part", F.when(F.col(key).isNull(), -1 - F.pmod("_h", F.lit(parts))).otherwise(part))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row for each range.
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key, "_h")) - 1
    return ranged.withColumn("_row", within).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_start", "_h")


def fixed_shards(indexed: DataFrame, size: int) -> DataFrame:
    """With shard and place: `size` rows to a shard."""
    return indexed.withColumn("shard", F.floor(F.col("idx") / size).cast("int")).withColumn("place", (F.col("idx") % size).cast("int"))


def balanced_shards(indexed: DataFrame, total: int, shards: int) -> DataFrame:
    """With shard: `shards` parts whose sizes differ by one at most, the larger ones first."""
    base, more = divmod(total, shards)
    cut = more * (base + 1)
    late = F.lit(more) + F.floor((F.col("idx") - cut) / max(1, base))
    return indexed.withColumn("shard", F.when(F.col("idx") < cut, F.floor(F.col("idx") / (base + 1))).otherwise(late).cast("int"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no run has finished."""
    return items.join(done.select(key), key, "left_anti")


def shard_status(items: DataFrame, done: DataFrame, key: str, shard: str) -> DataFrame:
    """shard, expected, finished, status: PENDING, PARTIAL or DONE."""
    marked = items.join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left")
    found = marked.groupBy(shard).agg(F.count("*").alias("expected"), F.count("_d").alias("finished"))
    return found.withColumn("status", F.when(F.col("finished") == 0, "PENDING").when(F.col("finished") < F.col("expected"), "PARTIAL").otherwise("DONE"))


def terminal_check(items: DataFrame, ok: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """One row: expected, ok, failed, and whether these are disjoint and together all items."""
    state = items.select(key, F.lit(1).alias("e"), F.lit(0).alias("o"), F.lit(0).alias("f"))
    state = state.unionByName(ok.select(key, F.lit(0).alias("e"), F.lit(1).alias("o"), F.lit(0).alias("f")))
    state = state.unionByName(failed.select(key, F.lit(0).alias("e"), F.lit(0).alias("o"), F.lit(1).alias("f")))
    by_key = state.groupBy(key).agg(F.max("e").alias("e"), F.max("o").alias("o"), F.max("f").alias("f"))
    sums = by_key.agg(F.sum("e").alias("expected"), F.sum("o").alias("ok"), F.sum("f").alias("failed"), F.coalesce(F.min(F.col("o") + F.col("f") == F.col("e")), F.lit(True)).alias("complete"))
    return sums


def finished(spark: SparkSession, path: str, runs: list[int]) -> DataFrame | None:
    """item_id, state, value, error of all whole runs below `path`; None before the first."""
    return spark.read.parquet(*[f"{path}/run={k}" for k in runs]) if runs else None


def run_items(items: DataFrame, handler: Callable[[str], str], path: str, runs: list[int], retries: int = 2) -> int:
    """Handles the items (item_id, payload) that no earlier run has, and writes them as the next run, whose number is returned.

    An item that fails after its retries becomes a row with its error, so every item ends in one row. A run is whole or absent: what a lost
    run left behind is written again."""

    def handle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, payload in zip(frame["item_id"], frame["payload"], strict=True):
                value, error = None, None
                for _ in range(retries + 1):
                    try:
                        value, error = handler(payload), None
                        break
                    except Exception as failure:  # kept as the item's result
                        error = f"{type(failure).__name__}: {failure}"
                rows.append((item, "OK" if error is None else "ERROR", value, error))
            yield pd.DataFrame(rows, columns=["item_id", "state", "value", "error"])

    spark, number = items.sparkSession, max(runs, default=-1) + 1
    done = finished(spark, path, runs)
    left = items if done is None else pending(items, done, "item_id")
    left.select("item_id", "payload").mapInPandas(handle, "item_id string, state string, value string, error string").write.mode("overwrite").parquet(f"{path}/run={number}")
    return number


def repair(segments: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Segments of items that a run has finished; the others are left over from one that was cut off."""
    return segments.join(done.select(key).distinct(), key, "left_semi")


def repair_violations(items: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """key, code, n of what a run that is taken up must not hold: items that are done and failed (BOTH), items of another shard (OUTSIDE), records without a key (NO_KEY), and
    items that are done twice (REPEATED)."""
    marks = done.select(key, F.lit(1).alias("d"), F.lit(0).alias("f")).unionByName(failed.select(key, F.lit(0).alias("d"), F.lit(1).alias("f")))
    by_key = marks.groupBy(key).agg(F.sum("d").alias("d"), F.sum("f").alias("f"))
    mine = items.select(F.col(key).alias("_k")).distinct()
    met = by_key.join(mine, F.col(key) == F.col("_k"), "left")
    there = F.col(key).isNotNull()
    codes = F.array(
        F.when(~there, F.struct(F.lit("NO_KEY").alias("code"), (F.col("d") + F.col("f")).alias("n"))), F.when(there & (F.col("d") > 0) & (F.col("f") > 0), F.struct(F.lit("BOTH").alias("code"), (F.col("d") + F.col("f")).alias("n"))),
        F.when(there & F.col("_k").isNull(), F.struct(F.lit("OUTSIDE").alias("code"), (F.col("d") + F.col("f")).alias("n"))), F.when(there & (F.col("d") > 1), F.struct(F.lit("REPEATED").alias("code"), F.col("d").alias("n"))),
    )
    return met.select(key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("c")).select(key, "c.code", "c.n")


def merge(parts: list[DataFrame], key: str, contracts: list[tuple[str, str]] | None = None) -> DataFrame:
    """All rows of the parts; a key that comes twice fails the query.

    `contracts` are the hashes of each part's configuration and manifest: parts of several contracts are an error before anything is read."""
    if contracts is not None and (len(contracts) != len(parts) or len(set(contracts)) != 1):
        raise ValueError("parts of one configuration and one manifest can be merged")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    checked = every.withColumn("_twice", twice)
    return checked.filter(F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("repeated "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_twice")


def upsert(old: DataFrame, new: DataFrame, key: str, version: Column) -> DataFrame:
    """Old rows, replaced or joined by new ones; of several rows of a key the greatest version stays, a new one among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(version.desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(old.columns))


def pilot(hits: DataFrame, narrow: int = 10, wide: int = 20, enough: int = 100, most: int = 250) -> DataFrame:
    """video, best, queries: candidate videos with a rank of `narrow` or better, or `wide` if those are fewer than `enough`, the best `most` of them."""
    best = hits.groupBy("video").agg(F.min("rank").alias("best"), F.concat_ws(",", F.sort_array(F.collect_set(F.concat_ws("=", "query_id", "rank")))).alias("queries"))
    close = best.agg(F.count_if(F.col("best") <= narrow).alias("close"))
    limit = F.when(F.col("close") < enough, wide).otherwise(narrow)
    kept = best.crossJoin(F.broadcast(close)).filter(F.col("best") <= limit).drop("close")  # the right side is one row
    return kept.orderBy("best", "video").limit(most)


def stratified(table: DataFrame, group: str, key: str, shares: list[tuple[str, int]], seed: int) -> DataFrame:
    """group, key, split: rows of each group in the order of a seeded hash, the first so many to the first split and so on."""
    order = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))))
    split, at = F.lit(None).cast("string"), 0
    for name, n in shares:
        split = F.when(F.col("_r").between(at + 1, at + n), name).otherwise(split)
        at += n
    return table.withColumn("_r", order).filter(F.col("_r") <= at).select(group, key, split.alias("split"))
