"""An upserted table that merges when it is read: a base and a log of changes, both by buckets of the key.

A batch of changes writes one folder of the log, with the buckets of its keys only; the base is not touched. A reader puts base and log together
and keeps the greatest version of each key. Compaction rewrites the buckets that have changes, and a new state that names, for each bucket, the folder of its
base; buckets without changes keep theirs. States are numbered and published by one rename, so a reader sees one of them or another.

Within a batch and in the merge, rows of a key meet by an aggregation that combines before it shuffles, so a key of very many changes sends one row from each task.

Defined results: of several rows of a key the greatest version stays, the later batch among equals, and then the greater row; null keys are one key; a batch that is
written again replaces itself; no changes give an empty table.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandwell.sources.store import Files

BUCKETS = 64


class UpsertedTable:
    """A table in a folder: rows of `schema`, one for each value of `key`, of the greatest `version`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, version: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.version, self.buckets = spark, path, schema, key, version, buckets
        self.files = Files(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key of rows with their batch."""
        best = F.max(F.struct(F.col(self.version).alias("_v"), F.col("batch").alias("_b"), F.struct(*self.schema.names).alias("row")))
        return rows.groupBy("bucket", self.key).agg(best.alias("_best")).select("bucket", F.col("_best._b").alias("batch"), "_best.row.*")

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        where = f"{self.path}/{folder}"
        return sorted(int(n.removeprefix(prefix)) for n in self.files.folders(where) if n.startswith(prefix)) if self.files.exists(where) else []

    def state(self) -> dict:
        """`upto`, the last batch that the base holds, and `base`, the folder of each bucket."""
        numbers = self._numbers("state", "n=")
        if not numbers:
            return {"upto": -1, "base": {}}
        return json.loads(self.spark.read.parquet(f"{self.path}/state/n={numbers[-1]}").first()["state"])

    def batches(self) -> list[int]:
        """The batches that the base doesn't hold yet."""
        upto = self.state()["upto"]
        return [b for b in self._numbers("log", "batch=") if b > upto]

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """Adds the changes as one batch; batches that the base holds are done."""
        if batch <= self.state()["upto"]:
            return
        began = f"{self.path}/.began-{uuid.uuid4().hex}"
        try:
            kept = self._newest(self._bucketed(rows.select(*self.schema.names)).withColumn("batch", F.lit(batch).cast("long")))
            kept.repartition("bucket").write.partitionBy("bucket").parquet(began)
            self.files.remove(f"{self.path}/log/batch={batch}")
            if not self.files.publish(began, f"{self.path}/log/batch={batch}"):
                raise OSError(f"batch {batch} can't be published")
        finally:
            if self.files.exists(began):
                self.files.remove(began)

    def _read(self, folders: list[str]) -> DataFrame:
        """Rows of folders of buckets, with bucket and batch."""
        stored = T.StructType([T.StructField("batch", T.LongType()), *self.schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [self.spark.read.schema(stored).option("basePath", f.partition("/bucket=")[0]).parquet(f) for f in folders]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], stored)

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """The base and the changes behind it. Base buckets of one compaction are read together."""
        state = self.state()
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in state["base"].items():
            by_folder.setdefault(folder, []).append(int(bucket))
        base = [self._read([f"{self.path}/base/{folder}"]).filter(F.col("bucket").isin(sorted(mine))) for folder, mine in sorted(by_folder.items())]
        log = self._read([f"{self.path}/log/batch={b}" for b in self.batches()])
        return (reduce(DataFrame.unionByName, base) if base else log.limit(0)), log

    def read(self) -> DataFrame:
        """The table as it is now."""
        base, log = self._parts()
        return self._newest(base.unionByName(log)).select(*self.schema.names)

    def compact(self) -> list[int]:
        """Takes the log into the base; the buckets that were rewritten."""
        upto = max(self.batches(), default=None)
        if upto is None:
            return []
        state, (base, log) = self.state(), self._parts()
        changed = sorted(r["bucket"] for r in log.select("bucket").distinct().collect())
        folder = f"upto={upto}-{uuid.uuid4().hex[:8]}"
        merged = self._newest(base.filter(F.col("bucket").isin(changed)).unionByName(log))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/base/{folder}")
        new = {"upto": upto, "base": state["base"] | {str(b): folder for b in changed}}
        began = f"{self.path}/.began-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(new),)], "state string").coalesce(1).write.parquet(began)
        number = max(self._numbers("state", "n="), default=-1) + 1
        if not self.files.publish(began, f"{self.path}/state/n={number}"):
            self.files.remove(began)
            self.files.remove(f"{self.path}/base/{folder}")
            raise OSError("another compaction was first")
        return changed

    def expire(self) -> list[str]:
        """Removes logs and bases that the newest state doesn't need; for when no older state is read any more."""
        state = self.state()
        gone = [f"log/batch={b}" for b in self._numbers("log", "batch=") if b <= state["upto"]]
        if self.files.exists(f"{self.path}/base"):
            gone += [f"base/{f}" for f in self.files.folders(f"{self.path}/base") if f not in set(state["base"].values())]
        for name in gone:
            self.files.remove(f"{self.path}/{name}")
        return gone


def keep_upserted(stream: DataFrame, table: UpsertedTable, checkpoint: str, compact_after: int = 20) -> StreamingQuery:
    """Runs the stream's available input into the table, a batch of the log for each micro-batch; every so many batches the log is taken into the base.

    A batch that is run again after a failure replaces itself, so each input row counts once."""

    def apply(batch: DataFrame, number: int) -> None:
        table.write_batch(batch, number)
        if len(table.batches()) >= compact_after:
            table.compact()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
