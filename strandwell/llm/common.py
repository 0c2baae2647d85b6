"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a folder of this machine serves if the executors are this machine too; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandwell-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/strandwell-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts the lineage, and a lost executor costs nothing but a read."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def forget(stored: DataFrame) -> None:
    """Removes a table of `materialise` that nothing will read again: of a loop's rounds only the last takes room."""
    jvm, conf = stored.sparkSession.sparkContext._jvm, stored.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(conf).delete(path, True)


#: Keys with more rows than HEAVY and than one in MOST_HEAVY of all rows are heavy: there are MOST_HEAVY of them at most.
HEAVY, MOST_HEAVY = 100, 10_000


def join_by_count(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows` joined with one row for each key, `keyed`, which has the number of `rows` of its key in `count`.

    Heavy keys (at most MOST_HEAVY, as their counts add up to `total`) are broadcast, so their rows stay where they are; the others are shuffled.
    Both tables are read more than once: give stored ones."""
    heavy = F.col(count) > max(HEAVY, total // MOST_HEAVY)
    if not keyed.filter(heavy).limit(1).count():
        return rows.join(keyed, key)
    hot = F.broadcast(keyed.filter(heavy))
    light = rows.join(hot.select(key), key, "left_anti").join(keyed.filter(~heavy), key)
    return rows.join(hot, key).unionByName(light)


def whole_text(name: str = "text") -> Column:
    """The text column with nulls as empty texts."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose given string or binary column holds about `most_bytes` at most; a longer value stands alone."""
    sizes = batch.column(column)
    start = used = 0
    lengths = pa.compute.binary_length(sizes).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and used + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n or 0
    if start < len(lengths):
        yield batch.slice(start)

#: Resident bytes of a Python worker from which it releases memory after a task.
HELD = 160 << 20


def _released() -> None:
    """Gives freed memory back to the system if the worker holds much: workers wait for their next task beside a full executor."""
    with contextlib.suppress(OSError), open("/proc/self/statm") as file:
        if int(file.read().split()[1]) * mmap.PAGESIZE < HELD:
            return
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What an operator's module keeps in a Python worker between its tasks: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def make_room(module: str) -> None:
    """Drops what other modules keep in this worker: a worker goes from one operator's tasks to the next one's."""
    others = [m for m in KEPT if m != module]
    for other in others:
        KEPT.pop(other)()
    if others:
        _released()


def tidied(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most_bytes: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, fed with parts of batches of about `most_bytes`, and memory released at its end.

    What other operators keep in the worker goes first."""
    module = function.__module__

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(module)
        try:
            yield from function(parts(batches))
        finally:
            _released()

    return run
