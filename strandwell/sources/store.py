"""Stored indexes: tables derived once, found again by what they were made of.

An index lies in a folder of its own below spark.checkpoint.dir (or `spark.strandwell.index.dir`), named by the index, its form, its parameters and the
files it was made from: their paths, lengths and times of modification. A session that asks for it reads what is there, whoever built it; where a
source or a parameter changed, the name differs and the index is built anew.

A build writes to a folder of its own, then the manifest: of every table the files, rows and a digest of the rows. Only then it is published by one
rename, so that a reader sees a whole index or none. A build that fails removes what it wrote; of two that finish at once the first stays.

Defined results: a source without files is an index of no files; a damaged, missing or unknown part is a row of `violations`; an index whose
manifest is whole has none.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Raised whenever what builders write changes its form: indexes of another form are not read.
FORMAT = 6


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of this machine if the executors are this machine too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandwell-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def index_root(spark: SparkSession) -> str:
    """Where indexes lie: the same folder for every session that shares the setting."""
    return spark.conf.get("spark.strandwell.index.dir", None) or f"{shared_dir(spark)}/strandwell-indexes"


class Files:
    """The few calls on a file system that Spark has no DataFrame for."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._system = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._system.exists(self.path(name))

    def folders(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._system.listStatus(self.path(name)) if f.isDirectory())

    def size(self, name: str) -> int:
        return self._system.getContentSummary(self.path(name)).getLength()

    def remove(self, name: str) -> None:
        self._system.delete(self.path(name), True)

    def publish(self, old: str, new: str) -> bool:
        """Moves a folder to a name that must not exist yet."""
        self._system.mkdirs(self.path(new).getParent())
        return not self.exists(new) and self._system.rename(self.path(old), self.path(new))


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, modified of the files of tables; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


@dataclass(frozen=True)
class Source:
    """What an index is made of: tables by path, and the state of their files."""

    paths: tuple[str, ...]
    files: int
    size: int
    state: str

    @classmethod
    def of(cls, spark: SparkSession, *paths: str) -> Source:
        each = F.xxhash64("path", "length", "modified").cast("decimal(38,0)")
        row = listed(spark, list(paths)).agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(each).alias("state")).first()
        return cls(paths, row["n"], row["size"] or 0, str(row["state"]))

    def version(self, parameters: dict) -> str:
        said = json.dumps([FORMAT, self.files, self.size, self.state, parameters], sort_keys=True)
        return hashlib.sha256(said.encode()).hexdigest()[:32]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """part (table/folders/file), rows, digest of the tables below a path; the manifest itself is left out, files that can't be read count as none.

    Of a table that packs several rows into one, which has a column `entries` with their number, these are the rows."""
    files, found = Files(spark, path), None
    for name in files.folders(path):
        if name in ("manifest", "about") or not files.size(f"{path}/{name}"):
            continue
        table = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{path}/{name}")
        n = F.col("entries").cast("long") if "entries" in table.columns else F.lit(1).cast("long")
        rows = table.select(F.col("_metadata.file_path").alias("part"), n.alias("n"), F.xxhash64(*table.columns).alias("h"))
        # Both halves of the hashes are summed by themselves, as whole numbers that stay below 64 bits.
        each = rows.groupBy("part").agg(F.sum("n").alias("rows"), F.sum(F.shiftright("h", 32)).alias("high"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"))
        exact = lambda c: F.col(c).cast("decimal(25,0)")
        each = each.select("part", "rows", (exact("high") * F.lit(1 << 32).cast("decimal(10,0)") + exact("low")).cast("decimal(38,0)").alias("digest"))
        # A task gives its files in several folders one name, so the folder is part of it; cut out once for each file.
        each = each.withColumn("part", F.concat(F.lit(f"{name}/"), F.regexp_extract("part", f".*/{name}/(.*)$", 1)))
        found = each if found is None else found.unionByName(each)
    return found if found is not None else spark.createDataFrame([], "part string, rows long, digest decimal(38,0)")


def stored(spark: SparkSession, name: str, sources: list[str], parameters: dict, build: Callable[[str, Source], None]) -> str:
    """The path of the index of that name over the sources as they are now; `build(path, source)` writes its tables where there is none yet."""
    source = Source.of(spark, *sources)
    home = f"{index_root(spark)}/{name}-{hashlib.sha256(json.dumps(sorted(sources)).encode()).hexdigest()[:12]}"
    path, files = f"{home}/{source.version(parameters)}", Files(spark, home)
    if files.exists(f"{path}/manifest"):
        return path
    began = f"{home}/.began-{uuid.uuid4().hex}"
    try:
        build(began, source)
        about = {"name": name, "parameters": json.dumps(parameters, sort_keys=True), "sources": json.dumps(source.paths), "version": source.version(parameters)}
        spark.createDataFrame([tuple(about.values())], ", ".join(f"{k} string" for k in about)).write.json(f"{began}/about")
        digests(spark, began).coalesce(1).write.parquet(f"{began}/manifest")
        if not files.publish(began, path) and not files.exists(f"{path}/manifest"):
            raise OSError(f"{path} can't be published")
    finally:
        if files.exists(began):
            files.remove(began)
    return path


def violations(spark: SparkSession, path: str) -> DataFrame:
    """part, code of an index that isn't what its manifest says: MISSING, UNKNOWN, ROWS, DIGEST parts, and STALE where the sources changed since."""
    told = spark.read.parquet(f"{path}/manifest")
    now = digests(spark, path).select("part", F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now"))
    code = (
        F.when(F.col("rows_now").isNull(), "MISSING").when(F.col("rows").isNull(), "UNKNOWN")
        .when(F.col("rows") != F.col("rows_now"), "ROWS").when(F.col("digest") != F.col("digest_now"), "DIGEST")
    )
    about = spark.read.json(f"{path}/about").first()
    version = Source.of(spark, *json.loads(about["sources"])).version(json.loads(about["parameters"]))
    stale = spark.createDataFrame([("sources", "STALE")] if version != about["version"] else [], "part string, code string")
    return told.join(now, "part", "full").select("part", code.alias("code")).filter("code is not null").unionByName(stale)


def expire(spark: SparkSession, path: str) -> list[str]:
    """Removes the other versions of an index, and unfinished builds of it; the paths that went. For when no session reads or builds them."""
    home, _, kept = path.rpartition("/")
    files = Files(spark, home)
    gone = [f"{home}/{v}" for v in files.folders(home) if v != kept]
    for old in gone:
        files.remove(old)
    return gone
