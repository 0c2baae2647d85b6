"""`.npy` matrices and members of zip archives as tables, read by Spark in parts (Python data sources).

After `register(spark)`, `spark.read.format("npy").load(path)` gives the rows of a matrix (file, row, vector); the reader reads the header once and plans ranges
of rows of about `PART_BYTES`, so a matrix of many gigabytes is read by many tasks and never as a whole. `format("zipped")` gives the members of archives
(file, member, content), one task for some members each; a filter on `member` reaches the reader, so other members are not unpacked.

Paths are those of pyarrow's file systems: local ones, s3://, gs://, hdfs://; a folder stands for its files of that kind. What the executors open they must see too.

Defined results: an empty matrix gives no rows; a matrix of other than two dimensions, of objects or stored by columns fails the query with its name; an archive
without members gives no rows.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

PART_BYTES = 32 << 20
BATCH_BYTES = 4 << 20


def _files(path: str, pattern: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The file system of a path and its files, in order of their names."""
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return system, sorted((f for f in found if f.type == pafs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, pattern))), key=lambda f: f.path)


def npy_header(stream: io.IOBase) -> tuple[tuple[int, int], np.dtype, int]:
    """Shape, type of entries and place of the first entry of a matrix."""
    version = np.lib.format.read_magic(stream)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) != 2 or by_column or kind.hasobject:
        raise ValueError(f"no matrix by rows: {shape}, {kind}")
    return shape, kind, stream.tell()


@dataclass
class Range(InputPartition):
    path: str
    file: str
    start: int
    stop: int
    width: int
    kind: str
    offset: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Range]:
        system, files = _files(self.path, "*.npy")
        out = []
        for info in files:
            with system.open_input_file(info.path) as stream:
                try:
                    (rows, width), kind, offset = npy_header(stream)
                except ValueError as error:
                    raise ValueError(f"{info.path}: {error}") from error
            step = max(1, self.part_bytes // max(1, width * kind.itemsize))
            out += [Range(self.path, info.path, at, min(rows, at + step), width, kind.str, offset) for at in range(0, rows, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, kind = _files(self.path, "*.npy")[0], np.dtype(part.kind)
        row_bytes = part.width * kind.itemsize
        step = max(1, BATCH_BYTES // max(1, row_bytes))
        with system.open_input_file(part.file) as stream:
            stream.seek(part.offset + part.start * row_bytes)
            for at in range(part.start, part.stop, step):
                n = min(step, part.stop - at)
                x = np.frombuffer(stream.read(n * row_bytes), dtype=kind).astype(np.float64)
                if len(x) != n * part.width:
                    raise ValueError(f"{part.file} is shorter than its header says")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(np.arange(at, at + n)), lists], ["file", "row", "vector"])


class NpySource(DataSource):
    """Rows of `.npy` matrices; option `partbytes` is the size of a part."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row long, vector array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options)


@dataclass
class Members(InputPartition):
    file: str
    names: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part_bytes, self.tests = options["path"], int(options.get("partbytes", PART_BYTES)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("member",):
                self.tests.append(lambda name, v=f.value: name == v)
            elif isinstance(f, In) and f.attribute == ("member",):
                self.tests.append(lambda name, v=frozenset(f.value): name in v)
            elif isinstance(f, StringStartsWith) and f.attribute == ("member",):
                self.tests.append(lambda name, v=f.value: name.startswith(v))
            else:
                yield f

    def partitions(self) -> list[Members]:
        system, files = _files(self.path, "*.zip")
        out = []
        for info in files:
            with system.open_input_file(info.path) as stream, zipfile.ZipFile(stream) as archive:
                names, used = [], 0
                for member in archive.infolist():
                    if member.is_dir() or not all(t(member.filename) for t in self.tests):
                        continue
                    if names and used + member.file_size > self.part_bytes:
                        out.append(Members(info.path, names))
                        names, used = [], 0
                    names.append(member.filename)
                    used += member.file_size
                if names:
                    out.append(Members(info.path, names))
        return out

    def read(self, part: Members) -> Iterator[tuple]:
        system = _files(self.path, "*.zip")[0]
        with system.open_input_file(part.file) as stream, zipfile.ZipFile(stream) as archive:
            for name in part.names:
                yield part.file, name, archive.read(name)


class ZipSource(DataSource):
    """Members of zip archives; option `partbytes` is the unpacked size that a task gets."""

    @classmethod
    def name(cls) -> str:
        return "zipped"

    def schema(self) -> str:
        return "file string, member string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach their readers (the reader of archives needs the setting)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ZipSource)
