"""Readers and writers for manifests, frame maps, archives and vectors. All go through Spark's readers, so any store works.

Defined results: blank lines of manifests are no rows; a line that breaks its format fails the query, a torn end only where it isn't asked for; empty files give no rows.
"""

from __future__ import annotations

import ast
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FRAME_MAP = "n int, pts_time double, fps double, frame_idx int"


def _fail_if(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The rows; the query fails at a row for which `bad` holds."""
    return rows.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def read_manifest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines with a schema; a line that doesn't parse or a repeated key fails the query."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    twice = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return _fail_if(twice, F.col("_n") > 1, F.concat(F.lit("repeated "), F.col(key).cast("string"))).drop("_n")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files. A file's lines are numbered in one task, as files are what is numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "value"))
    return parts.select("file", (F.col("line") + 1).alias("line"), "value")


def read_json_prefix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line and the columns of JSON lines up to the first line of each file that doesn't parse: what a torn write left valid."""
    parsed = StructType.fromDDL(schema).add("_bad", "string")
    rows = read_lines(spark, path).withColumn("j", F.from_json("value", parsed, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | (F.trim("value") == "")
    first = F.min(F.when(bad, F.col("line"))).over(Window.partitionBy("file"))
    kept = rows.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("line") < F.col("_first")))
    return kept.select("file", "line", "j.*").drop("_bad")


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines with columns in order of their names."""
    rows.select(*sorted(rows.columns)).write.json(path)


def read_frame_map(spark: SparkSession, path: str) -> DataFrame:
    """video (the file's stem), n, pts_time, fps, frame_idx of CSV files with a header."""
    rows = spark.read.schema(FRAME_MAP).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.select(stem(F.col("_metadata.file_path")).alias("video"), "*")


def stem(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_json_archive(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, value: the JSON members of zip archives; other members are left out."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in sorted(archive.namelist()) if n.endswith(".json")]
                    yield pd.DataFrame({"archive": name, "member": names, "value": [archive.read(n).decode("utf-8") for n in names]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, value string")


def detections(members: DataFrame) -> DataFrame:
    """video, n, ordinal, class_name, class_entity, confidence, box of detection files with parallel arrays; the member's path is video/n.json."""
    parallel = "detection_class_names array<string>, detection_class_entities array<string>, detection_scores array<string>, detection_boxes array<array<string>>"
    rows = members.select(F.regexp_extract("member", r"([^/]+)/(\d+)\.json$", 1).alias("video"), F.regexp_extract("member", r"(\d+)\.json$", 1).cast("int").alias("n"), F.from_json("value", parallel).alias("j"))
    zipped = F.arrays_zip("j.detection_class_names", "j.detection_class_entities", "j.detection_scores", "j.detection_boxes")
    out = rows.select("video", "n", F.posexplode(zipped).alias("ordinal", "d"))
    value = lambda k: F.col("d").getField(k)
    return out.select(
        "video", "n", (F.col("ordinal") + 1).alias("ordinal"), value("detection_class_names").alias("class_name"), value("detection_class_entities").alias("class_entity"),
        value("detection_scores").cast("double").alias("confidence"), F.transform(value("detection_boxes"), lambda x: x.cast("double")).alias("box"),
    )


def _npy(content: bytes) -> tuple[tuple[int, ...], str, bytes]:
    """Shape, type and data of a .npy file in C order."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = content[6] > 1
    size = struct.unpack("<I" if wide else "<H", content[8 : 12 if wide else 10])[0]
    start = (12 if wide else 10) + size
    head = ast.literal_eval(content[start - size : start].decode("latin-1").strip())
    if head["fortran_order"]:
        raise ValueError("columns first")
    return head["shape"], head["descr"], content[start:]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """video (the file's stem), n (row + 1), vector of .npy matrices."""
    import numpy as np

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["video"], frame["content"], strict=True):
                shape, kind, data = _npy(content)
                matrix = np.frombuffer(data, dtype=kind).reshape(shape).astype(np.float32)
                yield pd.DataFrame({"video": name, "n": np.arange(1, len(matrix) + 1, dtype=np.int32), "vector": list(matrix)})

    files = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("video"), "content")
    return files.mapInPandas(rows, "video string, n int, vector array<float>")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_review(rows: DataFrame, path: str) -> None:
    """A review sheet as CSV with a header."""
    rows.write.option("header", True).csv(path)


def numbered_queries(text: str, count: int) -> list[str]:
    """The queries of a combined text with headers like `Query 3:`; there must be exactly `count`, numbered from 1."""
    parts = re.split(r"(?im)^\s*query\s+(\d+)\s*[:.]?\s*$", text)
    found = {int(n): body.strip() for n, body in zip(parts[1::2], parts[2::2], strict=True)}
    if parts[0].strip() or len(parts) // 2 != count or sorted(found) != list(range(1, count + 1)) or not all(found.values()):
        raise ValueError(f"the text must hold the queries 1 to {count}, each once")
    return [found[k] for k in range(1, count + 1)]


def merged_settings(base: dict, override: dict) -> dict:
    """`base` with the values of `override`, level by level."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged_settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def read_settings(spark: SparkSession, path: str) -> dict:
    """One JSON object in a small file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
