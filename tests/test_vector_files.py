"""Matrices and archives read in parts."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwell.functions.text import snippet, tokens
from strandwell.sources.vectors import ZipReader, register


def test_matrices_are_read_in_ranges(spark, tmp_path):
    register(spark)
    x, y = np.arange(700, dtype=np.float32).reshape(100, 7), np.arange(30, dtype=np.int16).reshape(10, 3)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", y)
    np.save(tmp_path / "c.npy", np.zeros((0, 3)))
    (tmp_path / "other.txt").write_text("no matrix")
    found = spark.read.format("npy").option("partbytes", 280).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 11
    got = {(r["file"].rsplit("/", 1)[1], r["row"]): r["vector"] for r in found.collect()}
    assert got == {("a.npy", i): x[i].tolist() for i in range(100)} | {("b.npy", i): y[i].tolist() for i in range(10)}
    np.save(tmp_path / "d.npy", np.zeros(3))
    with pytest.raises(Exception, match="no matrix by rows"):
        spark.read.format("npy").load(str(tmp_path / "d.npy")).collect()


def test_archives_are_read_by_member(spark, tmp_path):
    register(spark)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        for i in range(20):
            archive.writestr(f"{'ab'[i % 2]}/{i}.json", str(i) * 100)
    found = spark.read.format("zipped").option("partbytes", 500).load(str(tmp_path))
    assert {r["member"]: bytes(r["content"]) for r in found.collect()} == {f"{'ab'[i % 2]}/{i}.json": (str(i) * 100).encode() for i in range(20)}
    assert [r["member"] for r in spark.read.format("zipped").load(str(tmp_path)).filter("member = 'a/4.json'").collect()] == ["a/4.json"]
    reader = ZipReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import StringStartsWith

    assert list(reader.pushFilters([StringStartsWith(("member",), "b/")])) == []
    assert sorted(n for p in reader.partitions() for n in p.names) == sorted(f"b/{i}.json" for i in range(1, 20, 2))


def test_snippets_hold_most_terms(spark):
    rows = [("a x b c d e f a b", 3), ("q q q a q q q q", 3), ("a", 3), ("none here", 3), (None, 3), ("b " * 30 + "a b", 4)]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string, n int").select(snippet(tokens(F.col("t")), ["a", "b"], 3).alias("s")).collect()]
    assert got == ["[a] x [b] …", "… q [a] q …", "[a]", None, None, "… [b] [b] [a] …"]
