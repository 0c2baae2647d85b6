"""The stored index of unit vectors: same answers as a scan, blocks left out, shards checked."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwell.operators import dense as D
from strandwell.operators import vectors as V

SCHEMA = "id long, v array<double>, label string, kind string"


def clustered(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(dim)).tolist(), "abc"[i % 3], "xy"[i % 2]) for i in range(n)]
    # A third of the rows is one vector, an id stands twice, and some vectors can't be compared.
    return rows + [(n + i, rows[0][1], None, "x") for i in range(n // 2)] + [(3, rows[5][1], "a", "x"), (None, rows[1][1], "b", "y"), (90_001, None, "a", "x"), (90_002, [0.0] * dim, "a", "x"), (90_003, [1.0, 2.0, 3.0], "a", "x")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = D.normalised(spark.createDataFrame(clustered(600), SCHEMA), "id", "v", "label", "kind").cache()
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    V.write(rows, path, 64)
    queries = rows.filter("uid % 97 = 0 or uid = 90003").select(F.col("uid").alias("query_id"), F.col("unit").alias("target"), F.col("label").alias("mine"))
    return rows, path, queries


def table(frame, *columns):
    return sorted(([str(x) for x in r] for r in frame.select(*columns).collect()))


def test_search_equals_a_scan(spark, built):
    rows, path, queries = built
    want = D.top(D.scored(rows, queries), 12)
    got = V.search(spark, path, queries, 12)
    assert table(got, "query_id", "rank", "uid", "score") == table(want, "query_id", "rank", "uid", "score") and got.count() > 60


def test_filter_before_the_cut_and_groups(spark, built):
    rows, path, queries = built
    found = D.scored(rows, queries)
    want = D.top(found.filter("label <=> mine"), 9)
    assert table(V.search(spark, path, queries, 9, same=("label", "mine")), "query_id", "rank", "uid", "score") == table(want, "query_id", "rank", "uid", "score")
    want = D.top(found.withColumn("query_id", F.struct("query_id", "label")), 4).select("query_id.*", "rank", "uid")
    assert table(V.search(spark, path, queries, 4, group="label"), "query_id", "label", "rank", "uid") == table(want, "query_id", "label", "rank", "uid")


def test_many_queries_are_searched_in_parts(spark, built, monkeypatch):
    rows, path, queries = built
    want = table(V.search(spark, path, queries, 5), "query_id", "rank", "uid", "score")
    monkeypatch.setattr(V, "MOST_QUERIES", 3)
    assert table(V.search(spark, path, queries, 5), "query_id", "rank", "uid", "score") == want


def test_small_products(spark, built, monkeypatch):
    rows, path, queries = built
    want = table(V.search(spark, path, queries, 5), "query_id", "rank", "uid", "score")
    monkeypatch.setattr(V, "CELLS", 7)
    assert table(V.search(spark, path, queries, 5), "query_id", "rank", "uid", "score") == want


def test_far_blocks_are_not_read(spark, built):
    rows, path, queries = built
    one = queries.filter("query_id = 97")
    plan = V.search(spark, path, one, 5)._jdf.queryExecution().toString()
    inside = plan[plan.index("PartitionFilters: [block") :].split("]")[0]
    blocks = spark.read.parquet(f"{path}/bounds").filter("dim = 8").count()
    assert blocks > 8 and 0 < inside.count(",") + 1 < blocks * 0.7
    limits = V.bounds_of(spark, path)[8]
    reach = limits.reach(np.array(one.first()["target"])[None, :])[0]
    for row in V.read(spark, path).filter(F.size("unit") == 8).collect():
        at = limits.block.tolist().index(row["block"])
        assert float(np.dot(one.first()["target"], row["unit"])) <= reach[at]


def test_empty_and_other_lengths(spark, tmp_path, built):
    rows, path, queries = built
    assert V.search(spark, path, queries.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(1, [0.6, 0.8])], "query_id long, target array<double>")
    assert V.search(spark, path, odd, 3).count() == 0
    V.write(rows.limit(0), str(tmp_path / "none"))
    assert V.search(spark, str(tmp_path / "none"), queries, 3).count() == 0


def test_ids_of_any_type(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"v{i:02}", [rng.random(), rng.random()]) for i in range(40)], "uid string, unit array<double>")
    units = D.normalised(rows, "uid", "unit")
    V.write(units, str(tmp_path / "s"), 8)
    queries = units.filter("uid < 'v05'").select(F.col("uid").alias("query_id"), F.col("unit").alias("target"))
    assert table(V.search(spark, str(tmp_path / "s"), queries, 6), "query_id", "rank", "uid") == table(D.top(D.scored(units, queries), 6), "query_id", "rank", "uid")


def test_shards_are_checked(spark):
    good = [0.6, 0.8]
    rows = [("a", 0, good), ("a", 1, good), ("b", 0, [3.0, 4.0]), ("b", 1, None), ("b", 2, []), ("c", 0, [1.0]), ("c", 0, good), ("d", 1, good), ("e", 0, [float("nan"), 1.0]), ("e", None, good)]
    shards = spark.createDataFrame(rows, "shard string, row long, vector array<double>")
    found = {tuple(r) for r in V.shard_violations(shards, 2, "double").collect()}
    assert found == {("b", "NORM", 1), ("b", "EMPTY", 2), ("c", "SHAPE", 1), ("c", "ROWS", 2), ("d", "ROWS", 1), ("e", "NOT_FINITE", 1), ("e", "ROWS", 2)}
    assert ("a", "TYPE", 2) in {tuple(r) for r in V.shard_violations(shards, 2).collect()}
    assert V.shard_violations(shards.limit(0), 2, "double").count() == 0


def test_schema_is_kept(spark, built):
    _, path, _ = built
    about = json.loads(spark.read.parquet(f"{path}/about_rows").first()["schema"])
    assert [f["name"] for f in about["fields"]] == ["uid", "unit", "label", "kind", "near", "block"]
