import numpy as np

from strandwell.llm import block_nearest as N
from pyspark.sql import functions as F


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, tuple(v)), tuple(v))
    out = []
    for q, a in good.items():
        if q % 20:
            continue
        near = sorted((-float(N.inner(np.array([a]), np.array([b]))[0]), i) for i, b in good.items() if i != q and len(b) == len(a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_equals_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]  # equal vectors: ties
    rows += [(2000 + i, rng.normal(size=8).tolist()) for i in range(45)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] + [1.0] * 15), (None, [1.0] * 16), (3080, [float("inf")] * 16), (20, rows[20][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, vector string")
    for query_block, block in ((2048, 8192), (7, 50)):
        got = sorted(map(tuple, N.nearest(table, F.col("vec_id") % 20 == 0, 20, query_block=query_block, block=block).collect()))
        assert got == brute(rows, 20)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(50, 64)), rng.normal(size=(80, 64)) * 10
    qc, qs, ql, qr = N.quantise(q)
    cc, cs, _, cr = N.quantise(c)
    near = (qc.astype(np.float64) @ cc.T.astype(np.float64)) * qs[:, None] * cs
    gap = ql[:, None] * cr + qr[:, None] * np.linalg.norm(c, axis=1)
    assert (np.abs(q @ c.T - near) <= gap).all()


def test_empty(spark):
    assert N.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_take_bounded_memory():
    """128 queries against 8,192 equal vectors of 256 dimensions: every pair survives."""
    import tracemalloc

    x = np.ones((8192, 256))
    tracemalloc.start()
    found = N.search_tile(np.arange(10_000, 10_128), x[:128], np.arange(8192), x, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 30
    assert found[0] == [q for q in range(10_000, 10_128) for _ in range(5)] and found[1] == [0, 1, 2, 3, 4] * 128 and set(found[2]) == {256.0}


def test_one_id_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(200)] + [(40, rng.normal(size=4).tolist()) for _ in range(100)] + [(40, rng.normal(size=3).tolist()) for _ in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = N.nearest(table, F.col("vec_id") % 20 == 0, 5)
    got = sorted(tuple(r) for r in found.collect() if r["query_id"] != 40)
    good = [(i, v) for i, v in rows if len(v) == 4]
    assert got == [r for r in brute(good, 5) if r[0] != 40]
    assert "min(vector" in found._jdf.queryExecution().toString()
