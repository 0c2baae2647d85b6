"""Windows and sequences as sorted streams: equal to their plain definitions, and videos of very many hits divided."""

import random
import time
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from strandwell.operators import fusion, sequence

HITS = "query_id int, provider string, evidence_id int, video string, rank int, start double, end double, anchor double"
STEPS = "case_id int, step_index int, video string, start_ms long, end_ms long, native_rank int, evidence_id int"


def plain_windows(rows, merge=4.0, span=12.0):
    """Numbers of windows from one fold over each video."""
    out, last = {}, {}
    for q, p, e, v, r, lo, hi, at in sorted(rows, key=lambda r: (r[0], str(r[3]), r[7] is not None, r[7] or 0, r[1], r[4], r[2])):
        if hi - lo > span:
            lo, hi = max(0.0, at - span / 2), at + span / 2
        n, first, top, before = last.get((q, v), (0, 0, 0, None))
        if n and at is not None and before is not None and at - before <= merge and max(top, hi) - min(first, lo) <= span:
            first, top = min(first, lo), max(top, hi)
        else:
            n, first, top = n + 1, lo, hi
        last[q, v] = (n, first, top, at)
        out.setdefault((q, v, n), set()).add((p, e))
    return sorted(map(sorted, out.values()))


def windows(spark, rows):
    found = fusion.assign_windows(spark.createDataFrame(rows, HITS)).collect()
    out = {}
    for r in found:
        out.setdefault((r["query_id"], r["video"], r["stretch"], r["window"]), set()).add((r["provider"], r["evidence_id"]))
    assert len(found) == len(rows)
    return sorted(map(sorted, out.values()))


def random_hits(n, seed, videos=("A", "B", None), length=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, half = rng.randrange(length * 4) / 4, rng.choice([0, 0, 1, 9]) * 1.0
        rows.append((rng.randrange(2), rng.choice(["asr", "visual"]), i, rng.choice(videos), rng.randrange(1, 50), max(0.0, at - half), at + half, at))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_windows_equal_the_fold(spark, seed):
    rows = random_hits(500, seed)
    assert windows(spark, rows) == plain_windows(rows)


def test_one_stretch_of_very_many_hits(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("query_id"), F.lit("visual").alias("provider"), F.col("id").cast("int").alias("evidence_id"), F.lit("V").alias("video"), F.lit(1).alias("rank"), (F.col("id") / 10).alias("start"))
    rows = rows.select("*", F.col("start").alias("end"), F.col("start").alias("anchor"))
    began = time.perf_counter()
    found = fusion.assign_windows(rows).groupBy("stretch", "window").count().collect()
    assert time.perf_counter() - began < 60
    # A window spans 12 seconds: 121 hits a tenth of a second apart.
    assert len(found) == -(-100_000 // 121) and {r["stretch"] for r in found} == {0} and max(r["count"] for r in found) == 121


def test_stretches_end_at_pauses_only(spark):
    times = [0, 10, 59, 62, 130, 133, 500, 501, None]
    rows = spark.createDataFrame([("k", t) for t in times], "key string, at long")
    got = {r["at"]: r["n"] for r in fusion.stretches(rows, ["key"], "at", 5, 60, "n").collect()}
    assert got[0] == got[10] == got[59] == got[62] and got[130] == got[133] != got[62] and got[500] == got[501] != got[133] and None in got


def plain_chains(hits, total, strict, min_gap, max_gap, max_span, per_video):
    """The chains of each video, from all combinations of hits."""
    out = set()
    for video in {h[2] for h in hits}:
        steps = [sorted((h[3], h[5], h[6], h[4]) for h in hits if h[2] == video and h[1] == k) for k in range(total)]
        kept = []
        for choice in (c for n in range(total, 0, -1) for c in combinations(range(total), n)):
            if len(choice) == 1 and kept and kept[0][0] > 1:
                break
            for chain in product(*(steps[k] for k in choice)):
                gaps = [b[0] - a[3] for a, b in zip(chain, chain[1:])]
                if strict and any(not min_gap <= g <= max_gap for g in gaps):
                    continue
                if max_span is not None and max(h[3] for h in chain) - min(h[0] for h in chain) > max_span:
                    continue
                kept.append((len(choice), ",".join(map(str, choice)), ",".join(str(h[2]) for h in chain)))
        out |= {(video, *k) for k in kept[:per_video]}
    return out


@pytest.mark.parametrize(("strict", "max_span"), [(True, None), (True, 90_000), (False, 70_000), (False, None)])
@pytest.mark.parametrize("seed", [0, 1])
def test_chains_equal_all_combinations(spark, strict, max_span, seed):
    rng = random.Random(seed)
    hits = []
    for i in range(60):
        at = rng.randrange(0, 900) * 1000
        hits.append((1, rng.randrange(3), rng.choice("VW"), at, at + rng.choice([0, 0, 2000, 40_000]), rng.randrange(9), i))
    rules = dict(strict=strict, min_gap=1000, max_gap=50_000, max_span=max_span, per_video=7)
    found = sequence.match(spark.createDataFrame(hits, STEPS), 3, per_group=1000, dedup_ms=-1, **rules)
    assert {(r["video"], r["matched"], r["steps"], r["evidence"]) for r in found.collect()} == plain_chains(hits, 3, **rules)


def test_a_hot_video_is_divided(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("case_id"), (F.col("id") % 3).cast("int").alias("step_index"), F.lit("V").alias("video"), (F.col("id") * 2000).alias("start_ms"), F.lit(1).alias("native_rank"), F.col("id").cast("int").alias("evidence_id"))
    rows = rows.withColumn("end_ms", F.col("start_ms"))
    sliced = sequence._sliced(rows, 20_000, 0)
    sizes = sliced.groupBy("slice").count().agg(F.count("*").alias("n"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert sizes["n"] >= 2000 and sizes["most"] <= 100 and sizes["all"] <= 3 * 60_000
    found = sequence.match(rows, 3, max_gap=10_000, dedup_ms=-1)
    assert "slice" in found._jdf.queryExecution().toString()
    first = found.filter("match_group = 'FULL'").orderBy("place").first()
    assert first["evidence"] == "0,1,2" and found.count() == 5


def plain_counts(hits, total, min_gap, max_gap, max_span):
    order = small = large = span = 0
    for a, b in product(hits, hits):
        if a[2] == b[2] and b[1] == a[1] + 1 < total:
            gap = b[3] - a[4]
            order, small, large = order + (gap < 0), small + (0 <= gap < min_gap), large + (gap > max_gap)
            span += max_span is not None and min_gap <= gap <= max_gap and max(a[4], b[4]) - min(a[3], b[3]) > max_span
    return order, small, large, span


@pytest.mark.parametrize("max_span", [None, 45_000])
def test_diagnostics_equal_all_pairs(spark, max_span):
    rng = random.Random(5)
    hits = []
    for i in range(150):
        at = rng.randrange(0, 400) * 1000
        hits.append((1, rng.randrange(3), rng.choice(["V", "W", None]), at, at + rng.choice([0, 3000, 20_000]), 1, i))
    frame = spark.createDataFrame(hits, STEPS)
    rules = dict(min_gap=2000, max_gap=30_000, max_span=max_span)
    statuses = spark.createDataFrame([(1, 0, "OK"), (1, 1, "OK"), (1, 2, "OK"), (2, 0, "ERROR"), (2, 1, "NO_RESULTS"), (3, 0, "OK"), (3, 1, "ERROR"), (4, 0, "NO_RESULTS")], "case_id int, step_index int, status string")
    found = sequence.match(frame, 3, dedup_ms=-1, **rules).filter("matched > 1")
    got = {r["case_id"]: r for r in sequence.diagnose(frame, found, statuses, 3, dedup_ms=-1, **rules).collect()}
    one = got[1]
    assert (one["order_violations"], one["gap_too_small"], one["gap_too_large"], one["span_violations"]) == plain_counts(hits, 3, **rules)
    assert (one["videos"], one["multi_step_videos"], one["chains"]) == (3, 3, found.count()) and one["chains"] > 0
    assert {k: r["status"] for k, r in got.items()} == {1: "OK", 2: "ERROR", 3: "PARTIAL", 4: "OK"}
    assert got[4]["videos"] == got[4]["order_violations"] == 0
