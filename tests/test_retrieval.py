"""Operators on small literal inputs with known results."""

import random
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from strandwell.functions import scalars as C
from strandwell.functions import text as X
from strandwell.operators import compare, dense, evaluate, fusion, jobs, lexical, sequence, structured, timeline

HITS = "query_id int, provider string, evidence_id string, video string, rank int, start double, end double, anchor double"


def hit(provider, evidence, video, rank, at, half=0.0):
    at = float(at)
    return (1, provider, evidence, video, rank, max(0.0, at - half), at + half, at)


def windows(spark, rows):
    return [(r["video"], r["start"], r["end"], r["n_evidence"], r["representative"], r["rrf"]) for r in fusion.windows(spark.createDataFrame(rows, HITS)).orderBy("video", "start").collect()]


def test_windows_merge_up_to_the_gap_and_keep_the_best_of_repeated_hits(spark):
    rows = [hit("visual", "V1:1", "V1", 2, 0), hit("asr", "A1", "V1", 1, 2, 1), hit("asr", "A1", "V1", 5, 2, 1), hit("visual", "V1:2", "V1", 3, 4), hit("asr", "A2", "V2", 1, 2, 1)]
    found = windows(spark, rows)
    assert [w[:4] for w in found] == [("V1", 0, 4, 3), ("V2", 1, 3, 1)]
    assert found[0][4] == "V1:1" and found[0][5] == pytest.approx(1 / 62 + 1 / 61)


def test_windows_do_not_chain_beyond_the_span(spark):
    found = windows(spark, [hit("visual", f"V:{t}", "V", 1 + t, t) for t in (0, 4, 8, 12, 16)])
    assert [w[1:3] for w in found] == [(0, 12), (16, 16)]


def test_ranking_breaks_ties_by_video(spark):
    rows = [hit("visual", "V2:1", "V2", 1, 0), hit("visual", "V1:1", "V1", 1, 0)]
    ranked = fusion.rank_windows(fusion.windows(spark.createDataFrame(rows, HITS)), 5).orderBy("place").collect()
    assert [r["video"] for r in ranked] == ["V1", "V2"] and all(r["window_id"].startswith("ew_") for r in ranked)
    with pytest.raises(ValueError):
        fusion.rank_windows(fusion.windows(spark.createDataFrame(rows, HITS)), 0)


def test_impossible_hits_fail(spark):
    bad = spark.createDataFrame([(1, "asr", "A", "V", 0, 1.0, 2.0, 1.5)], HITS)
    with pytest.raises(Exception, match="impossible hit"):
        fusion.checked(bad).collect()


def test_session_dedup(spark):
    rows = [(1, 1000, 5, "a"), (1, 1200, 1, "b"), (1, 1400, 8, "c"), (1, 8000, 2, "d")]
    kept = fusion.session_dedup(spark.createDataFrame(rows, "k int, start_ms long, native_rank int, evidence_id string"), ["k"])
    assert sorted(r["start_ms"] for r in kept.collect()) == [1200, 8000]


STEPS = "case_id int, step_index int, video string, start_ms long, end_ms long, native_rank int, evidence_id string"
# steps as (video, start, end) in seconds; parameters; chains by group
CASES = [
    ([("V01", 10, 10), ("V01", 25, 25)], {}, {"FULL": 1}),
    ([("V01", 15, 15), ("V01", 20, 26)], {}, {"FULL": 1}),
    ([("V01", 5, 12), ("V01", 30, 30)], {}, {"FULL": 1}),
    ([("V01", 40, 40), ("V01", 10, 10)], {}, {"STEP_ONLY": 2}),
    ([("V01", 10, 10), ("V01", 90, 90)], {"max_gap": 30_000}, {"STEP_ONLY": 2}),
    ([("V01", 10, 10), ("V01", 20, 20), ("V02", 30, 30)], {}, {"PREFIX": 1, "STEP_ONLY": 1}),
    ([("V02", 5, 5), ("V01", 22, 22), ("V01", 35, 35)], {}, {"SUFFIX": 1, "STEP_ONLY": 1}),
    ([("V02", 5, 5), ("V01", 15, 15), ("V01", 28, 28), ("V03", 45, 45)], {}, {"PARTIAL": 1, "STEP_ONLY": 2}),
]


@pytest.mark.parametrize(("steps", "rules", "wanted"), CASES)
def test_sequence_cases(spark, steps, rules, wanted):
    rows = [(1, k, v, a * 1000, b * 1000, 1, f"e{k}") for k, (v, a, b) in enumerate(steps)]
    found = sequence.match(spark.createDataFrame(rows, STEPS), len(steps), **rules)
    assert {r["match_group"]: r["count"] for r in found.groupBy("match_group").count().collect()} == wanted


def test_sequence_span_and_order_free(spark):
    rows = [(1, k, "V", t * 1000, t * 1000, 1, f"e{k}") for k, t in enumerate((5, 35, 80))]
    frame = spark.createDataFrame(rows, STEPS)
    assert sequence.match(frame, 3, max_span=60_000).filter("match_group = 'FULL'").count() == 0
    back = spark.createDataFrame([(1, 0, "V", 40_000, 40_000, 1, "a"), (1, 1, "V", 10_000, 10_000, 1, "b")], STEPS)
    assert sequence.match(back, 2, strict=False, max_span=60_000).filter("match_group = 'FULL'").count() == 1
    first = sequence.match(spark.createDataFrame([(1, 0, "V", 10_000, 10_000, 1, "a"), (1, 1, "V", 20_000, 25_000, 2, "b")], STEPS), 2).filter("match_group = 'FULL'").first()
    assert (first["gaps"], first["span"], first["ranks"], first["worst"]) == (10_000, 15_000, 3, 2)
    with pytest.raises(ValueError):
        sequence.match(frame, 6)


@pytest.mark.parametrize(("indices", "total", "group"), [((0, 1, 2), 3, "FULL"), ((0, 1), 3, "PREFIX"), ((1, 2), 3, "SUFFIX"), ((0, 2), 3, "PARTIAL"), ((1,), 3, "STEP_ONLY"), ((1, 2), 4, "PARTIAL"), ((1, 2, 3), 4, "SUFFIX"), ((0, 1, 3), 4, "PARTIAL")])
def test_groups(indices, total, group):
    assert sequence.group_of(indices, total) == group


def posted(spark):
    rows = [("L21_V001", "K1", "Person", 0.95, 1), ("L21_V001", "K1", "Motorcycle", 0.85, 2), ("L21_V001", "K2", "Person", 0.8, 1), ("L21_V001", "K2", "Car", 0.9, 2)]
    rows += [("L21_V002", "K3", "Person", 0.6, 1), ("L21_V002", "K3", "Car", 0.4, 2), ("L21_V002", "K3", "Motorcycle", 0.75, 3)]
    return structured.postings(spark.createDataFrame(rows, "video string, frame string, class_name string, score double, ordinal int"))


def test_objects(spark):
    p = posted(spark)
    scores = lambda found: {r["frame"]: r["score"] for r in found.collect()}
    assert scores(structured.search_objects(p, ["Person", "Motorcycle"], True)) == {"K1": 0.85, "K3": 0.6}
    assert scores(structured.search_objects(p, ["Car", "Car"], False, 0.5)) == {"K2": 0.9}
    assert scores(structured.search_objects(p, ["Person"], True, scope=["L21_V002"])) == {"K3": 0.6}
    assert scores(structured.search_objects(p, ["Person"], True, scope=[])) == {} == scores(structured.search_objects(p, [], False))
    known = structured.resolve([" person", "Unknown thing"], structured.class_dictionary(p))
    assert known == ["Person"]
    assert scores(structured.search_objects(p, known, True, asked=2)) == {}
    loose, tight = (set(scores(structured.search_objects(p, ["Person", "Car"], False, t))) for t in (0.1, 0.7))
    assert tight <= loose


FRAMES, PROBES = "video string, uid string, ms long", "video string, probe string, target_ms long"


@pytest.mark.parametrize("span", [timeline.HOUR_MS, 3000])
def test_nearest(spark, span):
    frames = spark.createDataFrame([("V", "a", 5000), ("V", "b", 15000), ("V", "c", 25000), ("V", "c2", 25000), ("W", "t1", 2000), ("W", "t2", 4000)], FRAMES)
    probes = spark.createDataFrame([("V", "mid", 20000), ("V", "early", 2000), ("V", "late", 40000), ("V", "same", 25000), ("W", "tie", 3000), ("U", "none", 1)], PROBES)
    got = {r["probe"]: r for r in timeline.nearest(frames, probes, span).collect()}
    assert (got["mid"]["before_uid"], got["mid"]["after_uid"], got["mid"]["uid"], got["mid"]["delta_ms"]) == ("b", "c", "b", -5000)
    assert (got["early"]["before_uid"], got["early"]["after_uid"]) == (None, "a") and (got["late"]["before_uid"], got["late"]["after_uid"]) == ("c", None)
    assert (got["same"]["before_uid"], got["same"]["after_uid"], got["same"]["delta_ms"]) == ("c", "c", 0)
    assert (got["tie"]["uid"], got["tie"]["delta_ms"]) == ("t1", -1000)
    assert got["none"]["status"] == "NO_KEYFRAME" and got["none"]["uid"] is None


def test_lane_sets(spark):
    rows = [(1, lane, v) for lane, videos in {"siglip": "123", "asr": "234", "ocr": "35"}.items() for v in videos]
    hits = spark.createDataFrame(rows, "query_id int, lane string, video string")
    assert tuple(compare.set_algebra(hits, ["siglip", "asr", "ocr"]).first())[1:] == (5, 1, 3)
    assert {r["lane"]: r["n_unique"] for r in compare.unique_to_lane(hits).collect()} == {"siglip": 1, "asr": 1, "ocr": 1}
    pair = compare.pairwise(hits).filter("lane_a = 'asr' AND lane_b = 'siglip'").first()
    assert (pair["overlap"], pair["jaccard"]) == (2, 0.5)
    assert compare.set_algebra(hits, ["siglip", "asr", "empty"]).first()["n_intersection"] == 0


@pytest.mark.parametrize(("frame", "right"), [(9, False), (10, True), (20, True), (21, False), (40, True), (45, True), (46, False)])
def test_frame_ranges_include_their_ends(spark, frame, right):
    truth = spark.sql("SELECT 1 AS query_id, 'V1' AS gt_video, array(named_struct('lo', 10, 'hi', 20), named_struct('lo', 40, 'hi', 45)) AS ranges")
    row = evaluate.frame_recall(truth, spark.createDataFrame([(1, 1, "V1", frame)], "query_id int, rank int, video string, frame int")).first()
    assert [row[f"r_at_{k}"] for k in evaluate.CUTOFFS] == [float(right)] * 5


def test_wrong_numbers_of_frames_fail(spark):
    truth = spark.sql("SELECT 1 AS query_id, 'V1' AS gt_video, array(named_struct('lo', 10, 'hi', 20)) AS ranges")
    with pytest.raises(Exception, match="do not match"):
        evaluate.event_score(truth, spark.createDataFrame([(1, 1, "V1", [1, 2])], "query_id int, rank int, video string, frames array<int>")).collect()


def test_normal_forms(spark):
    text = "  Chào Mừng\tBạn   Đến với Đà Nẵng, Phở Bò "
    row = spark.createDataFrame([(text,)], "t string").select(X.collapse(F.col("t")).alias("c"), X.strip_accents(X.collapse(F.col("t"))).alias("s"), X.tokens(F.col("t")).alias("w"), X.facet_phrase(F.lit(" «City  Street!» ")).alias("f")).first()
    assert row["c"] == "Chào Mừng Bạn Đến với Đà Nẵng, Phở Bò"
    assert row["s"] == "Chao Mung Ban Den voi Da Nang, Pho Bo"
    assert row["w"][:3] == ["chào", "mừng", "bạn"] and row["f"] == "city street"


def test_scalars(spark):
    rows = spark.createDataFrame([(0.0005, 25.0, "a/b.mp4"), (0.0015, 0.0, "../x"), (1.5, None, "C:/x"), (2.0, 29.97, "/etc")], "s double, fps double, p string")
    got = rows.select(C.millis(F.col("s")).alias("ms"), C.frame_of(F.col("s"), F.col("fps")).alias("f"), C.safe_path(F.col("p")).alias("ok")).collect()
    assert [r["ms"] for r in got] == [0, 2, 1500, 2000] and [r["f"] for r in got][2:] == [38, 60]
    assert [r["ok"] for r in got] == [True, False, False, False]


def test_queries_without_answers(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    index = lexical.indexed(docs, "doc_id", {"text": F.col("text")})
    terms = lexical.query_table(spark, [lexical.TextQuery(1, ("delta",)), lexical.TextQuery(2, ("beta", "alpha"))])
    scores = lexical.term_scores(index, terms, {"text": 1.0})
    assert [r["uid"] for r in lexical.top(lexical.all_terms(scores), 5).collect()] == [1]
    assert lexical.relaxed(lexical.TextQuery(1, ("find", "the", "dog", "dog"))).terms == ("dog",)
    assert lexical.relaxed(lexical.TextQuery(1, ("the",))).terms == ("the",)


def test_vectors_that_cannot_be_compared_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    table = dense.normalised(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    found = dense.scored(table, table.filter("uid = 1").select(F.col("uid").alias("query_id"), F.col("unit").alias("target")))
    assert sorted((r["uid"], r["score"]) for r in found.collect()) == [(1, 1.0), (5, 1.0)]
    asked = table.filter("uid = 1").select(F.col("uid").alias("query_id"), F.col("unit").alias("target"))
    assert dense.self_check(dense.top(found, 1), asked).first()["ok"]
    assert not dense.self_check(dense.top(found, 1).limit(0), asked).first()["ok"]


@pytest.mark.parametrize(("strict", "max_span"), [(True, None), (True, 900), (False, 700), (False, None)])
def test_chains_equal_all_combinations(strict, max_span):
    rng = random.Random(3)
    for n in range(2, 5):
        steps = [sorted((s := rng.randrange(1000), s + rng.randrange(60), k, k) for k in range(rng.randrange(0, 6))) for _ in range(n)]
        wanted = []
        for places in product(*(range(len(s)) for s in steps)):
            hits = [s[k] for s, k in zip(steps, places, strict=True)]
            gaps = [b[0] - a[1] for a, b in zip(hits, hits[1:], strict=False)]
            if strict and not all(max(0, 20) <= g <= 400 for g in gaps):
                continue
            if max_span is None or max(h[1] for h in hits) - min(h[0] for h in hits) <= max_span:
                wanted.append(places)
        assert list(sequence.chains(steps, strict, 20, 400, max_span)) == wanted


def test_many_hits_of_many_steps_take_no_time(spark):
    """Fifty hits of each of five steps in one video: 50^5 chains without order, of which five are kept, or none where the last can't follow."""
    rows = [(1, step, "V", 10_000 * k + step, 10_000 * k + step, k, f"{step}-{k}") for step in range(5) for k in range(50)]
    began = time.perf_counter()
    found = sequence.match(spark.createDataFrame(rows, STEPS), 5, strict=False).collect()
    assert len(found) == 5 and {r["match_group"] for r in found} == {"FULL"}
    far = [(c, s, v, a + (10**9 if s == 4 else 0), b + (10**9 if s == 4 else 0), r, e) for c, s, v, a, b, r, e in rows]
    assert {r["match_group"] for r in sequence.match(spark.createDataFrame(far, STEPS), 5, strict=False, max_span=10**6).collect()} == {"PREFIX"}
    assert time.perf_counter() - began < 60


def test_rows_without_a_key_are_numbered_too(spark):
    rows = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (None, "d")], "k int, v string")
    found = {r["v"]: r["idx"] for r in jobs.dense_index(rows, "k", 4).collect()}
    assert found["c"] == 2 and found["a"] == 3 and {found["b"], found["d"]} == {0, 1}


def test_near_scores_are_ranked_as_they_are(spark):
    rows = spark.createDataFrame([(k, [1.0, 1e-4 * (6 - k)]) for k in range(1, 7)], "uid int, v array<double>")
    units = dense.normalised(rows, "uid", "v")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "query_id int, target array<double>")
    found = dense.top(dense.scored(units, queries), 2).select("query_id", "rank", "uid")
    assert sorted(map(tuple, found.filter("query_id = 1").collect())) == [(1, 1, 6), (1, 2, 5)]
    assert sorted(map(tuple, dense.top(dense.scored(units, queries, most=2), 2).select("query_id", "rank", "uid").collect())) == sorted(map(tuple, found.collect()))


def test_compiled_requests():
    assert lexical.compile_text(1, 'show the "Red Car" near a bridge').terms == ("red car", "near", "bridge")
    assert lexical.compile_text(1, "the of").terms == ("the", "of") and lexical.compile_text(1, "the car", strict=True).terms == ("the", "car")
    assert len(lexical.compile_text(1, " ".join(f"w{k}" for k in range(40))).terms) == lexical.MOST_TERMS
    for wrong in ('one "two', "", '""'):
        with pytest.raises(ValueError):
            lexical.compile_text(1, wrong)


def test_stored_postings_equal_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b", "x"), (2, None, "b"), (3, "c", ""), (None, "b a", None)], "uid int, text string, title string")
    index = lexical.indexed(docs, "uid", {"text": F.col("text"), "title": F.col("title")})
    lexical.write_postings(index, ["text", "title"], str(tmp_path / "p"), 4)
    queries, weights = [lexical.TextQuery(1, ("b", "a", "none")), lexical.TextQuery(2, ("x",))], {"text": 2.0, "title": 0.0}
    one = sorted(map(str, lexical.indexed_scores(spark, str(tmp_path / "p"), queries, weights).collect()))
    two = sorted(map(str, lexical.term_scores(index, lexical.query_table(spark, queries), weights).collect()))
    assert one == two and len(one) == 4
    plan = lexical.indexed_scores(spark, str(tmp_path / "p"), queries, weights)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan


def test_a_lane_that_fails_when_it_runs_is_left_out(spark):
    from strandwell.operators.search import Request, search

    class Lane:
        def __init__(self, name, bad):
            self.name, self.bad = name, bad

        def available(self):
            return True

        def hits(self, spark, request):
            rows = spark.createDataFrame([(1, self.name, "e", "V", 1, 1.0, 2.0, 1.5)], "query_id int, provider string, evidence_id string, video string, rank int, start double, end double, anchor double")
            return rows.withColumn("anchor", F.raise_error(F.lit("gone")).cast("double")) if self.bad else rows

    answer = search(spark, Request("r", "q", ("visual", "asr")), [Lane("visual", False), Lane("asr", True)])
    assert answer.status == "PARTIAL" and answer.lanes["asr"].startswith("ERROR") and answer.windows.count() == 1
