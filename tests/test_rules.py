"""Rules about people's decisions, taxonomies, scopes and ids on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandwell.functions.scalars import stable_id
from strandwell.operators import annotation, evaluate, fusion, jobs, lexical, search, taxonomy, validate

DECISIONS = "query_id string, decision string, video_id string, start_frame int, representative_frame int, end_frame int, answer_text string, events array<struct<event_order:int,start_frame:int,representative_frame:int,end_frame:int>>"
LABELS = "query_id string, query_type string, label_status string, provenance string, gt_video string, ranges array<struct<lo:int,at:int,hi:int>>, answer_text string"


def test_decisions(spark):
    labels = spark.createDataFrame([("k", "KIS", "u", "p", "V", None, None), ("q", "QA", "u", "p", "V", None, "x"), ("t", "TRAKE", "u", "p", "V", None, None), ("n", "KIS", "u", "p", "V", None, None)], LABELS)
    good = [("k", "VERIFIED", "V1", 1, 2, 2, None, None), ("q", "NOT_FOUND_IN_CURRENT_POOL", None, None, None, None, None, None), ("t", "VERIFIED", "V3", None, None, None, None, [(1, 5, 6, 7), (0, 1, 2, 3)])]
    frame = spark.createDataFrame(good, DECISIONS)
    assert annotation.exact_violations(frame, labels).count() == 0
    got = {r["query_id"]: r for r in annotation.apply_exact(labels, frame).collect()}
    assert [tuple(x) for x in got["t"]["ranges"]] == [(1, 2, 3), (5, 6, 7)] and [tuple(x) for x in got["k"]["ranges"]] == [(1, 2, 2)]
    assert (got["q"]["label_status"], got["q"]["gt_video"], got["q"]["answer_text"]) == ("labeled", None, None) and got["n"]["provenance"] == "p"
    bad = [("k", None, None, 1, 2, 3, None, None), ("q", "VERIFIED", " V", 3, 2, 4, None, None), ("t", "VERIFIED", "", None, None, None, None, [(0, 1, None, 3), (2, 1, 2, 3)]), ("x", "VERIFIED", "V", 1, 2, 3, None, None), ("n", "UNREVIEWED", None, None, None, None, None, None), ("n", "UNRESOLVED", None, None, None, None, None, None)]
    found = {(r["query_id"], r["code"]) for r in annotation.exact_violations(spark.createDataFrame(bad, DECISIONS), labels).collect()}
    assert found == {("k", "BAD_DECISION"), ("q", "BAD_RANGE"), ("q", "NO_ANSWER"), ("t", "NO_VIDEO"), ("t", "BAD_EVENT"), ("t", "BAD_ORDER"), ("x", "UNKNOWN_QUERY"), ("n", "REPEATED_QUERY")}
    assert annotation.exact_violations(frame.limit(0), labels).count() == 0


def test_taxonomies(spark):
    nodes = spark.createDataFrame([("a", "R", [], True), ("a/b", "R", ["a"], True), ("c", "R", ["d"], True), ("d", "R", ["c"], True), ("e", "R", ["gone"], None)], "branch_id string, branch_type string, parent_ids array<string>, active boolean")
    entities = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "id int")
    listed = spark.createDataFrame([(3, "c"), (3, "c"), (9, "a")], "entity int, branch_id string")
    members = taxonomy.memberships(entities, "id", [("a/b", F.col("id") < 2), ("a", F.col("id") < 3), ("e", F.col("id") == 3)], listed)
    assert sorted(tuple(r) for r in members.collect()) == [(1, "a/b", "RULE"), (2, "a", "RULE"), (3, "c", "LISTED")]
    sizes = {r["branch_id"]: (r["own"], r["all"]) for r in taxonomy.branch_sizes(members, nodes).collect()}
    # c and d lie in a circle: each is above the other.
    assert sizes == {"a": (1, 2), "a/b": (1, 1), "c": (1, 1), "d": (0, 1)}
    wrong = {(r["subject"], r["code"], r["n"]) for r in taxonomy.membership_violations(members, nodes, entities, "id", {"a": 1, "c": 5}).collect()}
    assert wrong == {("entities", "NO_BRANCH", 1), ("e", "UNKNOWN_PARENT", 1), ("c", "COUNT", 1)}


def test_window_ids_tell_lists_apart(spark):
    rows = [(["a,b", "c"], "V"), (["a", "b,c"], "V"), (["a", 'b"'], "V"), (["a", 'b"'], 'V"'), (["c", "a,b"], "V")]
    frame = spark.createDataFrame(rows, "evidence_ids array<string>, video string").withColumns({"start": F.lit(1.0), "end": F.lit(2.0)})
    ids = [r["i"] for r in frame.select(fusion.window_id().alias("i")).collect()]
    assert len(set(ids)) == 4 and ids[0] == ids[4]


def test_votes_look_at_ranks_9_to_40(spark):
    hits = [(1, "v", f"V{r}", r) for r in (1, 8, 9, 40, 41, 60)] + [(1, "p", "V9", 20), (1, "p", "V9", 21), (1, "s", "V1", 3), (1, "s", "V41", 25)]
    got = {r["video"]: r["votes"] for r in evaluate.votes(spark.createDataFrame(hits, "query_id int, lane string, video string, rank int"), "v", "p", "s").collect()}
    assert got == {"V9": 42, "V40": 10, "V1": 30}


def test_stable_ids(spark):
    got = [r["i"] for r in spark.createDataFrame([("L01_V001:5",), ("é",), (None,)], "n string").select(stable_id(F.col("n")).alias("i")).collect()]
    want = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1) for n in ("L01_V001:5", "é")]
    assert got == [*want, None]


def test_scopes_and_words():
    assert search.scope_of(None, None) is None and search.scope_of("V", None) == ("V",) and search.scope_of(None, ()) == ()
    for wrong in (("V", ("W",)), (None, ("V", "V")), (None, (" ",)), (None, tuple(f"V{i}" for i in range(101)))):
        with pytest.raises(ValueError):
            search.scope_of(*wrong)
    assert lexical.compile_text(1, "tìm con mèo", stopwords=("tìm",)).terms == ("con", "mèo")
    assert search.reasons("nghe nói gì", {"asr": ("nói",)}) == ["asr:nói"]


def test_merging_needs_one_contract(spark):
    one = spark.createDataFrame([(1,)], "k int")
    assert jobs.merge([one, one.select((F.col("k") + 1).alias("k"))], "k", [("c", "m"), ("c", "m")]).count() == 2
    with pytest.raises(ValueError):
        jobs.merge([one, one], "k", [("c", "m"), ("d", "m")])


def test_completeness_shows_orphans(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "entity string")
    got = {r["entity"]: (r["known"], r["has_x"], r["has_y"], r["missing"]) for r in validate.completeness(entities, "id", {"x": rows("a", "z", "a"), "y": rows("a", None, "z")}).collect()}
    assert got == {"a": (True, True, True, ""), "b": (True, False, False, "x,y"), "z": (False, True, True, "")}
