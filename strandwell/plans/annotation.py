"""Decisions of annotators over orders as labelled queries, and a taxonomy over suppliers; faults are planted in the decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators import annotation as A
from strandwell.operators import taxonomy as T
from strandwell.sources.tables import table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("KIS"), F.lit("QA"), F.lit("TRAKE")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    ranges = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("lo", "at", "hi")]))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), kind.alias("query_type"), F.lit("unlabeled_reference").alias("label_status"), F.lit("SEED").alias("provenance"), F.lit("V0").alias("gt_video"), ranges.alias("ranges"), F.lit("old").alias("answer_text"))


def _decisions(spark: SparkSession, sf_dir: str, spoilt: bool) -> DataFrame:
    """A decision for every second query; spoilt ones lack videos, answers and order, come twice, or belong to no query."""
    k = F.col("k")
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"))
    bad = lambda n: (k % n == 0) if spoilt else F.lit(False)
    decision = F.when(bad(19), "MAYBE").when(k % 5 < 2, "VERIFIED").when(k % 5 == 2, "NEEDS_MORE_REVIEW").when(k % 5 == 3, "NOT_FOUND_IN_CURRENT_POOL").otherwise("UNREVIEWED")
    start = k % 100
    end = start + F.when(bad(11), -1).otherwise(9)
    event = lambda order, by: F.struct(order.alias("event_order"), (start + by).alias("start_frame"), (start + by + 5).alias("representative_frame"), (end + by).alias("end_frame"))
    events = F.array(event(F.when(bad(17), 0).otherwise(1), 20), event(F.lit(0), 0))
    events = F.when(bad(31), F.slice(events, 1, 0)).otherwise(events)
    rows = rows.select(
        "k", k.alias("query_id"), decision.alias("decision"), F.when(~bad(7), F.concat(F.lit("V"), (k % 40).cast("string"))).alias("video_id"), start.alias("start_frame"), (start + 5).alias("representative_frame"),
        end.alias("end_frame"), F.when(bad(13), "").otherwise(F.concat(F.lit("a"), (k % 10).cast("string"))).alias("answer_text"), events.alias("events"),
    )
    if spoilt:
        rows = rows.unionByName(rows.filter("k % 23 = 0")).unionByName(rows.filter("k % 29 = 0").withColumn("query_id", -k))
    return rows.drop("k")


def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exact_violations(_decisions(spark, sf_dir, True), _labels(spark, sf_dir))


def decisions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.apply_exact(_labels(spark, sf_dir), _decisions(spark, sf_dir, False))
    shown = F.concat_ws(",", F.transform("ranges", lambda r: F.concat_ws("-", *[r[c].cast("string") for c in ("lo", "at", "hi")])))
    return found.select("query_id", "label_status", "provenance", "gt_video", F.when(F.col("ranges").isNotNull(), shown).alias("ranges"), "answer_text")


def _video_decisions(spark: SparkSession, sf_dir: str, spoilt: bool) -> DataFrame:
    return _decisions(spark, sf_dir, spoilt).withColumn("decision", F.when(F.col("decision") == "VERIFIED", "VIDEO_VERIFIED").otherwise(F.col("decision")))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: a video for each of the first 35 numbers of suppliers."""
    return table(spark, sf_dir, "supplier").filter("s_suppkey < 35").select(F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("video_id"))


def video_decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.video_violations(_video_decisions(spark, sf_dir, True), _labels(spark, sf_dir), _videos(spark, sf_dir))


def video_decisions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_video(_labels(spark, sf_dir), _video_decisions(spark, sf_dir, False)).select("query_id", "video_status", "video_provenance", "verified_video")


NODES = [
    ("money", "ROOT", [], True), ("money/debtor", "RULE", ["money"], True), ("place", "ROOT", [], True), ("place/near", "RULE", ["place"], True),
    ("place/far", "RULE", ["place"], False), ("reviewed", "LIST", ["money", "place"], True), ("odd", "LIST", ["nowhere"], True),
]
EXPECTED = {"place/near": 0, "money/debtor": -1}


def _taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, suppliers and memberships: three rules, and suppliers that lists place, partly in a branch that isn't there."""
    nodes = spark.createDataFrame(NODES, "branch_id string, branch_type string, parent_ids array<string>, active boolean")
    suppliers, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rules = [("money/debtor", F.col("s_acctbal") < 0), ("place/near", F.col("s_nationkey") < 10), ("place/far", F.col("s_nationkey") < 20)]
    listed = suppliers.filter(n % 50 == 3).select(n.alias("entity"), F.explode(F.array(F.lit("reviewed"), F.lit("money/debtor"))).alias("branch_id"))
    listed = listed.unionByName(suppliers.filter(n % 50 == 7).select(n.alias("entity"), F.lit("ghost").alias("branch_id"))).unionByName(suppliers.limit(1).select(F.lit(-1).cast("long").alias("entity"), F.lit("reviewed").alias("branch_id")))
    return nodes, suppliers, T.memberships(suppliers, "s_suppkey", rules, listed)


def taxonomy_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, members = _taxonomy(spark, sf_dir)
    return T.branch_sizes(members, nodes)


def taxonomy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, suppliers, members = _taxonomy(spark, sf_dir)
    return T.membership_violations(members, nodes, suppliers, "s_suppkey", EXPECTED)


QUERIES = {
    "decision_violations": decision_violations, "decisions_applied": decisions_applied, "video_decision_violations": video_decision_violations, "video_decisions_applied": video_decisions_applied,
    "taxonomy_active": taxonomy_active, "taxonomy_violations": taxonomy_violations,
}

_CLEAN = """d0 AS (SELECT o_orderkey AS k, o_orderkey AS query_id, CASE WHEN {bad}19 = 0 THEN 'MAYBE' WHEN o_orderkey % 5 < 2 THEN 'VERIFIED' WHEN o_orderkey % 5 = 2 THEN 'NEEDS_MORE_REVIEW' WHEN o_orderkey % 5 = 3 THEN 'NOT_FOUND_IN_CURRENT_POOL' ELSE 'UNREVIEWED' END AS decision,
  CASE WHEN {bad}7 <> 0 THEN 'V' || o_orderkey % 40 END AS video_id, o_orderkey % 100 AS s, {bad}11 = 0 AS bad_range, CASE WHEN {bad}13 = 0 THEN '' ELSE 'a' || o_orderkey % 10 END AS answer, {bad}17 = 0 AS bad_order, {bad}31 = 0 AS none FROM orders WHERE o_orderkey % 2 = 0)"""
_SPOILT = _CLEAN.format(bad="o_orderkey % ") + """, d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE k % 23 = 0 UNION ALL SELECT * REPLACE (-k AS query_id) FROM d0 WHERE k % 29 = 0)"""
_GOOD = _CLEAN.format(bad="1 + 0 * o_orderkey + 0 * ")
_TWICE = "SELECT query_id, 'REPEATED_QUERY' AS code, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1"
_MEMBERS = """l AS (SELECT s_suppkey AS entity, unnest(['reviewed', 'money/debtor']) AS branch FROM supplier WHERE s_suppkey % 50 = 3 UNION ALL SELECT s_suppkey, 'ghost' FROM supplier WHERE s_suppkey % 50 = 7),
r AS (SELECT s_suppkey AS entity, CASE WHEN s_acctbal < 0 THEN 'money/debtor' WHEN s_nationkey < 10 THEN 'place/near' WHEN s_nationkey < 20 THEN 'place/far' END AS branch FROM supplier),
m AS (SELECT * FROM l UNION ALL SELECT * FROM r WHERE branch IS NOT NULL AND entity NOT IN (SELECT entity FROM l))"""
ORACLES = {
    "decision_violations": f"""WITH {_SPOILT}, t AS (SELECT d.*, query_id > 0 OR k = 0 AS known, query_id % 3 AS kind FROM d),
c AS (SELECT query_id, unnest([CASE WHEN NOT known THEN 'UNKNOWN_QUERY' END, CASE WHEN decision = 'MAYBE' THEN 'BAD_DECISION' END, CASE WHEN known AND decision = 'VERIFIED' AND video_id IS NULL THEN 'NO_VIDEO' END,
  CASE WHEN known AND decision = 'VERIFIED' AND kind < 2 AND bad_range THEN 'BAD_RANGE' END, CASE WHEN known AND decision = 'VERIFIED' AND kind = 1 AND answer = '' THEN 'NO_ANSWER' END, CASE WHEN known AND decision = 'VERIFIED' AND kind = 2 AND none THEN 'NO_EVENTS' END,
  CASE WHEN known AND decision = 'VERIFIED' AND kind = 2 AND NOT none AND bad_range THEN 'BAD_EVENT' END, CASE WHEN known AND decision = 'VERIFIED' AND kind = 2 AND NOT none AND bad_order THEN 'BAD_ORDER' END]) AS code FROM t)
SELECT query_id, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL UNION ALL {_TWICE}""",
    "decisions_applied": f"""WITH {_GOOD}, t AS (SELECT o_orderkey AS q, o_orderkey % 3 AS kind, d0.* FROM orders LEFT JOIN d0 ON d0.query_id = o_orderkey)
SELECT q AS query_id, CASE WHEN decision IN ('VERIFIED', 'NOT_FOUND_IN_CURRENT_POOL') THEN 'labeled' ELSE 'unlabeled_reference' END AS label_status, CASE WHEN decision <> 'UNREVIEWED' THEN 'INTERNAL_MANUAL_VERIFIED' ELSE 'SEED' END AS provenance,
CASE WHEN decision = 'VERIFIED' THEN video_id WHEN coalesce(decision, 'UNREVIEWED') = 'UNREVIEWED' THEN 'V0' END AS gt_video,
CASE WHEN decision = 'VERIFIED' THEN s || '-' || s + 5 || '-' || s + 9 || CASE WHEN kind = 2 THEN ',' || s + 20 || '-' || s + 25 || '-' || s + 29 ELSE '' END WHEN coalesce(decision, 'UNREVIEWED') = 'UNREVIEWED' THEN '0-0-0' END AS ranges,
CASE WHEN decision = 'VERIFIED' AND kind = 1 THEN answer WHEN decision = 'VERIFIED' OR coalesce(decision, 'UNREVIEWED') = 'UNREVIEWED' THEN 'old' END AS answer_text FROM t""",
    "video_decision_violations": f"""WITH {_SPOILT}, v AS (SELECT 'V' || s_suppkey AS video_id FROM supplier WHERE s_suppkey < 35),
c AS (SELECT query_id, unnest([CASE WHEN NOT (query_id > 0 OR k = 0) THEN 'UNKNOWN_QUERY' END, CASE WHEN decision = 'MAYBE' THEN 'BAD_DECISION' END, CASE WHEN decision = 'VERIFIED' AND video_id IS NULL THEN 'NO_VIDEO' END,
  CASE WHEN decision = 'VERIFIED' AND video_id NOT IN (SELECT video_id FROM v) THEN 'UNKNOWN_VIDEO' END]) AS code FROM d)
SELECT query_id, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL UNION ALL {_TWICE}""",
    "video_decisions_applied": f"""WITH {_GOOD} SELECT o_orderkey AS query_id, CASE decision WHEN 'VERIFIED' THEN 'VERIFIED' WHEN 'UNREVIEWED' THEN NULL ELSE decision END AS video_status,
CASE WHEN decision IN ('VERIFIED', 'NOT_FOUND_IN_CURRENT_POOL') THEN 'INTERNAL_MANUAL_VERIFIED' END AS video_provenance, CASE WHEN decision = 'VERIFIED' THEN video_id END AS verified_video FROM orders LEFT JOIN d0 ON d0.query_id = o_orderkey""",
    "taxonomy_active": f"""WITH {_MEMBERS}, u(branch, above) AS (VALUES ('money', 'money'), ('money/debtor', 'money/debtor'), ('money/debtor', 'money'), ('place', 'place'), ('place/near', 'place/near'), ('place/near', 'place'), ('reviewed', 'reviewed'), ('reviewed', 'money'), ('reviewed', 'place'), ('odd', 'odd')),
n(branch_id, branch_type) AS (VALUES ('money', 'ROOT'), ('money/debtor', 'RULE'), ('place', 'ROOT'), ('place/near', 'RULE'), ('reviewed', 'LIST'), ('odd', 'LIST'))
SELECT branch_id, branch_type, count(DISTINCT entity) FILTER (m.branch = branch_id) AS own, count(DISTINCT entity) AS "all" FROM n LEFT JOIN u ON above = branch_id LEFT JOIN m ON m.branch = u.branch GROUP BY ALL""",
    "taxonomy_violations": f"""WITH {_MEMBERS} SELECT branch AS subject, CASE branch WHEN 'ghost' THEN 'UNKNOWN_BRANCH' ELSE 'INACTIVE_BRANCH' END AS code, count(*) AS n FROM m WHERE branch IN ('ghost', 'place/far') GROUP BY ALL
UNION ALL SELECT 'entities', 'NO_BRANCH', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT entity FROM m) HAVING count(*) > 0 UNION ALL SELECT 'odd', 'UNKNOWN_PARENT', 1
UNION ALL SELECT branch, 'COUNT', count(*) FROM m WHERE branch IN ('place/near', 'money/debtor') GROUP BY ALL""",
}
