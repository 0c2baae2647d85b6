"""Fusion queries: all events of four types as hits of four lanes on a folded time axis, ranked by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.operators import fusion as X
from strandwell.plans.timeline import EVENTS, events

LANES = {"click": "visual", "view": "asr", "purchase": "ocr", "error": "object"}
#: Events of a user are laid on this many seconds, so that hits lie close together.
FOLD = 300
#: A lane's hits that a time range is applied to.
PER_LANE = 100


def lane_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the lanes as hits of one query, without ranks; asr hits are intervals of up to half a minute."""
    rows = events(spark, sf_dir).filter(F.col("space").isin(list(LANES)))
    provider = F.element_at(F.create_map(*[F.lit(x) for kv in LANES.items() for x in kv]), F.col("space"))
    anchor = (F.col("ms") % (FOLD * 1000)) / 1000
    rows = rows.select(F.lit(1).alias("query_id"), provider.alias("provider"), F.col("uid").alias("evidence_id"), "video", anchor.alias("anchor"), F.col("value").alias("raw_score"))
    half = F.when(F.col("provider") == "asr", (F.col("evidence_id") % 16) * 1.0).otherwise(0.0)
    return rows.withColumn("start", F.greatest(F.lit(0.0), F.col("anchor") - half)).withColumn("end", F.col("anchor") + half)


def ranked(rows: DataFrame, parts: int = 64) -> DataFrame:
    """All rows with their rank by value within the lane, without one task for a whole lane.

    Quantiles cut the values into ranges; rows are ranked within lane and range, behind the rows of the ranges above."""
    cuts = sorted(set(rows.approxQuantile("raw_score", [k / parts for k in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("raw_score") > c)) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", part)
    counts = ranged.groupBy("provider", "_part").agg(F.count("*").alias("_n"))
    # A row for each lane and range.
    above = Window.partitionBy("provider").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("provider", "_part", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_start"))
    order = Window.partitionBy("provider", "_part").orderBy(F.col("raw_score").desc(), "evidence_id")
    within = ranged.withColumn("_row", F.row_number().over(order)).join(F.broadcast(starts), ["provider", "_part"])
    return within.withColumn("rank", (F.col("_start") + F.col("_row")).cast("int")).drop("_part", "_row", "_start")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of each lane: rank by value within the lane."""
    return ranked(lane_events(spark, sf_dir))


def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.windows(X.checked(hits(spark, sf_dir))).drop("query_id", "evidence_ids")


def window_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose evidence or ranks were spoilt on purpose, and whatever else breaks the contract."""
    found = X.windows(hits(spark, sf_dir))
    spoilt = found.withColumn("end", F.when(F.col("video") % 7 == 1, F.col("start") + 13).otherwise(F.col("end"))).withColumn("rrf", F.when(F.col("video") % 5 == 2, F.col("rrf") * 2).otherwise(F.col("rrf")))
    return X.contract_violations(spoilt.withColumn("evidence_ids", F.when(F.col("video") % 11 == 3, F.concat("evidence_ids", "evidence_ids")).otherwise(F.col("evidence_ids"))))


def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.windows(hits(spark, sf_dir)).select("video", "start", X.window_id().alias("window_id"))


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.rank_windows(X.windows(hits(spark, sf_dir)), 100)
    return found.select("place", "video", "start", "end", "rrf", "best_rank", "n_evidence")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks by video: each lane counts with its best rank."""
    best = hits(spark, sf_dir).groupBy("video", "provider").agg(F.min("rank").alias("best"))
    lists = best.groupBy("video").agg(F.sort_array(F.collect_list("best")).alias("ranks"))
    return lists.select("video", F.size("ranks").alias("lanes"), F.round(F.aggregate("ranks", F.lit(0.0), lambda s, r: s + 1.0 / (X.RRF_K + r)), 9).alias("rrf"))


def time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time range is applied to each lane's 100 best hits, not before they are chosen."""
    return hits(spark, sf_dir).filter(F.col("rank") <= PER_LANE).filter(F.col("anchor").between(60, 120)).select("provider", "rank", "evidence_id", "anchor")


def interval_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clamped(lane_events(spark, sf_dir)).filter("provider = 'asr'").select("evidence_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


def session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(lane_events(spark, sf_dir)).select("provider", "video", "evidence_id", F.round(F.col("anchor") * 1000).cast("long").alias("start_ms"), F.col("rank").alias("native_rank"))
    return X.session_dedup(rows, ["provider", "video"], 2000)


QUERIES = {
    "evidence_windows": evidence_windows, "window_rank": window_rank, "rrf_fusion": rrf_fusion, "time_filter_after_topk": time_filter, "interval_clamp": interval_clamp, "session_dedup": session_dedup,
    "window_violations": window_violations, "window_ids": window_ids,
}

_HITS = f"""{EVENTS},
r AS (SELECT CASE space WHEN 'click' THEN 'visual' WHEN 'view' THEN 'asr' WHEN 'purchase' THEN 'ocr' ELSE 'object' END AS provider, uid AS evidence_id, video, (ms % {FOLD * 1000}) / 1000 AS anchor, value FROM e WHERE space <> 'signup'),
k AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY value DESC, evidence_id) AS rank FROM r),
h AS (SELECT *, greatest(0, anchor - CASE WHEN provider = 'asr' THEN evidence_id % 16 ELSE 0 END)::DOUBLE AS s, (anchor + CASE WHEN provider = 'asr' THEN evidence_id % 16 ELSE 0 END)::DOUBLE AS t FROM k),
c AS (SELECT *, CASE WHEN t - s > 12 THEN greatest(0, anchor - 6) ELSE s END AS lo, CASE WHEN t - s > 12 THEN anchor + 6 ELSE t END AS hi FROM h)"""
_WINDOWS = f"""WITH RECURSIVE {_HITS},
o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY anchor, provider, rank, evidence_id) AS n FROM c),
w AS (SELECT video, n, evidence_id, lo, hi, anchor, 1 AS no FROM o WHERE n = 1 UNION ALL
  SELECT o.video, o.n, o.evidence_id, CASE WHEN j THEN least(w.lo, o.lo) ELSE o.lo END, CASE WHEN j THEN greatest(w.hi, o.hi) ELSE o.hi END, o.anchor, CASE WHEN j THEN w.no ELSE w.no + 1 END
  FROM w JOIN (SELECT * FROM o) o ON o.video = w.video AND o.n = w.n + 1, LATERAL (SELECT o.anchor - w.anchor <= 4 AND greatest(w.hi, o.hi) - least(w.lo, o.lo) <= 12 AS j)),
m AS (SELECT o.*, w.no FROM o JOIN w ON o.video = w.video AND o.n = w.n),
l AS (SELECT video, no, provider, min(rank) AS best FROM m GROUP BY ALL),
f AS (SELECT video, no, round(list_sum(list(1.0::DOUBLE / (60 + best) ORDER BY provider)), 9) AS rrf, string_agg(provider || '=' || best, ',' ORDER BY provider) AS lanes FROM l GROUP BY ALL),
g AS (SELECT video, no, round(min(lo), 6) AS start, round(max(hi), 6) AS "end", count(*) AS n_evidence, string_agg(provider || ':' || evidence_id, ',' ORDER BY provider, rank, evidence_id) AS evidence, min(rank) AS best_rank,
  coalesce(arg_min(evidence_id, (rank, evidence_id)) FILTER (provider = 'visual'), arg_min(evidence_id, (rank, anchor, provider, evidence_id))) AS representative,
  CASE WHEN count(*) FILTER (provider = 'visual') > 0 THEN 'visual_keyframe' ELSE 'temporal_anchor' END AS kind FROM m GROUP BY ALL)"""

ORACLES = {
    "evidence_windows": f'{_WINDOWS} SELECT g.video, start, "end", n_evidence, evidence, best_rank::INTEGER AS best_rank, representative, kind, lanes, rrf FROM g JOIN f USING (video, no)',
    "window_rank": f'{_WINDOWS} SELECT row_number() OVER (ORDER BY rrf DESC, best_rank, video, start)::INTEGER AS place, video, start, "end", rrf, best_rank::INTEGER AS best_rank, n_evidence FROM g JOIN f USING (video, no) QUALIFY place <= 100',
    "window_violations": f"""{_WINDOWS}, s AS (SELECT g.video, start, CASE WHEN g.video % 7 = 1 THEN start + 13 ELSE "end" END AS e, CASE WHEN g.video % 11 = 3 THEN 1 ELSE 0 END AS twice, CASE WHEN g.video % 5 = 2 THEN 2 ELSE 1 END AS times FROM g)
SELECT video, start, 'SPAN' AS code FROM s WHERE NOT (e - start BETWEEN 0 AND 12) UNION ALL SELECT video, start, 'REPEATED_EVIDENCE' FROM s WHERE twice = 1 UNION ALL SELECT video, start, 'RRF' FROM s WHERE times = 2""",
    "window_ids": f"""{_WINDOWS}, i AS (SELECT m.video, m.no, string_agg('"' || provider || ':' || evidence_id || '"', ',' ORDER BY provider || ':' || evidence_id) AS ids FROM m GROUP BY ALL)
SELECT g.video, start, 'ew_' || substr(sha256('{{"end_sec":' || regexp_replace("end"::DECIMAL(20,6)::VARCHAR, '([.][0-9]+?)0+$', '\\1') || ',"evidence_ids":[' || ids || '],"policy_version":"window_policy_v1","start_sec":' || regexp_replace(start::DECIMAL(20,6)::VARCHAR, '([.][0-9]+?)0+$', '\\1') || ',"video_id":"' || g.video || '"}}'), 1, 24) AS window_id FROM g JOIN i USING (video, no)""",
    "rrf_fusion": f"WITH {_HITS}, b AS (SELECT video, provider, min(rank) AS best FROM h GROUP BY ALL) SELECT video, count(*)::INTEGER AS lanes, round(list_sum(list(1.0::DOUBLE / (60 + best) ORDER BY best)), 9) AS rrf FROM b GROUP BY video",
    "time_filter_after_topk": f"WITH {_HITS} SELECT provider, rank::INTEGER AS rank, evidence_id, anchor FROM h WHERE rank <= {PER_LANE} AND anchor BETWEEN 60 AND 120",
    "interval_clamp": f"WITH {_HITS} SELECT evidence_id, round(lo, 3) AS lo, round(hi, 3) AS hi FROM c WHERE provider = 'asr'",
    "session_dedup": f"""WITH {_HITS}, s AS (SELECT provider, video, evidence_id, round(anchor * 1000)::BIGINT AS start_ms, rank::INTEGER AS native_rank FROM h),
q AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY provider, video ORDER BY start_ms, native_rank) > 2000 THEN 1 ELSE 0 END AS b FROM s),
p AS (SELECT *, sum(b) OVER (PARTITION BY provider, video ORDER BY start_ms, native_rank ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT provider, video, evidence_id, start_ms, native_rank FROM p QUALIFY row_number() OVER (PARTITION BY provider, video, run ORDER BY native_rank, start_ms, evidence_id) = 1""",
}
