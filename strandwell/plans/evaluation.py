"""Comparison, sequence and evaluation queries over events."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.operators import compare as P
from strandwell.operators import evaluate as E
from strandwell.operators import sequence as Q
from strandwell.plans.fusion import ranked
from strandwell.plans.timeline import EVENTS, events

LANES = ["click", "error", "purchase", "view"]
PAIRS = [("click", "view"), ("click", "purchase"), ("view", "purchase"), ("click", "error")]


#: Hits of a lane whose items and videos `lane_jaccard` sets side by side.
COMPARED = 20


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, lane, video, item, start, end, uid, value: all events of each lane for the queries 0 to 4."""
    rows = events(spark, sf_dir).filter(F.col("space").isin(LANES))
    start = F.floor(F.col("ms") % 300_000 / 10_000) * 10
    return rows.select((F.col("uid") % 5).alias("query_id"), F.col("space").alias("lane"), "video", (F.col("uid") % 97).alias("item"), start.alias("start"), (start + 10).alias("end"), "uid", "value")


def _hits(spark: SparkSession, sf_dir: str, top: int | None) -> DataFrame:
    """Each lane's events with their rank, all or the best `top`."""
    order = Window.partitionBy("query_id", "lane").orderBy(F.col("value").desc(), "uid")
    ranked_rows = _found(spark, sf_dir).withColumn("rank", F.row_number().over(order))
    return ranked_rows if top is None else ranked_rows.filter(F.col("rank") <= top)


def _all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, lane, video, rank: all of each lane's events, ranked without one task for a whole lane."""
    rows = _found(spark, sf_dir).withColumnsRenamed({"value": "raw_score", "uid": "evidence_id"})
    return ranked(rows.withColumn("provider", F.concat_ws(":", "lane", "query_id"))).select("query_id", "lane", "video", "rank")


def compare_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.set_algebra(_found(spark, sf_dir), LANES)


def compare_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unique_to_lane(_found(spark, sf_dir))


def compare_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pairwise(_found(spark, sf_dir))


def lane_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pairs of lanes by the items and by the videos of their best hits."""
    return P.agreement(_hits(spark, sf_dir, COMPARED), PAIRS, ["item", "video"])


def lane_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a lane as one run of it; some lanes were not there for a user, some failed."""
    runs = events(spark, sf_dir).groupBy(F.col("space").alias("lane"), "video").agg(F.round(F.sum("value"), 2).alias("latency_ms"), F.count_if(F.col("value") > 20).alias("n"), F.countDistinct(F.col("uid") % 7).alias("videos"))
    status = F.when(F.col("video") % 11 == 3, "UNAVAILABLE").when(F.col("video") % 13 == 5, "ERROR").when(F.col("n") > 0, "OK").otherwise("EMPTY")
    ran = status.isin("OK", "EMPTY")
    return P.rollup(runs.withColumn("status", status).withColumn("hits", F.when(ran, F.col("n")).otherwise(0)).withColumn("videos", F.when(ran, F.col("videos")).otherwise(0)))


def compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall status of each user's lanes, where a lane without large values is in error."""
    by_lane = events(spark, sf_dir).groupBy("video", "space").agg(F.max("value").alias("m"))
    status = F.when(F.col("m") > 30, "OK").when(F.col("m") > 12, "EMPTY").otherwise("ERROR")
    return by_lane.groupBy("video").agg(F.sort_array(F.collect_list(status)).alias("s")).select("video", P.overall_status(F.col("s")).alias("status"))


STEPS = ["click", "view", "purchase"]


def _steps(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    rows = events(spark, sf_dir).filter(F.col("space").isin(STEPS[:n]))
    hits = ranked(rows.select(F.col("space").alias("provider"), F.col("uid").alias("evidence_id"), F.col("value").alias("raw_score"), "video", "ms")).withColumnRenamed("rank", "native_rank")
    index = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("provider")).cast("int") - 1
    end = F.col("ms") + F.when(F.col("provider") == "view", 1000 * (F.col("evidence_id") % 60)).otherwise(0)
    return hits.select(F.lit(1).alias("case_id"), index.alias("step_index"), "video", F.col("ms").alias("start_ms"), end.alias("end_ms"), "native_rank", "evidence_id")


DAY = 86_400_000
CASES = {
    "sequence_2step": dict(total=2, strict=True, min_gap=0, max_gap=4 * DAY, max_span=None),
    "sequence_3step": dict(total=3, strict=True, min_gap=3_600_000, max_gap=8 * DAY, max_span=12 * DAY),
    "sequence_nonstrict": dict(total=3, strict=False, min_gap=0, max_gap=0, max_span=3 * DAY),
}


def _sequence(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        case = CASES[name]
        return Q.match(_steps(spark, sf_dir, case["total"]), **case).drop("case_id")

    return query


def sequence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chains each group has, in the strict three-step case."""
    return Q.match(_steps(spark, sf_dir, 3), **CASES["sequence_3step"]).groupBy("match_group").agg(F.count("*").alias("n"), F.min("ranks").alias("least_ranks"))


DIAGNOSED = dict(total=3, min_gap=3_600_000, max_gap=2 * DAY, max_span=2 * DAY)


def sequence_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why there are few chains: all users' events as three cases by user. Of one no first step is found and its other steps lie far apart, of one a step's search failed."""
    hits = _steps(spark, sf_dir, 3).withColumn("case_id", (F.col("video") % 3).cast("int"))
    late = (F.col("case_id") == 1) & (F.col("step_index") > 0)
    hits = hits.withColumn("start_ms", F.col("start_ms") + F.when(late, F.col("step_index").cast("long") * (900 * DAY)).otherwise(0)).withColumn("end_ms", F.col("end_ms") + F.when(late, F.col("step_index").cast("long") * (900 * DAY)).otherwise(0))
    hits = hits.filter("video IS NOT NULL AND NOT (case_id = 1 AND step_index = 0)")
    statuses = hits.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step_index"))
    statuses = statuses.withColumn("status", F.when((F.col("case_id") == 2) & (F.col("step_index") == 1), "UNAVAILABLE").when((F.col("case_id") == 1) & (F.col("step_index") == 0), "NO_RESULTS").otherwise("OK"))
    # Single hits are no chains here.
    found = Q.match(hits, **DIAGNOSED).filter("matched > 1")
    return Q.diagnose(hits, found, statuses, **DIAGNOSED)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each user."""
    users = events(spark, sf_dir).filter("video IS NOT NULL").select(F.col("video").alias("query_id")).distinct()
    q = F.col("query_id")
    span = lambda lo, width: F.struct(lo.cast("int").alias("lo"), (lo + width).cast("int").alias("hi"))
    return users.select("query_id", (q % 7).alias("gt_video"), F.array(span(q * 5, 150), span(q * 0 + 700, 50), span(q * 11, 200)).alias("ranges"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("video IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.col("value").desc(), "uid")
    u = F.col("uid")
    rows = rows.select(F.col("video").alias("query_id"), "uid", "value").withColumn("rank", F.row_number().over(order)).filter("rank <= 100")
    frames = F.array((u % 1000).cast("int"), (u * 7 % 1000).cast("int"), (u * 13 % 1000).cast("int"))
    return rows.select("query_id", "rank", (u % 7).alias("video"), (u % 1000).cast("int").alias("frame"), frames.alias("frames"))


def kis_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frame_recall(_truth(spark, sf_dir), _predictions(spark, sf_dir))


def video_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.video_recall(_truth(spark, sf_dir), _predictions(spark, sf_dir))


def trake_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.event_score(_truth(spark, sf_dir), _predictions(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kis_recall(spark, sf_dir).withColumn("split", F.lit("DEV")).withColumn("trap", F.concat(F.lit("t"), (F.col("query_id") % 3).cast("string")))
    return found.withColumn("status", F.when(F.col("query_id") % 6 == 5, "BLOCKED").otherwise("SCORED"))


def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(_scored(spark, sf_dir))


def eval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(_scored(spark, sf_dir), "trap")


def prediction_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("frame", F.col("frame") % 40)
    return E.invalid_predictions(rows, 60)


def candidate_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates: every hit of the three lanes, whatever its rank, and every video that has one."""
    found = E.candidates(_all_hits(spark, sf_dir), "click", "view", "purchase", every=True)
    named = found.withColumnsRenamed({"query_id": "provider", "votes": "raw_score", "video": "evidence_id"})
    return ranked(named).select(F.col("provider").alias("query_id"), F.col("rank").alias("place"), F.col("evidence_id").alias("video"), F.col("raw_score").alias("votes"), "lanes")


def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_candidates(_hits(spark, sf_dir, None), LANES)


QUERIES = {
    "compare_set_algebra": compare_set_algebra, "compare_unique": compare_unique, "compare_pairwise": compare_pairwise, "lane_jaccard": lane_jaccard, "lane_rollup": lane_rollup, "compare_status": compare_status,
    **{name: _sequence(name) for name in CASES}, "sequence_groups": sequence_groups, "sequence_diagnostics": sequence_diagnostics,
    "kis_recall": kis_recall, "video_recall": video_recall, "trake_score": trake_score, "eval_aggregate": eval_aggregate, "eval_breakdown": eval_breakdown,
    "prediction_violations": prediction_violations, "candidate_votes": candidate_votes, "review_candidates": review_candidates,
}

_ALL = f"""{EVENTS}, h AS (SELECT uid % 5 AS query_id, space AS lane, video, uid % 97 AS item, (ms % 300000) // 10000 * 10 AS start, (ms % 300000) // 10000 * 10 + 10 AS "end", uid, row_number() OVER (PARTITION BY uid % 5, space ORDER BY value DESC, uid) AS rank FROM e WHERE space IN ('click', 'error', 'purchase', 'view'))"""
_HITS = _ALL.replace("'view'))", f"'view') QUALIFY rank <= {COMPARED})")
_TRUTH = f"""{EVENTS}, g AS (SELECT DISTINCT video AS query_id, video % 7 AS gt_video, [video * 5, 700, video * 11] AS lo, [video * 5 + 150, 750, video * 11 + 200] AS hi FROM e WHERE video IS NOT NULL),
p AS (SELECT video AS query_id, row_number() OVER (PARTITION BY video ORDER BY value DESC, uid) AS rank, uid % 7 AS video, uid % 1000 AS frame, [uid % 1000, uid * 7 % 1000, uid * 13 % 1000] AS frames FROM e WHERE e.video IS NOT NULL QUALIFY rank <= 100)"""
_AT = ", ".join(f"CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r_at_{k}" for k in E.CUTOFFS)
_KIS = f"""{_TRUTH}, f AS (SELECT g.query_id, min(rank)::INTEGER AS first_rank FROM g JOIN p USING (query_id) WHERE video = gt_video AND (frame BETWEEN lo[1] AND hi[1] OR frame BETWEEN lo[2] AND hi[2] OR frame BETWEEN lo[3] AND hi[3]) GROUP BY 1),
k AS (SELECT g.query_id, first_rank, {_AT} FROM g LEFT JOIN f USING (query_id))"""
_MEANS = "count(*) AS n, count(*) FILTER (query_id % 6 <> 5) AS n_scored, count(*) FILTER (query_id % 6 = 5) AS n_blocked, round(avg(first_rank) FILTER (query_id % 6 <> 5), 4) AS mean_first_rank, " + ", ".join(f"round(avg(r_at_{k}) FILTER (query_id % 6 <> 5), 4) AS mean_r_at_{k}" for k in E.CUTOFFS)


def _sequence_sql(total: int, strict: bool, min_gap: int, max_gap: int, max_span: int | None, start: str = "ms", where: str = "TRUE", case: str = "1") -> str:
    """Common table expressions up to z: the chains kept, from one join for every choice of steps."""
    parts = []
    for order, choice in enumerate(c for n in range(total, 0, -1) for c in combinations(range(total), n)):
        names = [f"s{k}" for k in choice]
        first, top = "least(" + ", ".join(f"{n}.start_ms" for n in names) + ")", "greatest(" + ", ".join(f"{n}.end_ms" for n in names) + ")"
        rules = [f"{n}.step_index = {k}" for n, k in zip(names, choice, strict=True)] + [f"{n}.video = {names[0]}.video" for n in names[1:]]
        gaps = [f"({b}.start_ms - {a}.end_ms)" for a, b in zip(names, names[1:], strict=False)]
        if strict:
            rules += [f"{g} BETWEEN {max(0, min_gap)} AND {max_gap}" for g in gaps]
        if max_span is not None:
            rules.append(f"{top} - {first} <= {max_span}")
        parts.append(
            f"SELECT {names[0]}.video, {order} AS choice, {len(choice)} AS matched, '{','.join(map(str, choice))}' AS steps, '{Q.group_of(choice, total)}' AS match_group, {first} AS first, {top} AS top, "
            f"{' + '.join(f'{n}.native_rank' for n in names)} AS ranks, greatest({', '.join(f'{n}.native_rank' for n in names)}) AS worst, {' + '.join(gaps) or '0'} AS gaps, [{', '.join(f'{n}.pos' for n in names)}] AS places, "
            f"concat_ws(',', {', '.join(f'{n}.evidence_id' for n in names)}) AS evidence FROM {', '.join(f'd {n}' for n in names)} WHERE {' AND '.join(rules)}"
        )
    return f"""WITH {EVENTS}, hm AS (SELECT list_position(['click', 'view', 'purchase'], space) - 1 AS step_index, video, ms, uid, space, value,
  row_number() OVER (PARTITION BY space ORDER BY value DESC, uid) AS native_rank FROM e WHERE space IN ({", ".join(repr(s) for s in STEPS[:total])}) ),
h0 AS (SELECT step_index, video, {start} AS start_ms, {start} + CASE WHEN space = 'view' THEN 1000 * (uid % 60) ELSE 0 END AS end_ms, native_rank, uid AS evidence_id FROM hm WHERE {where}),
h1 AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY step_index, video ORDER BY start_ms, native_rank) > 1000 THEN 1 ELSE 0 END AS b FROM h0),
h2 AS (SELECT *, sum(b) OVER (PARTITION BY step_index, video ORDER BY start_ms, native_rank ROWS UNBOUNDED PRECEDING) AS run FROM h1),
h3 AS (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY step_index, video, run ORDER BY native_rank, start_ms, evidence_id) = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY step_index, video ORDER BY start_ms, native_rank, evidence_id) AS pos FROM h3),
u AS ({" UNION ALL ".join(parts)}),
v AS (SELECT * FROM u QUALIFY matched > 1 OR max(matched) OVER (PARTITION BY video) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY choice, places) AS number FROM v QUALIFY number <= 5),
z AS (SELECT match_group, row_number() OVER (PARTITION BY {case}, match_group ORDER BY matched DESC, ranks, worst, top - first, gaps, video, first, number::VARCHAR)::INTEGER AS place, video, steps, matched, evidence, ranks::INTEGER AS ranks, worst::INTEGER AS worst, top - first AS span, gaps::BIGINT AS gaps FROM n QUALIFY place <= 50)"""


ORACLES = {
    "compare_set_algebra": f"WITH {_ALL}, s AS (SELECT query_id, video, count(DISTINCT lane) AS n FROM h GROUP BY ALL) SELECT query_id, count(*) AS n_union, count(*) FILTER (n = 4) AS n_intersection, count(*) FILTER (n = 1) AS n_unique FROM s GROUP BY query_id",
    "compare_unique": f"WITH {_ALL}, s AS (SELECT query_id, video, count(DISTINCT lane) AS n, min(lane) AS only FROM h GROUP BY ALL) SELECT l.query_id, l.lane, count(s.video) AS n_unique FROM (SELECT DISTINCT query_id, lane FROM h) l LEFT JOIN s ON s.query_id = l.query_id AND s.only = l.lane AND s.n = 1 GROUP BY ALL",
    "compare_pairwise": f"""WITH {_ALL}, d AS (SELECT DISTINCT query_id, lane, video FROM h), s AS (SELECT query_id, lane, list(video) AS v FROM d GROUP BY ALL)
SELECT a.query_id, a.lane AS lane_a, b.lane AS lane_b, len(list_intersect(a.v, b.v))::BIGINT AS overlap, round(len(list_intersect(a.v, b.v)) / (len(a.v) + len(b.v) - len(list_intersect(a.v, b.v))), 4) AS jaccard FROM s a JOIN s b ON a.query_id = b.query_id AND a.lane < b.lane""",
    "lane_jaccard": f"""WITH {_HITS}, """ + ", ".join(
        f"""p{i}{kind} AS (SELECT '{a}' AS lane_a, '{b}' AS lane_b, '{kind}' AS kind, count(*) AS queries, round(avg(both_ / (both_ + oa + ob)), 4) AS mean_jaccard, sum(oa)::BIGINT AS only_a, sum(ob)::BIGINT AS only_b, sum(both_)::BIGINT AS shared FROM
(SELECT query_id, sum(a * b) AS both_, sum(a * (1 - b)) AS oa, sum(b * (1 - a)) AS ob FROM (SELECT query_id, {kind}, max((lane = '{a}')::INT) AS a, max((lane = '{b}')::INT) AS b FROM h WHERE lane IN ('{a}', '{b}') GROUP BY ALL) GROUP BY 1))"""
        for i, (a, b) in enumerate(PAIRS) for kind in ("item", "video")
    ) + " " + " UNION ALL ".join(f"SELECT * FROM p{i}{kind}" for i in range(len(PAIRS)) for kind in ("item", "video")),
    "lane_rollup": f"""WITH {EVENTS}, r0 AS (SELECT space AS lane, video, round(sum(value), 2) AS latency, count(*) FILTER (value > 20) AS n, count(DISTINCT uid % 7) AS videos FROM e GROUP BY ALL),
r AS (SELECT *, CASE WHEN video % 11 = 3 THEN 'UNAVAILABLE' WHEN video % 13 = 5 THEN 'ERROR' WHEN n > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM r0)
SELECT lane, count(*) AS executed, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'EMPTY') AS n_empty, count(*) FILTER (status = 'UNAVAILABLE') AS n_unavailable, count(*) FILTER (status = 'ERROR') AS n_error,
round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95, round(avg(CASE WHEN status IN ('OK', 'EMPTY') THEN n ELSE 0 END), 4) AS mean_hits, round(avg(CASE WHEN status IN ('OK', 'EMPTY') THEN videos ELSE 0 END), 4) AS mean_videos FROM r GROUP BY lane""",
    "compare_status": f"""WITH {EVENTS}, m AS (SELECT video, space, max(value) AS m FROM e GROUP BY ALL) SELECT video, CASE WHEN count(*) FILTER (m > 12) = count(*) THEN 'OK' WHEN count(*) FILTER (m > 12) > 0 THEN 'PARTIAL' ELSE 'ERROR' END AS status FROM m GROUP BY video""",
    **{name: f"{_sequence_sql(**case)} SELECT * FROM z" for name, case in CASES.items()},
    "sequence_groups": f"{_sequence_sql(**CASES['sequence_3step'])} SELECT match_group, count(*) AS n, min(ranks) AS least_ranks FROM z GROUP BY match_group",
    "sequence_diagnostics": f"""{_sequence_sql(strict=True, start=f"ms + CASE WHEN video % 3 = 1 AND step_index > 0 THEN step_index * {900 * DAY} ELSE 0 END", where="video IS NOT NULL AND NOT (video % 3 = 1 AND step_index = 0)", case="video % 3", **DIAGNOSED)},
y AS (SELECT (video % 3)::INTEGER AS case_id, count(*) AS chains FROM z WHERE matched > 1 GROUP BY 1), m AS (SELECT video, count(DISTINCT step_index) AS s FROM d GROUP BY 1),
x AS (SELECT (video % 3)::INTEGER AS case_id, count(*) AS videos, count(*) FILTER (s > 1) AS multi_step_videos FROM m GROUP BY 1),
p AS (SELECT (a.video % 3)::INTEGER AS case_id, b.start_ms - a.end_ms AS gap, greatest(a.end_ms, b.end_ms) - least(a.start_ms, b.start_ms) AS span FROM d a JOIN d b ON a.video = b.video AND b.step_index = a.step_index + 1),
c AS (SELECT case_id, count(*) FILTER (gap < 0) AS order_violations, count(*) FILTER (gap >= 0 AND gap < {DIAGNOSED["min_gap"]}) AS gap_too_small, count(*) FILTER (gap > {DIAGNOSED["max_gap"]}) AS gap_too_large,
  count(*) FILTER (gap BETWEEN {DIAGNOSED["min_gap"]} AND {DIAGNOSED["max_gap"]} AND span > {DIAGNOSED["max_span"]}) AS span_violations FROM p GROUP BY 1)
SELECT case_id, videos, multi_step_videos, coalesce(order_violations, 0) AS order_violations, coalesce(gap_too_small, 0) AS gap_too_small, coalesce(gap_too_large, 0) AS gap_too_large, coalesce(span_violations, 0) AS span_violations, coalesce(chains, 0) AS chains,
  CASE WHEN case_id = 2 OR coalesce(chains, 0) = 0 THEN 'PARTIAL' ELSE 'OK' END AS status FROM x LEFT JOIN c USING (case_id) LEFT JOIN y USING (case_id)""",
    "kis_recall": f"WITH {_KIS} SELECT * FROM k",
    "video_recall": f"WITH {_TRUTH}, f AS (SELECT g.query_id, min(rank)::INTEGER AS first_rank FROM g JOIN p USING (query_id) WHERE video = gt_video GROUP BY 1) SELECT g.query_id, first_rank, {_AT} FROM g LEFT JOIN f USING (query_id)",
    "trake_score": f"""WITH {_TRUTH}, r AS (SELECT g.query_id, rank, CASE WHEN video <> gt_video THEN 0 ELSE ((frames[1] BETWEEN lo[1] AND hi[1])::INT + (frames[2] BETWEEN lo[2] AND hi[2])::INT + (frames[3] BETWEEN lo[3] AND hi[3])::INT) / 3 END AS share FROM g JOIN p USING (query_id)),
f AS (SELECT query_id, min(rank) FILTER (share > 0)::INTEGER AS first_rank, {", ".join(f"coalesce(max(share) FILTER (rank <= {k}), 0) AS a{k}" for k in E.CUTOFFS)} FROM r GROUP BY 1)
SELECT g.query_id, first_rank, {", ".join(f"round(coalesce(a{k}, 0), 6) AS r_at_{k}" for k in E.CUTOFFS)}, round(({" + ".join(f"coalesce(a{k}, 0)" for k in E.CUTOFFS)}) / 5, 6) AS score FROM g LEFT JOIN f USING (query_id)""",
    "eval_aggregate": f"WITH {_KIS} SELECT {_MEANS} FROM k",
    "eval_breakdown": f"WITH {_KIS} SELECT 't' || query_id % 3 AS trap, {_MEANS} FROM k GROUP BY 1",
    "prediction_violations": f"""WITH {_TRUTH}, n AS (SELECT query_id, count(*) AS n, count(DISTINCT rank) AS ranks, count(DISTINCT (video, frame % 40)) AS places FROM p GROUP BY 1)
SELECT query_id, 'TOO_MANY' AS code, n - 60 AS n FROM n WHERE n > 60 UNION ALL SELECT query_id, 'REPEATED_RANK', n - ranks FROM n WHERE n > ranks UNION ALL SELECT query_id, 'REPEATED_PLACE', n - places FROM n WHERE n > places""",
    "candidate_votes": f"""WITH {_ALL}, v AS (SELECT query_id, video, lane, CASE WHEN lane = 'click' AND rank BETWEEN 9 AND 40 THEN 50 - rank WHEN lane = 'view' AND rank <= 20 THEN 21 - rank WHEN lane = 'purchase' THEN 30 ELSE 0 END AS v FROM h WHERE lane IN ('click', 'view', 'purchase')),
c AS (SELECT query_id, video, sum(v)::BIGINT AS votes, count(DISTINCT lane) AS lanes FROM v GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, video NULLS FIRST)::INTEGER AS place, video, votes, lanes FROM c""",
    "review_candidates": f"""WITH {_ALL}, c AS (SELECT query_id, video, start, "end", count(DISTINCT lane)::INTEGER AS n_lanes, {', '.join(f'min(rank) FILTER (lane = {x!r})::INTEGER AS rank_{x}' for x in LANES)} FROM h GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n_lanes DESC, {', '.join(f'coalesce(rank_{x}, 999)' for x in LANES)}, video NULLS FIRST, start, "end")::INTEGER AS place, video, start, "end", n_lanes, {', '.join(f'rank_{x}' for x in LANES)} FROM c QUALIFY place <= 8""",
}
