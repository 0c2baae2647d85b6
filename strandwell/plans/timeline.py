"""Timeline queries: events as frames, users as videos, event types as spaces of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.functions import scalars as C
from strandwell.operators import timeline as T
from strandwell.sources.tables import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, uid, ms, space, value; ms are milliseconds from the start of 2024."""
    rows = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    return rows.select(F.col("user_id").alias("video"), F.col("event_id").alias("uid"), F.floor(micros / 1000).cast("long").alias("ms"), F.col("event_type").alias("space"), "value")


def _space(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("space") == name).select("video", "uid", "ms")


def _probes(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("space") == name).select("video", F.col("uid").alias("probe"), F.col("ms").alias("target_ms"))


def window_points_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return T.points_near(_space(rows, "click"), _probes(rows, "purchase"), 600_000)


def _intervals(rows: DataFrame) -> DataFrame:
    return _space(rows, "view").select("video", "uid", F.col("ms").alias("start_ms"), (F.col("ms") + 1000 * (F.col("uid") % 900)).alias("end_ms"))


def interval_overlap_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return T.intervals_near(_intervals(rows), _probes(rows, "purchase"), 300_000)


def nearest_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return T.nearest(_space(rows, "click"), _probes(rows, "purchase")).select("video", "probe", "target_ms", "uid", "ms", "delta_ms", "status")


def nearest_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return T.nearest(_space(rows, "signup"), _probes(rows, "error")).select("probe", "before_uid", "before_ms", "after_uid", "after_ms", "uid")


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    there = T.nearest(_space(rows, "view"), _probes(rows, "click")).withColumn("direction", F.lit("click to view"))
    back = T.nearest(_space(rows, "click"), _probes(rows, "view")).withColumn("direction", F.lit("view to click"))
    return there.unionByName(back)


def nearest_cross_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross(spark, sf_dir).select("direction", "probe", "uid", "delta_ms")


def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cross(spark, sf_dir)
    parts = [T.distribution(found.filter(F.col("direction") == d), F.col("delta_ms")).withColumn("direction", F.lit(d)) for d in ("click to view", "view to click")]
    return parts[0].unionByName(parts[1])


def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 probes that are farthest from their nearest frame."""
    found = _cross(spark, sf_dir).filter("direction = 'click to view'").withColumn("gap_ms", F.abs("delta_ms"))
    return found.orderBy(F.col("gap_ms").desc_nulls_last(), "probe").limit(20).select("video", "probe", "gap_ms")


def segment_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    middle = _intervals(rows).select("video", F.col("uid").alias("probe"), T.midpoint(F.col("start_ms"), F.col("end_ms")).alias("target_ms"))
    return T.nearest(_space(rows, "click"), middle).select("probe", "target_ms", "uid", "delta_ms")


def video_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer: nation, orders and their lines as counts and sums, and the latest order."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = items.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    mine = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.round(F.coalesce(F.sum("quantity"), F.lit(0.0)), 2).alias("quantity"),
        F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest_order"),
    )
    met = customers.join(mine, customers["c_custkey"] == mine["o_custkey"], "left").join(nations, customers["c_nationkey"] == nations["n_nationkey"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return met.select("c_custkey", "n_name", zero("orders"), zero("lines"), zero("quantity"), "latest_order")


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame and time arithmetic over events, with frame rates that are sometimes missing."""
    rows = events(spark, sf_dir).withColumn("fps", F.when(F.col("uid") % 7 > 0, (F.col("uid") % 5) * 7.5))
    frame = C.frame_of(F.col("ms") / 1000, F.col("fps"))
    return rows.select(
        "uid", frame.alias("frame"), C.seconds_of(F.col("uid"), F.col("fps")).alias("seconds"), C.submission_frame(F.col("ms") / 1000, F.col("fps")).alias("submission"),
        C.clamp(frame, F.lit(100_000)).alias("clamped"), C.clock(F.col("value") * 7).alias("clock"), C.millis(F.col("value")).alias("value_ms"),
    )


QUERIES = {
    "window_points_near": window_points_near, "interval_overlap_near": interval_overlap_near, "nearest_keyframe": nearest_keyframe, "nearest_before_after": nearest_before_after,
    "nearest_cross_space": nearest_cross_space, "delta_stats": delta_stats, "top_gaps": top_gaps, "segment_midpoints": segment_midpoints,
    "video_drilldown": video_drilldown, "frame_times": frame_times,
}

EVENTS = "e AS (SELECT user_id AS video, event_id AS uid, epoch_us(ts) // 1000 - 1704067200000 AS ms, event_type AS space, value FROM events)"


def _nearest_sql(name: str, frames: str, probes: str) -> str:
    """Common table expressions up to {name}: probe with before, after and nearest, by sorting all frames of the video around each probe."""
    return f"""
f{name} AS ({frames}), p{name} AS ({probes}),
b{name} AS (SELECT probe, arg_min(uid, (-ms, uid)) AS before_uid, max(ms) AS before_ms FROM (SELECT p.probe, f.uid, f.ms FROM p{name} p JOIN f{name} f ON f.video = p.video AND f.ms <= p.target_ms) GROUP BY probe),
a{name} AS (SELECT probe, arg_min(uid, (ms, uid)) AS after_uid, min(ms) AS after_ms FROM (SELECT p.probe, f.uid, f.ms FROM p{name} p JOIN f{name} f ON f.video = p.video AND f.ms >= p.target_ms) GROUP BY probe),
n{name} AS (SELECT probe, arg_min(uid, (abs(ms - target_ms), ms, uid)) AS uid, arg_min(ms, (abs(ms - target_ms), ms, uid)) AS ms FROM (SELECT p.probe, p.target_ms, f.uid, f.ms FROM p{name} p JOIN f{name} f ON f.video = p.video) GROUP BY probe),
{name} AS (SELECT p.video, p.probe, p.target_ms, before_uid, before_ms, after_uid, after_ms, uid, ms, ms - target_ms AS delta_ms, CASE WHEN uid IS NULL THEN 'NO_KEYFRAME' ELSE 'OK' END AS status
  FROM p{name} p LEFT JOIN b{name} USING (probe) LEFT JOIN a{name} USING (probe) LEFT JOIN n{name} USING (probe))"""


_F = "SELECT video, uid, ms FROM e WHERE space = '{}'"
_P = "SELECT video, uid AS probe, ms AS target_ms FROM e WHERE space = '{}'"
_I = "i AS (SELECT video, uid, ms AS start_ms, ms + 1000 * (uid % 900) AS end_ms FROM e WHERE space = 'view')"
_CROSS = f"WITH {EVENTS}, {_nearest_sql('_x', _F.format('view'), _P.format('click'))}, {_nearest_sql('_y', _F.format('click'), _P.format('view'))}, z AS (SELECT 'click to view' AS direction, * FROM _x UNION ALL SELECT 'view to click', * FROM _y)"
_FPS = "CASE WHEN fps > 0 THEN fps ELSE 25.0::DOUBLE END"

ORACLES = {
    "window_points_near": f"WITH {EVENTS} SELECT p.uid AS probe, f.uid, f.ms, f.ms - p.ms AS delta_ms FROM e p JOIN e f ON p.space = 'purchase' AND f.space = 'click' AND p.video = f.video AND f.ms BETWEEN greatest(0, p.ms - 600000) AND p.ms + 600000",
    "interval_overlap_near": f"WITH {EVENTS}, {_I} SELECT p.uid AS probe, i.uid, start_ms, end_ms FROM e p JOIN i ON p.space = 'purchase' AND p.video = i.video AND end_ms >= p.ms - 300000 AND start_ms <= p.ms + 300000",
    "nearest_keyframe": f"WITH {EVENTS}, {_nearest_sql('x', _F.format('click'), _P.format('purchase'))} SELECT video, probe, target_ms, uid, ms, delta_ms, status FROM x",
    "nearest_before_after": f"WITH {EVENTS}, {_nearest_sql('x', _F.format('signup'), _P.format('error'))} SELECT probe, before_uid, before_ms, after_uid, after_ms, uid FROM x",
    "nearest_cross_space": f"{_CROSS} SELECT direction, probe, uid, delta_ms FROM z",
    "delta_stats": f"{_CROSS}, d AS (SELECT direction, abs(delta_ms) AS d FROM z) SELECT direction, count(d) AS n, min(d) AS min_ms, round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.9), 3) AS p90, round(quantile_cont(d, 0.95), 3) AS p95, round(quantile_cont(d, 0.99), 3) AS p99, max(d) AS max_ms, round(avg(d), 3) AS mean_ms FROM d GROUP BY direction",
    "top_gaps": f"{_CROSS} SELECT video, probe, abs(delta_ms) AS gap_ms FROM z WHERE direction = 'click to view' ORDER BY gap_ms DESC NULLS LAST, probe LIMIT 20",
    "segment_midpoints": f"WITH {EVENTS}, {_I}, {_nearest_sql('x', _F.format('click'), 'SELECT video, uid AS probe, (start_ms + end_ms) // 2 AS target_ms FROM i')} SELECT probe, target_ms, uid, delta_ms FROM x",
    "video_drilldown": """
WITH l AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1),
m AS (SELECT o_custkey, count(*) AS orders, coalesce(sum(lines), 0) AS lines, round(coalesce(sum(quantity), 0), 2) AS quantity, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey, n_name, coalesce(orders, 0) AS orders, coalesce(lines, 0)::BIGINT AS lines, coalesce(quantity, 0)::DOUBLE AS quantity, latest_order FROM customer LEFT JOIN m ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "frame_times": f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN uid % 7 > 0 THEN (uid % 5) * 7.5::DOUBLE END AS fps FROM e)
SELECT uid, round_even(ms / 1000 * ({_FPS}), 0)::BIGINT AS frame, round(uid / ({_FPS}), 6) AS seconds, floor(ms / 1000 * round({_FPS}, 2))::BIGINT AS submission,
greatest(0, least(round_even(ms / 1000 * ({_FPS}), 0)::BIGINT, 99999)) AS clamped, printf('%02d:%02d', floor(value * 7)::BIGINT // 60, floor(value * 7)::BIGINT % 60) AS clock, round_even(value * 1000, 0)::BIGINT AS value_ms FROM g""",
}
