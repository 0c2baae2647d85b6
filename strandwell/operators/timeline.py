"""Lookups on timelines: windows around points, nearest frames, distances between two spaces of frames.

Frames are rows of (video, uid, ms). Nearest-neighbour joins put probes and frames of a video on one axis and carry the last frame
seen from the left and from the right along it, so each is one shuffle and one sort by video, whatever the number of probes.
A video with very many rows can be cut by `span_ms`: rows are then dealt by video and span of time, and the nearest frame
of a neighbouring span is joined in from a table of one row for each span.

Defined results: rows with a null video or time meet nothing; frames of one time count as the one of the smallest uid; repeated probes give a row each; a probe whose
video has no frames is NO_KEYFRAME in `nearest` and gives no row elsewhere; no probes give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def points_near(frames: DataFrame, probes: DataFrame, width_ms: int = 5000) -> DataFrame:
    """probe, uid, ms, delta_ms: the frames within `width_ms` of each probe of their video, ends included.

    Time is cut into cells as wide as the window; a probe looks into its cell and the two beside it."""
    cell = lambda ms: F.floor(ms / width_ms)
    left = probes.select("video", "probe", "target_ms", F.explode(F.array(*[cell(F.col("target_ms")) + d for d in (-1, 0, 1)])).alias("cell"))
    right = frames.select("video", "uid", "ms", cell(F.col("ms")).alias("cell"))
    met = left.join(right, ["video", "cell"])
    inside = F.col("ms").between(F.greatest(F.lit(0), F.col("target_ms") - width_ms), F.col("target_ms") + width_ms)
    return met.filter(inside).select("probe", "uid", "ms", (F.col("ms") - F.col("target_ms")).alias("delta_ms"))


def intervals_near(intervals: DataFrame, probes: DataFrame, width_ms: int = 15_000) -> DataFrame:
    """probe, uid, start_ms, end_ms: the intervals of a probe's video that reach into its window.

    An interval stands in every cell that it touches; a pair is taken from the first cell that both share."""
    cell = lambda ms: F.floor(ms / (2 * width_ms))
    spread = lambda lo, hi: F.explode(F.sequence(cell(lo), cell(hi)))
    lo, hi = F.col("target_ms") - width_ms, F.col("target_ms") + width_ms
    left = probes.select("video", "probe", "target_ms", cell(lo).alias("p0"), spread(lo, hi).alias("cell"))
    right = intervals.select("video", "uid", "start_ms", "end_ms", cell(F.col("start_ms")).alias("i0"), spread(F.col("start_ms"), F.col("end_ms")).alias("cell"))
    met = left.join(right, ["video", "cell"]).filter(F.col("cell") == F.greatest("p0", "i0"))
    return met.filter((F.col("end_ms") >= lo) & (F.col("start_ms") <= hi)).select("probe", "uid", "start_ms", "end_ms")


def nearest(frames: DataFrame, probes: DataFrame, span_ms: int = HOUR_MS) -> DataFrame:
    """video, probe, target_ms, before_uid, before_ms, after_uid, after_ms, uid, ms, delta_ms, status for every probe.

    Before and after include a frame at the probe's very time. The nearest is the one of the least distance, then of the earlier
    time, then of the smaller uid; among frames of one time the smallest uid counts. Status is OK, or NO_KEYFRAME for a video without frames."""
    moments = frames.groupBy("video", "ms").agg(F.min("uid").alias("uid"))
    span = F.floor(F.col("ms") / span_ms)
    at = F.struct("ms", "uid")
    axis = moments.select("video", "ms", span.alias("span"), at.alias("frame"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    asked = probes.select("video", F.col("target_ms").alias("ms"), F.floor(F.col("target_ms") / span_ms).alias("span"), F.lit(None).cast(axis.schema["frame"].dataType).alias("frame"), "probe")
    rows = axis.unionByName(asked)
    here = Window.partitionBy("video", "span").orderBy("ms")
    seen = rows.select(
        "*",
        F.max("frame").over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("b"),
        F.min("frame").over(here.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("a"),
    ).filter(F.col("probe").isNotNull())
    # One row for each span that has frames or probes: the nearest frames outside of it.
    spans = rows.groupBy("video", "span").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    order = Window.partitionBy("video").orderBy("span")
    outside = spans.select(
        "video", "span",
        F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    met = seen.join(outside, ["video", "span"])
    before, after = F.coalesce("b", "earlier"), F.coalesce("a", "later")
    rows = met.select("video", "probe", F.col("ms").alias("target_ms"), before.alias("b"), after.alias("a"))
    distance = lambda f: F.struct(F.abs(f["ms"] - F.col("target_ms")).alias("d"), f["ms"].alias("ms"), f["uid"].alias("uid"))
    best = F.least(F.when(F.col("b").isNotNull(), distance(F.col("b"))), F.when(F.col("a").isNotNull(), distance(F.col("a"))))
    rows = rows.withColumn("n", best)
    return rows.select(
        "video", "probe", "target_ms", F.col("b.uid").alias("before_uid"), F.col("b.ms").alias("before_ms"), F.col("a.uid").alias("after_uid"), F.col("a.ms").alias("after_ms"),
        F.col("n.uid").alias("uid"), F.col("n.ms").alias("ms"), (F.col("n.ms") - F.col("target_ms")).alias("delta_ms"),
        F.when(F.col("n").isNull(), "NO_KEYFRAME").otherwise("OK").alias("status"),
    )


def distribution(deltas: DataFrame, value: Column) -> DataFrame:
    """n, min, p50, p90, p95, p99, max, mean of absolute distances, one row; percentiles are interpolated."""
    d = F.abs(value)
    at = lambda p: F.round(F.percentile(d, p), 3).alias(f"p{int(p * 100)}")
    return deltas.agg(F.count(d).alias("n"), F.min(d).alias("min_ms"), at(0.5), at(0.9), at(0.95), at(0.99), F.max(d).alias("max_ms"), F.round(F.avg(d), 3).alias("mean_ms"))


def midpoint(start_ms: Column, end_ms: Column) -> Column:
    """The middle of an interval in whole milliseconds, rounded down."""
    return F.floor((start_ms + end_ms) / 2)
