"""Decisions of annotators: what is wrong with them, and the labels once they are applied.

Decisions are rows of (query_id, decision, video_id, start_frame, representative_frame, end_frame, answer_text, events), events being an array of
(event_order, start_frame, representative_frame, end_frame); labels have query_id and query_type (KIS, QA or TRAKE). Nothing is applied while there are violations:
`apply_exact` and `apply_video` take checked decisions.

Defined results: a null decision is an unknown one; a query that is decided twice is a violation and not a choice; labels without a decision, or with one that is
UNREVIEWED, stay as they are; no decisions change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The decisions that there are.
EXACT = ("UNREVIEWED", "VERIFIED", "NEEDS_MORE_REVIEW", "NOT_FOUND_IN_CURRENT_POOL", "UNRESOLVED")
VIDEO = ("UNREVIEWED", "VIDEO_VERIFIED", "NOT_FOUND_IN_CURRENT_POOL", "NEEDS_MORE_REVIEW", "UNRESOLVED")
MANUAL = "INTERNAL_MANUAL_VERIFIED"


def _range_ok(start: Column, middle: Column, end: Column) -> Column:
    """Whether three frame numbers are there, not negative and in order."""
    return F.coalesce((start >= 0) & (start <= middle) & (middle <= end), F.lit(False))


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def exact_violations(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, code, n: UNKNOWN_QUERY, REPEATED_QUERY, BAD_DECISION, and of verified ones NO_VIDEO, BAD_RANGE, NO_ANSWER, NO_EVENTS, BAD_EVENT, BAD_ORDER."""
    known = labels.select(F.col("query_id").alias("_q"), "query_type").dropDuplicates(["_q"])
    met = decisions.join(known, F.col("query_id") == F.col("_q"), "left")
    sure, kind = F.col("decision") == "VERIFIED", F.col("query_type")
    framed = sure & kind.isin("KIS", "QA")
    good = _range_ok(F.col("start_frame"), F.col("representative_frame"), F.col("end_frame"))
    events, n = F.col("events"), F.coalesce(F.size("events"), F.lit(-1))
    each = F.forall(events, lambda e: F.coalesce(e["event_order"] >= 0, F.lit(False)) & _range_ok(e["start_frame"], e["representative_frame"], e["end_frame"]))
    ordered = F.array_sort(F.transform(events, lambda e: e["event_order"])) == F.sequence(F.lit(0), n - 1)
    some = sure & (kind == "TRAKE") & (n > 0)
    codes = F.array(
        F.when(F.col("_q").isNull(), "UNKNOWN_QUERY"), F.when(~F.coalesce(F.col("decision").isin(*EXACT), F.lit(False)), "BAD_DECISION"),
        F.when(sure & kind.isNotNull() & _blank(F.col("video_id")), "NO_VIDEO"), F.when(framed & ~good, "BAD_RANGE"), F.when(sure & (kind == "QA") & _blank(F.col("answer_text")), "NO_ANSWER"),
        F.when(sure & (kind == "TRAKE") & (n < 1), "NO_EVENTS"), F.when(some & ~each, "BAD_EVENT"), F.when(some & ~F.coalesce(ordered, F.lit(False)), "BAD_ORDER"),
    )
    found = met.select("query_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    twice = decisions.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").select("query_id", F.lit("REPEATED_QUERY").alias("code"), "n")
    return found.groupBy("query_id", "code").agg(F.count("*").alias("n")).unionByName(twice)


def video_violations(decisions: DataFrame, labels: DataFrame, videos: DataFrame) -> DataFrame:
    """query_id, code, n: UNKNOWN_QUERY, REPEATED_QUERY, BAD_DECISION, and of verified ones NO_VIDEO or UNKNOWN_VIDEO (not in the registry `videos`)."""
    known = labels.select(F.col("query_id").alias("_q")).distinct()
    registry = videos.select(F.col("video_id").alias("_v")).distinct()
    met = decisions.join(known, F.col("query_id") == F.col("_q"), "left").join(registry, F.col("video_id") == F.col("_v"), "left")
    sure = F.col("decision") == "VIDEO_VERIFIED"
    codes = F.array(
        F.when(F.col("_q").isNull(), "UNKNOWN_QUERY"), F.when(~F.coalesce(F.col("decision").isin(*VIDEO), F.lit(False)), "BAD_DECISION"),
        F.when(sure & _blank(F.col("video_id")), "NO_VIDEO"), F.when(sure & ~_blank(F.col("video_id")) & F.col("_v").isNull(), "UNKNOWN_VIDEO"),
    )
    found = met.select("query_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    twice = decisions.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").select("query_id", F.lit("REPEATED_QUERY").alias("code"), "n")
    return found.groupBy("query_id", "code").agg(F.count("*").alias("n")).unionByName(twice)


def apply_exact(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """query_id, query_type, label_status, provenance, gt_video, ranges, answer_text of every label, with its decision applied.

    A verified decision labels with its frames (events in their order); one that found nothing labels with nothing, and open ones take the label away."""
    d = decisions.select("query_id", F.col("decision").alias("_d"), F.col("video_id").alias("_v"), "start_frame", "representative_frame", "end_frame", F.col("answer_text").alias("_a"), "events")
    met = labels.join(d, "query_id", "left")
    sure, gone = F.col("_d") == "VERIFIED", F.col("_d").isin("NOT_FOUND_IN_CURRENT_POOL", "NEEDS_MORE_REVIEW", "UNRESOLVED")
    one = F.array(F.struct(F.col("start_frame").alias("lo"), F.col("representative_frame").alias("at"), F.col("end_frame").alias("hi")))
    many = F.transform(F.array_sort("events", lambda a, b: a["event_order"] - b["event_order"]), lambda e: F.struct(e["start_frame"].alias("lo"), e["representative_frame"].alias("at"), e["end_frame"].alias("hi")))
    choose = lambda yes, old, none=None: F.when(sure, yes).when(gone, F.lit(none)).otherwise(old)
    status = F.when(sure | (F.col("_d") == "NOT_FOUND_IN_CURRENT_POOL"), "labeled").when(gone, "unlabeled_reference").otherwise(F.col("label_status"))
    return met.select(
        "query_id", "query_type", status.alias("label_status"), F.when(sure | gone, MANUAL).otherwise(F.col("provenance")).alias("provenance"), choose(F.col("_v"), F.col("gt_video")).alias("gt_video"),
        choose(F.when(F.col("query_type") == "TRAKE", many).otherwise(one), F.col("ranges")).alias("ranges"), choose(F.when(F.col("query_type") == "QA", F.col("_a")).otherwise(F.col("answer_text")), F.col("answer_text")).alias("answer_text"),
    )


def apply_video(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """The labels with video_status, video_provenance and verified_video of their decisions; null where there is none."""
    d = decisions.filter("decision <> 'UNREVIEWED'").select("query_id", F.col("decision").alias("_d"), F.col("video_id").alias("_v"))
    met = labels.join(d, "query_id", "left")
    sure = F.col("_d") == "VIDEO_VERIFIED"
    settled = sure | (F.col("_d") == "NOT_FOUND_IN_CURRENT_POOL")
    return met.withColumns({"video_status": F.when(sure, "VERIFIED").otherwise(F.col("_d")), "video_provenance": F.when(settled, MANUAL), "verified_video": F.when(sure, F.col("_v"))}).drop("_d", "_v")
