"""Scores of ranked predictions against ground truth, and their summaries.

Defined results: a question without predictions has no first rank and scores 0; null videos and frames are never right; of repeated ranks each counts; a query_id that
stands twice in the truth gives two rows; no truth gives no rows, and a summary of no rows counts 0 with null means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 20, 50, 100)


def recalls(rank: Column) -> list[Column]:
    """r_at_k for every cutoff: 1 if the first right rank is at k or better, else 0."""
    return [F.when(rank <= k, 1.0).otherwise(0.0).alias(f"r_at_{k}") for k in CUTOFFS]


def frame_recall(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """query_id, first_rank, r_at_k: the first prediction in the right video and in one of the frame ranges, ends included."""
    met = predictions.join(truth, "query_id")
    inside = (F.col("video") == F.col("gt_video")) & F.exists("ranges", lambda r: (F.col("frame") >= r["lo"]) & (F.col("frame") <= r["hi"]))
    first = met.filter(inside).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return truth.select("query_id").join(first, "query_id", "left").select("query_id", "first_rank", *recalls(F.col("first_rank")))


def video_recall(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """query_id, first_rank, r_at_k: the first prediction in the right video."""
    first = predictions.join(truth, "query_id").filter(F.col("video") == F.col("gt_video")).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return truth.select("query_id").join(first, "query_id", "left").select("query_id", "first_rank", *recalls(F.col("first_rank")))


def event_score(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """query_id, first_rank, r_at_k, score: the best share of events hit in their order of place among the first k; score is the mean over k.

    `ranges` of the truth are the events; `frames` of a prediction one frame for each event, else the prediction is an error."""
    met = predictions.join(truth, "query_id")
    wrong = F.raise_error(F.concat(F.lit("frames do not match events of query "), F.col("query_id").cast("string")))
    hits = F.aggregate(F.zip_with("ranges", "frames", lambda r, f: ((f >= r["lo"]) & (f <= r["hi"])).cast("int")), F.lit(0), lambda s, x: s + x)
    n = F.size("ranges")
    share = F.when(F.size("frames") != n, wrong.cast("double")).when((F.col("video") != F.col("gt_video")) | (n == 0), 0.0).otherwise(hits / n)
    rated = met.withColumn("share", share)
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("share"))), F.lit(0.0)).alias(f"r_at_{k}") for k in CUTOFFS]
    found = rated.groupBy("query_id").agg(F.min(F.when(F.col("share") > 0, F.col("rank"))).alias("first_rank"), *best)
    whole = truth.select("query_id").join(found, "query_id", "left")
    filled = [F.round(F.coalesce(f"r_at_{k}", F.lit(0.0)), 6).alias(f"r_at_{k}") for k in CUTOFFS]
    mean = sum((F.coalesce(f"r_at_{k}", F.lit(0.0)) for k in CUTOFFS[1:]), F.coalesce("r_at_1", F.lit(0.0))) / len(CUTOFFS)
    return whole.select("query_id", "first_rank", *filled, F.round(mean, 6).alias("score"))


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Counts by status and means over the scored rows, for each value of `by`, or for all.

    `scored` has status, split, first_rank and r_at_k; rows of several splits are an error."""
    splits = F.countDistinct("split")
    ok = F.col("status") == "SCORED"
    one = F.when(splits > 1, F.raise_error(F.lit("rows of several splits")).cast("long")).otherwise(F.count("*"))
    return scored.groupBy(*by).agg(
        one.alias("n"), F.count_if(ok).alias("n_scored"), F.count_if(F.col("status") == "BLOCKED").alias("n_blocked"), F.round(F.avg(F.when(ok, F.col("first_rank"))), 4).alias("mean_first_rank"),
        *[F.round(F.avg(F.when(ok, F.col(f"r_at_{k}"))), 4).alias(f"mean_r_at_{k}") for k in CUTOFFS],
    )


def invalid_predictions(predictions: DataFrame, most: int = 100) -> DataFrame:
    """query_id, code, n: queries with too many predictions, repeated ranks or repeated (video, frame)."""
    per_query = predictions.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.countDistinct(F.struct("video", "frame")).alias("places"))
    codes = F.array(
        F.struct(F.lit("TOO_MANY").alias("code"), (F.col("n") - most).alias("n")), F.struct(F.lit("REPEATED_RANK").alias("code"), (F.col("n") - F.col("ranks")).alias("n")),
        F.struct(F.lit("REPEATED_PLACE").alias("code"), (F.col("n") - F.col("places")).alias("n")),
    )
    return per_query.select("query_id", F.explode(codes).alias("c")).select("query_id", "c.code", "c.n").filter("n > 0")


#: Ranks of the whole query that vote, hits of a phrase and of speech that do, and candidates that are kept.
WHOLE_RANKS, PHRASE_RANKS, KEPT = (9, 40), 20, 20


def candidates(hits: DataFrame, whole: str, phrase: str, speech: str, every: bool = False) -> DataFrame:
    """query_id, video, votes, lanes: all videos with votes.

    A hit of the whole query has 50 - rank votes at ranks 9 to 40 (the first eight are looked at anyway), one of a phrase 21 - rank among its 20 best,
    one of speech 30 among its 20 best. With `every`, all hits of speech vote, and hits whose rank has no votes make their video a candidate too."""
    rank, lane = F.col("rank"), F.col("lane")
    heard = (lane == speech) & (F.lit(every) | (rank <= PHRASE_RANKS))
    vote = F.when((lane == whole) & rank.between(*WHOLE_RANKS), 50 - rank).when((lane == phrase) & (rank <= PHRASE_RANKS), PHRASE_RANKS + 1 - rank).when(heard, F.lit(30))
    if every:
        vote = vote.when(lane.isin(whole, phrase), F.lit(0))
    cast = hits.withColumn("v", vote).filter("v IS NOT NULL")
    return cast.groupBy("query_id", "video").agg(F.sum("v").cast("long").alias("votes"), F.countDistinct("lane").alias("lanes"))


def votes(hits: DataFrame, whole: str, phrase: str, speech: str, keep: int = KEPT) -> DataFrame:
    """query_id, place, video, votes, lanes: the `keep` candidates of the most votes of each query, ties to the smaller video."""
    found = candidates(hits, whole, phrase, speech)
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "video")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("query_id", "place", "video", "votes", "lanes")


def review_candidates(hits: DataFrame, lanes: list[str], keep: int = 8) -> DataFrame:
    """query_id, place, video, start, end, n_lanes and the best rank in each lane: the `keep` windows of each query that are to be looked at.

    `hits` are windows (query_id, lane, video, start, end, rank). Windows of several lanes are one by video, start and end; those of more lanes come first, then
    the better rank in the first lane, the second and so on, where a missing rank counts as 999, then video and start."""
    key = ["query_id", "video", "start", "end"]
    best = hits.groupBy(*key).pivot("lane", lanes).agg(F.min("rank"))
    n = sum((F.col(x).isNotNull().cast("int") for x in lanes[1:]), F.col(lanes[0]).isNotNull().cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n_lanes"), *[F.coalesce(x, F.lit(999)) for x in lanes], "video", "start", "end")
    placed = best.withColumn("n_lanes", n).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    return placed.select("query_id", "place", "video", "start", "end", "n_lanes", *[F.col(x).alias(f"rank_{x}") for x in lanes])


BLOCKED, UNLABELLED = "BLOCKED_BY_SCORING_CONTRACT", "UNLABELED"
#: Scorers by type of query; None stands for a type whose scoring is not agreed.
SCORERS = {"KIS": frame_recall, "TRAKE": event_score, "QA": None}


def score_by_type(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """query_id, query_type, status, first_rank, r_at_k of every query by its type's scorer; `truth` also has query_type and label_status.

    A type without a scorer fails the query."""
    unknown = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce("query_type", F.lit("null")))).cast("boolean")
    known = truth.filter(F.when(F.col("query_type").isin(list(SCORERS)), True).otherwise(unknown))
    open_ = known.filter(F.col("label_status") != "unlabeled_reference")
    blank = [F.lit(None).cast("int").alias("first_rank"), *[F.lit(None).cast("double").alias(f"r_at_{k}") for k in CUTOFFS]]
    out = known.filter(~(F.col("label_status") != "unlabeled_reference")).select("query_id", "query_type", F.lit(UNLABELLED).alias("status"), *blank)
    for kind, scorer in SCORERS.items():
        mine = open_.filter(F.col("query_type") == kind)
        if scorer is None:
            part = mine.select("query_id", "query_type", F.lit(BLOCKED).alias("status"), *blank)
        else:
            part = scorer(mine, predictions).select("query_id", F.lit(kind).alias("query_type"), F.lit("SCORED").alias("status"), "first_rank", *[f"r_at_{k}" for k in CUTOFFS])
        out = out.unionByName(part)
    return out
