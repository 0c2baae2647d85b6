"""Lanes side by side: set algebra over the videos they return, and agreement of two lanes query by query.

Defined results: a null video is one video; repeated hits count once; a query without hits gives no row, a lane without hits none of its own; no hits give no rows, and
`agreement` a row of no queries with a null mean for each pair and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_algebra(hits: DataFrame, lanes: list[str]) -> DataFrame:
    """query_id, n_union, n_intersection, n_unique (videos of one lane only): videos by the number of lanes that return them.

    The intersection is over all `lanes`: a lane without hits leaves it empty."""
    seen = hits.filter(F.col("lane").isin(lanes)).groupBy("query_id", "video").agg(F.countDistinct("lane").alias("n"))
    return seen.groupBy("query_id").agg(
        F.count("*").alias("n_union"), F.count_if(F.col("n") == len(set(lanes))).alias("n_intersection"), F.count_if(F.col("n") == 1).alias("n_unique")
    )


def unique_to_lane(hits: DataFrame) -> DataFrame:
    """query_id, lane, n_unique."""
    only = hits.groupBy("query_id", "video").agg(F.countDistinct("lane").alias("n"), F.min("lane").alias("only"))
    mine = only.filter("n = 1").groupBy("query_id", F.col("only").alias("lane")).agg(F.count("*").alias("n_unique"))
    every = hits.select("query_id", "lane").distinct()
    return every.join(mine, ["query_id", "lane"], "left").select("query_id", "lane", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def pairwise(hits: DataFrame) -> DataFrame:
    """query_id, lane_a, lane_b, overlap, jaccard (4 digits) of every two lanes.

    Each video lists its lanes (few), and pairs of these are counted; nothing is joined with itself."""
    lanes = hits.select("query_id", "lane", "video").distinct()
    sizes = lanes.groupBy("query_id", "lane").agg(F.count("*").alias("n"))
    by_video = lanes.groupBy("query_id", "video").agg(F.sort_array(F.collect_list("lane")).alias("lanes"))
    one = by_video.select("query_id", "lanes", F.posexplode("lanes").alias("at", "lane_a"))
    both = one.select("query_id", "lane_a", F.explode(F.slice("lanes", F.col("at") + 2, F.size("lanes"))).alias("lane_b")).groupBy("query_id", "lane_a", "lane_b").agg(F.count("*").alias("overlap"))
    a, b = sizes.select("query_id", F.col("lane").alias("lane_a"), F.col("n").alias("n_a")), sizes.select("query_id", F.col("lane").alias("lane_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "query_id").filter("lane_a < lane_b").join(both, ["query_id", "lane_a", "lane_b"], "left")
    overlap = F.coalesce("overlap", F.lit(0))
    return pairs.select("query_id", "lane_a", "lane_b", overlap.alias("overlap"), F.round(overlap / (F.col("n_a") + F.col("n_b") - overlap), 4).alias("jaccard"))


def agreement(hits: DataFrame, pairs: list[tuple[str, str]], kinds: list[str]) -> DataFrame:
    """lane_a, lane_b, kind, queries, mean_jaccard, only_a, only_b, shared: for each pair of lanes and each kind of thing that they find (a column).

    The mean is over the queries where either lane finds anything; counts are of things within queries, added up over them."""
    found = None
    for lane_a, lane_b in pairs:
        mine = hits.filter(F.col("lane").isin(lane_a, lane_b))
        for kind in kinds:
            sides = mine.groupBy("query_id", kind).agg(F.max((F.col("lane") == lane_a).cast("int")).alias("a"), F.max((F.col("lane") == lane_b).cast("int")).alias("b"))
            by_query = sides.groupBy("query_id").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_a"), F.sum(F.col("b") * (1 - F.col("a"))).alias("only_b"))
            jaccard = F.col("both") / (F.col("both") + F.col("only_a") + F.col("only_b"))
            one = by_query.agg(F.count("*").alias("queries"), F.round(F.avg(jaccard), 4).alias("mean_jaccard"), F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"), F.sum("both").alias("shared"))
            named = one.select(F.lit(lane_a).alias("lane_a"), F.lit(lane_b).alias("lane_b"), F.lit(kind).alias("kind"), "*")
            found = named if found is None else found.unionByName(named)
    return found


STATUSES = ("OK", "EMPTY", "UNAVAILABLE", "ERROR")


def rollup(runs: DataFrame) -> DataFrame:
    """lane, executed, n_ok, n_empty, n_unavailable, n_error, p50, p95 (interpolated), mean_hits, mean_videos of runs (lane, status, latency_ms, hits, videos)."""
    return runs.groupBy("lane").agg(
        F.count("*").alias("executed"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES], F.round(F.percentile("latency_ms", 0.5), 4).alias("p50"),
        F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"), F.round(F.avg("hits"), 4).alias("mean_hits"), F.round(F.avg("videos"), 4).alias("mean_videos"),
    )


def overall_status(statuses: Column) -> Column:
    """OK if every lane is OK or EMPTY, PARTIAL if some is, else ERROR."""
    fine = F.filter(statuses, lambda s: s.isin("OK", "EMPTY"))
    return F.when(F.size(fine) == F.size(statuses), "OK").when(F.size(fine) > 0, "PARTIAL").otherwise("ERROR")
