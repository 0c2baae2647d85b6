"""Exact dense search: cosine similarity of query vectors with every row, many queries at a time.

Query vectors are broadcast after a check of their number (`MOST_QUERIES`); beyond it, blocks of queries meet blocks of rows. The rows are scanned once, and
each task keeps what can still be among the best. Scores are ranked as they are and rounded where they are shown. Vectors are compared in double precision. `vectors`
keeps them in a stored index, which this module's expressions prepare and check.

Defined results: vectors that are null, of another length, zero or not finite are left out; equal scores rank by uid, null first; repeated uids are rows of their own;
fewer than k rows give fewer; no rows or no queries give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def finite(v: Column) -> Column:
    """Whether every component is a finite number."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def normalised(table: DataFrame, uid: str, vector: str, *keep: str) -> DataFrame:
    """uid, unit (vector of length 1), and the kept columns, of the rows that can be compared."""
    rows = table.select(F.col(uid).alias("uid"), F.col(vector).cast("array<double>").alias("v"), *keep)
    rows = rows.filter(F.col("v").isNotNull() & finite(F.col("v"))).withColumn("n", norm(F.col("v"))).filter("n > 0")
    return rows.select("uid", F.transform("v", lambda x: x / F.col("n")).alias("unit"), *keep)


def scored(rows: DataFrame, queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """query_id, uid, score: cosine of each query (query_id, target) with each row of the same length.

    Beyond `most` queries, every pair of a block of `most` queries and a block of rows is a key of the join."""
    n, near = queries.count(), F.size("unit") == F.size("target")
    if n <= most:
        met = rows.join(F.broadcast(queries), near)
    else:
        q, r = -(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        left = rows.withColumn("_r", F.pmod(F.xxhash64("uid"), F.lit(r)).cast("int")).withColumn("_q", each(q))
        right = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q)).cast("int")).withColumn("_r", each(r))
        met = left.join(right, ["_q", "_r"]).filter(near).drop("_q", "_r")
    return met.withColumn("score", dot(F.col("unit"), F.col("target")))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; the window keeps k rows of each task before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def self_check(best: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, best, best_score, ok: whether the best row found for each query is the query itself or scores as high as it does with itself."""
    own = queries.select("query_id", dot(F.col("target"), F.col("target")).alias("own_score"))
    met = own.join(best.filter("rank = 1").select("query_id", F.col("uid").alias("best"), F.col("score").alias("best_score")), "query_id", "left")
    ok = F.coalesce((F.col("best") == F.col("query_id")) | (F.col("own_score") <= F.col("best_score")), F.lit(False))
    return met.select("query_id", "best", F.round("best_score", 6).alias("best_score"), ok.alias("ok"))


def matrix_rows(wanted: DataFrame, vectors: DataFrame, videos: DataFrame) -> DataFrame:
    """row, video, n, vector: the wanted frames (video, n from 1) with their vectors (video, n, vector), in order of the videos' ordinals and of n.

    Rows are numbered from running sums over videos. A frame beyond its video's vectors fails the query."""
    known = vectors.withColumn("_there", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no vector for "), F.concat_ws(":", "video", "n"))).cast("boolean")
    met = wanted.select("video", "n").join(known, ["video", "n"], "left").filter(F.when(F.col("_there").isNull(), lost).otherwise(True)).drop("_there")
    sizes = wanted.groupBy("video").agg(F.count("*").alias("c")).join(videos.select("video", "ordinal"), "video")
    # A row for each video.
    starts = sizes.select("video", F.coalesce(F.sum("c").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("video").orderBy("n")) - 1
    return met.withColumn("_p", place).join(starts, "video").select((F.col("start") + F.col("_p")).alias("row"), "video", "n", "vector")


def sanity(table: DataFrame, vector: str) -> DataFrame:
    """One row: vectors, unusable vectors, lengths, and the least, mean and greatest norm."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & finite(v)
    n = F.when(good, norm(v))
    return table.agg(
        F.count("*").alias("n_vectors"), F.count_if(~F.coalesce(good, F.lit(False))).alias("n_bad"), F.countDistinct(F.size(v)).alias("n_dims"),
        F.round(F.min(n), 5).alias("min_norm"), F.round(F.avg(n), 5).alias("mean_norm"), F.round(F.max(n), 5).alias("max_norm"),
    )
