"""Validators of registries, segments, frames, shards and evaluation sets over tables with planted faults; scoring by type; vector matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.operators import dense as D
from strandwell.operators import evaluate as E
from strandwell.operators import validate as V
from strandwell.plans.evaluation import _TRUTH, _predictions, _truth
from strandwell.plans.timeline import EVENTS, events
from strandwell.sources.tables import table


def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as videos: every tenth has a bad id, every fifteenth a wrong series, every twentieth a path upwards, and ordinal 5 comes twice."""
    k = F.col("s_suppkey")
    series = F.format_string("L%02d", (k % 20).cast("int"))
    name = F.when(k % 10 == 3, F.concat(F.lit("bad"), k)).otherwise(F.concat(series, F.format_string("_V%03d", (k % 1000).cast("int"))))
    ordinal = F.when(k == 6, 5).otherwise(k)
    path = F.concat(F.when(k % 20 == 9, F.lit("../")).otherwise(F.lit("")), F.lit("videos/"), k.cast("string"), F.lit(".mp4"))
    videos = table(spark, sf_dir, "supplier").select(name.alias("video_id"), ordinal.alias("ordinal"), path.alias("relpath"), F.when(k % 15 == 4, "L99").otherwise(series).alias("series"))
    return V.registry_violations(videos, 101)


def segment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments with planted faults; a user is expected to have 66."""
    u, rows = F.col("uid"), events(spark, sf_dir)
    box = F.when(u % 2 == 0, F.array(F.lit(0.0), F.lit(0.0), (u % 50).cast("double") - 1, F.lit(10.0)))
    segments = rows.select(
        F.when(u % 1000 == 1, u - 1).otherwise(u).alias("segment_id"), "video", F.col("ms").alias("start_ms"), (F.col("ms") + F.when(u % 97 == 5, -5).otherwise(900)).alias("end_ms"),
        F.when(u % 89 == 7, F.lit("  ")).otherwise(F.col("space")).alias("text"), F.when(u % 83 == 2, "HALF").otherwise("OK").alias("status"), box.alias("box"), F.when(u % 500 != 499, u).alias("row"),
    )
    expected = rows.select("video").filter("video IS NOT NULL").distinct().withColumn("n", F.lit(66))
    return V.segment_violations(segments, expected, ["OK", "ERROR"])


def frame_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sampled frames at 25 a second."""
    n, v = F.col("l_linenumber"), F.col("l_orderkey")
    fps = F.when(F.col("l_quantity") == 50, 0.0).otherwise(25.0)
    frame = (n * 100 + F.col("l_suppkey")).alias("frame_idx")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") == 1, F.concat_ws("-", v, n)).otherwise(F.concat_ws(":", v, n)).alias("uid"), v.alias("video"), n.alias("n"), fps.alias("fps"), frame,
        F.bround((n * 100 + F.col("l_suppkey")) * 1000 / 25.0, 0).cast("long").alias("ms"), F.when(F.col("l_quantity") == 2, n).otherwise(n - 1).alias("row"),
    )
    return V.frame_violations(rows)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a video whose length is a hundred days and an hour for each number."""
    users = events(spark, sf_dir).filter("video IS NOT NULL").select("video").distinct()
    return users.withColumn("duration_ms", F.lit(15 * 86_400_000) + F.col("video") * 3_600_000)


def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.out_of_range(events(spark, sf_dir), _spans(spark, sf_dir))


def samples_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.samples_along(events(spark, sf_dir), _spans(spark, sf_dir), "uid")


def shard_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of 40 shards."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select((k % 40).alias("shard"), F.when(k % 1500 == 7, k - 1).otherwise(k).alias("item_id"), F.when(k % 4000 == 11, "PENDING").when(k % 10 == 1, "ERROR").otherwise("OK").alias("state"))
    counts = items.groupBy("shard").agg(F.count("*").alias("n"))
    s = F.col("shard")
    shards = counts.select("shard", F.when(s == 3, 2).otherwise(1).alias("schema_version"), F.lit("m").alias("manifest_sha"), F.when(s == 9, "c2").otherwise("c1").alias("config_sha"), (F.col("n") + F.when(s % 13 == 5, 1).otherwise(0)).alias("item_count"))
    return V.shard_violations(items, shards)


TYPES, TRAPS, STATUSES = ["KIS", "QA", "TRAKE"], ["t0", "t1", "t2"], ["verified", "unlabeled_reference"]


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, span = F.col("c_custkey"), lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    ranges = F.when(k % 8 == 0, none).otherwise(F.array(span(k, k + F.when(k % 31 == 4, -1).otherwise(40))))
    return table(spark, sf_dir, "customer").select(
        F.when(k % 300 == 2, k - 1).otherwise(k).alias("query_id"), F.when(k % 41 == 0, "OTHER").otherwise(F.element_at(F.array(*map(F.lit, TYPES)), (k % 3 + 1).cast("int"))).alias("query_type"),
        F.concat(F.lit("t"), (k % 3).cast("string")).alias("trap"), F.when(k % 3 == 0, "holdout").otherwise("dev").alias("split"), F.when(k % 4 == 0, "unlabeled_reference").otherwise("verified").alias("label_status"),
        F.when(k % 4 > 0, k % 7).alias("gt_video"), ranges.alias("ranges"), F.when(k % 5 == 1, F.sha2("c_name", 256)).when(k % 53 == 0, "none").alias("sha"), F.when(k % 59 == 1, " ").otherwise(F.col("c_name")).alias("text"),
    )


def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dataset_violations(_dataset(spark, sf_dir), TYPES, TRAPS, STATUSES)


def score_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as queries of three types, some of them without labels."""
    q = F.col("query_id")
    truth = _truth(spark, sf_dir).withColumn("query_type", F.element_at(F.array(*map(F.lit, TYPES)), (q % 3 + 1).cast("int"))).withColumn("label_status", F.when(q % 10 == 9, "unlabeled_reference").otherwise("verified"))
    return E.score_by_type(truth, _predictions(spark, sf_dir))


def item_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of order lines with the frame that their file names, and the vector that goes with some."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("video"), F.concat(F.lit("ocr/"), F.col("l_orderkey").cast("string"), F.lit(".json")).alias("path"), F.col("l_linenumber").alias("text_index"))
    frames = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("video"), F.col("o_orderkey").cast("string").alias("stem"), F.col("o_orderstatus").alias("frame"))
    known = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    lost = known.select(F.concat(F.lit("ocr/"), F.col("l_orderkey").cast("string"), F.lit(".json")).alias("path"))
    met = V.with_item_frames(items.join(lost, "path", "left_anti"), frames, "path")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("stem"), (F.col("label") % 7 + 1).alias("text_index"), F.lit(True).alias("dense"))
    return met.join(vectors, ["stem", "text_index"], "left").groupBy("video", "frame").agg(F.count("*").alias("n"), F.count("dense").alias("n_dense"))


def ocr_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of items, lines as items."""
    box = F.when(F.col("l_linenumber") % 3 > 0, F.array(*[F.lit(float(k)) for k in range(4)])).otherwise(F.array(F.lit(1.0)))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("text"), (F.col("l_quantity") / 50).alias("confidence"), box.alias("box"))).alias("items"))
    return V.sweep(table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select((F.col("o_custkey") % 50).alias("video"), "items"), 0.5)


def vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of labels as videos, labels in falling order, even places only."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), place.alias("n"), "vec_id", "embedding")
    videos = vectors.select("video").distinct().withColumn("ordinal", -F.col("video"))
    found = D.matrix_rows(vectors.filter("n % 2 = 0"), vectors.select("video", "n", F.struct("vec_id", F.size("embedding").alias("dims")).alias("vector")), videos)
    return found.select("row", "video", "n", "vector.vec_id", "vector.dims")


QUERIES = {
    "registry_violations": registry_violations, "segment_violations": segment_violations, "frame_violations": frame_violations, "out_of_range": out_of_range, "samples_along": samples_along,
    "shard_violations": shard_violations, "dataset_violations": dataset_violations, "score_registry": score_registry, "item_frames": item_frames, "ocr_sweep": ocr_sweep, "vector_matrix": vector_matrix,
}

_SPANS = f"WITH {EVENTS}, d AS (SELECT DISTINCT video, 15 * 86400000::BIGINT + video * 3600000 AS duration_ms FROM e WHERE video IS NOT NULL)"
_RATES = ", ".join(f"r_at_{k}" for k in E.CUTOFFS)
_NULLS = ", ".join(f"NULL::DOUBLE AS r_at_{k}" for k in E.CUTOFFS)
ORACLES = {
    "registry_violations": r"""WITH b AS (SELECT s_suppkey AS k, printf('L%02d', s_suppkey % 20) AS s FROM supplier),
v AS (SELECT k, CASE WHEN k % 10 = 3 THEN 'bad' || k ELSE s || printf('_V%03d', k % 1000) END AS id, CASE WHEN k = 6 THEN 5 ELSE k END AS o, CASE WHEN k % 20 = 9 THEN '../' ELSE '' END || 'videos/' || k || '.mp4' AS p, CASE WHEN k % 15 = 4 THEN 'L99' ELSE s END AS series FROM b)
SELECT 'ID' AS code, o::VARCHAR AS entity, id AS detail FROM v WHERE k % 10 = 3 UNION ALL SELECT 'SERIES', o::VARCHAR, series FROM v WHERE k % 15 = 4 OR k % 10 = 3 UNION ALL SELECT 'UNSAFE_PATH', o::VARCHAR, p FROM v WHERE k % 20 = 9
UNION ALL SELECT 'COUNT', 'table', count(*)::VARCHAR FROM v HAVING count(*) <> 101 UNION ALL SELECT 'REPEATED_ID', id, count(*)::VARCHAR FROM v GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'REPEATED_ORDINAL', o::VARCHAR, count(*)::VARCHAR FROM v GROUP BY o HAVING count(*) > 1 UNION ALL SELECT 'REPEATED_PATH', p, count(*)::VARCHAR FROM v GROUP BY p HAVING count(*) > 1
UNION ALL SELECT 'ORDINAL_GAP', 'table', (max(o) - count(DISTINCT o))::VARCHAR FROM v HAVING max(o) <> count(DISTINCT o)""",
    "segment_violations": f"""WITH {EVENTS}, s AS (SELECT uid, CASE WHEN uid % 1000 = 1 THEN uid - 1 ELSE uid END AS id, video, ms, ms + CASE WHEN uid % 97 = 5 THEN -5 ELSE 900 END AS stop, CASE WHEN uid % 500 <> 499 THEN uid END AS r FROM e)
SELECT 'STATUS' AS code, id::VARCHAR AS entity, 'HALF' AS detail FROM s WHERE uid % 83 = 2 UNION ALL SELECT 'INTERVAL', id::VARCHAR, ms || '..' || stop FROM s WHERE NOT (ms >= 0 AND stop >= ms) UNION ALL SELECT 'EMPTY_TEXT', id::VARCHAR, '' FROM s WHERE uid % 89 = 7
UNION ALL SELECT 'BOX', id::VARCHAR, '0.0,0.0,' || printf('%.1f', uid % 50 - 1.0) || ',10.0' FROM s WHERE uid % 2 = 0 AND uid % 50 <= 1 UNION ALL SELECT 'REPEATED_ID', id::VARCHAR, count(*)::VARCHAR FROM s GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'REPEATED_ROW', r::VARCHAR, count(*)::VARCHAR FROM s WHERE r IS NOT NULL GROUP BY r HAVING count(*) > 1 UNION ALL SELECT 'ROW', 'table', max(r)::VARCHAR FROM s HAVING max(r) + 1 <> count(r)
UNION ALL SELECT 'VIDEO_COUNT', video::VARCHAR, count(*)::VARCHAR FROM s WHERE video IS NOT NULL GROUP BY video HAVING count(*) <> 66""",
    "frame_violations": r"""WITH f AS (SELECT l_orderkey || CASE WHEN l_quantity = 1 THEN '-' ELSE ':' END || l_linenumber AS uid, l_linenumber AS n, l_quantity AS q, l_linenumber * 100 + l_suppkey AS frame FROM lineitem)
SELECT 'UID' AS code, uid AS entity, uid AS detail FROM f WHERE q = 1 UNION ALL SELECT 'FPS', uid, '0.0' FROM f WHERE q = 50 UNION ALL SELECT 'MS', uid, (frame * 40)::VARCHAR FROM f WHERE q = 50 UNION ALL SELECT 'ROW', uid, n::VARCHAR FROM f WHERE q = 2
UNION ALL SELECT 'REPEATED_ID', uid, count(*)::VARCHAR FROM f GROUP BY uid HAVING count(*) > 1""",
    "out_of_range": f"{_SPANS} SELECT e.video, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM e JOIN d USING (video) WHERE ms < 0 OR ms > duration_ms + 1000 GROUP BY e.video",
    "samples_along": f"{_SPANS}, p AS (SELECT e.video, uid, (['early', 'mid', 'late'])[least(2, floor(ms * 3 / greatest(1, duration_ms)))::INT + 1] AS part FROM e JOIN d USING (video) WHERE ms BETWEEN 0 AND duration_ms) SELECT video, part, arg_min(uid, (md5(uid::VARCHAR), uid)) AS uid FROM p GROUP BY video, part",
    "shard_violations": """WITH i AS (SELECT o_orderkey % 40 AS s, CASE WHEN o_orderkey % 1500 = 7 THEN o_orderkey - 1 ELSE o_orderkey END AS id, o_orderkey % 4000 <> 11 AS ended FROM orders), c AS (SELECT s, count(*) AS n, count(*) FILTER (ended) AS e FROM i GROUP BY s)
SELECT 'SCHEMA' AS code, s::VARCHAR AS entity, '2' AS detail FROM c WHERE s = 3 UNION ALL SELECT 'ITEM_COUNT', s::VARCHAR, n::VARCHAR FROM c WHERE s % 13 = 5 UNION ALL SELECT 'UNFINISHED', s::VARCHAR, e::VARCHAR FROM c WHERE e <> n
UNION ALL SELECT 'REPEATED_ITEM', id::VARCHAR, count(*)::VARCHAR FROM i GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'MIXED_CONFIG', 'shards', '2'""",
    "dataset_violations": """WITH k AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 300 = 2 THEN c_custkey - 1 ELSE c_custkey END AS id FROM customer)
SELECT 'TYPE' AS code, id::VARCHAR AS entity, 'OTHER' AS detail FROM k WHERE k % 41 = 0 UNION ALL SELECT 'TEXT', id::VARCHAR, '' FROM k WHERE k % 59 = 1 UNION ALL SELECT 'RANGES', id::VARCHAR, '1' FROM k WHERE k % 8 <> 0 AND k % 31 = 4
UNION ALL SELECT 'UNLABELLED', id::VARCHAR, NULL FROM k WHERE k % 4 = 0 AND k % 8 <> 0 UNION ALL SELECT 'SHA', id::VARCHAR, 'none' FROM k WHERE k % 53 = 0 AND k % 5 <> 1
UNION ALL SELECT 'REPEATED_ID', id::VARCHAR, count(*)::VARCHAR FROM k GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'HOLDOUT_SHARE', 'set', p::VARCHAR FROM (SELECT round(count(*) FILTER (k % 3 = 0) / count(*), 4) AS p FROM k) WHERE NOT p BETWEEN 0.2 AND 0.3""",
    "score_registry": f"""WITH {_TRUTH}, kf AS (SELECT g.query_id, min(rank)::INTEGER AS first_rank FROM g JOIN p USING (query_id) WHERE video = gt_video AND (frame BETWEEN lo[1] AND hi[1] OR frame BETWEEN lo[2] AND hi[2] OR frame BETWEEN lo[3] AND hi[3]) GROUP BY 1),
r AS (SELECT g.query_id, rank, CASE WHEN video <> gt_video THEN 0 ELSE ((frames[1] BETWEEN lo[1] AND hi[1])::INT + (frames[2] BETWEEN lo[2] AND hi[2])::INT + (frames[3] BETWEEN lo[3] AND hi[3])::INT) / 3 END AS share FROM g JOIN p USING (query_id)),
tf AS (SELECT query_id, min(rank) FILTER (share > 0)::INTEGER AS first_rank, {", ".join(f"round(coalesce(max(share) FILTER (rank <= {k}), 0), 6) AS r_at_{k}" for k in E.CUTOFFS)} FROM r GROUP BY 1)
SELECT query_id, (['KIS', 'QA', 'TRAKE'])[query_id % 3 + 1] AS query_type, 'UNLABELED' AS status, NULL::INTEGER AS first_rank, {_NULLS} FROM g WHERE query_id % 10 = 9
UNION ALL SELECT query_id, 'QA', 'BLOCKED_BY_SCORING_CONTRACT', NULL, {", ".join("NULL" for _ in E.CUTOFFS)} FROM g WHERE query_id % 10 <> 9 AND query_id % 3 = 1
UNION ALL SELECT g.query_id, 'KIS', 'SCORED', first_rank, {", ".join(f"CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for k in E.CUTOFFS)} FROM g LEFT JOIN kf USING (query_id) WHERE g.query_id % 10 <> 9 AND g.query_id % 3 = 0
UNION ALL SELECT g.query_id, 'TRAKE', 'SCORED', first_rank, {", ".join(f"coalesce(r_at_{k}, 0)" for k in E.CUTOFFS)} FROM g LEFT JOIN tf USING (query_id) WHERE g.query_id % 10 <> 9 AND g.query_id % 3 = 2""",
    "item_frames": """SELECT l_orderkey % 40 AS video, o_orderstatus AS frame, count(*) AS n, count(vec_id) AS n_dense FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN embeddings ON vec_id = l_orderkey AND label % 7 + 1 = l_linenumber GROUP BY 1, 2""",
    "ocr_sweep": """WITH i AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_quantity / 50 >= 0.5) AS kept, count(*) FILTER (l_linenumber % 3 > 0) AS boxed FROM lineitem GROUP BY 1)
SELECT o_custkey % 50 AS video, count(*) AS n_files, coalesce(sum(n), 0)::BIGINT AS n_items, coalesce(sum(kept), 0)::BIGINT AS n_kept, coalesce(sum(boxed), 0)::BIGINT AS n_boxed FROM orders LEFT JOIN i ON o_orderkey = k GROUP BY 1""",
    "vector_matrix": "WITH v AS (SELECT label AS video, vec_id, len(embedding) AS dims, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS n FROM embeddings) SELECT row_number() OVER (ORDER BY video DESC, n) - 1 AS row, video, n, vec_id, dims::INTEGER AS dims FROM v WHERE n % 2 = 0",
}
