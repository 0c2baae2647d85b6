"""Object and facet queries: lineitem rows as detections, parts as frames with facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.operators import structured as S
from strandwell.sources.tables import table

K = 50


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame"), F.concat("l_returnflag", "l_linestatus").alias("class_name"),
        F.round(F.col("l_quantity") / 50, 6).alias("score"), F.col("l_linenumber").alias("ordinal"),
    )


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by order alone: an order is a frame of one video."""
    return S.postings(_detections(spark, sf_dir).withColumn("video", F.col("frame") % 100))


def _best(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("score").desc(), "video", "frame").limit(K)


def object_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _frames(spark, sf_dir)
    return found.withColumn("top_scores", F.concat_ws(",", F.transform("top_scores", lambda x: F.format_number(x, 2))))


def class_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_dictionary(_frames(spark, sf_dir))


def object_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(S.search_objects(_frames(spark, sf_dir), ["RF"], True, 0.9))


def object_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(S.search_objects(_frames(spark, sf_dir), ["RF", "AF", "NO"], True, 0.3))


def object_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(S.search_objects(_frames(spark, sf_dir), ["RF", "AO"], False, 0.5))


def object_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = _frames(spark, sf_dir)
    return _best(S.search_objects(posted, ["RF", "AF"], True, 0.2, scope=[3, 7, 11]))


def object_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a known and an unknown class: nothing; any of them: the known one's frames."""
    posted = _frames(spark, sf_dir)
    names = S.resolve(["rf", "no such class"], S.class_dictionary(posted))
    none = S.search_objects(posted, names, True, 0.98, asked=2).withColumn("mode", F.lit("all"))
    return none.unionByName(S.search_objects(posted, names, False, 0.98).withColumn("mode", F.lit("any")))


def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    pair = lambda namespace, value: F.struct(F.lit(namespace).alias("namespace"), value.alias("value"))
    size = F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string"))
    pairs = F.array(pair("brand", F.lower("p_brand")), pair("type", F.lower("p_type")), pair("size", size), pair("name", F.lower("p_name")))
    rows = parts.select(F.col("p_partkey").alias("frame"), (F.col("p_partkey") % 40).alias("video"), F.explode(pairs).alias("f"))
    return rows.select("frame", "video", "f.namespace", "f.value", F.concat_ws("/", "f.namespace", "f.value").alias("facet_id"))


def facet_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facet_frequency(_facets(spark, sf_dir))


WANTED = [(1, "size/size 1"), (1, "type/economy"), (1, "brand/brand#2"), (2, "size/size 4"), (2, "type/standard"), (2, "no/such facet")]


def facet_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = _facets(spark, sf_dir)
    wanted = spark.createDataFrame(WANTED, "query_id int, facet_id string")
    total = table(spark, sf_dir, "part").count()
    found = S.facet_scores(facets, wanted, F.lit(total), S.facet_frequency(facets)).withColumn("matched", F.concat_ws(",", "matched"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "frame")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K).drop("rank")


#: A name as it stands with marks and punctuation, a type, a word of names, and words of which one is none.
DISCOVERED = ["  Réd RING! ", "economy", "ring", "red nothing"]


def facet_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _facets(spark, sf_dir).select("facet_id", "value").distinct()
    found = None
    for text in DISCOVERED:
        one = S.discover(words, text).withColumn("asked", F.lit(text))
        found = one if found is None else found.unionByName(one)
    return found


def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facets(spark, sf_dir).groupBy("namespace").agg(F.count("*").alias("n"))


def vocabulary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary_audit(_facets(spark, sf_dir).select("namespace", "value"))


QUERIES = {
    "object_postings": object_postings, "class_dictionary": class_dictionary, "object_single": object_single, "object_all": object_all, "object_any": object_any,
    "object_scoped": object_scoped, "object_unknown": object_unknown, "facet_df": facet_df, "facet_score_topk": facet_score_topk, "facet_discover": facet_discover,
    "namespace_counts": namespace_counts, "vocabulary_audit": vocabulary_audit,
}

_POSTED = """
WITH d AS (SELECT l_orderkey % 100 AS video, l_orderkey AS frame, l_returnflag || l_linestatus AS class_name, round(l_quantity / 50, 6) AS score, l_linenumber AS ordinal FROM lineitem),
p AS (SELECT video, frame, class_name, round(max(score), 6) AS max_score, count(*) AS detection_count, arg_max(ordinal, score * 1000 - ordinal / 1000.0) AS top_ordinal,
  list_sort(list(score), 'DESC') AS scores FROM d GROUP BY ALL)
"""
_CUT = f"ORDER BY score DESC, video, frame LIMIT {K}"
_ALL = lambda names, least, more="": f"SELECT video, frame, min(max_score) AS score FROM p WHERE max_score >= {least} AND class_name IN ({names}) {more} GROUP BY ALL HAVING count(DISTINCT class_name) = {names.count(',') + 1}"
_FACETS = """
WITH f AS (SELECT p_partkey AS frame, p_partkey % 40 AS video, unnest([{'namespace': 'brand', 'value': lower(p_brand)}, {'namespace': 'type', 'value': lower(p_type)},
  {'namespace': 'size', 'value': 'size ' || (p_size // 10)}, {'namespace': 'name', 'value': lower(p_name)}]) AS x FROM part),
g AS (SELECT frame, video, x.namespace AS namespace, x.value AS value, x.namespace || '/' || x.value AS facet_id FROM f)
"""
def _discover(text: str) -> str:
    plain = text.strip(" !").lower().replace("é", "e")
    words = ", ".join(f"'{w}'" for w in text.strip(" !").lower().split())
    return f"""(WITH v AS (SELECT DISTINCT facet_id, value, ' ' || array_to_string(regexp_extract_all(value, '[a-z0-9_]+'), ' ') || ' ' AS t FROM g),
c AS (SELECT facet_id, CASE WHEN value = '{plain}' THEN 0 WHEN contains(t, ' {plain} ') THEN 1 WHEN len(list_intersect(string_split(t, ' '), [{words}])) > 0 THEN 2 END AS stage FROM v)
SELECT '{text}' AS asked, facet_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY facet_id) AS n, min(stage) OVER () AS least FROM c WHERE stage IS NOT NULL) WHERE (stage < 2 OR least = 2) AND (stage = 0 OR n <= 25))"""


_W = ", ".join(f"({q}, '{f}')" for q, f in WANTED)
ORACLES = {
    "object_postings": f"""{_POSTED} SELECT video, frame, class_name, max_score, detection_count, top_ordinal, array_to_string(list_transform(scores[1:5], lambda x: printf('%.2f', x)), ',') AS top_scores FROM p""",
    "class_dictionary": f"{_POSTED} SELECT class_name, count(*) AS frame_count, sum(detection_count)::BIGINT AS detection_count, max(max_score) AS max_score, min(max_score) AS min_score, row_number() OVER (ORDER BY class_name)::INTEGER AS class_id FROM p GROUP BY class_name",
    "object_single": f"{_POSTED} {_ALL(repr('RF'), 0.9)} {_CUT}",
    "object_all": f"{_POSTED} {_ALL(repr('RF') + ',' + repr('AF') + ',' + repr('NO'), 0.3)} {_CUT}",
    "object_any": f"{_POSTED} SELECT video, frame, max(max_score) AS score FROM p WHERE max_score >= 0.5 AND class_name IN ('RF', 'AO') GROUP BY ALL {_CUT}",
    "object_scoped": f"{_POSTED} {_ALL(repr('RF') + ',' + repr('AF'), 0.2, 'AND video IN (3, 7, 11)')} {_CUT}",
    "object_unknown": f"{_POSTED} SELECT video, frame, max(max_score) AS score, 'any' AS mode FROM p WHERE max_score >= 0.98 AND class_name = 'RF' GROUP BY ALL",
    "facet_df": f"{_FACETS} SELECT facet_id, count(DISTINCT frame) AS df_frames, count(DISTINCT video) AS df_videos FROM g GROUP BY facet_id",
    "facet_score_topk": f"""{_FACETS}, w AS (SELECT * FROM (VALUES {_W}) w(query_id, facet_id)), n AS (SELECT facet_id, count(DISTINCT frame) AS df FROM g GROUP BY 1), t AS (SELECT count(*) AS total FROM part),
s AS (SELECT query_id, facet_id, round(ln((total + 1) / (df + 1)) + 1, 4) AS weight FROM w JOIN n USING (facet_id), t),
h AS (SELECT DISTINCT query_id, video, frame, facet_id, weight FROM g JOIN s USING (facet_id))
SELECT * FROM (SELECT query_id, video, frame, round(sum(weight), 4) AS score, string_agg(facet_id, ',' ORDER BY facet_id) AS matched FROM h GROUP BY query_id, video, frame) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame) <= {K}""",
    "facet_discover": f"{_FACETS} {' UNION ALL '.join(map(_discover, DISCOVERED))}",
    "namespace_counts": f"{_FACETS} SELECT namespace, count(*) AS n FROM g GROUP BY namespace",
    "vocabulary_audit": f"""{_FACETS}, r AS (SELECT namespace, value, length(value) AS len, row_number() OVER (PARTITION BY namespace ORDER BY length(value), value) - 1 AS r, count(*) OVER (PARTITION BY namespace) AS n FROM g)
SELECT namespace, count(*) AS n, count(DISTINCT value) AS n_distinct, max(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN len END)::INTEGER AS p50, max(CASE WHEN r = least(floor(n * 0.9), n - 1) THEN len END)::INTEGER AS p90, max(CASE WHEN r = least(floor(n * 0.99), n - 1) THEN len END)::INTEGER AS p99 FROM r GROUP BY namespace""",
}
