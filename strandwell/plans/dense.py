"""Vector queries over embeddings; a row's vector stands in for an encoded text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators import dense as D
from strandwell.operators import vectors as V
from strandwell.sources.store import stored
from strandwell.sources.tables import table

K = 10
#: Rows of a block of the stored vectors.
BLOCK_ROWS = 512
CHECK_EVERY = 64
QUERY_IDS = [3, 17, 42, 101, 256, 333, 404]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.normalised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _queries(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("uid").isin(QUERY_IDS)).select(F.col("uid").alias("query_id"), F.col("unit").alias("target"), F.col("label").alias("query_label"))


def vector_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the unit vectors lie; built by the first query that asks for them, in whichever session."""
    rows = _rows(spark, sf_dir)
    return stored(spark, "vectors", [f"{sf_dir}/embeddings.parquet"], {"keep": ["label"], "block_rows": BLOCK_ROWS}, lambda path, _: V.write(rows, path, BLOCK_ROWS))


def _search(spark: SparkSession, sf_dir: str, k: int = K, **how) -> DataFrame:
    return V.search(spark, vector_index(spark, sf_dir), _queries(_rows(spark, sf_dir)), k, **how)


def _shape(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", F.col("uid").alias("vec_id"), F.round("score", 6).alias("score"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(_search(spark, sf_dir))


def scoped_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows among those of the query's label: the scope comes first, so k rows are found if there are k."""
    return _shape(_search(spark, sf_dir, same=("label", "query_label")))


def scoped_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of all, of which those of the query's label are kept: may be fewer than k."""
    labels = _rows(spark, sf_dir).select("uid", "label")
    asked = F.broadcast(_queries(_rows(spark, sf_dir)).select("query_id", "query_label"))  # a request's vectors
    return _shape(_search(spark, sf_dir).join(asked, "query_id").join(labels, "uid").filter("label = query_label"))


def per_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best rows of every label for each query: one index for each label."""
    return _search(spark, sf_dir, 3, group="label").select("query_id", "label", "rank", F.col("uid").alias("vec_id"), F.round("score", 6).alias("score"))


def selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64th vector by its id is asked for; the nearest row must be its own, or one as near."""
    rows = _rows(spark, sf_dir)
    asked = rows.filter(F.pmod("uid", F.lit(CHECK_EVERY)) == 0).select(F.col("uid").alias("query_id"), F.col("unit").alias("target"))
    return D.self_check(V.search(spark, vector_index(spark, sf_dir), asked, 1), asked)


def vector_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sanity(table(spark, sf_dir, "embeddings"), "embedding")


def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shards of the unit vectors, spoilt on purpose, and how each breaks its form."""
    n = lambda k: F.col("uid") % k == 0
    v = F.when(n(101), None).when(n(103), F.slice("unit", 1, 9)).when(n(107), F.transform("unit", lambda _: F.lit(float("nan")))).when(n(109), F.transform("unit", lambda x: 2 * x)).otherwise(F.col("unit"))
    shard = (F.col("uid") % 7).cast("int")
    row = F.floor(F.col("uid") / 7) + F.when(shard == 3, 1).otherwise(0)
    return V.shard_violations(_rows(spark, sf_dir).select(shard.alias("shard"), row.alias("row"), v.alias("vector")), 64, "double")


QUERIES = {
    "vector_shards": vector_shards,
    "dense_cosine_topk": cosine_topk, "dense_scoped_prefilter": scoped_prefilter, "dense_scoped_postfilter": scoped_postfilter,
    "dense_per_index": per_index, "dense_selfcheck": selfcheck, "vector_sanity": vector_sanity,
}

_ASKED = f"uid IN ({', '.join(map(str, QUERY_IDS))})"
_BASE = f"""
WITH n AS (SELECT vec_id AS uid, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT uid, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS unit FROM n WHERE list_inner_product(v, v) > 0),
q AS (SELECT uid AS query_id, unit AS target, label AS query_label FROM u WHERE {_ASKED}),
f AS (SELECT query_id, query_label, u.uid AS vec_id, u.label, list_inner_product(unit, target) AS score FROM u, q)
"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank"

ORACLES = {
    "vector_shards": """WITH v AS (SELECT (vec_id % 7)::INTEGER AS shard, CASE WHEN vec_id % 101 = 0 THEN 'EMPTY' WHEN vec_id % 103 = 0 THEN 'SHAPE' WHEN vec_id % 107 = 0 THEN 'NOT_FINITE' WHEN vec_id % 109 = 0 THEN 'NORM' END AS code FROM embeddings),
-- A vector that lost components has another length too.
w AS (SELECT shard, code FROM v WHERE code IS NOT NULL UNION ALL SELECT shard, 'NORM' FROM v WHERE code = 'SHAPE')
SELECT shard, code, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT 3, 'ROWS', count(*) FROM v WHERE shard = 3""",
    "dense_cosine_topk": f"{_BASE} SELECT query_id, {_RANK}, vec_id, round(score, 6) AS score FROM f QUALIFY rank <= {K}",
    "dense_scoped_prefilter": f"{_BASE} SELECT query_id, {_RANK}, vec_id, round(score, 6) AS score FROM f WHERE label = query_label QUALIFY rank <= {K}",
    "dense_scoped_postfilter": f"{_BASE}, r AS (SELECT query_id, {_RANK}, vec_id, score, label, query_label FROM f QUALIFY rank <= {K}) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE label = query_label",
    "dense_per_index": f"{_BASE} SELECT query_id, label, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, round(score, 6) AS score FROM f QUALIFY rank <= 3",
    "dense_selfcheck": f"""{_BASE.replace(_ASKED, f"uid % {CHECK_EVERY} = 0")}, b AS (SELECT query_id, vec_id AS best, score AS best_score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1),
o AS (SELECT query_id, score AS own FROM f WHERE vec_id = query_id) SELECT query_id, best, round(best_score, 6) AS best_score, coalesce(own >= best_score, FALSE) OR best = query_id AS ok FROM b LEFT JOIN o USING (query_id)""",
    "vector_sanity": """WITH n AS (SELECT embedding::DOUBLE[] AS v FROM embeddings)
SELECT count(*) AS n_vectors, count(*) FILTER (v IS NULL OR len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS n_bad, count(DISTINCT len(v)) AS n_dims,
round(min(sqrt(list_inner_product(v, v))), 5) AS min_norm, round(avg(sqrt(list_inner_product(v, v))), 5) AS mean_norm, round(max(sqrt(list_inner_product(v, v))), 5) AS max_norm FROM n""",
}
