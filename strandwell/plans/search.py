"""Unified search over conversations and vectors: speech by words, text by substrings, pictures by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.operators import dense as D
from strandwell.operators import lexical as L
from strandwell.operators.search import InvalidConfig, Request, search, side_by_side
from strandwell.sources.tables import table

VIDEOS, STEP = 60, 3.0
TERMS = ("reat", "the", "onti")
NEEDLE, VECTOR = "ation", 7
REQUEST = Request("demo-1", " ".join(TERMS), ("visual", "asr", "ocr"), start_sec=0.0, end_sec=20.0, limit=50)


def _ranked(rows: DataFrame, provider: str, evidence, video, anchor, half: float) -> DataFrame:
    """Scored rows as hits."""
    order = Window.orderBy(F.col("score").desc(), "uid")
    best = rows.orderBy(F.col("score").desc(), "uid").limit(100).withColumn("rank", F.row_number().over(order))
    hits = best.select(F.lit(1).alias("query_id"), F.lit(provider).alias("provider"), evidence.alias("evidence_id"), video.alias("video"), "rank", anchor.alias("anchor"))
    return hits.withColumn("start", F.greatest(F.lit(0.0), F.col("anchor") - half)).withColumn("end", F.col("anchor") + half)


class _Lane:
    def __init__(self, name: str, sf_dir: str):
        self.name, self.sf_dir = name, sf_dir

    def available(self) -> bool:
        return True

    def _turns(self, spark: SparkSession) -> DataFrame:
        return table(spark, self.sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("uid"), "text")


class Speech(_Lane):
    def hits(self, spark: SparkSession, request: Request) -> DataFrame:
        index = L.indexed(self._turns(spark), "uid", {"text": F.col("text")})
        scores = L.any_terms(L.term_scores(index, L.query_table(spark, [L.TextQuery(1, tuple(request.query.split()))]), {"text": 1.0}))
        uid = F.col("uid")
        return _ranked(scores, self.name, F.concat(F.lit("a"), uid), F.floor(uid / 100) % VIDEOS, (uid % 100) * STEP, 1.0)


class Written(_Lane):
    def hits(self, spark: SparkSession, request: Request) -> DataFrame:
        turns = self._turns(spark)
        counts = L.trigram_counts(turns, "uid", F.col("text"), spark.createDataFrame([(1, NEEDLE)], "query_id int, needle string"))
        corpus = turns.agg(F.count("*").alias("n_docs"), F.avg(F.greatest(F.length("text") - 2, F.lit(0))).alias("avgdl"))
        uid = F.col("uid")
        return _ranked(L.rate(counts, corpus), self.name, F.concat(F.lit("o"), uid), F.floor(uid / 100) % VIDEOS, (uid % 100) * STEP, 0.0)


class Pictures(_Lane):
    def hits(self, spark: SparkSession, request: Request) -> DataFrame:
        rows = D.normalised(table(spark, self.sf_dir, "embeddings"), "vec_id", "embedding")
        found = D.scored(rows, rows.filter(F.col("uid") == VECTOR).select(F.col("uid").alias("query_id"), F.col("unit").alias("target")))
        uid = F.col("uid")
        return _ranked(found, self.name, F.concat(F.lit("v"), uid), uid % VIDEOS, (F.floor(uid / VIDEOS) % 10).cast("double"), 0.0)


def orchestrated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = search(spark, REQUEST, [Pictures("visual", sf_dir), Speech("asr", sf_dir), Written("ocr", sf_dir)])
    return answer.windows.select("place", "video", "start", "end", "evidence", "lanes", "rrf", "representative", F.lit(answer.status).alias("status"))


class Broken(_Lane):
    """A lane that is planned without fault and fails when it runs."""

    def hits(self, spark: SparkSession, request: Request) -> DataFrame:
        return Pictures(self.name, self.sf_dir).hits(spark, request).withColumn("anchor", F.raise_error(F.lit("no index")).cast("double"))


class Away(_Lane):
    def available(self) -> bool:
        return False


class Unset(_Lane):
    def hits(self, spark: SparkSession, request: Request) -> DataFrame:
        raise InvalidConfig("no encoder")


def compare_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes side by side: two that answer, an alias of one of them, and four that don't, each for its own reason."""
    lanes = [Pictures("visual", sf_dir), Speech("asr", sf_dir), Broken("ocr", sf_dir), Away("object", sf_dir), Unset("caption", sf_dir), Pictures("siglip_custom", sf_dir)]
    return side_by_side(spark, REQUEST, lanes, ["visual", "asr", "ocr", "object", "caption", "siglip", "siglip_custom"], {"siglip": "siglip_custom"})


QUERIES = {"orchestrated_search": orchestrated_search, "compare_lanes": compare_lanes}

ORACLES = {
    "compare_lanes": rf"""WITH p AS (SELECT count(*) AS n, count(DISTINCT v) AS k FROM (SELECT vec_id % {VIDEOS} AS v FROM (SELECT a.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE b.vec_id = {VECTOR} ORDER BY s DESC, a.vec_id LIMIT 100))),
w AS (SELECT conv_id * 100 + turn AS uid, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations), c AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT term, uid, count(*) AS f, any_value(len) AS len FROM (SELECT uid, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN {TERMS} GROUP BY ALL),
ti AS (SELECT term, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT term, count(*) AS n FROM tf GROUP BY 1), c),
sa AS (SELECT uid, list_sum(list(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) ORDER BY term)) AS score FROM tf JOIN ti USING (term) GROUP BY uid ORDER BY score DESC, uid LIMIT 100),
a AS (SELECT count(*) AS n, count(DISTINCT uid // 100 % {VIDEOS}) AS k FROM sa)
SELECT lane, status, n_hits, n_videos, 'PARTIAL' AS overall FROM (SELECT 'visual' AS lane, 'OK' AS status, n AS n_hits, k AS n_videos FROM p UNION ALL SELECT 'asr', 'OK', n, k FROM a UNION ALL SELECT 'ocr', 'ERROR', 0, 0 UNION ALL SELECT 'object', 'UNAVAILABLE', 0, 0
UNION ALL SELECT 'caption', 'SKIPPED_INVALID_CONFIG', 0, 0 UNION ALL SELECT 'siglip_custom', 'OK', n, k FROM p)""",
    "orchestrated_search": rf"""
WITH RECURSIVE d AS (SELECT conv_id * 100 + turn AS uid, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations),
c AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl, avg(greatest(length(text) - 2, 0)) AS avgtl FROM d),
tf AS (SELECT term, uid, count(*) AS f, any_value(len) AS len FROM (SELECT uid, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN {TERMS} GROUP BY ALL),
ti AS (SELECT term, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT term, count(*) AS n FROM tf GROUP BY 1), c),
sa AS (SELECT uid, list_sum(list(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) ORDER BY term)) AS score FROM tf JOIN ti USING (term) GROUP BY uid),
gf AS (SELECT uid, greatest(length(text) - 2, 0) AS len, (length(t) - length(replace(t, '{NEEDLE}', ''))) // {len(NEEDLE)} AS f FROM (SELECT *, replace(strip_accents(lower(text)), 'đ', 'd') AS t FROM d) WHERE contains(t, '{NEEDLE}')),
gi AS (SELECT greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgtl FROM (SELECT count(*) AS n FROM gf), c),
so AS (SELECT uid, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgtl)) AS score FROM gf, gi),
e AS (SELECT vec_id AS uid, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT uid, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e),
sv AS (SELECT a.uid, list_inner_product(a.u, b.u) AS score FROM n a, n b WHERE b.uid = {VECTOR}),
ra AS (SELECT *, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM sa QUALIFY rank <= 100), ro AS (SELECT *, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM so QUALIFY rank <= 100), rv AS (SELECT *, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM sv QUALIFY rank <= 100),
h AS (SELECT 'asr' AS provider, 'a' || uid AS evidence_id, uid // 100 % {VIDEOS} AS video, rank, (uid % 100) * {STEP}::DOUBLE AS anchor, 1.0::DOUBLE AS half FROM ra UNION ALL SELECT 'ocr', 'o' || uid, uid // 100 % {VIDEOS}, rank, (uid % 100) * {STEP}::DOUBLE, 0 FROM ro
  UNION ALL SELECT 'visual', 'v' || uid, uid % {VIDEOS}, rank, (uid // {VIDEOS} % 10)::DOUBLE, 0 FROM rv),
o AS (SELECT *, greatest(0, anchor - half) AS lo, anchor + half AS hi, row_number() OVER (PARTITION BY video ORDER BY anchor, provider, rank, evidence_id) AS k FROM h WHERE anchor BETWEEN 0 AND 20),
w AS (SELECT video, k, lo, hi, anchor, 1 AS no FROM o WHERE k = 1 UNION ALL
  SELECT o.video, o.k, CASE WHEN j THEN least(w.lo, o.lo) ELSE o.lo END, CASE WHEN j THEN greatest(w.hi, o.hi) ELSE o.hi END, o.anchor, CASE WHEN j THEN w.no ELSE w.no + 1 END
  FROM w JOIN (SELECT * FROM o) o ON o.video = w.video AND o.k = w.k + 1, LATERAL (SELECT o.anchor - w.anchor <= 4 AND greatest(w.hi, o.hi) - least(w.lo, o.lo) <= 12 AS j)),
m AS (SELECT o.*, w.no FROM o JOIN w ON o.video = w.video AND o.k = w.k), l AS (SELECT video, no, provider, min(rank) AS best FROM m GROUP BY ALL),
f AS (SELECT video, no, round(list_sum(list(1.0::DOUBLE / (60 + best) ORDER BY provider)), 9) AS rrf, string_agg(provider || '=' || best, ',' ORDER BY provider) AS lanes FROM l GROUP BY ALL),
g AS (SELECT video, no, round(min(lo), 6) AS start, round(max(hi), 6) AS "end", string_agg(provider || ':' || evidence_id, ',' ORDER BY provider, rank, evidence_id) AS evidence, min(rank) AS best_rank,
  coalesce(arg_min(evidence_id, (rank, evidence_id)) FILTER (provider = 'visual'), arg_min(evidence_id, (rank, anchor, provider, evidence_id))) AS representative FROM m GROUP BY ALL)
SELECT row_number() OVER (ORDER BY rrf DESC, best_rank, video, start)::INTEGER AS place, video, start, "end", evidence, lanes, rrf, representative, 'OK' AS status FROM g JOIN f USING (video, no) QUALIFY place <= 50""",
}
