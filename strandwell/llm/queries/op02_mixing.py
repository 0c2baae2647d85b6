"""op2: all documents mixed to target weights."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.mixing import BUCKETS, SEED, mix

NAME = "op2_mix_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap, n FROM s
), r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, row_number() OVER (ORDER BY cap / weight, n) AS k,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS cap_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS weight_left
  FROM w
), f AS (
  SELECT *, min(CASE WHEN cap > weight * (budget - cap_before) / weight_left THEN k END) OVER () AS first_open FROM r
), l AS (
  SELECT min(CASE WHEN k = first_open THEN budget - cap_before END) AS pool, min(CASE WHEN k = first_open THEN weight_left END) AS weights FROM f
), t AS (
  SELECT source, source_size, CASE WHEN first_open IS NULL OR k < first_open THEN cap ELSE weight * pool / weights END AS target FROM f, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), o AS (
  SELECT doc_id, size, e.source_size, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.source_size::BIGINT AS extra, d.source,
    ('0x' || substr(md5('{SEED}:' || doc_id || ':' || size), 1, 15))::BIGINT AS h
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), q AS (
  SELECT *, extra - coalesce(sum(size) OVER (PARTITION BY source ORDER BY h % {BUCKETS}, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spare FROM o
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, spare)))::BIGINT AS taken FROM q
"""
