"""op12: how far the sources of each language stand apart."""

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.source_divergence import divergence

NAME = "op12_source_divergence"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d
), counted AS (
  SELECT doc, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY lang, term HAVING count(*) >= 10
), langs AS (
  SELECT l.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang
), sources AS (
  SELECT DISTINCT lang, source FROM d
), cells AS (
  SELECT s.lang, s.source, k.term, k.n AS in_lang, coalesce(c.n, 0)::HUGEINT AS n
  FROM sources s JOIN kept k ON k.lang = s.lang LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM counted GROUP BY ALL) c
    ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sized AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM cells
), shares AS (
  SELECT z.lang, z.source, z.term, z.n, 1 + (1000000000 * (z.n + 2)) // (z.total::HUGEINT + 2 * l.v) AS p, 1 + (1000000000 * (z.in_lang + 2)) // (l.n + 2 * l.v) AS q
  FROM sized z JOIN langs l ON l.lang = z.lang
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
