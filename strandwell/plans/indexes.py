"""The stored indexes themselves: what they hold, and whether it is what their manifests say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.plans.lexical import BODY, TITLE, WORDS, _page_postings, trigram_index, word_index
from strandwell.sources.store import violations


def audit(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, bad: of each table of an index its rows by the manifest, and the files that break it."""
    name = F.substring_index("part", "/", 1)
    told = spark.read.parquet(f"{path}/manifest").groupBy(name.alias("part")).agg(F.sum("rows").alias("rows"))
    bad = violations(spark, path).groupBy(name.alias("part")).agg(F.count("*").alias("bad"))
    return told.join(bad, "part", "full").select("part", "rows", F.coalesce("bad", F.lit(0)).alias("bad"))


def index_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, word_index(spark, sf_dir))


def index_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, trigram_index(spark, sf_dir))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, _page_postings(spark, sf_dir))


QUERIES = {"index_words": index_words, "index_trigrams": index_trigrams, "index_pages": index_pages}

_COUNTED = """SELECT 'postings' AS part, (SELECT count(*) FROM (SELECT DISTINCT uid, term FROM t)) AS rows, 0 AS bad
UNION ALL SELECT 'terms', (SELECT count(DISTINCT term) FROM t), 0 UNION ALL SELECT 'totals', 1, 0"""
_WORD = r"'[\p{L}\p{N}_]+'"
ORACLES = {
    "index_words": f"WITH t AS (SELECT doc_id AS uid, unnest({WORDS}) AS term FROM documents) {_COUNTED}",
    "index_trigrams": f"""WITH d AS (SELECT doc_id AS uid, replace(strip_accents(lower(text)), 'đ', 'd') AS x FROM documents),
t AS (SELECT uid, substr(x, k, 3) AS term FROM (SELECT uid, x, unnest(range(1, length(x) - 1)) AS k FROM d)) {_COUNTED}""",
    "index_pages": f"""WITH w AS (SELECT page_id AS uid, regexp_extract_all(lower(regexp_extract(html, '{TITLE}', 1)), {_WORD}) AS a,
regexp_extract_all(lower(regexp_replace(html, '{BODY}', ' ', 'g')), {_WORD}) AS b, regexp_extract_all(lower(url), {_WORD}) AS c FROM pages),
t AS (SELECT uid, unnest(list_concat(a, b, c)) AS term FROM w) {_COUNTED}""",
}
