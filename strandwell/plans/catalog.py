"""Validation and job queries over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators import jobs as J
from strandwell.operators import validate as V
from strandwell.plans.evaluation import _all_hits
from strandwell.plans.timeline import EVENTS, events
from strandwell.sources.tables import table


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below and above the customers' keys, and labels of documents that are not there."""
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey") * 2)
    lost = V.orphans(orders, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "ORDER_CUSTOMER")
    return lost.unionByName(V.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id", "doc_id", "LABEL_DOCUMENT"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "LINE")
    return found.unionByName(V.duplicates(table(spark, sf_dir, "documents").withColumn("h", F.md5("text")), ["h"], "TEXT"))


def ordinal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ordinal_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def interval_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    met = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    days = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date"))
    return V.bad_intervals(met, F.concat_ws(":", "l_orderkey", "l_linenumber"), days("o_orderdate"), days("l_shipdate"))


def value_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bad_values(table(spark, sf_dir, "events"), "EVENT_TYPE", F.col("event_id"), F.col("event_type"), ["click", "view", "purchase", "signup"])


def path_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("../"), "url")).when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), "url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return V.unsafe_paths(table(spark, sf_dir, "pages"), F.col("page_id"), path)


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coverage(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.countDistinct("o_custkey").alias("n_customers"), F.coalesce(F.sum((F.col("o_totalprice") > 1000).cast("int")), F.lit(0)).alias("n_large")
    )


def matched_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the last of their labels, and those without."""
    labels = table(spark, sf_dir, "labels").withColumn("o", F.col("quality") * 2 + F.col("toxic"))
    matched, missing = V.split_matched(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, ["doc_id"], "o")
    return matched.select("doc_id", "lang", F.col("o").cast("int").alias("o")).unionByName(missing.select("doc_id", "lang", F.lit(None).cast("int").alias("o")))


def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every branch of region, nation and customer, counted at each node."""
    regions, nations, customers = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    per_nation = customers.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    leaves = nations.join(per_nation, nations["n_nationkey"] == per_nation["c_nationkey"], "left").select("n_name", "n_regionkey", F.coalesce("n", F.lit(0)).alias("n"))
    roots = leaves.groupBy("n_regionkey").agg(F.sum("n").alias("n")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("node"), F.lit(None).cast("string").alias("parent"), "n")
    named = leaves.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return roots.unionByName(named.select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"), "n"))


def taxonomy_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of suppliers by rule, with single exceptions; every supplier has one membership."""
    rule = F.when(F.col("s_acctbal") < 0, "debtor").when(F.col("s_nationkey") < 10, "near").otherwise("far")
    listed = F.when(F.col("s_suppkey").isin(3, 7), "reviewed").otherwise(rule)
    return table(spark, sf_dir, "supplier").groupBy(listed.alias("branch")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


def catalog_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return V.merkle(table(spark, sf_dir, "orders"), F.col("o_orderkey"), line)


def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a.HTML").when(F.col("page_id") % 3 == 1, "/b.jpg").otherwise("/c")).alias("path"))
    return V.extensions(paths.select(F.regexp_replace("path", r"\?[^/]*", "").alias("path")), "path")


def modality_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of events each user has, and how many are missing."""
    rows = events(spark, sf_dir)
    has = [F.max((F.col("space") == s).cast("int")).alias(f"has_{s}") for s in ("click", "purchase", "signup")]
    return rows.groupBy("video").agg(*has).withColumn("missing", 3 - F.col("has_click") - F.col("has_purchase") - F.col("has_signup"))


def shard_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return J.fixed_shards(J.dense_index(docs, "doc_id", 8), 40)


def shard_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return J.balanced_shards(J.dense_index(docs, "doc_id", 8), docs.count(), 7).groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), _done(spark, sf_dir), "doc_id")


def shard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("shard"))
    return J.shard_status(docs, _done(spark, sf_dir), "doc_id", "shard")


def terminal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return J.terminal_check(labels.select("doc_id"), labels.filter("toxic = 0").select("doc_id"), labels.filter("toxic = 1").select("doc_id"), "doc_id")


def resume_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn"), table(spark, sf_dir, "conversations").filter("role = 'system'").select("conv_id"), "conv_id")


def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return J.merge([parts.filter(F.col("p_partkey") % 3 == k) for k in range(3)], "p_partkey")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.round("o_totalprice", 2).alias("balance"))
    return J.upsert(old, new, "c_custkey", F.col("balance"))


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), F.lit("new").alias("origin"))
    return J.insert_new(old, new, "key")


def pilot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pilot(_all_hits(spark, sf_dir), 5, 10, 1000, 40)


def dense_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with enough text, numbered anew, 50 to a shard."""
    turns = table(spark, sf_dir, "conversations").filter(F.length(F.trim("text")) >= 200).select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"))
    return J.fixed_shards(J.dense_index(turns, "uid", 4), 50)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", [("DEV", 15), ("HOLDOUT", 5)], 2026)


QUERIES = {
    "orphans": orphans, "duplicates": duplicates, "ordinal_gaps": ordinal_gaps, "interval_violations": interval_violations, "value_violations": value_violations,
    "path_violations": path_violations, "coverage_status": coverage_status, "status_counts": status_counts, "matched_annotations": matched_annotations, "taxonomy_counts": taxonomy_counts,
    "taxonomy_memberships": taxonomy_memberships, "catalog_checksum": catalog_checksum, "extension_histogram": extension_histogram, "modality_completeness": modality_completeness,
    "shard_fixed": shard_fixed, "shard_balanced": shard_balanced, "resume_pending": resume_pending, "shard_status": shard_status, "terminal_check": terminal_check, "resume_repair": resume_repair,
    "merge_shards": merge_shards, "upsert": upsert, "insert_ignore": insert_ignore, "pilot_candidates": pilot_candidates, "dense_eligibility": dense_eligibility, "stratified_sample": stratified_sample,
}

_TREE = lambda n, below: f"d{n} AS (SELECT o // 1000 AS o, sha256(string_agg(d, chr(10) ORDER BY o)) AS d FROM d{below} GROUP BY 1)"
_LANES = ("click", "error", "purchase", "view")

ORACLES = {
    "orphans": """SELECT 'ORDER_CUSTOMER' AS code, k::VARCHAR AS entity, n::VARCHAR AS detail FROM (SELECT o_custkey * 2 AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'LABEL_DOCUMENT', k::VARCHAR, n::VARCHAR FROM (SELECT doc_id AS k, count(*) AS n FROM labels GROUP BY 1) WHERE k NOT IN (SELECT doc_id FROM documents)""",
    "duplicates": """SELECT 'LINE' AS code, l_orderkey || ':' || l_linenumber AS entity, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'TEXT', md5(text), count(*)::VARCHAR FROM documents GROUP BY md5(text) HAVING count(*) > 1""",
    "ordinal_gaps": "WITH s AS (SELECT l_orderkey, l_linenumber - coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS s FROM lineitem) SELECT l_orderkey, sum(greatest(s - 1, 0))::BIGINT AS missing, sum((s = 0)::INT)::BIGINT AS repeated FROM s GROUP BY 1 HAVING missing > 0 OR repeated > 0",
    "interval_violations": """WITH d AS (SELECT l_orderkey || ':' || l_linenumber AS entity, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'INTERVAL' AS code, entity, concat_ws('..', a, b) AS detail FROM d WHERE coalesce(a > b, TRUE)""",
    "value_violations": "SELECT 'EVENT_TYPE' AS code, event_id::VARCHAR AS entity, event_type AS detail FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')",
    "path_violations": "SELECT 'UNSAFE_PATH' AS code, page_id::VARCHAR AS entity, CASE WHEN page_id % 9 = 0 THEN '../' || url ELSE '/' || url END AS detail FROM pages WHERE page_id % 9 = 0 OR page_id % 5 = 0",
    "coverage_status": "SELECT c_custkey AS key, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) > 0 THEN 'HAS_ITEMS' ELSE 'NO_ITEMS' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "status_counts": "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_custkey) AS n_customers, coalesce(sum((o_totalprice > 1000)::INT), 0)::BIGINT AS n_large FROM orders",
    "matched_annotations": "SELECT d.doc_id, lang, max(quality * 2 + toxic)::INTEGER AS o FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id, lang",
    "taxonomy_counts": """WITH l AS (SELECT n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT n_name AS node, r_name AS parent, n FROM l JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, sum(n)::BIGINT FROM l JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "taxonomy_memberships": "SELECT CASE WHEN s_suppkey IN (3, 7) THEN 'reviewed' WHEN s_acctbal < 0 THEN 'debtor' WHEN s_nationkey < 10 THEN 'near' ELSE 'far' END AS branch, count(*) AS n, min(s_suppkey) AS first FROM supplier GROUP BY 1",
    "catalog_checksum": f"""WITH d0 AS (SELECT o_orderkey AS o, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS d FROM orders), {_TREE(1, 0)}, {_TREE(2, 1)}, {_TREE(3, 2)}, t AS (SELECT max(o) AS top FROM d0)
SELECT d AS checksum FROM d1, t WHERE top < 1000 UNION ALL SELECT d FROM d2, t WHERE top >= 1000 AND top < 1000000 UNION ALL SELECT d FROM d3, t WHERE top >= 1000000""",
    "extension_histogram": r"""WITH p AS (SELECT regexp_replace(url || CASE page_id % 3 WHEN 0 THEN '/a.HTML' WHEN 1 THEN '/b.jpg' ELSE '/c' END, '\?[^/]*', '', 'g') AS path FROM pages)
SELECT lower(regexp_extract(regexp_extract(regexp_replace(path, '[?#].*$', ''), '([^/]*)$', 1), '\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n, min(path) AS sample FROM p GROUP BY 1""",
    "modality_completeness": f"WITH {EVENTS}, h AS (SELECT video, max((space = 'click')::INT) AS has_click, max((space = 'purchase')::INT) AS has_purchase, max((space = 'signup')::INT) AS has_signup FROM e GROUP BY 1) SELECT *, 3 - has_click - has_purchase - has_signup AS missing FROM h",
    "shard_fixed": "WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) SELECT doc_id, idx, (idx // 40)::INTEGER AS shard, (idx % 40)::INTEGER AS place FROM i",
    "shard_balanced": "WITH i AS (SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents) SELECT shard::INTEGER AS shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM i GROUP BY shard",
    "resume_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "shard_status": """WITH s AS (SELECT source AS shard, count(*) AS expected, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS finished FROM documents GROUP BY 1)
SELECT *, CASE WHEN finished = 0 THEN 'PENDING' WHEN finished < expected THEN 'PARTIAL' ELSE 'DONE' END AS status FROM s""",
    "terminal_check": "SELECT count(DISTINCT doc_id) AS expected, count(DISTINCT doc_id) FILTER (toxic = 0) AS ok, count(DISTINCT doc_id) FILTER (toxic = 1) AS failed, TRUE AS complete FROM labels",
    "resume_repair": "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "merge_shards": "SELECT p_partkey, p_brand FROM part",
    "upsert": """WITH u AS (SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer UNION ALL SELECT o_custkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 3 = 0) SELECT c_custkey, max(balance) AS balance FROM u GROUP BY 1""",
    "insert_ignore": "SELECT s_suppkey AS key, 'old' AS origin FROM supplier UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "pilot_candidates": f"""WITH {EVENTS}, h AS (SELECT uid % 5 AS query_id, space AS lane, video, row_number() OVER (PARTITION BY uid % 5, space ORDER BY value DESC, uid) AS rank FROM e WHERE space IN {_LANES}),
b AS (SELECT video, min(rank)::INTEGER AS best, string_agg(DISTINCT query_id || '=' || rank, ',' ORDER BY query_id || '=' || rank) AS queries FROM h GROUP BY 1), c AS (SELECT count(*) FILTER (best <= 5) AS close FROM b)
SELECT video, best, queries FROM b, c WHERE best <= CASE WHEN close < 1000 THEN 10 ELSE 5 END ORDER BY best, video LIMIT 40""",
    "dense_eligibility": "WITH i AS (SELECT conv_id * 1000 + turn AS uid FROM conversations WHERE length(trim(text)) >= 200), n AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS idx FROM i) SELECT uid, idx, (idx // 50)::INTEGER AS shard, (idx % 50)::INTEGER AS place FROM n",
    "stratified_sample": "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('2026:' || doc_id)) AS r FROM documents) SELECT lang, doc_id, CASE WHEN r <= 15 THEN 'DEV' ELSE 'HOLDOUT' END AS split FROM r WHERE r <= 20",
}
