"""The library as a whole: the media lane with its weights and filters, checksums by kind of entity, completeness, storage, frames as documents, shards by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.functions.scalars import natural_key
from strandwell.functions.text import accentless
from strandwell.operators import jobs as J
from strandwell.operators import lexical as L
from strandwell.operators import structured as S
from strandwell.operators import validate as V
from strandwell.plans.lexical import K, _values
from strandwell.plans.timeline import EVENTS, events
from strandwell.sources.store import stored
from strandwell.sources.tables import table

#: Weights of the media fields; the key is stored and never rated, and the title's form without accents has its own stage.
MEDIA = {"key": 0.0, "title": 10.0, "plain": 10.0, "author": 8.0, "about": 6.0, "tags": 2.0}
ASKED = [L.TextQuery(1, ("red", "ring")), L.TextQuery(2, ("economy", "gear", "nowhere")), L.TextQuery(3, ("small", "brand")), L.TextQuery(4, ("standard", "21"))]
AUTHOR, FIRST, LAST = "BRAND#1", "01/03/2001", "20/11/2019"


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as media: names as titles, brands as authors, and a day made of the key."""
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("p_partkey") % 9000).cast("int")), "dd/MM/yyyy")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("about"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("tags"), day.alias("published"))


def media_index(spark: SparkSession, sf_dir: str) -> str:
    media = _media(spark, sf_dir)
    fields = {"key": F.col("uid").cast("string"), "title": F.col("title"), "plain": accentless(F.col("title")), "author": F.col("author"), "about": F.col("about"), "tags": F.col("tags")}
    index = L.indexed(media, "uid", fields)
    return stored(spark, "media", [f"{sf_dir}/part.parquet"], {"fields": list(fields)}, lambda path, source: L.write_postings(index, list(fields), path, source.size))


def media_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in the weighted fields, else any, else any in the title without accents; the filters by author and day hold in each stage."""
    path = media_index(spark, sf_dir)
    rated = L.indexed_scores(spark, path, ASKED, MEDIA)
    plain = L.indexed_scores(spark, path, ASKED, {f: w if f == "plain" else 0.0 for f, w in MEDIA.items()})
    allowed = _media(spark, sf_dir).filter(L.author_has(F.col("author"), AUTHOR.lower()) & L.dates_within(F.col("published"), FIRST, LAST)).select("uid")
    stages = [s.join(allowed, "uid") for s in (L.all_terms(rated), L.any_terms(rated), L.any_terms(plain))]
    return L.cascade(stages, K).select("query_id", "rank", F.col("uid").alias("part"), F.round("score", 4).alias("score"), "stage")


#: Kinds of entities: table, key (which numbers the rows), and the columns of a line.
KINDS = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]), "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]), "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey"]), "part": ("p_partkey", ["p_partkey", "p_name", "p_brand"]), "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"]),
    "events": ("event_id", ["event_id", "user_id", "event_type"]), "documents": ("doc_id", ["doc_id", "lang", "source"]), "pages": ("page_id", ["page_id", "url"]),
}


def catalog_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.checksums({kind: (table(spark, sf_dir, kind), F.col(key), F.concat_ws("|", *[F.col(c).cast("string") for c in columns])) for kind, (key, columns) in KINDS.items()})


def modality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their kinds of events; users of events who are no customers are orphans."""
    rows = events(spark, sf_dir).select(F.col("video").alias("entity"), "space")
    kinds = {s: rows.filter(F.col("space") == s) for s in ("click", "purchase", "signup")}
    return V.completeness(table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 1"), "c_custkey", kinds)


def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(".HTML"), F.lit(".jpg"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("dir"), (F.col("page_id") % 7).cast("string"), F.lit("/f"), F.col("page_id").cast("string"), kind).alias("path"), F.length("html").alias("size"))
    return V.storage(files, "path", "size", 4).withColumn("samples", F.concat_ws(",", "samples"))


def frame_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a frame: its customer, its lines as objects (the best first) and how many classes they have, in one nested document."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct((-F.col("l_quantity")).alias("s"), F.col("l_linenumber").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("c")).alias("x"))
    objects = lines.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("x"))
    listed = F.transform("x", lambda o: F.struct(o["c"].alias("class"), o["n"].alias("line")))
    met = table(spark, sf_dir, "orders").join(objects, F.col("o_orderkey") == F.col("k"), "left").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    empty = F.array().cast("array<struct<class:string,line:int>>")
    classes = F.size(F.array_distinct(F.coalesce(F.transform("x", lambda o: o["c"]), F.array().cast("array<string>"))))
    body = F.struct(F.col("o_orderkey").alias("frame"), F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).alias("video"), F.coalesce(listed.cast("array<struct<class:string,line:int>>"), empty).alias("objects"), classes.alias("n_classes"))
    return met.select(F.col("o_orderkey").alias("frame"), F.to_json(body).alias("document"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as videos named like L3_V12, placed within their nation by the numbers in their names and not by their letters."""
    name = F.concat(F.lit("L"), (F.col("s_suppkey") % 13).cast("string"), F.lit("_V"), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", name.alias("name"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(natural_key(F.col("name")), "name")))


def artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of events as segments whose contents, counts and times were spoilt on purpose after their digests were told."""
    e = events(spark, sf_dir).filter("video IS NOT NULL")
    good = e.select((F.col("uid") % 12).alias("shard"), F.col("uid").alias("segment_id"), "video", F.col("ms").alias("start_ms"), (F.col("ms") + 900).alias("end_ms"), F.col("space").alias("text"))
    shards = good.groupBy("shard").agg(F.count("*").alias("count"), V.segment_digest().alias("digest"))
    shards = shards.withColumn("count", F.col("count") + F.when(F.col("shard") == 5, 1).otherwise(0))
    i = F.col("segment_id")
    spoilt = good.withColumn("text", F.when(i == 3, "other").otherwise(F.col("text"))).withColumn("end_ms", F.when(i % 997 == 4, F.col("start_ms") - 1).otherwise(F.col("end_ms")))
    videos = e.filter("video % 17 <> 2").groupBy("video").agg((F.max("ms") - F.when(F.col("video") % 5 == 1, 500).otherwise(0)).alias("duration_ms"))
    return V.artifact_violations(shards, spoilt, videos)


def availability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, without, and those whose orders are not to be had."""
    customers = table(spark, sf_dir, "customer")
    return V.coverage(customers, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", customers.filter("c_custkey % 9 = 4").select(F.col("c_custkey").alias("key")))


LABELS = [(1, "Small_Ring"), (1, "brand#7"), (2, "  ECONOMY "), (2, "/m/3"), (3, "no such class"), (3, "red-widget")]


def class_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a request among classes that have an id, a name and an entity."""
    p = table(spark, sf_dir, "part")
    dictionary = p.select(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string")).alias("class_name"), F.col("p_name").alias("class_norm"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("class_entity"), F.col("p_size").alias("frame_count"))
    return S.resolve_classes(spark.createDataFrame(LABELS, "query_id int, label string"), dictionary)


def repair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders as items of a shard, some done twice, done and failed, of another shard, or without a key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    k = F.col("item")
    done = o.filter(k % 4 == 0).unionByName(o.filter(k % 100 == 8)).unionByName(o.filter(k % 1000 == 1).select(F.lit(None).cast("long").alias("item")))
    failed = o.filter(k % 4 == 1).unionByName(o.filter(k % 60 == 20)).unionByName(o.filter(k % 500 == 3).select((-k).alias("item")))
    return J.repair_violations(o, done, failed, "item")


QUERIES = {
    "availability_status": availability_status, "class_resolve": class_resolve, "repair_violations": repair_violations,
    "media_lane": media_lane, "catalog_checksums": catalog_checksums, "modality_audit": modality_audit, "storage_report": storage_report, "frame_document": frame_document,
    "natural_order": natural_order, "artifact_violations": artifact_violations,
}

_WORD = r"'[\p{L}\p{N}_]+'"
_FIELDS = {"key": "p_partkey::VARCHAR", "title": "p_name", "plain": "replace(strip_accents(lower(p_name)), 'đ', 'd')", "author": "p_brand", "about": "p_type", "tags": "'size ' || p_size"}


def _rated(name: str, weights: dict[str, float]) -> str:
    """Common table expressions up to a{name}: query_id, uid, score, matched, n_terms by weighted fields."""
    hits = " UNION ALL ".join(f"SELECT uid, len, unnest({f}) AS term, {w}::DOUBLE AS w FROM m" for f, w in weights.items() if w)
    return f"""h{name} AS ({hits}), f{name} AS (SELECT term, uid, sum(w) AS f, any_value(len) AS len FROM h{name} WHERE term IN (SELECT term FROM q) GROUP BY term, uid),
i{name} AS (SELECT term, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT term, count(*) AS n FROM f{name} GROUP BY term), c),
a{name} AS (SELECT query_id, uid, list_sum(list(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) ORDER BY term)) AS score, count(*) AS matched, any_value(n_terms) AS n_terms FROM f{name} JOIN i{name} USING (term) JOIN q USING (term) GROUP BY query_id, uid)"""


_LINES = {kind: f"SELECT {key} AS o, sha256(concat_ws('|', {', '.join(columns)})) AS d FROM {kind}" for kind, (key, columns) in KINDS.items()}


def _tree(kind: str) -> str:
    levels = ", ".join(f"{kind}{i} AS (SELECT o // 1000 AS o, sha256(string_agg(d, chr(10) ORDER BY o, d)) AS d FROM {kind}{i - 1} GROUP BY 1)" for i in (1, 2, 3))
    return f"{kind}0 AS ({_LINES[kind]}), {levels}"


def _top(kind: str) -> str:
    levels = " ".join(f"WHEN m < {1000 ** i} THEN (SELECT any_value(d) FROM {kind}{i})" for i in (1, 2))
    return f"SELECT '{kind}' AS kind, n, CASE {levels} ELSE (SELECT any_value(d) FROM {kind}3) END AS checksum FROM (SELECT count(*) AS n, max(o) AS m FROM {kind}0)"


ORACLES = {
    "availability_status": "SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE count(o_orderkey) END AS n, CASE WHEN c_custkey % 9 = 4 THEN 'UNAVAILABLE' WHEN count(o_orderkey) > 0 THEN 'HAS_ITEMS' ELSE 'NO_ITEMS' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "class_resolve": """WITH k AS (SELECT '/m/' || p_partkey AS id, p_size AS n, lower(p_name) AS form FROM part UNION SELECT '/m/' || p_partkey, p_size, lower(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END) FROM part),
f AS (SELECT form, id AS by_name FROM k QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, id) = 1), a(query_id, label, form) AS (VALUES (1, 'Small_Ring', 'small ring'), (1, 'brand#7', 'brand#7'), (2, '  ECONOMY ', 'economy'), (2, '/m/3', '/m/3'), (3, 'no such class', 'no such class'), (3, 'red-widget', 'red widget'))
SELECT query_id, label, coalesce(by_name, id) AS class_name, CASE WHEN by_name IS NULL THEN 'id' ELSE 'name' END AS how FROM a LEFT JOIN f USING (form) LEFT JOIN (SELECT DISTINCT id FROM k) i ON i.id = label WHERE by_name IS NOT NULL OR id IS NOT NULL""",
    "repair_violations": """WITH d AS (SELECT o_orderkey AS item FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 8 UNION ALL SELECT NULL FROM orders WHERE o_orderkey % 1000 = 1),
f AS (SELECT o_orderkey AS item FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 60 = 20 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 500 = 3),
m AS (SELECT item, count(*) FILTER (k = 'd') AS d, count(*) FILTER (k = 'f') AS f FROM (SELECT item, 'd' AS k FROM d UNION ALL SELECT item, 'f' FROM f) GROUP BY item)
SELECT item, 'NO_KEY' AS code, d + f AS n FROM m WHERE item IS NULL UNION ALL SELECT item, 'BOTH', d + f FROM m WHERE item IS NOT NULL AND d > 0 AND f > 0 UNION ALL SELECT item, 'OUTSIDE', d + f FROM m WHERE item NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT item, 'REPEATED', d FROM m WHERE item IS NOT NULL AND d > 1""",
    "media_lane": f"""WITH d AS (SELECT p_partkey AS uid, p_brand AS brand, DATE '2000-01-01' + (p_partkey % 9000)::INTEGER AS day, {', '.join(f"regexp_extract_all(lower({x}), {_WORD}) AS {f}" for f, x in _FIELDS.items())} FROM part),
m AS (SELECT *, {' + '.join(f'len({f})' for f in _FIELDS)} AS len FROM d), c AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM m), q AS (SELECT * FROM {_values(ASKED)}),
{_rated('', MEDIA)}, {_rated('_p', {'plain': 10.0})},
u AS (SELECT query_id, uid, score, 0 AS stage FROM a WHERE matched = n_terms UNION ALL SELECT query_id, uid, score, 1 FROM a UNION ALL SELECT query_id, uid, score, 2 FROM a_p),
o AS (SELECT uid FROM m WHERE contains(lower(brand), 'brand#1') AND day BETWEEN DATE '2001-03-01' AND DATE '2019-11-20'),
v AS (SELECT * FROM u WHERE uid IN (SELECT uid FROM o) QUALIFY stage = min(stage) OVER (PARTITION BY query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid)::INTEGER AS rank, uid AS part, round(score, 4) AS score, stage FROM v QUALIFY rank <= {K}""",
    "catalog_checksums": f"WITH {', '.join(map(_tree, KINDS))} {' UNION ALL '.join(map(_top, KINDS))}",
    "modality_audit": f"""WITH {EVENTS}, h AS (SELECT video AS entity, max((space = 'click')::INT) = 1 AS c, max((space = 'purchase')::INT) = 1 AS p, max((space = 'signup')::INT) = 1 AS s FROM e WHERE video IS NOT NULL AND space IN ('click', 'purchase', 'signup') GROUP BY 1),
x AS (SELECT c_custkey AS entity, TRUE AS known FROM customer WHERE c_custkey % 3 <> 1), m AS (SELECT coalesce(x.entity, h.entity) AS entity, coalesce(known, FALSE) AS known, coalesce(c, FALSE) AS c, coalesce(p, FALSE) AS p, coalesce(s, FALSE) AS s FROM x FULL JOIN h ON x.entity = h.entity)
SELECT entity, known, c AS has_click, p AS has_purchase, s AS has_signup, concat_ws(',', CASE WHEN NOT c THEN 'click' END, CASE WHEN NOT p THEN 'purchase' END, CASE WHEN NOT s THEN 'signup' END) AS missing FROM m""",
    "storage_report": """WITH f AS (SELECT 'dir' || page_id % 7 AS folder, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'jpg' ELSE '' END AS extension, 'dir' || page_id % 7 || '/f' || page_id || CASE page_id % 3 WHEN 0 THEN '.HTML' WHEN 1 THEN '.jpg' ELSE '' END AS path, length(html) AS size FROM pages)
SELECT folder, extension, count(*) AS n, sum(size)::BIGINT AS bytes, array_to_string(list_sort(list(path))[1:4], ',') AS samples FROM f GROUP BY ALL""",
    "frame_document": """WITH l AS (SELECT l_orderkey AS k, list({'class': l_returnflag || l_linestatus, 'line': l_linenumber} ORDER BY -l_quantity, l_linenumber, l_returnflag || l_linestatus) AS x, count(DISTINCT l_returnflag || l_linestatus) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS frame, to_json({'frame': o_orderkey, 'video': {'key': c_custkey, 'name': c_name}, 'objects': coalesce(x, []), 'n_classes': coalesce(n, 0)})::VARCHAR AS document FROM orders LEFT JOIN l ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""",
    "natural_order": "SELECT s_nationkey, 'L' || s_suppkey % 13 || '_V' || s_suppkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 13, s_suppkey)::INTEGER AS place FROM supplier",
    "artifact_violations": f"""WITH {EVENTS}, g AS (SELECT uid % 12 AS shard, uid, video, ms, CASE WHEN uid % 997 = 4 THEN ms - 1 ELSE ms + 900 END AS stop FROM e WHERE video IS NOT NULL),
v AS (SELECT video, max(ms) - CASE WHEN video % 5 = 1 THEN 500 ELSE 0 END AS d FROM e WHERE video % 17 <> 2 GROUP BY 1)
SELECT 'COUNT' AS code, '5' AS entity, count(*)::VARCHAR AS detail FROM g WHERE shard = 5 UNION ALL SELECT 'DIGEST', shard::VARCHAR, '' FROM g WHERE uid = 3 OR uid % 997 = 4 GROUP BY shard
UNION ALL SELECT 'UNKNOWN_VIDEO', uid::VARCHAR, video::VARCHAR FROM g WHERE video % 17 = 2 UNION ALL SELECT 'INTERVAL', uid::VARCHAR, ms || '..' || stop FROM g WHERE uid % 997 = 4 OR ms < 0
UNION ALL SELECT 'LATE', uid::VARCHAR, ms || '..' || stop FROM g JOIN v USING (video) WHERE stop > d + 1000""",
}
