"""Lanes in full: staged text search with filters, compiled requests, late enrichment, facets by alias, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.functions.text import accentless
from strandwell.operators import lexical as L
from strandwell.operators import postings as P
from strandwell.operators import structured as S
from strandwell.plans.lexical import FOLDED, K, PLAIN, _TOP, WORDS, _accentless_scores, _score_sql, _scores, _shape, word_index
from strandwell.plans.structured import _FACETS, _facets
from strandwell.plans.timeline import EVENTS, events
from strandwell.sources.tables import table

AUTHOR, FIRST, LAST = "HIGH", "01/06/1994", "31/12/1999"


def media_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, any word, any word without accents: the first stage with results after the filters by author and dates; orders lend both."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("author"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("published"))
    allowed = orders.filter(L.author_has(F.col("author"), AUTHOR.lower()) & L.dates_within(F.col("published"), FIRST, LAST) & L.dates_within(F.col("published"), "no date", None)).select("uid")
    plain = _scores(spark, sf_dir, PLAIN)
    stages = [L.all_terms(plain), L.any_terms(plain), L.any_terms(_accentless_scores(spark, sf_dir, PLAIN))]
    return _shape(L.cascade([s.join(allowed, "uid") for s in stages], K), "stage")


def ocr_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, folded = _scores(spark, sf_dir, PLAIN), _accentless_scores(spark, sf_dir, PLAIN)
    return _shape(L.fill_or_else([L.all_terms(plain), L.all_terms(folded)], [L.any_terms(plain), L.any_terms(folded)], K), "stage")


def caption_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(L.top(L.either(_scores(spark, sf_dir, PLAIN), _accentless_scores(spark, sf_dir, PLAIN)), K))


ASKED = ['find the reat "of the" anti', '"de la" dans', "show the image"]
COMPILED = [L.compile_text(k, text) for k, text in enumerate(ASKED, 1)]


def compiled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed requests with phrases: a document counts with every word and phrase that it holds."""
    words = [L.TextQuery(q.query_id, tuple(t for t in q.terms if " " not in t)) for q in COMPILED]
    scores = _scores(spark, sf_dir, [q for q in words if q.terms]).select("query_id", "uid", "term", "score")
    # A phrase of a query gets an id of its own, as each is rated like a term.
    named = [(q.query_id * 100 + k, t) for q in COMPILED for k, t in enumerate(q.terms) if " " in t]
    rated = L.indexed_phrases(spark, word_index(spark, sf_dir), [(n, t.split()) for n, t in named])
    text = F.element_at(F.create_map(*[F.lit(x) for n in named for x in n]), F.col("query_id"))
    phrases = rated.select(F.floor(F.col("query_id") / 100).cast("int").alias("query_id"), "uid", text.alias("term"), "score")
    return _shape(L.top(L.any_terms(scores.unionByName(phrases).withColumn("n_terms", F.lit(0))), K))


def request_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of text were compiled to, and in how many documents each word and phrase stands."""
    path = word_index(spark, sf_dir)
    rows = [(q.query_id, k, t) for q in COMPILED for k, t in enumerate(q.terms)]
    found = P.phrase_counts(spark, path, [(t, t.split()) for t in sorted({t for *_, t in rows})], kind="string").groupBy(F.col("query_id").alias("term")).agg(F.count("*").alias("df"))
    asked = spark.createDataFrame(rows, "query_id int, place int, term string")
    return asked.join(found, "term", "left").select("query_id", "place", "term", F.coalesce("df", F.lit(0)).alias("df"))


def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents with their labels, which only some have."""
    best = L.top(L.any_terms(_scores(spark, sf_dir, PLAIN)), K)
    return _shape(L.enriched(best, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": -1}), "quality", "toxic")


ALIASES = {"xe": "the", "mèo": "reat", "con mèo": "onti"}


def alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of users stand for words of the catalogue."""
    asked = spark.createDataFrame([(1, "Con mèo XE"), (2, "mèo")], "query_id int, text string").select("query_id", L.substituted(F.col("text"), ALIASES).alias("text"))
    queries = [L.compile_text(r["query_id"], r["text"], strict=True) for r in asked.collect()]
    return _shape(L.top(L.any_terms(_scores(spark, sf_dir, queries)), K))


NAMES = ("brand", "type", "size", "name")
WANTED = [(1, "brand", "Brand#2"), (1, "type", "  ECONOMY, "), (1, "name", "RED RING"), (2, "name", "hot-gear"), (2, "colour", "red"), (2, "size", "size 99"), (2, "brand", "  ")]


def _dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facets with their number (order of ids stands in for it) and their aliases."""
    known = _facets(spark, sf_dir).select("facet_id", "namespace", "value").distinct()
    aliases = known.select(F.col("facet_id").alias("ordinal"), F.explode(F.array(F.replace("value", F.lit(" "), F.lit("-")), F.reverse("value"))).alias("alias"))
    return known.select("facet_id", "namespace", F.col("facet_id").alias("ordinal")), aliases


def facet_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve_facets(spark.createDataFrame(WANTED, "query_id int, namespace string, raw string"), *_dictionary(spark, sf_dir), NAMES)


def vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary_top(_facets(spark, sf_dir).select("namespace", "value"), 5)


def vocabulary_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are one without their spaces and digits."""
    return S.vocabulary_collisions(_facets(spark, sf_dir).select("namespace", "value"), F.regexp_replace(accentless(F.col("value")), r"[\s\d]", ""))


def video_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as one nested document: nation, and the orders with their lines, in order of their keys."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("k"), "left")
    empty = F.array().cast("array<struct<n:int,p:bigint>>")
    nested = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.coalesce("lines", empty).alias("lines")))).alias("orders"))
    met = table(spark, sf_dir, "customer").join(nested, F.col("c_custkey") == F.col("c"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.coalesce(F.size("orders"), F.lit(0)).alias("n_orders"), F.coalesce("orders", F.array().cast(nested.schema["orders"].dataType)).alias("orders"))).alias("document"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by their keys: one that is there, one that isn't, from three tables."""
    keys = [3, 10**9]
    one = table(spark, sf_dir, "customer").filter(F.col("c_custkey").isin(keys)).select(F.lit("video").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    two = table(spark, sf_dir, "part").filter(F.col("p_partkey").isin(keys)).select(F.lit("keyframe"), "p_partkey", "p_name")
    three = table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(keys)).select(F.lit("segment"), "doc_id", "source")
    return one.union(two).union(three)


def video_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each video and space the number of frames, the first and the last time."""
    return events(spark, sf_dir).groupBy("video", "space").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def series_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by the series in their names (the last digit but two of the number)."""
    series = F.regexp_extract("c_name", r"(\d)\d\d$", 1)
    return table(spark, sf_dir, "customer").groupBy(series.alias("series")).agg(F.count("*").alias("n"))


def confidence_floor(spark: SparkSession, sf_dir: str, floor: float = 0.2) -> DataFrame:
    """Detections of each class that an ingest keeps and leaves out: those of `floor` or more stay."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("class_name"), F.round(F.col("l_quantity") / 50, 6).alias("score"))
    return rows.groupBy("class_name").agg(F.count_if(F.col("score") >= floor).alias("kept"), F.count_if(~(F.coalesce(F.col("score"), F.lit(0.0)) >= floor)).alias("dropped"))


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON as lists: a list as it is, a single value or object as a list of one, what doesn't parse as none."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("j"))
    kind = "array<struct<k:int>>"
    whole = F.from_json("j", kind, {"mode": "PERMISSIVE"})
    listed = F.when(F.startswith(F.trim("j"), F.lit("[")), whole).otherwise(F.array(F.from_json("j", "struct<k:int>")))
    ks = F.filter(F.transform(F.coalesce(listed, F.array().cast(kind)), lambda x: x["k"]), lambda k: k.isNotNull())
    return rows.select("event_id", F.concat_ws(",", F.transform(ks, lambda k: k.cast("string"))).alias("ks"), F.size(ks).alias("n"))


QUERIES = {
    "media_cascade": media_cascade, "ocr_fill": ocr_fill, "caption_either": caption_either, "compiled_search": compiled_search, "request_terms": request_terms, "enriched_hits": enriched_hits,
    "alias_search": alias_search, "facet_resolve": facet_resolve, "vocabulary_top": vocabulary_top, "vocabulary_collisions": vocabulary_collisions, "video_document": video_document,
    "point_lookup": point_lookup, "video_coverage": video_coverage, "series_histogram": series_histogram, "confidence_floor": confidence_floor, "json_lists": json_lists,
}

_BOTH = f"{_score_sql(PLAIN)}, {_score_sql(PLAIN, FOLDED, '_x')}"
_STAGED = f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {{order}}score DESC, uid)::INTEGER AS rank, uid AS doc_id, round(score, 4) AS score, stage FROM v QUALIFY rank <= {K}"
_PHRASED = ", ".join(f"({q.query_id}, '{t}', {len(t.split())})" for q in COMPILED for t in q.terms if " " in t)
_SINGLE = [L.TextQuery(q.query_id, tuple(t for t in q.terms if " " not in t)) for q in COMPILED]
_RESOLVED = [(1, "brand", "Brand#2", "brand/brand#2", "exact"), (1, "type", "  ECONOMY, ", "type/economy", "exact"), (1, "name", "RED RING", "name/red ring", "exact")]
ORACLES = {
    "media_cascade": f"""WITH {_BOTH}, o AS (SELECT o_orderkey AS uid FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderdate BETWEEN '1994-06-01' AND '1999-12-31'),
u AS (SELECT query_id, uid, score, 0 AS stage FROM a WHERE matched = n_terms UNION ALL SELECT query_id, uid, score, 1 FROM a UNION ALL SELECT query_id, uid, score, 2 FROM a_x),
v AS (SELECT * FROM u WHERE uid IN (SELECT uid FROM o) QUALIFY stage = min(stage) OVER (PARTITION BY query_id)) {_STAGED.format(order="")}""",
    "ocr_fill": f"""WITH {_BOTH}, u AS (SELECT query_id, uid, score, 0 AS stage FROM a WHERE matched = n_terms UNION ALL SELECT query_id, uid, score, 1 FROM a_x WHERE matched = n_terms),
u2 AS (SELECT query_id, uid, score, 2 AS stage FROM a UNION ALL SELECT query_id, uid, score, 3 FROM a_x),
w AS (SELECT * FROM u UNION ALL SELECT * FROM u2 WHERE query_id NOT IN (SELECT query_id FROM u)), v AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id, uid ORDER BY stage) = 1) {_STAGED.format(order="stage, ")}""",
    "caption_either": f"""WITH {_BOTH}, b AS (SELECT query_id, uid, n_terms, 'p:' || term AS term, score, 1 AS p FROM s UNION ALL SELECT query_id, uid, n_terms, 'x:' || term, score, 0 FROM s_x),
e AS (SELECT query_id, uid, list_sum(list(score ORDER BY term)) AS score FROM b GROUP BY query_id, uid HAVING sum(p) = any_value(n_terms) OR count(*) - sum(p) = any_value(n_terms)) {_TOP.format("e")}""",
    "compiled_search": f"""WITH {_score_sql(_SINGLE)}, p AS (SELECT * FROM (VALUES {_PHRASED}) p(query_id, phrase, n)),
h AS (SELECT uid, len(w) AS len, n, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
pf AS (SELECT query_id, phrase, uid, count(*) AS f, any_value(len) AS len FROM h JOIN p USING (phrase, n) GROUP BY ALL),
pi AS (SELECT query_id, phrase, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT query_id, phrase, count(*) AS n FROM pf GROUP BY ALL), c),
b AS (SELECT query_id, uid, term, score FROM s UNION ALL SELECT query_id, uid, phrase, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) FROM pf JOIN pi USING (query_id, phrase)),
e AS (SELECT query_id, uid, list_sum(list(score ORDER BY term)) AS score FROM b GROUP BY ALL) {_TOP.format("e")}""",
    "request_terms": f"""WITH d AS (SELECT ' ' || array_to_string({WORDS}, ' ') || ' ' AS t FROM documents),
r AS (SELECT * FROM (VALUES (1, 0, 'of the'), (1, 1, 'reat'), (1, 2, 'anti'), (2, 0, 'de la'), (2, 1, 'dans'), (3, 0, 'show'), (3, 1, 'the'), (3, 2, 'image')) v(query_id, place, term))
SELECT query_id, place, term, (SELECT count(*) FROM d WHERE contains(d.t, ' ' || r.term || ' ')) AS df FROM r""",
    "enriched_hits": f"""WITH {_score_sql(PLAIN)}, r AS ({_TOP.format("a")}) SELECT query_id, rank, r.doc_id, score, coalesce(quality, -1)::INTEGER AS quality, coalesce(toxic, -1)::INTEGER AS toxic FROM r LEFT JOIN labels USING (doc_id)""",
    "alias_search": f"WITH {_score_sql([L.TextQuery(1, ('onti', 'the')), L.TextQuery(2, ('reat',))])} {_TOP.format('a')}",
    "facet_resolve": f"""{_FACETS} SELECT r.* FROM (VALUES {", ".join(str(r) for r in _RESOLVED)}) r(query_id, namespace, raw, facet_id, how) WHERE facet_id IN (SELECT facet_id FROM g)
UNION ALL SELECT 2, 'name', 'hot-gear', min(facet_id), 'alias' FROM g WHERE namespace = 'name' AND replace(value, ' ', '-') = 'hot-gear' HAVING count(*) > 0""",
    "vocabulary_top": f"{_FACETS}, c AS (SELECT namespace, value, count(*) AS n FROM g GROUP BY ALL) SELECT namespace, row_number() OVER (PARTITION BY namespace ORDER BY n DESC, value)::INTEGER AS place, value, n FROM c QUALIFY place <= 5",
    "vocabulary_collisions": rf"{_FACETS}, c AS (SELECT DISTINCT namespace, value, regexp_replace(value, '[\s\d]', '', 'g') AS key FROM g) SELECT namespace, key, string_agg(value, '|' ORDER BY value) AS values, count(*) AS n_values FROM c GROUP BY namespace, key HAVING count(*) > 1",
    "video_document": """WITH l AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'p': l_partkey} ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS c, list({'key': o_orderkey, 'status': o_orderstatus, 'lines': coalesce(lines, [])} ORDER BY o_orderkey) AS orders FROM orders LEFT JOIN l ON o_orderkey = k GROUP BY 1)
SELECT c_custkey, to_json({'name': c_name, 'nation': n_name, 'n_orders': coalesce(len(orders), 0), 'orders': coalesce(orders, [])})::VARCHAR AS document FROM customer LEFT JOIN o ON c_custkey = c LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "point_lookup": "SELECT 'video' AS kind, c_custkey AS key, c_name AS name FROM customer WHERE c_custkey IN (3, 1000000000) UNION ALL SELECT 'keyframe', p_partkey, p_name FROM part WHERE p_partkey IN (3, 1000000000) UNION ALL SELECT 'segment', doc_id, source FROM documents WHERE doc_id IN (3, 1000000000)",
    "video_coverage": f"WITH {EVENTS} SELECT video, space, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM e GROUP BY video, space",
    "series_histogram": r"SELECT regexp_extract(c_name, '(\d)\d\d$', 1) AS series, count(*) AS n FROM customer GROUP BY 1",
    "confidence_floor": "SELECT l_returnflag || l_linestatus AS class_name, count(*) FILTER (round(l_quantity / 50, 6) >= 0.2) AS kept, count(*) FILTER (NOT coalesce(round(l_quantity / 50, 6) >= 0.2, FALSE)) AS dropped FROM lineitem GROUP BY 1",
    "json_lists": r"""WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS times, props->>'k' AS k FROM events)
SELECT event_id, CASE times WHEN 2 THEN k || ',' || k WHEN 1 THEN k ELSE '' END AS ks, times::INTEGER AS n FROM t""",
}
