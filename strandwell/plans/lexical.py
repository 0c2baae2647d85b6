"""Full-text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.functions.text import accentless, snippet, tokens
from strandwell.operators import lexical as L
from strandwell.operators import postings as P
from strandwell.sources.store import stored
from strandwell.sources.tables import table

K = 20
REQUESTS = [
    L.TextQuery(1, ("erti", "onti", "reat")),
    L.TextQuery(2, ("the", "anti", "heat", "here")),
    L.TextQuery(3, ("pour", "dans")),
    L.TextQuery(4, ("nicht", "sich", "ener")),
    L.TextQuery(5, ("èque", "étion")),
    L.TextQuery(6, ("que", "nowhere")),
]
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _values(queries: list[L.TextQuery]) -> str:
    return "(VALUES " + ", ".join(f"({q.query_id}, '{t}', {len(set(q.terms))})" for q in queries for t in dict.fromkeys(q.terms)) + ") q(query_id, term, n_terms)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.indexed(table(spark, sf_dir, "documents"), "doc_id", {"text": F.col("text")})


def _postings(spark: SparkSession, sf_dir: str, name: str, text: Column) -> str:
    """Where the postings of the documents lie; built by the first query that asks for them, in whichever session."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), text.alias("text"))
    return stored(spark, name, [f"{sf_dir}/documents.parquet"], {"fields": ["text"], "form": name}, lambda path, source: L.write_texts(texts, ["text"], path, source.size))


def word_index(spark: SparkSession, sf_dir: str) -> str:
    return _postings(spark, sf_dir, "documents", F.col("text"))


def trigram_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the trigrams of the documents' folded texts lie."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), accentless(F.col("text")).alias("text"))
    return stored(spark, "trigrams", [f"{sf_dir}/documents.parquet"], {"form": "accentless"}, lambda path, source: P.write(P.trigram_postings(texts), texts.agg(F.count("*").alias("n_docs")), ["text"], path, source.size))


def _scores(spark: SparkSession, sf_dir: str, queries: list[L.TextQuery]) -> DataFrame:
    return L.indexed_scores(spark, word_index(spark, sf_dir), queries, {"text": 1.0})


def _score_sql(queries: list[L.TextQuery], words: str = WORDS, name: str = "") -> str:
    """Common table expressions up to a{name}: query_id, uid, score, matched, n_terms."""
    return f"""
d{name} AS (SELECT doc_id AS uid, {words} AS w FROM documents),
c{name} AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d{name}),
q{name} AS (SELECT * FROM {_values(queries)}),
t{name} AS (SELECT uid, len(w) AS len, unnest(w) AS term FROM d{name}),
f{name} AS (SELECT term, uid, count(*) AS f, any_value(len) AS len FROM t{name} WHERE term IN (SELECT term FROM q{name}) GROUP BY term, uid),
i{name} AS (SELECT term, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT term, count(*) AS n FROM f{name} GROUP BY term), c{name}),
s{name} AS (SELECT query_id, uid, term, n_terms, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS score FROM f{name} JOIN i{name} USING (term) JOIN q{name} USING (term)),
a{name} AS (SELECT query_id, uid, list_sum(list(score ORDER BY term)) AS score, count(*) AS matched, any_value(n_terms) AS n_terms FROM s{name} GROUP BY query_id, uid)"""


_TOP = f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid)::INTEGER AS rank, uid AS doc_id, round(score, 4) AS score FROM {{}} QUALIFY rank <= {K}"


def _shape(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select("query_id", "rank", F.col("uid").alias("doc_id"), F.round("score", 4).alias("score"), *more)


def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(L.top(L.any_terms(_scores(spark, sf_dir, REQUESTS)), K))


def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(L.top(L.all_terms(_scores(spark, sf_dir, REQUESTS)), K))


PLAIN = [L.TextQuery(1, ("erti", "onti", "reat")), L.TextQuery(5, ("eque", "etion")), L.TextQuery(7, ("oner", "nowhere")), L.TextQuery(8, ("nowhere",))]


def _accentless_scores(spark: SparkSession, sf_dir: str, queries: list[L.TextQuery]) -> DataFrame:
    return L.indexed_scores(spark, _postings(spark, sf_dir, "documents_plain", accentless(F.col("text"))), queries, {"text": 1.0})


FOLDED = r"regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{L}\p{N}_]+')"


def bm25_accentless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(L.top(L.any_terms(_accentless_scores(spark, sf_dir, PLAIN)), K))


def bm25_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _scores(spark, sf_dir, PLAIN)
    stages = [L.all_terms(plain), L.any_terms(plain), L.any_terms(_accentless_scores(spark, sf_dir, PLAIN))]
    return _shape(L.cascade(stages, K), "stage")


def lexical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [L.all_terms(_scores(spark, sf_dir, PLAIN)), L.all_terms(_accentless_scores(spark, sf_dir, PLAIN))]
    return _shape(L.fill(stages, K), "stage")


def stopword_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(L.top(L.any_terms(_scores(spark, sf_dir, [L.relaxed(q) for q in REQUESTS])), K))


SCOPES = [L.TextQuery(1, REQUESTS[0].terms, ("src1", "src2", "src3")), L.TextQuery(2, REQUESTS[1].terms, None), L.TextQuery(3, REQUESTS[2].terms, ())]


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores come from the whole corpus; a scope only says which sources may be returned."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "source")
    return _shape(L.top(L.scoped(L.any_terms(_scores(spark, sf_dir, SCOPES)), SCOPES, sources, "source"), K), "source")


PHRASES = [(1, ["of", "the"]), (2, ["the", "erst"]), (3, ["de", "la"]), (4, ["and", "of", "the"])]


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(L.top(L.indexed_phrases(spark, word_index(spark, sf_dir), PHRASES), K))


def _phrase_sql() -> str:
    rows = ", ".join(f"({i}, '{' '.join(p)}', {len(p)})" for i, p in PHRASES)
    return f"""
WITH d AS (SELECT doc_id AS uid, {WORDS} AS w FROM documents), c AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
p AS (SELECT * FROM (VALUES {rows}) p(query_id, phrase, n)),
h AS (SELECT uid, len(w) AS len, n, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
f AS (SELECT query_id, uid, count(*) AS f, any_value(len) AS len FROM h JOIN p USING (phrase, n) GROUP BY query_id, uid),
i AS (SELECT query_id, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT query_id, count(*) AS n FROM f GROUP BY 1), c),
a AS (SELECT query_id, uid, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS score FROM f JOIN i USING (query_id))
{_TOP.format("a")}"""


NEEDLES = [(1, "eration"), (2, "chtung"), (3, "étion"), (4, "xq"), (5, "The on")]


def _folded(spark: SparkSession, needles: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """A request's needles in the form that texts are stored in."""
    return [(r["query_id"], r["needle"]) for r in spark.createDataFrame(needles, "query_id int, needle string").select("query_id", accentless(F.col("needle")).alias("needle")).collect()]


def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = trigram_index(spark, sf_dir)
    return _shape(L.top(L.rate(P.substring_counts(spark, path, _folded(spark, NEEDLES)), spark.read.parquet(f"{path}/totals")), K))


def _trigram_sql() -> str:
    rows = ", ".join(f"({i}, replace(strip_accents(lower('{n}')), 'đ', 'd'))" for i, n in NEEDLES if len(n) >= 3)
    return f"""
WITH d AS (SELECT doc_id AS uid, replace(strip_accents(lower(text)), 'đ', 'd') AS t, greatest(length(text) - 2, 0) AS len FROM documents),
c AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM d), p AS (SELECT * FROM (VALUES {rows}) p(query_id, needle)),
f AS (SELECT query_id, uid, len, (length(t) - length(replace(t, needle, ''))) // length(needle) AS f FROM d JOIN p ON contains(t, needle)),
i AS (SELECT query_id, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT query_id, count(*) AS n FROM f GROUP BY 1), c),
a AS (SELECT query_id, uid, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS score FROM f JOIN i USING (query_id))
{_TOP.format("a")}"""


SUBSTRINGS = [(1, "eration the"), (2, "chtung der"), (3, "The on"), (4, "ation reti")]


def substring_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = trigram_index(spark, sf_dir)
    return _shape(L.top(L.rate(P.substring_terms(spark, path, _folded(spark, SUBSTRINGS)), spark.read.parquet(f"{path}/totals")), K))


def _substring_sql() -> str:
    whole = ", ".join(f"({i}, lower('{n}'))" for i, n in SUBSTRINGS)
    words = ", ".join(f"({i}, '{w}', {len([x for x in n.split() if len(x) > 2])})" for i, n in SUBSTRINGS for w in n.lower().split() if len(w) > 2)
    return f"""
WITH d AS (SELECT doc_id AS uid, replace(strip_accents(lower(text)), 'đ', 'd') AS t, greatest(length(text) - 2, 0) AS len FROM documents),
c AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM d), p AS (SELECT * FROM (VALUES {whole}) p(query_id, needle)), w AS (SELECT * FROM (VALUES {words}) w(query_id, needle, n)),
a1 AS (SELECT query_id, uid, len, (length(t) - length(replace(t, needle, ''))) // length(needle) AS f, 0 AS stage FROM d JOIN p ON contains(t, needle)),
a2 AS (SELECT query_id, uid, any_value(len) AS len, sum((length(t) - length(replace(t, needle, ''))) // length(needle)) AS f, 1 AS stage FROM d JOIN w ON contains(t, needle) GROUP BY query_id, uid HAVING count(*) = any_value(n)),
f AS (SELECT * FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) QUALIFY row_number() OVER (PARTITION BY query_id, uid ORDER BY stage) = 1),
i AS (SELECT query_id, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT query_id, count(*) AS n FROM f GROUP BY 1), c),
a AS (SELECT query_id, uid, idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS score FROM f JOIN i USING (query_id))
{_TOP.format("a")}"""


FIELDS = {"title": 10.0, "body": 6.0, "url": 0.0}
PAGE_REQUESTS = [L.TextQuery(1, ("the", "oner", "anti")), L.TextQuery(2, ("que", "pour")), L.TextQuery(3, ("das",))]
TITLE, BODY = r"(?s)<title>(.*?)</title>", r"(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>"


def _page_postings(spark: SparkSession, sf_dir: str) -> str:
    fields = {"title": F.regexp_extract("html", TITLE, 1), "body": F.regexp_replace("html", BODY, " "), "url": F.col("url")}
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("uid"), *[text.alias(name) for name, text in fields.items()])
    return stored(spark, "pages", [f"{sf_dir}/pages.parquet"], {"fields": list(fields)}, lambda path, source: L.write_texts(texts, list(fields), path, source.size))


def bm25_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = L.indexed_scores(spark, _page_postings(spark, sf_dir), PAGE_REQUESTS, FIELDS)
    return L.top(L.any_terms(scores), K).select("query_id", "rank", F.col("uid").alias("page_id"), F.round("score", 4).alias("score"))


def _fields_sql() -> str:
    word = r"'[\p{L}\p{N}_]+'"
    return f"""
WITH d AS (SELECT page_id AS uid, regexp_extract_all(lower(regexp_extract(html, '{TITLE}', 1)), {word}) AS t, regexp_extract_all(lower(regexp_replace(html, '{BODY}', ' ', 'g')), {word}) AS b, regexp_extract_all(lower(url), {word}) AS u FROM pages),
c AS (SELECT count(*) AS n_docs, avg(len(t) + len(b) + len(u)) AS avgdl FROM d), q AS (SELECT * FROM {_values(PAGE_REQUESTS)}),
h AS (SELECT uid, len(t) + len(b) + len(u) AS len, unnest(t) AS term, 10::DOUBLE AS w FROM d UNION ALL SELECT uid, len(t) + len(b) + len(u), unnest(b), 6::DOUBLE FROM d),
f AS (SELECT term, uid, sum(w) AS f, any_value(len) AS len FROM h WHERE term IN (SELECT term FROM q) GROUP BY term, uid),
i AS (SELECT term, greatest(ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM (SELECT term, count(*) AS n FROM f GROUP BY term), c),
a AS (SELECT query_id, uid, list_sum(list(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) ORDER BY term)) AS score FROM f JOIN i USING (term) JOIN q USING (term) GROUP BY query_id, uid)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid)::INTEGER AS rank, uid AS page_id, round(score, 4) AS score FROM a QUALIFY rank <= {K}"""


SNIPPET_TERMS, SNIPPET_WIDTH = ["reat", "the", "onti", "erst"], 8


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that hold a term, with the words where most of them stand together."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    found = turns.filter(F.arrays_overlap("w", F.array(*[F.lit(t) for t in SNIPPET_TERMS])))
    return found.select("conv_id", "turn", snippet(F.col("w"), SNIPPET_TERMS, SNIPPET_WIDTH).alias("snippet"))


QUERIES = {
    "bm25_or_topk": bm25_or, "bm25_and_topk": bm25_and, "bm25_accentless": bm25_accentless, "bm25_cascade": bm25_cascade, "lexical_fill": lexical_fill,
    "stopword_relaxed": stopword_relaxed, "scope_filter": scope_filter, "phrase_match": phrase_match, "trigram_topk": trigram_topk, "substring_topk": substring_topk,
    "bm25_weighted_fields": bm25_weighted_fields, "snippets": snippets,
}

ORACLES = {
    "bm25_or_topk": f"WITH {_score_sql(REQUESTS)} {_TOP.format('a')}",
    "bm25_and_topk": f"WITH {_score_sql(REQUESTS)} {_TOP.format('(SELECT * FROM a WHERE matched = n_terms)')}",
    "bm25_accentless": f"WITH {_score_sql(PLAIN, FOLDED)} {_TOP.format('a')}",
    "bm25_cascade": f"""WITH {_score_sql(PLAIN)}, {_score_sql(PLAIN, FOLDED, "_x")},
u AS (SELECT query_id, uid, score, 0 AS stage FROM a WHERE matched = n_terms UNION ALL SELECT query_id, uid, score, 1 FROM a UNION ALL SELECT query_id, uid, score, 2 FROM a_x),
v AS (SELECT * FROM u QUALIFY stage = min(stage) OVER (PARTITION BY query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid)::INTEGER AS rank, uid AS doc_id, round(score, 4) AS score, stage FROM v QUALIFY rank <= {K}""",
    "lexical_fill": f"""WITH {_score_sql(PLAIN)}, {_score_sql(PLAIN, FOLDED, "_x")},
u AS (SELECT query_id, uid, score, 0 AS stage FROM a WHERE matched = n_terms UNION ALL SELECT query_id, uid, score, 1 FROM a_x WHERE matched = n_terms),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, uid ORDER BY stage) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, score DESC, uid)::INTEGER AS rank, uid AS doc_id, round(score, 4) AS score, stage FROM v QUALIFY rank <= {K}""",
    "stopword_relaxed": f"WITH {_score_sql([L.relaxed(q) for q in REQUESTS])} {_TOP.format('a')}",
    "scope_filter": f"""WITH {_score_sql(SCOPES)}, v AS (SELECT a.*, source FROM a JOIN documents ON uid = doc_id WHERE query_id = 2 OR query_id = 1 AND source IN ('src1', 'src2', 'src3'))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid)::INTEGER AS rank, uid AS doc_id, round(score, 4) AS score, source FROM v QUALIFY rank <= {K}""",
    "phrase_match": _phrase_sql(),
    "trigram_topk": _trigram_sql(),
    "substring_topk": _substring_sql(),
    "bm25_weighted_fields": _fields_sql(),
    "snippets": rf"""
WITH d AS (SELECT row_number() OVER () AS r, conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w, {SNIPPET_TERMS} AS t FROM conversations),
h AS (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda k: list_contains(t, w[k]))) AS p FROM d),
c AS (SELECT *, len(list_distinct(list_filter(w[p:p + {SNIPPET_WIDTH - 1}], lambda x: list_contains(t, x)))) AS n, list_max(list_filter(range(p, least(p + {SNIPPET_WIDTH}, len(w) + 1)), lambda k: list_contains(t, w[k]))) AS last FROM h),
b AS (SELECT *, greatest(1, least(p - ({SNIPPET_WIDTH} - (last - p + 1)) // 2, len(w) - {SNIPPET_WIDTH - 1})) AS s FROM c QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, p) = 1)
SELECT conv_id, turn, (CASE WHEN s > 1 THEN '… ' ELSE '' END) || array_to_string(list_transform(w[s:s + {SNIPPET_WIDTH - 1}], lambda x: CASE WHEN list_contains(t, x) THEN '[' || x || ']' ELSE x END), ' ') || (CASE WHEN s + {SNIPPET_WIDTH} <= len(w) THEN ' …' ELSE '' END) AS snippet FROM b""",
}
