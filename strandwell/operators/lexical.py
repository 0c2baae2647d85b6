"""Ranked full-text search over any table of (uid, field texts), many queries at a time.

Scores are BM25 with k1 = 1.2 and b = 0.75: for each matching term or phrase idf * f * (k1 + 1) / (f + k1 * (1 - b + b * D / avgdl)), where
f is the weighted frequency over the fields, D the number of tokens in all fields and idf is floored at 1e-6. Higher is better.
A column filter holds for the whole group of terms behind it. Ties go to the smaller uid.

Two ways lead to scores. `term_scores`, `phrase_counts`, `trigram_counts` and `substring_terms` scan the texts once for all queries: tokens meet the
query terms, a small table that is broadcast (its size is that of the request), so only matching tokens are shuffled. `write_postings` stores an
inverted index with positions once (`postings`), and `indexed_scores` and `indexed_phrases` read of it only what a request's terms need.

Scores are ranked as they are and rounded where they are shown; a document's sum is taken in order of its terms, so equal documents tie.

Defined results: a null text has no words; a null uid is ranked like any other, before all others among equals; no rows give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.functions.text import accentless, tokens
from strandwell.operators import postings as P

K1, B, FLOOR = 1.2, 0.75, 1e-6

# Words that say how something is asked for, not what.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "find", "for", "from", "image", "in", "is", "it", "of", "on", "or", "scene", "show", "that", "the", "this", "to", "video", "was", "with")


@dataclass(frozen=True)
class TextQuery:
    """A request: its id and its terms; `scope` None means everywhere, an empty tuple nowhere."""

    query_id: int
    terms: tuple[str, ...]
    scope: tuple[str, ...] | None = None


MOST_TERMS = 12
_QUOTED = re.compile(r'"([^"]*)"')
_WORD = re.compile(r"\w+")


def compile_text(query_id: int, text: str, strict: bool = False, scope: tuple[str, ...] | None = None, stopwords: tuple[str, ...] = STOPWORDS) -> TextQuery:
    """The request that a line of text asks for: phrases in quotes first, then the other words, each once.

    An odd number of quotes is an error. Strict requests hold every word. Relaxed ones leave out stop words (unless nothing else is left) and
    hold `MOST_TERMS` terms at most. A phrase is a term of several words with spaces between them."""
    if text.count('"') % 2:
        raise ValueError("a quote is not closed")
    phrases = [" ".join(_WORD.findall(part.lower())) for part in _QUOTED.findall(text)]
    words = _WORD.findall(_QUOTED.sub(" ", text).lower())
    if not strict:
        words = [w for w in words if w not in stopwords] or ([] if any(phrases) else words)
    terms = tuple(dict.fromkeys(t for t in (*phrases, *words) if t))
    if not terms:
        raise ValueError("no words")
    return TextQuery(query_id, terms if strict else terms[:MOST_TERMS], scope)


def relaxed(query: TextQuery, most: int = MOST_TERMS, stopwords: tuple[str, ...] = STOPWORDS) -> TextQuery:
    """Without stop words (unless nothing else is left) and with `most` terms at most."""
    kept = tuple(t for t in query.terms if t not in stopwords) or query.terms
    return TextQuery(query.query_id, tuple(dict.fromkeys(kept))[:most], query.scope)


def query_table(spark: SparkSession, queries: list[TextQuery]) -> DataFrame:
    """query_id, term, n_terms: a row for each distinct term of each query."""
    rows = [(q.query_id, t, len(set(q.terms))) for q in queries for t in dict.fromkeys(q.terms)]
    return spark.createDataFrame(rows, "query_id int, term string, n_terms int")


def indexed(table: DataFrame, uid: str, fields: dict[str, Column]) -> DataFrame:
    """uid and one token array for each field."""
    return table.select(F.col(uid).alias("uid"), *[tokens(text).alias(name) for name, text in fields.items()])


def lengths(index: DataFrame, fields: list[str]) -> DataFrame:
    """n_docs and avgdl of the corpus, one row."""
    size = sum((F.size(f) for f in fields[1:]), F.size(fields[0]))
    return index.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avgdl"))


def _weighted(field: str, weight: float) -> Column:
    """The field's tokens with its weight."""
    return F.transform(field, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))


def term_scores(index: DataFrame, terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query_id, uid, term, n_terms, score: the score of each query term in each document that has it in a field of positive weight.

    Lengths and average count all fields, also those of weight 0."""
    fields = list(weights)
    size = sum((F.size(f) for f in fields[1:]), F.size(fields[0]))
    words = F.concat(*[_weighted(f, w) for f, w in weights.items() if w > 0])
    wanted = terms.select("term").distinct()
    hits = index.select("uid", size.alias("len"), F.explode(words).alias("t")).select("uid", "len", "t.term", "t.w")
    counts = hits.join(F.broadcast(wanted), "term").groupBy("term", "uid").agg(F.sum("w").alias("f"), F.first("len").alias("len"))
    df = counts.groupBy("term").agg(F.count("*").alias("n"))
    corpus = lengths(index, fields)
    ratio = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # One row for each term of the request.
    rated = df.crossJoin(F.broadcast(corpus)).select("term", "avgdl", F.greatest(ratio, F.lit(FLOOR)).alias("idf"))
    score = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return counts.join(F.broadcast(rated), "term").join(F.broadcast(terms), "term").select("query_id", "uid", "term", "n_terms", score.alias("score"))


def write_postings(index: DataFrame, fields: list[str], path: str, size: int = 0) -> None:
    """Stores the postings (term, uid, len, counts and positions by field) of an index of token arrays made from `size` bytes, and its totals."""
    P.write(P.packed_words(index, fields), index.agg(F.count("*").alias("n_docs")), fields, path, size)


def write_texts(texts: DataFrame, fields: list[str], path: str, size: int = 0) -> None:
    """As write_postings, of a table of texts (uid and the fields) whose words are those of `tokens`."""
    P.write(P.packed_texts(texts, fields), texts.agg(F.count("*").alias("n_docs")), fields, path, size)


def indexed_scores(spark: SparkSession, path: str, queries: list[TextQuery], weights: dict[str, float]) -> DataFrame:
    """As term_scores, from stored postings: only the partitions and pages of the request's terms are read, without their positions."""
    totals = P.totals_of(spark, path)
    wanted = sorted({t for q in queries for t in q.terms})
    f = sum((F.col(f"n_{name}") * float(w) for name, w in weights.items()), F.lit(0.0))
    counts = P.read(spark, path, wanted, ["uid", "len", *(f"n_{name}" for name in weights)]).select("term", "uid", "len", f.alias("f")).filter("f > 0")
    df = counts.groupBy("term").agg(F.count("*").alias("n"))
    ratio = F.log((F.lit(totals["n_docs"]) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rated = df.select("term", F.greatest(ratio, F.lit(FLOOR)).alias("idf"))
    score = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(float(totals["avgdl"] or 0))))
    terms = query_table(spark, queries)  # a row for each term of the request, as `rated` has
    return counts.join(F.broadcast(rated), "term").join(F.broadcast(terms), "term").select("query_id", "uid", "term", "n_terms", score.alias("score"))


def indexed_phrases(spark: SparkSession, path: str, phrases: list[tuple], field: str = "text") -> DataFrame:
    """query_id, uid, score of phrases (query_id, words) by stored positions; each phrase is rated like a term."""
    return rate(P.phrase_counts(spark, path, phrases, field), spark.read.parquet(f"{path}/totals"))


def scoped(scores: DataFrame, queries: list[TextQuery], places: DataFrame, place: str) -> DataFrame:
    """The rows of each query within its scope: `places` has uid and the column `place` that scopes name. Scores don't change by a scope."""
    allowed = F.lit(False)
    for q in queries:
        here = F.lit(True) if q.scope is None else F.col(place).isin(list(q.scope)) if q.scope else F.lit(False)
        allowed = allowed | ((F.col("query_id") == q.query_id) & here)
    return scores.join(places.select("uid", place), "uid").filter(allowed)


def top(scored: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """The k best rows of each query by score, then uid, with their rank; the window keeps k rows of each task before it shuffles."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "uid")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def any_terms(scores: DataFrame) -> DataFrame:
    """query_id, uid, score, matched: documents with at least one term. Terms are a request's, so a document has few."""
    terms = scores.groupBy("query_id", "uid").agg(F.sort_array(F.collect_list(F.struct("term", "score"))).alias("t"), F.first("n_terms").alias("n_terms"))
    total = F.aggregate("t", F.lit(0.0), lambda s, t: s + t["score"])
    return terms.select("query_id", "uid", total.alias("score"), F.size("t").alias("matched"), "n_terms")


def all_terms(scores: DataFrame) -> DataFrame:
    """As any_terms, documents with every term only."""
    return any_terms(scores).filter(F.col("matched") == F.col("n_terms"))


def _staged(stages: list[DataFrame], k: int) -> DataFrame:
    """query_id, uid, score, stage: the k best of each stage and query, which is all that later steps can show."""
    every = None
    for number, stage in enumerate(stages):
        part = top(stage, k).select("query_id", "uid", "score", F.lit(number).alias("stage"))
        every = part if every is None else every.unionByName(part)
    return every


def cascade(stages: list[DataFrame], k: int) -> DataFrame:
    """For each query the results of the first stage that has any: query_id, stage, rank, uid, score."""
    every = _staged(stages, k)  # k rows of each stage at most
    first = F.min("stage").over(Window.partitionBy("query_id"))
    return top(every.withColumn("_first", first).filter(F.col("stage") == F.col("_first")).drop("_first"), k)


def fill(stages: list[DataFrame], k: int) -> DataFrame:
    """For each query the results of one stage after the other, without repeats, until there are k.

    A document that an earlier stage has is dropped from a later one; as the earlier have at most k, the k + k * stages best suffice."""
    every = _staged(stages, k * (1 + len(stages)))
    seen = every.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "uid").orderBy("stage"))).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("stage", F.col("score").desc(), "uid")
    return seen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fill_or_else(strict: list[DataFrame], loose: list[DataFrame], k: int) -> DataFrame:
    """The strict stages filled up to k; queries that they have nothing for get the loose stages, whose numbers follow on."""
    first = fill(strict, k)
    answered = F.broadcast(first.select("query_id").distinct())  # a request's ids
    second = fill(loose, k).join(answered, "query_id", "left_anti").withColumn("stage", F.col("stage") + len(strict))
    return first.unionByName(second.select(first.columns))


def either(plain: DataFrame, folded: DataFrame) -> DataFrame:
    """query_id, uid, score: documents with every term of a query as it stands, or every one without accents; all that match count.

    Both are scores of terms; of a document that one side alone makes a result, the other side's terms count too."""
    side = lambda rows, name, p: rows.select("query_id", "uid", F.concat(F.lit(name), "term").alias("term"), "n_terms", "score", F.lit(p).alias("p"))
    both = side(plain, "p:", 1).unionByName(side(folded, "x:", 0)).groupBy("query_id", "uid")
    terms = both.agg(F.sort_array(F.collect_list(F.struct("term", "score"))).alias("t"), F.first("n_terms").alias("n"), F.sum("p").alias("n_plain"), F.count("*").alias("n_all"))
    kept = terms.filter((F.col("n_plain") == F.col("n")) | (F.col("n_all") - F.col("n_plain") == F.col("n")))
    return kept.select("query_id", "uid", F.aggregate("t", F.lit(0.0), lambda s, t: s + t["score"]).alias("score"))


def author_has(author: Column, wanted: str) -> Column:
    """Whether an author's name holds a text, whatever the case; the text has no wildcards."""
    return F.contains(F.lower(author), F.lit(unicodedata.normalize("NFC", wanted).lower()))


def dates_within(text: Column, first: str | None, last: str | None) -> Column:
    """Whether a date dd/mm/yyyy lies between two such dates, ends included; a bound that is no date counts as none, a row without a date fails a bound."""
    day, inside = F.try_to_date(text, "dd/MM/yyyy"), F.lit(True)
    for bound, test in ((first, lambda d: day >= d), (last, lambda d: day <= d)):
        try:
            at = F.lit(datetime.strptime(bound or "", "%d/%m/%Y").date())
        except ValueError:
            continue
        inside = inside & F.coalesce(test(at), F.lit(False))
    return inside


def substituted(text: Column, aliases: dict[str, str]) -> Column:
    """A text in lower case with the words of a language of users replaced by a catalogue's, longer ones first."""
    out = F.lower(text)
    for old in sorted(aliases, key=lambda a: (-len(a), a)):
        out = F.replace(out, F.lit(old), F.lit(aliases[old]))
    return out


def enriched(ranked: DataFrame, entities: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Ranked rows with the columns `defaults` names of their entities, joined after the cut; a missing entity or value gives the default."""
    kept = entities.select(F.col(key).alias("_key"), *defaults)
    met = ranked.join(kept, F.col("uid") == F.col("_key"), "left")
    return met.drop("_key").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def phrase_counts(table: DataFrame, uid: str, text: Column, phrases: DataFrame) -> DataFrame:
    """query_id, uid, f, len: how often each phrase (array column `words`) occurs in a row of words.

    A request's phrases are few: each is looked for in every text as a string between spaces, and counted by place where it is found."""
    rows = table.select(F.col(uid).alias("uid"), tokens(text).alias("w")).select("uid", "w", F.concat(F.lit(" "), F.concat_ws(" ", "w"), F.lit(" ")).alias("t"))
    wanted = phrases.select("query_id", "words", F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")).alias("needle"), F.size("words").alias("n"))
    met = rows.join(F.broadcast(wanted), F.contains("t", F.col("needle")))
    places = F.filter(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: (F.get("w", i - 1) == F.get("words", F.lit(0))) & (F.slice("w", i, F.col("n")) == F.col("words")))
    return met.select("query_id", "uid", F.size(places).alias("f"), F.size("w").alias("len"))


def rate(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, uid, score of counted phrases: each phrase is one term."""
    n = counts.groupBy("query_id").agg(F.count("*").alias("n"))
    rated = n.crossJoin(F.broadcast(corpus)).select("query_id", "avgdl", F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(FLOOR)).alias("idf"))
    score = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return counts.join(F.broadcast(rated), "query_id").select("query_id", "uid", score.alias("score"))


def trigram_counts(table: DataFrame, uid: str, text: Column, queries: DataFrame) -> DataFrame:
    """query_id, uid, f, len: occurrences of each query's `needle` (three characters or more, case and marks ignored) in a text.

    A request's needles are few: each is looked for in every text as a string; len counts the text's trigrams."""
    folded = table.select(F.col(uid).alias("uid"), accentless(text).alias("t"))
    rows = folded.select("uid", "t", F.greatest(F.length("t") - 2, F.lit(0)).alias("len"))
    wanted = queries.select("query_id", accentless(F.col("needle")).alias("needle")).filter(F.length("needle") >= 3)
    # Needles are a request's: few, each once against every text.
    met = rows.join(F.broadcast(wanted), F.contains("t", F.col("needle")))
    f = ((F.length("t") - F.length(F.replace("t", F.col("needle"), F.lit("")))) / F.length("needle")).cast("int")
    return met.select("query_id", "uid", f.alias("f"), "len")


def substring_terms(table: DataFrame, uid: str, text: Column, queries: DataFrame) -> DataFrame:
    """query_id, uid, f, len: texts with a query's whole `needle`, or else with all of its words of three characters or more.

    f is the number of occurrences of the needle, or that of all its words where the needle as a whole isn't there."""
    whole = trigram_counts(table, uid, text, queries).select("query_id", "uid", "f", "len", F.lit(0).alias("stage"))
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(accentless(F.col("needle")), r"\s+"), lambda w: F.length(w) >= 3))).alias("w"))
    numbered = words.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).withColumn("part", F.row_number().over(Window.partitionBy("query_id").orderBy("w")))
    parts = trigram_counts(table, uid, text, numbered.select(F.struct("query_id", "n", "part").alias("query_id"), F.col("w").alias("needle")))
    flat = parts.select("query_id.query_id", "query_id.n", "uid", "f", "len")
    every = flat.groupBy("query_id", "uid").agg(F.sum("f").cast("int").alias("f"), F.first("len").alias("len"), F.count("*").alias("c"), F.first("n").alias("n")).filter("c = n")
    both = whole.unionByName(every.select("query_id", "uid", "f", "len", F.lit(1).alias("stage")))
    first = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy("stage"))
    return both.withColumn("_n", first).filter("_n = 1").select("query_id", "uid", "f", "len")
