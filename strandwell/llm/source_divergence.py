"""How far the sources of a language stand apart: an audit by sorted streams of terms.

1. Tasks cut blocks of whole documents into terms, sort each block by (term, source, document) and scan its runs, so that a block sends one
   record of document frequency and count for each (lang, term, source), however often the term stands in it.
2. The records are dealt by (lang, term) and sorted by (lang, term, source), lang and term being one key of bytes; one scan adds up runs, knows at the end of a term's run in how
   many documents of the language it stands, and emits the kept terms. It holds the run of one term: a row for each of its sources.
3. With the totals known, a second scan over the kept terms, dealt and sorted alike, emits the partial sums of the pairs of sources that
   share a term. What a term adds where one or both sources lack it depends on its count alone, so it comes from a histogram of counts:
   sum f(p, q) = sum over shared terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)) + sum over terms of one (f(p, q0) - f(p0, q0)),
   the same for the other, + V f(p0, q0), where p0 and q0 are the shares of a count of zero.

A frequent term is counted down to one record for each block and source before it travels; no task holds its documents. All
arithmetic is on integers, decimals where a product may pass a long.

Defined results: null text, lang and source are empty strings; each row is a document, rows of one doc_id or without one too; a text without
terms still makes its (lang, source) group occur; a language without kept terms gives pairs of value 0; a language with one source gives no pairs; equal
values rank by their items' bytes; no rows give no rows. Other columns are ignored. Document frequencies and counts are longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, tidied

#: Bytes of text that a block holds at most; a longer text is a block of its own.
BLOCK_BYTES = 20 << 20
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

#: Bytes of terms: letters of ASCII, and every byte of a character beyond it. Upper case becomes lower in ASCII alone.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[ord("A") : ord("Z") + 1] = IN_TERM[ord("a") : ord("z") + 1] = IN_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

RECORDS = "key binary, source string, documents long, count long"
KEPT = "key binary, source string, count long, in_lang long, first boolean"
SHARED = "lang string, a string, b string, value long"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (binary, without nulls) as one array, and the number of terms in each text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = IN_TERM[raw]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]  # a text's first byte begins a term even where the text before it ended in one
    ends = inside[:-1] & ~inside[1:]
    ends[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(begins)
    edges = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(np.flatnonzero(ends) - starts + 1, out=edges[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(LOWER[raw[inside[:-1]]])])
    return terms, np.diff(np.searchsorted(starts, offsets))


def block_records(block: pa.RecordBatch) -> pa.RecordBatch:
    """The records of a block of documents (text, lang, source): its terms sorted by (term, group, document), and their runs."""
    langs, sources = (block.column(i).dictionary_encode() for i in (1, 2))
    width = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))  # documents of one group stand side by side
    terms, lengths = terms_of(block.column(0))
    coded = terms.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(place, lengths)
    key.sort()
    document = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    code, at = np.divmod(key[document], max(1, len(order)))
    of_run = group[order][at] if len(key) else at
    run = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (of_run[1:] != of_run[:-1])]) if len(key) else document
    lang = langs.dictionary.cast(pa.binary()).take(pa.array(of_run[run] // width))
    columns = [
        pc.binary_join_element_wise(lang, coded.dictionary.take(pa.array(code[run])), b"\0"),
        sources.dictionary.take(pa.array(of_run[run] % width)),
        pa.array(np.diff(np.r_[run, len(document)])),
        pa.array(np.diff(np.r_[document[run], len(key)])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["key", "source", "documents", "count"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks of about BLOCK_BYTES."""
    held: list[pa.RecordBatch] = []
    used = 0
    for batch in batches:
        if held and used + batch.nbytes > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, used = [], 0
        if batch.num_rows:
            held.append(batch)
            used += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def records(docs: DataFrame) -> DataFrame:
    """key, source, documents, count: one record for each block of documents and (lang, term, source) in it; a key is lang, a zero byte and term."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield block_records(block)

    return docs.select(text, _name("lang"), _name("source")).mapInArrow(tidied(count, BLOCK_BYTES // 4), RECORDS)


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where rows begin that differ from the row before in any column."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _whole_runs(batches: Iterator[pa.RecordBatch], reduce, keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, reduced, and cut anew so that no run of the first `keys` columns is divided. What is carried over is one reduced run."""
    carried: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        batch = reduce(batch)
        last = int(np.flatnonzero(_changes(*batch.columns[:keys]))[-1])
        if last:
            yield batch.slice(0, last)
        carried = batch.slice(last)
    if carried is not None:
        yield carried


def _added(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring records of one key and source become one."""
    at = np.flatnonzero(_changes(*batch.columns[:2]))
    sums = [np.add.reduceat(batch.column(i).to_numpy(), at) for i in (2, 3)]
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(2)), *map(pa.array, sums)], batch.schema.names)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, count, in_lang (its count in the lang), first (of its term): the terms in at least `least` documents of their lang."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _whole_runs(batches, _added, 1):
            new = _changes(runs.column(0))
            at = np.flatnonzero(new)
            sizes = np.diff(np.r_[at, runs.num_rows])
            documents, count = (runs.column(i).to_numpy() for i in (2, 3))
            keep = np.repeat(np.add.reduceat(documents, at) >= least, sizes)
            total = np.repeat(np.add.reduceat(count, at), sizes)
            columns = [*(runs.column(i) for i in (0, 1, 3)), pa.array(total), pa.array(new)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "source", "count", "in_lang", "first"]).filter(pa.array(keep))

    found = records(docs).repartition("key").sortWithinPartitions("key", "source").mapInArrow(tidied(scan), KEPT)
    # No term holds a zero byte, so the last one of a key ends the lang.
    key = F.col("key").cast("string")
    named = found.withColumn("term", F.substring_index(key, "\0", -1)).withColumn("lang", F.substring(key, F.lit(1), F.length(key) - F.length("term") - 1))
    return named.select("lang", "term", "source", "count", "in_lang", "first")


def _div(a: Column, b: Column) -> Column:
    """a / b without its fraction (both are no less than 0); null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total); null where total is 0."""
    return _div((count.cast("decimal(20,0)") + 2) * SCALE, total) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are SCALE + 1 at most, so nothing passes a long."""
    return _div((p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N + 2 V), v (V), zero (the share of a count of 0), lang_total: of every (lang, source) that occurs."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.filter("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    found = docs.select(_name("lang"), _name("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    v, n, lang_n = (F.coalesce(F.col(c), F.lit(0)) for c in ("v", "n", "lang_n"))
    return found.select("lang", "source", (n + 2 * v).alias("total"), v.alias("v"), (lang_n + 2 * v).alias("lang_total")).withColumn("zero", share(F.lit(0), F.col("total")))


def shared_terms(shares: DataFrame) -> DataFrame:
    """lang, a, b, value: for pairs of sources (a before b), partial sums over the terms that both have.

    `shares` has lang, term, source, p, zero, one row for each (lang, term, source)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _whole_runs(batches, lambda batch: batch, 2):
            run = np.cumsum(_changes(runs.column(0), runs.column(1)))
            lang, source = runs.column(0).dictionary_encode(), runs.column(2).dictionary_encode()
            n = len(source.dictionary)
            name = lang.indices.to_numpy().astype(np.int64) * n + source.indices.to_numpy()
            p, zero = (runs.column(i).to_numpy() for i in (3, 4))
            for step in range(1, int(np.bincount(run).max())):  # partners that stand `step` rows further on in the same run
                left = np.flatnonzero(run[step:] == run[:-step])
                right = left + step
                value = _distance(p[left], p[right]) - _distance(p[left], zero[right]) - _distance(zero[left], p[right]) + _distance(zero[left], zero[right])
                pair = name[left] * n + name[right] % n
                order = np.argsort(pair, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
                found, sums = pair[order][at], np.add.reduceat(value[order], at)
                columns = [lang.dictionary.take(pa.array(found // n // n)), source.dictionary.take(pa.array(found // n % n)), source.dictionary.take(pa.array(found % n)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

    dealt = shares.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(tidied(scan), SHARED)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the divergence of every pair of sources of a lang, a before b."""
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total")))
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    counts = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    counts = counts.select("lang", "source", "terms", "zero", share(F.col("count"), F.col("total")).alias("p"))
    added = F.col("terms") * (distance(F.col("p"), F.col("other_zero")) - distance(F.col("zero"), F.col("other_zero")))
    pair = [F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    alone = counts.join(others, "lang").filter("source <> other").select("lang", *pair, added.alias("value"))
    base = F.coalesce(F.col("v") * distance(F.col("zero"), F.col("other_zero")), F.lit(0))
    none = groups.join(others, "lang").filter("source < other").select("lang", *pair, base.alias("value"))
    return shared_terms(shares).unionByName(alone).unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far every other source of the lang stands apart, and the terms that stand out."""
    kept = materialise(kept_terms(docs, least), "kept-terms")
    groups = materialise(groups_of(docs, kept), "source-groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    terms = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("count"), F.col("total")), "q": share(F.col("in_lang"), F.col("lang_total"))})
    out = terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    out = out.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    parts = [(both.withColumn("rank", F.row_number().over(ranked)), "pair"), (out, "term")]
    found = [part.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, name in parts]
    return found[0].unionByName(found[1])
