"""Stored postings with positions: words of fields, and trigrams of folded texts.

A task groups the words of a block of rows in one sort and sends one row for each term of the block, which packs the term's postings: of each row
of the source that holds it the id, the length, the counts and the positions by field. So what is shuffled, sorted, written and audited are as many rows
as blocks have terms, and not as there are postings; a packed row is never longer than its block. They are dealt once, by a hash of the term, and written sorted by term, so that a request reads the partitions, row groups and pages of its
terms only. Partitions follow the size of the source; tasks that write them follow the size of the postings, so the postings of a term that is everywhere are
spread over several. Positions are whole numbers in rising order, which the file format stores as differences.

Trigrams are as many as the texts have characters, so a posting of theirs is one number: where the trigram stands in its block, whose rows follow each other
with a gap. They are stored as differences of one byte or more, and a row without a term tells each block's ids and lengths once. Nothing of them is
shuffled: a task sorts the postings of its split by term and writes them, a file for each of a fixed number of buckets.

Phrases are met by intersecting positions shifted by the words' places; substrings in each block by the places of a cover of their trigrams, the fewest first.

Defined results: a null text has no terms; a null uid is a row like others; repeated uids have a posting for each row, and count as rows of their own
only where `uid` tells them apart; an empty phrase or a needle below three characters matches nothing; no rows give an empty index.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwell.functions.text import WORD

#: Bytes of a source for each partition, and the partitions that there are at least and at most.
PART_BYTES, FEWEST, MOST = 64 << 20, 16, 4096
#: Words and trigrams that a task groups at once, and the bytes of rows that it holds for this beyond one batch.
BLOCK, GRAMS, HELD = 1 << 21, 1 << 21, 64 << 20
#: Places between the trigrams of two rows of a block: as many as keep a cover, which goes by steps of three at most, from leading into the next row.
GAP = 3
#: Rows of a page of trigrams, so that a request reads few others beside its own.
PAGE = 256
#: Packed rows that a task sends at once, and bytes of texts that it cuts into words at once.
SENT, CUT = 1 << 16, 1 << 20
#: Documents of the rarest trigrams whose blocks are broadcast, so that other blocks' postings are dropped before they travel.
MOST_CANDIDATES = 100_000


def buckets_for(size: int) -> tuple[int, int]:
    """Partitions by term for a source of so many bytes, and the files that each is dealt over."""
    buckets = min(MOST, max(FEWEST, -(-size // PART_BYTES)))
    return buckets, max(1, -(-size // (buckets * PART_BYTES)))


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows by bucket and term. A task takes what Spark's advisory size says: a large bucket, as that of a term which is everywhere, is split over several."""
    return rows.hint("rebalance", tasks, "bucket").sortWithinPartitions("bucket", "term")


def _grouped(uids: pa.Array, lengths: np.ndarray, names: pa.Array, code: np.ndarray, row: np.ndarray, field: np.ndarray, position: np.ndarray, fields: list[str]) -> pa.RecordBatch:
    """The postings of a block, packed: one row for each term `code` (of `names`), which stands at `position` of a field of a row.

    Positions of one (row, field) come in rising order, and the fields of a row in theirs."""
    if len(fields) > 1:
        by_row = np.argsort(row, kind="stable")
        code, row, field, position = code[by_row], row[by_row], field[by_row], position[by_row]
    # By the lower two bytes and then the upper ones, as numbers of two bytes are sorted without comparing them.
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    if len(names) > 1 << 16:
        order = order[np.argsort((code >> 16).astype(np.uint16)[order], kind="stable")]
    code, row, field, position = code[order], row[order], field[order], position[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])] if len(code) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    term = code[at]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(at) else at
    ends = np.r_[first, len(at)].astype(np.int32)
    packed = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
    tokens = np.diff(np.r_[at[first], len(code)])
    columns = [names.take(pa.array(term[first])), pa.array(np.diff(ends)), pa.array(tokens.astype(np.int64))]
    columns += [packed(uids.take(pa.array(row[at]))), packed(pa.array(lengths[row[at]].astype(np.int32)))]
    counts = [np.add.reduceat(field == k, at, dtype=np.int32) if len(at) else np.zeros(0, dtype=np.int32) for k in range(len(fields))]
    upto = [np.r_[0, np.cumsum(n)].astype(np.int32) for n in counts]
    columns += [packed(pa.array(u[1:] - np.repeat(u[first], np.diff(ends)))) for u in upto]
    for k, u in enumerate(upto):
        columns.append(pa.ListArray.from_arrays(pa.array(u[ends]), pa.array(position[field == k])))
    return pa.RecordBatch.from_arrays(columns, ["term", "entries", "tokens", "uid", "len", *(f"e_{f}" for f in fields), *(f"p_{f}" for f in fields)])


def _schema(uid: T.DataType, fields: list[str]) -> T.StructType:
    """A packed row: a term, how many rows of its block hold it and how often in all, and these rows' ids, lengths, and positions in one list for each
    field (p_<field>) with the place where each row's end (e_<field>)."""
    whole, many = T.IntegerType(), T.ArrayType
    counts = [T.StructField(f"e_{f}", many(whole)) for f in fields]
    places = [T.StructField(f"p_{f}", many(whole)) for f in fields]
    told = [T.StructField("term", T.StringType()), T.StructField("entries", whole), T.StructField("tokens", T.LongType())]
    return T.StructType([*told, T.StructField("uid", many(uid)), T.StructField("len", many(whole)), *counts, *places])


def unpacked(packed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """term and the columns asked for (all, if none are named) of packed postings, a row for each posting."""
    fields = [c[2:] for c in packed.columns if c.startswith("e_")]
    columns = columns or ["uid", "len", *(f"n_{f}" for f in fields), *(f"p_{f}" for f in fields)]

    def each(column: str) -> Column:
        kind, ends = column[:2], F.col(f"e_{column[2:]}") if column[2:] in fields else None
        if ends is None or kind not in ("n_", "p_"):
            return F.col(column)
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        if kind == "n_":
            return F.transform(ends, lambda end, i: end - before(i))
        return F.transform(ends, lambda end, i: F.slice(F.col(column), before(i) + 1, end - before(i)))

    rows = packed.select("term", *[each(c).alias(c) for c in columns])
    return rows.select("term", F.inline(F.arrays_zip(*columns)))


def _blocks(batches: Iterator[pa.RecordBatch], sizes_of: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that hold about `most` terms in all, with the terms of each, whatever the batches they came in; a longer row is a block of its own."""
    held: list[tuple[pa.RecordBatch, np.ndarray]] = []
    used = 0

    def block() -> tuple[pa.RecordBatch, np.ndarray]:
        parts, sizes = zip(*held)
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0], np.concatenate(sizes)

    for batch in batches:
        if held and sum(part.nbytes for part, _ in held) + batch.nbytes > HELD:
            yield block()
            held, used = [], 0
        sizes, start = sizes_of(batch), 0
        for i, n in enumerate(sizes.tolist()):
            if used and used + n > most:
                if i > start:
                    held.append((batch.slice(start, i - start), sizes[start:i]))
                yield block()
                held, used, start = [], 0, i
            used += max(n, 1)  # rows without terms take room, too
        if batch.num_rows > start:
            held.append((batch.slice(start), sizes[start:]))
    if held:
        yield block()


def _sent(packed: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A block's rows in batches of a bounded size."""
    return (packed.slice(start, most) for start in range(0, packed.num_rows, most))


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of some sizes."""
    return (np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)).astype(np.int32)


def word_letters(spark: SparkSession) -> np.ndarray:
    """Of every code point whether it belongs to words, as Spark's own expression for words has it (a bit each)."""
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    # Surrogates, which are no characters, are left out.
    found = spark.range(0xD800).unionByName(spark.range(0xE000, 0x110000)).filter(F.rlike(letter, F.lit(WORD))).toArrow()
    letters = np.zeros(0x110000, dtype=bool)
    letters[found["id"].to_numpy()] = True
    return np.packbits(letters)


def _cut(texts: pa.Array, letters: np.ndarray) -> pa.ListArray:
    """The words of each text, in order: its longest runs of letters."""
    texts = texts.fill_null("")
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.r_[0, ends[:-1]]
    inside = letters[chars]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[starts[starts < ends]] = inside[starts[starts < ends]]  # a word ends with its text
    at, kept = np.flatnonzero(first), chars[inside]
    place = np.r_[np.cumsum(inside, dtype=np.int32)[at] - 1, len(kept)].astype(np.int32)
    if len(kept) and kept.max() > 0x7F:
        width = 1 + (kept > 0x7F).astype(np.int8) + (kept > 0x7FF) + (kept > 0xFFFF)
        place = np.r_[0, np.cumsum(width, dtype=np.int32)].astype(np.int32)[place]
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(place), pa.py_buffer(kept.tobytes().decode("utf-32-le").encode()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.r_[0, ends]).astype(np.int32)), words)


def packed_texts(texts: DataFrame, fields: list[str]) -> DataFrame:
    """As packed_words, of a table of texts (uid and the fields): they are brought to lower case by Spark and cut into words in the task that groups these,
    many texts in one pass."""
    letters = word_letters(texts.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(letters).astype(bool)
        for batch in batches:
            sizes = sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            for part, _ in _blocks(iter([batch]), lambda _, sizes=sizes: sizes, CUT):
                yield pa.RecordBatch.from_arrays([part.column(0), *[_cut(c, known) for c in part.columns[1:]]], ["uid", *fields])

    lower = texts.select("uid", *[F.lower(f).alias(f) for f in fields])
    return lower.mapInArrow(lambda batches: _group_words(cut(batches), fields, BLOCK, SENT), _schema(texts.schema["uid"].dataType, fields))


def word_postings(index: DataFrame, fields: list[str]) -> DataFrame:
    """term, uid, len (of all fields), n_<field>, p_<field> of an index of token arrays (uid and the fields)."""
    return unpacked(packed_words(index, fields))


def _group_words(batches: Iterator[pa.RecordBatch], fields: list[str], most: int, sent: int) -> Iterator[pa.RecordBatch]:
    """Packed postings of rows of an id and word arrays."""
    lengths = lambda c: c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for part, sizes in _blocks(batches, lambda batch: sum(lengths(c).astype(np.int64) for c in batch.columns[1:]), most):
        each = [lengths(c) for c in part.columns[1:]]
        words = pa.chunked_array([c.flatten() for c in part.columns[1:]], pa.string()).combine_chunks().dictionary_encode()
        row = np.concatenate([np.repeat(np.arange(part.num_rows, dtype=np.int32), e) for e in each])
        field = np.concatenate([np.full(e.sum(), k, dtype=np.int8) for k, e in enumerate(each)])
        position = np.concatenate([_places(e) for e in each])
        yield from _sent(_grouped(part.column(0), sizes, words.dictionary, words.indices.to_numpy(), row, field, position, fields), sent)


def packed_words(index: DataFrame, fields: list[str]) -> DataFrame:
    """The postings of an index of token arrays (uid and the fields), a row for each term of a block of rows."""
    return index.select("uid", *fields).mapInArrow(lambda batches: _group_words(batches, fields, BLOCK, SENT), _schema(index.schema["uid"].dataType, fields))


def _shortened(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in one byte or more, seven bits each, the lowest first; all but a number's last byte have the eighth bit. And where each ends."""
    size = 1 + sum((values >= 1 << bits).astype(np.int8) for bits in (7, 14, 21, 28))
    ends = np.cumsum(size, dtype=np.int64)
    packed = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(size.max(initial=0)):
        longer = size > k
        packed[ends[longer] - size[longer] + k] = values[longer] >> 7 * k & 0x7F | (size[longer] > k + 1) * 0x80
    return packed, ends


def _lengthened(packed: bytes) -> np.ndarray:
    """The numbers that `_shortened` took, summed up one after the other."""
    each = np.frombuffer(packed, dtype=np.uint8)
    ends = np.flatnonzero(each < 0x80) + 1
    first = np.r_[0, ends[:-1]]
    return np.cumsum(np.add.reduceat((each & 0x7F).astype(np.int64) << 7 * _places(ends - first), first))


def _begins(lengths: np.ndarray) -> np.ndarray:
    """Where the rows of a block begin."""
    return np.cumsum(lengths, dtype=np.int64) - lengths + GAP * np.arange(len(lengths))


def _sorted(code: np.ndarray) -> np.ndarray:
    """The order of whole numbers, equal ones as they come: by two bytes at a time, which are sorted without comparing them."""
    order, most = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable"), int(code.max(initial=0))
    for bits in range(16, most.bit_length(), 16):
        order = order[np.argsort((code >> bits & 0xFFFF).astype(np.uint16)[order], kind="stable")]
    return order


def _group_trigrams(texts: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """The trigrams of a block's texts: of each kind its name, in how many texts it is, how often in all, and its packed places."""
    chars = np.frombuffer("".join(texts.fill_null("").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    long = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # The block's characters are numbered, so that a trigram is a small number.
    used = np.flatnonzero(np.bincount(chars, minlength=1))
    number = np.zeros(used.max(initial=0) + 1, dtype=np.int64)
    number[used] = np.arange(len(used))
    chars, inside = number[chars], _places(sizes)
    at = np.repeat(np.cumsum(long) - long, sizes) + inside
    code = (chars[at] * len(used) + chars[at + 1]) * len(used) + chars[at + 2]
    del chars, at
    order = _sorted(code)
    code, row = code[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    place = (np.repeat(_begins(sizes), sizes) + inside)[order]
    del order, inside
    new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    new[1:] |= row[1:] != row[:-1]
    entries = np.add.reduceat(new, first, dtype=np.int32) if len(first) else np.zeros(0, dtype=np.int32)
    packed, ends = _shortened(step)
    kinds = [used[code[first] // len(used) ** k % len(used)].tolist() for k in (2, 1, 0)] if len(first) else [[]] * 3
    names = pa.array([chr(a) + chr(b) + chr(c) for a, b, c in zip(*kinds)], pa.string())
    last = np.r_[first, len(code)]
    offsets = pa.py_buffer(np.r_[0, ends][last].astype(np.int32))
    return names, entries, np.diff(last), pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(packed)])


def trigram_postings(texts: DataFrame) -> DataFrame:
    """Packed postings of (uid, text), by blocks of rows: of each term (three characters) the number of rows that hold it, how often they do in all, and its places
    in the block; and a row of the empty term with the ids and lengths (in trigrams) of the block's rows."""
    uid = texts.schema["uid"].dataType
    told = [T.StructField("term", T.StringType()), T.StructField("entries", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("block", T.LongType())]
    schema = T.StructType([*told, T.StructField("uid", T.ArrayType(uid)), T.StructField("len", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType())])

    def count(batch: pa.RecordBatch) -> np.ndarray:
        return np.maximum(pc.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) - 2, 0)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32  # a task that runs again numbers its blocks as before
        for part, sizes in _blocks(batches, count, GRAMS):
            names, entries, tokens, places = _group_trigrams(part.column(1), sizes)
            rows, n, ids = part.num_rows, len(names), part.column(0)
            none = lambda kind: pa.nulls(n, pa.list_(kind))
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), values)
            about = [pa.array([""]), pa.array([0], pa.int32()), pa.array([0]), pa.array([block]), whole(ids), whole(pa.array(sizes.astype(np.int32))), pa.nulls(1, pa.binary())]
            terms = [names, pa.array(entries), pa.array(tokens.astype(np.int64)), pa.array(np.full(n, block)), none(ids.type), none(pa.int32()), places]
            for columns in (about, terms):
                yield from _sent(pa.RecordBatch.from_arrays(columns, schema.names), SENT)
            block += 1

    return texts.select("uid", "text").mapInArrow(group, schema)


def _laid(postings: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Packed postings as they are written, with their bucket, and the number of buckets.

    Words are dealt by term. Trigrams aren't shuffled: each task sorts and writes its own, so files are as many as tasks by buckets, and these stay few."""
    whole = "block" in postings.columns
    buckets, files = (FEWEST, 1) if whole else buckets_for(size)
    rows = postings.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
    return rows.sortWithinPartitions("bucket", "term") if whole else _dealt(rows, buckets * files), buckets


def write(postings: DataFrame, totals: DataFrame, fields: list[str], path: str, size: int) -> None:
    """Stores packed postings by bucket and term, the number of rows for each term, and the totals (n_docs, avgdl; one row) of a source of `size` bytes.

    Where `totals` has no avgdl it is made from the postings, which count every token once, so that texts aren't cut into tokens again."""
    laid, buckets = _laid(postings, size)
    # The second version of the format stores rising whole numbers as differences, and sorted terms by what they don't share; dictionaries would only be tried in vain.
    kept = laid.write.partitionBy("bucket").option("parquet.writer.version", "v2").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false")
    if "block" in postings.columns:
        kept = kept.option("parquet.page.row.count.limit", PAGE).option("compression", "zstd")
    kept.parquet(f"{path}/postings")
    spark = postings.sparkSession
    schema = T.StructType([*postings.schema.fields, T.StructField("bucket", T.IntegerType())])
    back = spark.read.schema(schema).parquet(f"{path}/postings")
    counts = back.filter("entries > 0").groupBy("bucket", "term").agg(F.sum("entries").alias("df"), F.sum("tokens").alias("n"))
    _dealt(counts, buckets).write.partitionBy("bucket").parquet(f"{path}/terms")
    if "avgdl" not in totals.columns:
        tokens = spark.read.schema("n long").parquet(f"{path}/terms").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
        totals = totals.crossJoin(tokens).select("n_docs", F.try_divide("n", "n_docs").alias("avgdl"))  # one row each
    totals.withColumn("buckets", F.lit(buckets)).withColumn("schema", F.lit(schema.json())).coalesce(1).write.parquet(f"{path}/totals")


def totals_of(spark: SparkSession, path: str) -> dict:
    """n_docs, avgdl, buckets, and the schema of the postings."""
    return spark.read.parquet(f"{path}/totals").first().asDict()


def _of_terms(spark: SparkSession, path: str, table: str, terms: list[str]) -> DataFrame:
    totals = totals_of(spark, path)
    schema = T.StructType.fromJson(json.loads(totals["schema"])) if table == "postings" else "term string, df long, bucket int"
    here = sorted({zlib.crc32(t.encode()) % totals["buckets"] for t in terms})
    # Pages are found by each term of a short list, but only by the first and last one of a list that is longer than Spark's setting for this.
    terms, most = sorted(terms), max(1, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")))
    asked = [F.col("term").isin(terms[i : i + most]) for i in range(0, max(1, len(terms)), most)]
    return spark.read.schema(schema).parquet(f"{path}/{table}").filter(F.col("bucket").isin(here) & reduce(or_, asked))


def read(spark: SparkSession, path: str, terms: list[str], columns: list[str] | None = None) -> DataFrame:
    """The postings of some terms, with the columns asked for: only these, and the terms' partitions and pages, are read."""
    return unpacked(_of_terms(spark, path, "postings", terms), columns)


def frequencies(spark: SparkSession, path: str, terms: list[str]) -> dict[str, int]:
    """Of a request's terms the number of rows that hold them."""
    rows = _of_terms(spark, path, "terms", terms)
    return {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _starts(rows: DataFrame, wanted: list[tuple], kind: str) -> DataFrame:
    """query_id, uid, len, starts: rows that hold every term of a request at its place; `wanted` has (query_id, place, term).

    A row's positions of a term, less its place, are where the request could begin; these lists are intersected, so nothing is
    multiplied out."""
    need: dict = {}
    for query_id, *_ in wanted:
        need[query_id] = need.get(query_id, 0) + 1
    spark = rows.sparkSession
    asked = spark.createDataFrame([(q, place, term, need[q]) for q, place, term in wanted], f"query_id {kind}, place int, term string, need int")
    met = rows.join(F.broadcast(asked), "term")  # a row for each term of the request
    shifted = F.transform("p", lambda p: p - F.col("place"))
    # The row number of a uid's rows doesn't exist here: rows that share a uid are told apart by nothing, as in the table.
    each = met.groupBy("query_id", "uid", "len").agg(F.collect_list(F.struct("place", shifted.alias("s"))).alias("lists"), F.first("need").alias("need"))
    lists = F.transform(F.sort_array(F.filter("lists", lambda x: x["s"].isNotNull())), lambda x: x["s"])
    whole = each.filter(F.size("lists") == F.col("need")).withColumn("lists", lists)
    both = F.aggregate(F.slice("lists", 2, 1 << 20), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return whole.select("query_id", "uid", "len", both.alias("starts")).filter(F.size("starts") > 0)


def phrase_counts(spark: SparkSession, path: str, phrases: list[tuple], field: str = "text", kind: str = "int") -> DataFrame:
    """query_id, uid, f, len: how often each phrase (query_id, words) occurs in a field of the stored rows."""
    wanted = [(q, place, word) for q, words in phrases for place, word in enumerate(words)]
    terms = sorted({t for *_, t in wanted})
    rows = read(spark, path, terms, ["uid", "len", f"p_{field}"]).withColumnRenamed(f"p_{field}", "p")
    return _starts(rows, wanted, kind).select("query_id", "uid", F.size("starts").alias("f"), "len")


def cover(needle: str, df: dict[str, int]) -> list[tuple[int, str]]:
    """Places and trigrams that hold every character of a needle: steps of three, shifted so that the rarest trigram is among them."""
    last = len(needle) - 3
    grams = [needle[i : i + 3] for i in range(last + 1)]
    rarest = min(range(last + 1), key=lambda i: df.get(grams[i], 0))
    places = {0, last, rarest, *range(rarest % 3, last + 1, 3)}
    return [(i, grams[i]) for i in sorted(places)]


def _standing(places: dict[str, np.ndarray], wanted: list[tuple[int, str]]) -> np.ndarray:
    """Where in a block a needle stands, by the places of the trigrams of its cover: each list, shifted, is looked up in the next, the shortest first."""
    if not all(gram in places for _, gram in wanted):
        return np.zeros(0, dtype=np.int64)
    found, *others = sorted((places[gram] - at for at, gram in wanted), key=len)
    for more in others:
        found = found[more[np.minimum(np.searchsorted(more, found), len(more) - 1)] == found]
    return found


def _apart(starts: np.ndarray, size: int) -> np.ndarray:
    """Occurrences taken from the left; one that overlaps the last one taken doesn't count."""
    if not (np.diff(starts) < size).any():
        return starts
    kept, free = [], -1
    for start in starts.tolist():
        if start >= free:
            kept.append(start)
            free = start + size
    return np.array(kept)


def substring_counts(spark: SparkSession, path: str, needles: list[tuple], kind: str = "int") -> DataFrame:
    """query_id, uid, f, len: how often each needle (query_id, folded text of three characters or more) occurs, without overlap, in the stored texts.

    All postings come from the index: blocks with the rarest trigram are the candidates, the others of the cover are read for these. A block's postings of the
    request, which are no more than its characters, meet in one group."""
    needles = [(q, n) for q, n in needles if len(n) >= 3]
    df = frequencies(spark, path, sorted({n[i : i + 3] for _, n in needles for i in range(len(n) - 2)})) if needles else {}
    # A needle with a trigram that no row has is nowhere.
    needles = [(q, n) for q, n in needles if all(n[i : i + 3] in df for i in range(len(n) - 2))]
    uid = T.StructType.fromJson(json.loads(totals_of(spark, path)["schema"]))["uid"].dataType.elementType.simpleString()
    if not needles:
        return spark.createDataFrame([], f"query_id {kind}, uid {uid}, f int, len int")
    wanted = [(cover(n, df), len(n)) for _, n in needles]
    rows = _of_terms(spark, path, "postings", ["", *sorted({g for grams, _ in wanted for _, g in grams})])
    rarest = {min((g for _, g in grams), key=lambda g: (df[g], g)) for grams, _ in wanted}
    if sum(df[g] for g in rarest) <= MOST_CANDIDATES:
        candidates = _of_terms(spark, path, "postings", sorted(rarest)).select("block").distinct()
        rows = rows.join(F.broadcast(candidates), "block", "left_semi")

    def meet(block: pa.Table) -> pa.Table:
        terms = block["term"].to_pylist()
        about = terms.index("")
        places = {term: _lengthened(block["places"][i].as_py()) for i, term in enumerate(terms) if i != about}
        uids, lengths = block["uid"][about].values, block["len"][about].values
        begins = _begins(lengths.to_numpy())
        needle, row, f = [], [], []
        for k, (grams, size) in enumerate(wanted):
            held, n = np.unique(np.searchsorted(begins, _apart(_standing(places, grams), size), side="right") - 1, return_counts=True)
            needle.append(np.full(len(held), k, dtype=np.int32))
            row.append(held)
            f.append(n.astype(np.int32))
        rows = pa.array(np.concatenate(row))
        return pa.table([pa.array(np.concatenate(needle)), uids.take(rows), pa.array(np.concatenate(f)), lengths.take(rows)], ["needle", "uid", "f", "len"])

    found = rows.select("block", "term", "uid", "len", "places").groupBy("block").applyInArrow(meet, f"needle int, uid {uid}, f int, len int")
    named = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(needles)], f"needle int, query_id {kind}")
    return found.join(F.broadcast(named), "needle").select("query_id", "uid", "f", "len")


def substring_terms(spark: SparkSession, path: str, needles: list[tuple]) -> DataFrame:
    """query_id, uid, f, len: rows with a whole (folded) needle, or else with all of its words of three characters or more.

    f is the number of occurrences of the needle, or that of all its words where the needle as a whole isn't there."""
    whole = substring_counts(spark, path, needles).withColumn("stage", F.lit(0))
    words = [(q, w, len(ws)) for q, n in needles for ws in [[w for w in dict.fromkeys(n.split()) if len(w) >= 3]] for w in ws]
    parts = substring_counts(spark, path, list(enumerate([w for _, w, _ in words])))
    named = spark.createDataFrame([(i, q, n) for i, (q, _, n) in enumerate(words)], "part int, query_id int, need int")
    met = parts.withColumnRenamed("query_id", "part").join(F.broadcast(named), "part").groupBy("query_id", "uid", "len")
    every = met.agg(F.sum("f").cast("int").alias("f"), F.count("*").alias("c"), F.first("need").alias("need")).filter("c = need")
    both = whole.unionByName(every.select("query_id", "uid", "f", "len", F.lit(1).alias("stage")))
    first = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy("stage"))
    return both.withColumn("_n", first).filter("_n = 1").select("query_id", "uid", "f", "len")
