"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus.

1. Texts are cut into pre-tokens; tasks count them, and one shuffle of these counts gives the distinct pre-tokens.
2. The tokenizer splits each distinct pre-token once; its number of pieces is stored.
3. Each document's pre-token frequencies meet these numbers: those of the `HOT` most frequent pre-tokens (at most `HOT_BYTES`
   bytes each, so the table's size has a fixed bound) are broadcast and added up where the text is read; all others are
   joined by the pre-token, which no longer has frequent keys, and added up by document.

The cut is that of byte-level BPE: `PATTERN`, after the text is split at the special strings that the tokenizer file
declares; as in the library, such a string inside a text is one token. Counts are those of encode(add_special_tokens=False). Files that
cut otherwise (another pre-tokenizer, a normaliser, a prefix space, added tokens that take spaces) are refused.

Defined results: a null text is an empty one with 0 tokens; repeated rows stay; a null doc_id is kept; no rows give no rows;
columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, tidied, whole_text

# Fixed value: the public pre-token pattern of byte-level BPE, with white space spelt out as Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
HOT = 600_000
HOT_BYTES = 48
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 300_000
#: Keys that equal rows are spread over.
SALTS = 1024
#: Steps for each doubling of a frequency in the histogram that finds the hot pre-tokens.
STEPS = 8


def _byte_level(step: dict | None) -> bool:
    """Whether a pre-tokenizer cuts by PATTERN and nothing else."""
    return bool(step) and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True)


@lru_cache(maxsize=4)
def special_strings(tokenizer_path: str) -> tuple[str, ...]:
    """The strings that the tokenizer file takes out of a text before its pattern; a file whose cut is another one is an error."""
    with open(tokenizer_path, encoding="utf-8") as file:
        said = json.load(file)
    added = said.get("added_tokens") or []
    plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) for x in added)
    if said.get("normalizer") or not _byte_level(said.get("pre_tokenizer")) or not plain:
        raise ValueError(f"{tokenizer_path}: only byte-level cuts without normaliser and prefix space, and plain added tokens")
    return tuple(x["content"] for x in added)


def cutter(tokenizer_path: str) -> Callable[[str], list[str]]:
    """The function from a text to its pre-tokens; special strings stand for themselves."""
    find = regex.compile(PATTERN).findall
    specials = special_strings(tokenizer_path)
    split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")").split if specials else None
    first = tuple(specials)

    def cut(text: str) -> list[str]:
        if not any(s in text for s in first):
            return find(text)
        found: list[str] = []
        for part in split(text):
            found += [part] if part in first else find(part)
        return found

    return cut


def distinct_pretokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """token, n: every pre-token of the corpus and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = cutter(tokenizer_path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cut(text))
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    return docs.select(whole_text().alias("text")).mapInArrow(tidied(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(distinct: DataFrame, tokenizer_path: str) -> DataFrame:
    """token, n, pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            found: list[int] = []
            tokens = batch.column(0).to_pylist()
            for k in range(0, len(tokens), 2000):
                found += [len(e.ids) for e in tokenizer.encode_batch(tokens[k : k + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], ["token", "n", "pieces"])

    return distinct.mapInArrow(tidied(encode), "token string, n long, pieces int")


ROWS = "doc_id long, stamp long, n_bytes long, known long, token string, times int, salt int"


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    pieces = materialise(piece_counts(distinct_pretokens(docs, tokenizer_path), tokenizer_path), "pretokens")
    step = F.floor(F.log2(F.col("n")) * STEPS).cast("int")
    short = F.octet_length("token") <= HOT_BYTES
    held, least = 0, 1 << 30
    for row in sorted(pieces.filter(short).groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # at most 64 * STEPS rows
        held += row["count"]
        if held > hot:
            break
        least = row["step"]
    is_hot = short & (step >= least)
    table = pieces.filter(is_hot).select("token", "pieces").toArrow()  # at most `hot` rows of HOT_BYTES
    known = spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, get = cutter(tokenizer_path), known.value.get

        def send() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ROWS.split(", ")])
            for c in columns:
                c.clear()
            return out

        columns: tuple[list, ...] = ([], [], [], [], [], [], [])
        number = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8")
                # The stamp tells texts of one doc_id apart: their length and their checksum.
                stamp = zlib.crc32(raw) << 31 | len(raw) & 0x7FFFFFFF
                total, rare = 0, []
                for token, times in Counter(cut(text)).items():
                    if (n := get(token)) is None:
                        rare.append((token, times))
                    else:
                        total += n * times
                columns[0].extend([doc_id] * (1 + len(rare)))
                columns[1].extend([stamp] * (1 + len(rare)))
                columns[2].extend([len(raw)] + [None] * len(rare))
                columns[3].extend([total] + [None] * len(rare))
                columns[4].extend([None] + [t for t, _ in rare])
                columns[5].extend([None] + [c for _, c in rare])
                number += 1
                columns[6].extend([number % SALTS] + [None] * len(rare))
                if len(columns[0]) > 20_000:
                    yield send()
        yield send()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidied(frequencies), ROWS)
    # A row for the document itself has no pre-token and meets nothing; its key spreads such rows over the partitions, repeated ones too.
    keyed = rows.withColumn("own", F.col("token").isNull()).withColumn("key", F.coalesce("token", F.concat_ws(":", "doc_id", "stamp", "salt")))
    others = pieces.filter(~is_hot).select(F.lit(False).alias("own"), F.col("token").alias("key"), "pieces")
    met = keyed.join(others, ["own", "key"], "left")
    summed = met.groupBy("doc_id", "stamp").agg(
        F.sum("n_bytes").alias("n_bytes"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.coalesce(F.col("times") * F.col("pieces"), F.lit(0)))).alias("n_tokens"),
        F.count("n_bytes").alias("rows"),
    )
    # Repeated rows were added up together; each gets its share back.
    each = summed.select("doc_id", (F.col("n_bytes") / F.col("rows")).cast("long").alias("n_bytes"), (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), "rows")
    each = each.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
