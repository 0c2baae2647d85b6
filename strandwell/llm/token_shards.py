"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride binary shards.

1. A document of b bytes has b tokens at most (each has a byte), so it gets room for b div length + 1 sequences. A first pass adds up
   the room of each run of rows (rows of one file that a task reads in a row) from text lengths alone; running sums over the runs, in
   order of file and row, give every run, and so every possible sequence, an index that depends on files and rows only.
2. The second pass cuts each document's tokens (with an end token) into sequences of `length` ids and permutes their indices: a keyed Feistel
   network over the next even power of two, walked until it falls below the number of indices, hence a bijection on them.
3. Permuted indices are dealt by range, `span` of them to a partition, ordered there and written as one file of records of a fixed size.
   The place in this order is the sequence's slot: slots are 0 to n - 1 without gaps, and a file's size says how many it holds.
   A reader finds a slot by the sizes of the files and the stride, starts anywhere without an index, and reads on in training order; a shard
   that is missing can be made again alone.

A record: doc_id (int64), number within the document (int32), ids in use (int32), then `length` ids (uint16), all little-endian, and a
line end. Texts are tokenized once; sequences travel compressed, and nothing but the shuffle and the shards takes disk.

Defined results: a null text is an empty one, with one sequence that holds the end token; a null doc_id is stored as the least int64;
repeated rows have sequences of their own; no rows give no shards; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.llm.common import fresh_path, materialise, slices, tidied, whole_text
from strandwell.llm.shingles import mix

LENGTH = 512
SPAN = 65_536
ROUNDS = 6
NO_ID = -(1 << 63)
HEAD = np.dtype([("doc_id", "<i8"), ("number", "<i4"), ("used", "<i4")])
# Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 to n - 1 at x."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _little(ids: array) -> bytes:
    """The bytes of 16-bit numbers, the low one first."""
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class Tokenizer:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if len(ranks) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.end = len(ranks)
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def packed(self, text: str) -> bytes:
        """The ids of the text as 16-bit numbers, without the end token."""
        return _little(array("H", self.encode(text)))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a rank file, built once in each Python process."""
    return Tokenizer(path)


@dataclass(frozen=True)
class Layout:
    """Where the shards are, and what a record and a shard hold."""

    path: str
    room: int
    length: int
    span: int
    stride: int

    def files(self, spark: SparkSession) -> list[tuple[int, int, int, str]]:
        """shard, first slot, rows and path of every file, from the folder's listing."""
        if not self.room:
            return []
        listed = spark.read.format("binaryFile").load(f"{self.path}/shards").select(shard_of(F.col("path")).alias("shard"), "length", "path")
        out, slot = [], 0
        for file in listed.orderBy("shard").collect():
            rows = file["length"] // self.stride
            out.append((file["shard"], slot, rows, file["path"]))
            slot += rows
        return out

    def starts(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        """shard, first slot, rows of every file."""
        return [(shard, slot, rows) for shard, slot, rows, _ in self.files(spark)]


def shard_of(path: Column) -> Column:
    """The number of the partition that wrote a file."""
    return F.regexp_extract(path, r"part-(\d+)", 1).cast("int")


def located(docs: DataFrame) -> DataFrame:
    """file, row, n_bytes, doc_id, text: rows with their place in the files that they are read from."""
    values = [F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")]
    n_bytes = F.octet_length(whole_text()).cast("long").alias("n_bytes")
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(place["file_path"].alias("file"), place["row_index"].alias("row"), n_bytes, *values)
    except AnalysisException:  # not the rows of parquet files as they are
        return located(materialise(docs.select(*values), "shard-input"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """Parts of the batches that lie in one run, the run's first place, and whether it begins."""
    run, expected = None, None
    for part in batches:
            files, rows = part.column(0).to_pylist(), part.column(1).to_pylist()
            start = 0
            for k in range(len(rows) + 1):
                if k == len(rows) or (files[k], rows[k]) != expected:
                    if k > start:
                        yield run, False, part.slice(start, k - start)
                    if k < len(rows):
                        run, start = (files[k], rows[k]), k
                        yield run, True, part.slice(k, 0)
                if k < len(rows):
                    expected = (files[k], rows[k] + 1)


def room_of(n_bytes: int, length: int) -> int:
    """Sequences that a text of so many bytes can have at most."""
    return n_bytes // length + 1


def count_runs(rows: DataFrame, length: int) -> DataFrame:
    """file, row, room of each run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], int] = {}
        for run, _, part in _runs(batches):
            totals[run] = totals.get(run, 0) + sum(room_of(n, length) for n in part.column(2).to_pylist())
        columns = [pa.array([r[0] for r in totals], pa.string()), pa.array([r[1] for r in totals], pa.int64()), pa.array(list(totals.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["file", "row", "room"])

    return rows.select("file", "row", "n_bytes").mapInArrow(tidied(count), "file string, row long, room long")


def write_shards(docs: DataFrame, ranks: str, key: int, path: str | None = None, length: int = LENGTH, span: int = SPAN) -> Layout:
    """Writes the sequences of all documents to `path` (default: below the shared folder) and says how they lie."""
    import zstandard

    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    rows = located(docs)
    # One number for each run: as many as the input has splits, which the driver lists anyway.
    bases: dict[tuple[str, int], int] = {}
    total = 0
    for run in sorted(count_runs(rows, length).collect(), key=lambda r: (r["file"], r["row"])):
        bases[run["file"], run["row"]] = total
        total += run["room"]
    layout = Layout(path, total, length, span, HEAD.itemsize + 2 * length + 1)
    known = spark.sparkContext.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at = tokenizer(ranks), 0
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
        pad = np.full(length, tok.end, dtype="<u2").tobytes()
        for run, begins, part in _runs(batches):
            if begins:
                at = known.value[run]  # a run that the first pass didn't have is an error
                continue
            sizes, ids, texts = (part.column(k).to_pylist() for k in (2, 3, 4))
            records, indices = [], []
            for n_bytes, doc_id, text in zip(sizes, ids, texts, strict=True):
                packed = tok.packed(text) + pad[:2]
                for number, begin in enumerate(range(0, len(packed), 2 * length)):
                    piece = packed[begin : begin + 2 * length]
                    head = struct.pack("<qii", NO_ID if doc_id is None else doc_id, number, len(piece) // 2)
                    records.append(pack(head + piece + pad[len(piece) :]))
                    indices.append(at + number)
                at += room_of(n_bytes, length)
            slots = feistel(np.array(indices, dtype=np.int64), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // span, pa.int32()), pa.array(records, pa.binary())], ["place", "shard", "record"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([open_(r) for r in part.column(0).to_pylist()], pa.binary())], ["record"])

    sequences = rows.mapInArrow(tidied(cut), "place long, shard int, record binary")
    if total:
        dealt = sequences.repartitionById(-(-total // span), F.col("shard")).sortWithinPartitions("place")
        # The bytes of a record go to the file as they are, with the writer's line end behind them.
        dealt.select("record").mapInArrow(tidied(unpack), "record binary").select(F.col("record").cast("string").alias("value")).write.text(f"{path}/shards")
    spark.createDataFrame([asdict(layout)]).coalesce(1).write.json(f"{path}/layout")
    return layout


SEQUENCES = "slot long, shard int, offset long, doc_id long, number int, used int, ids_crc32 long"


def read_shards(spark: SparkSession, layout: Layout, first_slot: int = 0, ids: bool = False) -> DataFrame:
    """The stored sequences from `first_slot` on: slot, place, document and checksum of the ids in use, with `ids` the ids too."""
    schema = SEQUENCES + (", ids array<int>" if ids else "")
    # One row for each file; files before the slot are not opened.
    wanted = [file for file in layout.files(spark) if file[1] + file[2] > first_slot]
    if not wanted:
        return spark.createDataFrame([], schema)
    starts = {shard: slot for shard, slot, *_ in wanted}
    stride, length = layout.stride, layout.length
    known = spark.sparkContext.broadcast(starts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), dtype=np.uint8).reshape(-1, stride)
                start = known.value[shard]
                skip = max(0, first_slot - start)
                for at in range(skip, len(raw), 4096):
                    rows = raw[at : at + 4096]
                    head = np.ascontiguousarray(rows[:, : HEAD.itemsize]).view(HEAD).ravel()
                    values = np.ascontiguousarray(rows[:, HEAD.itemsize : HEAD.itemsize + 2 * length]).view("<u2")
                    crc = [zlib.crc32(v[:n].tobytes()) for v, n in zip(values, head["used"], strict=True)]
                    place = np.arange(at, at + len(rows), dtype=np.int64)
                    no_id = head["doc_id"] == NO_ID
                    columns = [
                        pa.array(place + start), pa.array(np.full(len(rows), shard, dtype=np.int32)), pa.array(place * stride),
                        pa.array(head["doc_id"].astype(np.int64), mask=no_id), pa.array(head["number"].astype(np.int32)), pa.array(head["used"].astype(np.int32)), pa.array(crc, pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([v[:n].tolist() for v, n in zip(values, head["used"], strict=True)], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    places = [path for *_, path in wanted] if first_slot else f"{layout.path}/shards"
    files = spark.read.format("binaryFile").load(places)
    return files.select(shard_of(F.col("path")).alias("shard"), "content").mapInArrow(tidied(read), schema)
