"""Similarity join on word shingles: MinHash bands find candidates, Bayesian pruning drops most, exact verification decides.

1. A text is the set of its five-word shingles. Texts of equal sets are copies; they form a class that goes on as one node.
2. `BANDS` bands of `ROWS` MinHash values: nodes that agree in a band are candidates. At the threshold 0.8 a pair misses every band
   with a probability of 8e-5.
3. In each bucket, MinHash values (8 bits each) of its nodes are compared `STEP` by `STEP`: a pair is dropped as soon as the posterior
   probability of reaching the threshold, from a uniform prior and the matches so far, is below `TOLERANCE`. What is left makes groups,
   so that nodes that meet by chance don't chain groups together however large the corpus is.
4. Within a group, pairs are pruned alike and the rest is verified on the whole sets. Links that hold give the classes (connected
   components) and each document's number of links.

Scale: copies meet in a pre-aggregated shuffle; candidates are linear in the bands; a bucket returns a spanning forest, never pairs. A bucket
beyond `BLOCK` nodes is a star around its least node instead. Groups beyond `BLOCK` nodes are cut into blocks and every pair of blocks is a
task; a task returns counts for each node and a spanning forest, so what is shuffled stays linear in nodes (times blocks for a group
beyond one). Keys of very many rows (hubs of a star, a text with very many copies) are met by a broadcast of bounded size.

Defined results: null texts are empty ones; texts without words are copies of each other; repeated rows stay and count as
copies; a null doc_id takes part, and is never a class id unless its class has no other; no rows give no rows; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.llm.common import join_by_count, materialise, slices, tidied, whole_text
from strandwell.llm.components import components
from strandwell.llm.shingles import mix, set_keys, shingle_sets

BANDS, ROWS = 40, 7
VALUES = BANDS * ROWS
STEP = 40
TOLERANCE = 1e-6
BLOCK = 1500
#: Rows of buckets (about 300 bytes) that one task compares, or a little more.
TASK_ROWS = 20_000
#: Pairs that are compared in one go, at a byte for each of STEP values.
PAIRS_AT_ONCE = 250_000
#: Rows of 24 bytes up to which a list of documents is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Pairs from which intersections are counted as matrix products.
DENSE_PAIRS = 3000
SEED = 5

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
BAND_FACTORS = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minhash(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash values of sets laid end to end; those of an empty set are all ones."""
    out = np.full((len(sizes), VALUES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        short = (values >> np.uint64(32)).astype(np.uint32)
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(short * FACTORS[k] + SHIFTS[k], starts)
    return out


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (64 bits) and the 8-bit values for comparison."""
    banded = (found.reshape(-1, BANDS, ROWS).astype(np.uint64) * BAND_FACTORS).sum(axis=2, dtype=np.uint64)
    return mix(banded ^ BAND_SALTS).view(np.int64), (found * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the matches below which a pair is dropped.

    From a uniform prior, m matches of n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m); values of 8 bits also match by chance."""
    t = Fraction(threshold).limit_denominator(1000)
    t = t + (1 - t) / 256
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += float(comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m))
        out[n] = m
    return out


SKETCH = "doc_id long, stamp long, node binary, n_shingles int, bands array<long>, values binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Class key, band hashes and 8-bit MinHash values of every row; `stamp`, a hash of the text, tells rows of one doc_id apart."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                nodes, counts, bands, packed = [], [], [], []
                for values, sizes in shingle_sets(part.column(1).to_pylist()):
                    key, (band, value) = set_keys(values, sizes), sketch(minhash(values, sizes))
                    nodes += [k.astype(">u8").tobytes() for k in key]
                    counts.append(sizes)
                    bands.append(band)
                    packed += [v.tobytes() for v in value]
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands).ravel()))
                columns = [part.column(0), part.column(2), pa.array(nodes, pa.binary()), pa.array(np.concatenate(counts).astype(np.int32)), lists, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "stamp", "node", "n_shingles", "bands", "values"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("stamp"))
    return rows.mapInArrow(tidied(compute), SKETCH)


def _dealt(nodes: DataFrame) -> DataFrame:
    """bucket, node: every node in its bucket of each band."""
    return nodes.filter("n_shingles > 0").select(F.explode("bands").alias("bucket"), "node")


def candidate_edges(nodes: DataFrame, least: dict[int, int]) -> DataFrame:
    """a, b: links between nodes of a bucket that pruning leaves, as a forest; in a bucket beyond BLOCK nodes, each with the least node."""
    shared_buckets = _dealt(nodes).groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    shared_buckets = materialise(shared_buckets, "buckets")
    few = shared_buckets.count() <= BROADCAST_ROWS
    hubs = shared_buckets.filter(F.col("size") > BLOCK).select("bucket", "hub")  # at most 1 / BLOCK of the nodes' bands
    met = _dealt(nodes).join(F.broadcast(shared_buckets) if few else shared_buckets, "bucket").select("bucket", "size", "hub", "node")
    star = met.filter((F.col("size") > BLOCK) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    small = shared_buckets.filter(F.col("size") <= BLOCK).drop("hub")
    rows = _dealt(nodes).join(F.broadcast(small) if few else small, "bucket").select("bucket", "node")
    tasks = max(1, -(-(shared_buckets.filter(F.col("size") <= BLOCK).agg(F.sum("size")).first()[0] or 0) // TASK_ROWS))
    sketched = rows.join(nodes.select("node", "values"), "node").withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks)))

    def prune(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bucket", "ascending"), ("node", "ascending")])
        bucket, nodes_of = group.column("bucket").to_numpy(), group.column("node").to_pylist()
        values = np.frombuffer(b"".join(group.column("values").to_pylist()), dtype=np.uint8).reshape(len(bucket), -1)
        i, j = surviving_in_buckets(values, bucket, least)
        names = sorted(set(nodes_of))
        place = {name: k for k, name in enumerate(names)}
        at = np.array([place[name] for name in nodes_of])
        roots = forest(len(names), at[i], at[j])  # over all buckets of the task
        found = [(names[k], names[roots[k]]) for k in np.flatnonzero(roots != np.arange(len(names)))]
        return pa.table({"a": pa.array([e[0] for e in found], pa.binary()), "b": pa.array([e[1] for e in found], pa.binary())})

    pruned = sketched.select("task", "bucket", "node", "values").groupBy("task").applyInArrow(prune, "a binary, b binary")
    return pruned.unionByName(star) if hubs.limit(1).count() else pruned


def compared(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows i of left and j of right that comparing values step by step doesn't drop."""
    matches = np.zeros(len(i), dtype=np.int32)
    for n in range(0, VALUES, STEP):
        part = slice(n, n + STEP)
        matches += (left[i, part] == right[j, part]).sum(axis=1, dtype=np.int32)
        on = matches >= least[n + STEP]
        i, j, matches = i[on], j[on], matches[on]
    return i, j


def surviving(left: np.ndarray, right: np.ndarray, least: dict[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that pruning leaves; with `same`, pairs i < j of one block."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 128):
        i, j = np.meshgrid(np.arange(at, min(at + 128, len(left))), np.arange(len(right)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if same:
            i, j = i[i < j], j[i < j]
        kept.append(compared(left, right, i, j, least))
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def surviving_in_buckets(values: np.ndarray, bucket: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of one bucket (rows of a bucket stand together) that pruning leaves."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(bucket)], np.diff(np.r_[starts, len(bucket)]))
    later = ends - 1 - np.arange(len(bucket))  # rows of the same bucket behind each row
    total = np.cumsum(later)
    kept = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    at = 0
    while at < len(bucket):  # about PAIRS_AT_ONCE pairs at a time
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        count = later[at:to]
        i = np.repeat(np.arange(at, to), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        kept.append(compared(values, values, i, j, least))
        at = to
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets i of left and j of right."""
    if len(i) < DENSE_PAIRS:
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    everything = np.concatenate(left if left is right else [*left, *right])
    values, counts = np.unique(everything, return_counts=True)
    values = values[counts > 1]
    width = 4096
    total = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        col = np.minimum(np.searchsorted(values, flat), max(0, len(values) - 1))
        on = values[col] == flat if len(values) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(col[on], kind="stable")
        return row[on][order], col[on][order]

    sides = [places(left)] + ([] if left is right else [places(right)])
    for at in range(0, len(values), width):
        parts = []
        for (row, col), sets in zip(sides, (left, right), strict=False):
            lo, hi = np.searchsorted(col, (at, at + width))
            x = np.zeros((len(sets), width), dtype=np.float32)
            x[row[lo:hi], col[lo:hi] - at] = 1
            parts.append(x)
        total += parts[0] @ parts[-1].T
    return total[i, j].astype(np.int64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is linked with, directly or through others."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


LINKS = "node binary, root binary, texts long, rows long"


def link_counts(group: pa.Table, threshold: Fraction, least: dict[int, int]) -> pa.Table:
    """Links within one task's rows: for each node a root, its linked texts and their rows."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    columns = {c: group.column(c).to_pylist() for c in ("component", "first", "second", "block", "node", "copies", "values", "shingles")}
    order = sorted(range(group.num_rows), key=lambda k: (columns["component"][k], columns["first"][k], columns["second"][k], columns["node"][k]))
    tiles: dict[tuple, dict[bytes, int]] = {}
    for k in order:  # rows of one node are equal: repeated documents
        tiles.setdefault((columns["component"][k], columns["first"][k], columns["second"][k]), {})[columns["node"][k]] = k
    up, down = threshold.numerator, threshold.denominator
    for (_, first, second), members in tiles.items():
        sides = []
        for block in dict.fromkeys((first, second)):
            at = [k for k in members.values() if columns["block"][k] == block]
            values = np.array([np.frombuffer(columns["values"][k], dtype=np.uint8) for k in at]).reshape(len(at), -1)
            sides.append((at, values, [np.frombuffer(columns["shingles"][k], dtype="<u8") for k in at]))
        left, right = sides[0], sides[-1]
        if not left[0] or not right[0]:
            continue
        i, j = surviving(left[1], right[1], least, first == second)
        if not len(i):
            continue
        both = shared(left[2], right[2], i, j)
        sizes = [np.array([len(s) for s in side[2]]) for side in (left, right)]
        on = (down + up) * both >= up * (sizes[0][i] + sizes[1][j])
        i, j = i[on], j[on]
        if not len(i):
            continue
        at = left[0] if first == second else left[0] + right[0]
        j = j if first == second else j + len(left[0])
        copies = np.array([columns["copies"][k] for k in at], dtype=np.int64)
        texts = np.bincount(np.r_[i, j], minlength=len(at))
        rows = np.zeros(len(at), dtype=np.int64)
        np.add.at(rows, i, copies[j])
        np.add.at(rows, j, copies[i])
        roots = forest(len(at), i, j)
        for k in np.flatnonzero(texts):
            out[0].append(columns["node"][at[k]])
            out[1].append(columns["node"][at[roots[k]]])
            out[2].append(int(texts[k]))
            out[3].append(int(rows[k]))
    kinds = (("node", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("rows", pa.int64()))
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(out, kinds, strict=True)})


def member_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members with the shingle sets of their representatives' texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("stamp"))
    few = members.count() <= BROADCAST_ROWS
    wanted = members.select(F.col("representative").alias("r"), F.col("stamp").alias("s"), F.col("node").alias("wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("stamp") == F.col("s"))
    met = texts.join(F.broadcast(wanted) if few else wanted, same).select("wanted", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                wanted, nodes, packed = part.column(0).to_pylist(), [], []
                done = 0
                for values, sizes in shingle_sets(part.column(1).to_pylist()):
                    edges = np.r_[0, np.cumsum(sizes)]
                    for k, key in enumerate(set_keys(values, sizes)):
                        if key.astype(">u8").tobytes() == wanted[done + k]:
                            nodes.append(wanted[done + k])
                            packed.append(values[edges[k] : edges[k + 1]].astype("<u8").tobytes())
                    done += len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], ["node", "shingles"])

    # Repeated rows of a representative have equal sets: one is kept, before anything is shuffled.
    sets = met.mapInArrow(tidied(compute), "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return members.join(sets, "node")


def similarity_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, stamp, class_node, class_id, copies, text_links, n_links of every row.

    class_id is the least doc_id of the class; n_links counts the other rows that reach the threshold with this one, copies included;
    text_links counts linked classes of copies, that is different texts."""
    sketched = materialise(sketches(docs), "sketches")
    least, exact = least_matches(threshold), Fraction(threshold).limit_denominator(1000)
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "stamp"))
    nodes = sketched.groupBy("node").agg(chosen.alias("r"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("values").alias("values"))
    nodes = materialise(nodes.select("node", F.col("r.doc_id").alias("representative"), F.col("r.stamp").alias("stamp"), "copies", "n_shingles", "bands", "values"), "nodes")
    grouped = components(candidate_edges(nodes, least), "candidates")
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    placed = grouped.unionByName(roots).withColumnRenamed("root", "component")
    placed = materialise(placed, "placed")
    sizes = materialise(placed.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    placed = join_by_count(placed, sizes, "component", "size", nodes.count())
    members = materialise(placed.join(nodes.select("node", "representative", "stamp", "copies", "values"), "node"), "members")

    tasks = max(1, -(-members.count() // BLOCK))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = member_sets(docs, members).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    # Groups of one block share tasks; every pair of blocks of a larger group is a task of its own.
    alone = F.concat_ws(":", F.hex("component"), "first", "second")
    dealt = dealt.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string")).otherwise(alone))

    def count(group: pa.Table) -> pa.Table:
        return link_counts(group, exact, least)

    columns = ["task", "component", "first", "second", "block", "node", "copies", "values", "shingles"]
    links = materialise(dealt.select(*columns).groupBy("task").applyInArrow(count, LINKS), "links")
    totals = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")

    known = nodes.select("node", "representative", "copies").join(joined, "node", "left").join(totals, "node", "left")
    known = materialise(known.withColumn("root", F.coalesce("root", "node")), "known")
    names = materialise(known.groupBy("root").agg(F.min("representative").alias("class_id"), F.count("*").alias("texts_in_class")), "names")
    named = join_by_count(known, names, "root", "texts_in_class", nodes.count()).select("node", F.col("root").alias("class_node"), "class_id", "copies", F.coalesce("texts", F.lit(0)).alias("text_links"), (F.coalesce("rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = materialise(named, "named")
    rows = join_by_count(sketched.select("doc_id", "stamp", "node"), named, "node", "copies", sketched.count())
    return rows.select("doc_id", "stamp", "class_node", "class_id", "copies", "text_links", "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each class the row of the least doc_id stays, once; of several texts of that id one.

    Of rows with the same doc_id and text, the first in order of their columns (as JSON) stays."""
    found = materialise(similarity_classes(docs, threshold).select("doc_id", "stamp", "class_id", "class_node"), "class-rows")
    is_first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    first = found.filter(is_first)  # one row for each class, but for repeated doc_ids
    kept_stamp = first.groupBy("class_node").agg(F.min("stamp").alias("kept"))
    chosen = materialise(first.join(kept_stamp, "class_node"), "class-first")
    rest = found.filter(~is_first).select("doc_id", "stamp").unionByName(chosen.filter("stamp <> kept").select("doc_id", "stamp"))
    mark = "_" * (1 + max(map(len, docs.columns)))  # begins no column of docs
    stamp, doc_id = F.xxhash64(whole_text()), F.col("doc_id").cast("long")

    def rows_of(keys: DataFrame) -> tuple[DataFrame, Column]:
        """The keys (doc_id, stamp) for a join with docs, broadcast if they are few, and the condition."""
        named = keys.select(F.col("doc_id").alias(f"{mark}d"), F.col("stamp").alias(f"{mark}s"))
        return F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, doc_id.eqNullSafe(F.col(f"{mark}d")) & (stamp == F.col(f"{mark}s"))

    kept = docs.join(*rows_of(rest.distinct()), "left_anti")
    # Rows that repeat doc_id and text: of these the first by their other columns stays.
    repeated = materialise(chosen.filter("stamp = kept").groupBy("class_node").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("stamp").alias("stamp")).filter("n > 1").select("doc_id", "stamp"), "class-repeated")
    if not repeated.limit(1).count():
        return kept
    keys, same = rows_of(repeated)
    order = Window.partitionBy(f"{mark}i", f"{mark}t").orderBy(F.to_json(F.struct(*docs.columns)))
    several = kept.join(keys, same, "left_semi").withColumns({f"{mark}i": doc_id, f"{mark}t": stamp})
    first = several.withColumn(f"{mark}n", F.row_number().over(order)).filter(F.col(f"{mark}n") == 1).select(*docs.columns)
    return kept.join(keys, same, "left_anti").unionByName(first)
