"""Toxicity: a factorization machine over hashed terms.

A text is the set of its lower-case words and of their prefixes of 4, 5 and 6 letters, hashed into 2^20 buckets. The score
is a logistic function of a bias, one weight for each present bucket and, for each pair of present buckets, the product of
their factor vectors, so that two terms can say together what neither says alone.

Training: at most `max_train_rows` labelled rows of different id or text, chosen by a hash of both (so the list of those chosen has a fixed size
and can be broadcast, and an id in a third of all rows is no hot key); their buckets are stored once. Up to `max_terms` buckets become the model's terms:

* those that go with the label or against it alone, by `MIN_STRENGTH` standard deviations or more, the strongest first;
* those of pairs that do so together and not alone: the `PAIR_TERMS` buckets of the strongest association and the greatest frequency are
  counted two by two (matrix products of a fixed size in `WORKERS` tasks), and a pair counts where its share of the label is
  `MIN_PAIR` deviations away from the sum of what its two buckets say.

Each round, workers run gradient steps from the same parameters and the driver averages the fixed-size results, term by term over the
workers that met it.

Defined results: a null text is an empty one, whose score is that of the bias; rows without doc_id are scored and never learnt from; a
document with several labels counts with their mean; labels of absent documents count for nothing; rows that repeat id and text are learnt from
once and scored each; without any usable label every score is 0.5; no rows give
no rows. Columns beyond doc_id and text (doc_id and the label) are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, tidied, whole_text

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
FACTORS = 8
ROUNDS = 8
WORKERS = 8
SEED = 11
#: Spread of the factors before the first step.
SPREAD = 0.02
#: How much a toxic row counts against a clean one: they are few, and one insult must suffice.
POSITIVE_WEIGHT = 1.5
WORD = re.compile(r"\w+")
CACHE = 150_000
#: Standard deviations between a bucket's labels and chance from which it can become a term, and the same for pairs of buckets.
MIN_STRENGTH, MIN_PAIR = 3.5, 6.0
#: Buckets that are counted two by two, and the least number of documents of a pair.
PAIR_TERMS, PAIR_DOCS = 1024, 10


def buckets_of(word: str) -> list[int]:
    """Hash buckets of a word and of its prefixes."""
    terms = ["=" + word, *(f"{k}{word[:k]}" for k in PREFIXES if len(word) > k)]
    return [zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms]


class Lookup(dict):
    """Words to the model's term numbers, remembered up to a bound."""

    def __init__(self, index: dict[int, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = tuple(self.index[b] for b in buckets_of(word) if b in self.index)
        return found

    def terms(self, text: str) -> list[int]:
        """Sorted distinct term numbers of a text."""
        return sorted({t for w in set(WORD.findall(text.lower())) for t in self[w]})


@dataclass
class Model:
    """Terms by bucket, bias, weights and factors."""

    index: dict[int, int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        mixed = x @ self.factor
        pairs = 0.5 * ((mixed**2).sum(axis=1) - x @ (self.factor**2).sum(axis=1))
        return self.bias + x @ self.weight + pairs

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of texts by their terms; the work is that of their terms, not of the model's."""
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([np.asarray(rows[k], dtype=np.int64) for k in full])
            starts = (np.cumsum(sizes) - sizes)[full]
            mixed = np.add.reduceat(self.factor[flat], starts)
            own = self.weight - 0.5 * (self.factor**2).sum(axis=1)
            out[full] += np.add.reduceat(own[flat], starts) + 0.5 * (mixed**2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def dense(rows: list[list[int]], width: int) -> np.ndarray:
    """Presence of terms as a matrix."""
    x = np.zeros((len(rows), width), dtype=np.float32)
    for k, terms in enumerate(rows):
        x[k, terms] = 1
    return x


def train(model: Model, rows: list[list[int]], y: np.ndarray, seed: int, epochs: int = 4, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adagrad steps over the rows on logistic loss, from the given parameters."""
    rng = np.random.default_rng(seed)
    bias, weight, factor = model.bias, model.weight.copy(), model.factor.copy()
    seen = [1e-2, np.full_like(weight, 1e-2), np.full_like(factor, 1e-2)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), 128):
            take = order[k : k + 128]
            x = dense([rows[i] for i in take], len(weight))
            now = Model(model.index, bias, weight, factor)
            gap = (1 / (1 + np.exp(-np.clip(now.logits(x), -40, 40))) - y[take]) / len(take)
            gap *= np.where(y[take] > 0.5, POSITIVE_WEIGHT, 1.0)
            touched = x.any(axis=0)
            steps = [gap.sum(), x.T @ gap + decay * weight * touched, x.T @ (gap[:, None] * (x @ factor)) - factor * (x.T @ gap)[:, None] + decay * factor * touched[:, None]]
            for total, step in zip(seen, steps, strict=True):
                if isinstance(total, np.ndarray):
                    total += step**2
            seen[0] += steps[0] ** 2
            bias -= rate * steps[0] / np.sqrt(seen[0])
            weight -= rate * steps[1] / np.sqrt(seen[1])
            factor -= rate * steps[2] / np.sqrt(seen[2])
    return Model(model.index, float(bias), weight, factor)


def local_steps(start: Model, seed: int):
    """The function that trains on one worker's rows from the given parameters."""

    def step(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        rows = group.column("terms").to_pylist()
        found = train(start, rows, group.column("y").to_numpy(), seed)
        met = np.bincount([t for r in rows for t in r], minlength=len(start.weight)) if rows else np.zeros(len(start.weight))
        packed = np.concatenate([[found.bias], found.weight, found.factor.ravel(), met])
        return pa.table({"n": [group.num_rows], "packed": pa.array([packed], pa.list_(pa.float64()))})

    return step


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and the length of each list; no Python objects are made of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(buckets: list[int]) -> np.ndarray:
    """For each bucket its place in the list, or -1."""
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    return place


def _counts(rows: DataFrame) -> DataFrame:
    """bucket, n, y: documents with each bucket and the sum of their labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            at, sizes = _flat(batch.column("buckets"))
            total += np.bincount(at, minlength=BUCKETS)
            hits += np.bincount(at, weights=np.repeat(batch.column("y").to_numpy(zero_copy_only=False), sizes), minlength=BUCKETS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part]), pa.array(hits[part])], ["bucket", "n", "y"])

    return rows.select("buckets", "y").mapInArrow(tidied(count), "bucket long, n double, y double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def telling_pairs(rows: DataFrame, wanted: list[int], share: float) -> list[tuple[int, int, float]]:
    """Pairs of the wanted buckets whose label share differs from the sum of what both say alone, the clearest first: (bucket, bucket, deviations)."""
    place, m = _places(wanted), len(wanted)

    def products(group: pa.Table) -> pa.Table:
        both, hits = np.zeros((m, m), dtype=np.float32), np.zeros((m, m), dtype=np.float32)
        for k in range(0, group.num_rows, 512):
            part = group.slice(k, 512)
            flat, sizes = _flat(part.column("buckets"))
            column, row = place[flat], np.repeat(np.arange(len(sizes)), sizes)
            x = np.zeros((len(sizes), m), dtype=np.float32)
            x[row[column >= 0], column[column >= 0]] = 1
            both += x.T @ x
            hits += x.T @ (x * part.column("y").to_numpy().astype(np.float32)[:, None])
        return pa.table({"i": pa.array(range(m), pa.int32()), "n": pa.array(list(both), pa.list_(pa.float32())), "y": pa.array(list(hits), pa.list_(pa.float32()))})

    parts = rows.groupBy("worker").applyInArrow(products, "i int, n array<float>, y array<float>")
    # WORKERS rows of a fixed size for each i; labels are sums of halves and whole numbers or close to them, added in one order.
    alone = {r["i"]: (r["n"], r["y"]) for r in parts.select("i", F.get("n", F.col("i")).alias("n"), F.get("y", F.col("i")).alias("y")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()}
    said = np.array([alone[k][1] / max(1.0, alone[k][0]) for k in range(m)])

    def test(group: pa.Table) -> pa.Table:
        i = group.column("i")[0].as_py()
        n, y = (np.sum(sorted(group.column(c).to_pylist()), axis=0, dtype=np.float64) for c in ("n", "y"))
        told = np.clip(said[i] + said - share, 1e-3, 1 - 1e-3)
        z = (y - n * told) / np.sqrt(n * told * (1 - told) + 1)
        on = np.flatnonzero((np.arange(m) > i) & (n >= PAIR_DOCS) & (np.abs(z) >= MIN_PAIR))
        return pa.table({"i": pa.array(np.full(len(on), i), pa.int32()), "j": pa.array(on, pa.int32()), "z": pa.array(np.round(z[on], 6))})

    found = parts.groupBy("i").applyInArrow(test, "i int, j int, z double").orderBy(F.abs("z").desc(), "i", "j").limit(4 * PAIR_TERMS).collect()
    return [(wanted[r["i"]], wanted[r["j"]], r["z"]) for r in found]


def choose_terms(rows: DataFrame, max_terms: int) -> tuple[dict[int, int], float, int]:
    """The buckets that become terms, the mean label, and the number of rows."""
    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, positive = size["n"], float(size["y"] or 0)
    if not n:
        return {}, 0.5, 0
    share = positive / n
    spread = F.sqrt(F.col("n") * F.lit(share * (1 - share)) + 1.0)
    strength = F.abs((F.col("y") - F.col("n") * F.lit(share)) / spread)
    counts = materialise(_counts(rows).filter("n >= 3"), "toxicity-counts")
    strong = [r["bucket"] for r in counts.filter(strength >= MIN_STRENGTH).orderBy(strength.desc(), "bucket").limit(max_terms).collect()]
    often = [r["bucket"] for r in counts.filter(F.col("n") >= PAIR_DOCS).orderBy(F.col("n").desc(), "bucket").limit(PAIR_TERMS).collect()]
    screened = list(dict.fromkeys([*strong[: PAIR_TERMS // 2], *often]))[:PAIR_TERMS]
    chosen = dict.fromkeys(strong)
    if 0 < share < 1 and len(screened) > 1:
        for a, b, _ in telling_pairs(rows, screened, share):
            if len(chosen) + 2 <= max_terms:
                chosen |= dict.fromkeys((a, b))
    return {bucket: k for k, bucket in enumerate(chosen)}, share, n


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, max_train_rows: int) -> DataFrame:
    """doc_id, stamp, text, y: the labelled rows to learn from, each different one once."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.avg(F.col(label).cast("double")).alias("y")).filter(learn_from)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("stamp"), whole_text().alias("text"))
    learnable = keyed.select("doc_id", "stamp").distinct().join(known, "doc_id")
    chosen = learnable.orderBy(F.xxhash64(F.lit(SEED), "doc_id", "stamp"), "doc_id", "stamp").limit(max_train_rows)
    # At most max_train_rows rows of 24 bytes. Rows that repeat id and text become one before they are shuffled.
    return keyed.join(F.broadcast(chosen), ["doc_id", "stamp"]).groupBy("doc_id", "stamp").agg(F.first("text").alias("text"), F.first("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, max_train_rows: int, max_terms: int) -> Model | None:
    """The model learnt from at most `max_train_rows` labelled rows; None without any."""
    texts = training_rows(docs, labels, label, learn_from, max_train_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                here: set[int] = set()
                for w in set(WORD.findall(text.lower())):
                    found = seen.get(w)
                    if found is None:
                        if len(seen) >= CACHE // 4:  # with four numbers to a word
                            seen.clear()
                        found = seen[w] = buckets_of(w)
                    here.update(found)
                rows.append(sorted(here))
            columns = [batch.column("doc_id"), batch.column("stamp"), batch.column("y"), pa.array(rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "stamp", "y", "buckets"])

    # The corpus is read once to learn; all that follows works on these rows.
    rows = texts.mapInArrow(tidied(hashed), "doc_id long, stamp long, y double, buckets array<int>").withColumn("worker", F.pmod(F.xxhash64("doc_id", "stamp"), F.lit(WORKERS)).cast("int"))
    rows = materialise(rows, "toxicity-rows")
    index, share, n = choose_terms(rows, max_terms)
    if not n:
        return None

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(list(index))
        for batch in batches:
            flat, sizes = _flat(batch.column("buckets"))
            term = place[flat]
            kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[term >= 0], minlength=len(sizes))
            terms = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), pa.array(term[term >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("worker"), terms], ["doc_id", "y", "worker", "terms"])

    trained = materialise(rows.select("doc_id", "y", "worker", "buckets").mapInArrow(tidied(compress), "doc_id long, y double, worker int, terms array<int>"), "toxicity-terms")
    rng = np.random.default_rng(SEED)
    odds = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    model = Model(index, odds, np.zeros(len(index)), rng.normal(0, SPREAD, (len(index), FACTORS)))
    for number in range(ROUNDS):
        # WORKERS rows of a fixed size.
        parts = trained.groupBy("worker").applyInArrow(local_steps(model, SEED + number), "n long, packed array<double>").collect()
        parts.sort(key=lambda p: (p["n"], p["packed"][:2]))  # sums in one order each time
        model = averaged(model, parts)
    return model


def averaged(model: Model, parts: list) -> Model:
    """The mean of the workers' parameters: a term's over the workers that met it, by how often they did; others know nothing of it."""
    m = len(model.index)
    packed, rows_of = np.array([p["packed"] for p in parts]), np.array([p["n"] for p in parts], dtype=float)
    met = packed[:, 1 + m + m * FACTORS :]
    part = met / np.maximum(met.sum(axis=0), 1)
    weight = (packed[:, 1 : m + 1] * part).sum(axis=0)
    factor = (packed[:, m + 1 : 1 + m + m * FACTORS].reshape(len(parts), m, FACTORS) * part[:, :, None]).sum(axis=0)
    return Model(model.index, float(packed[:, 0] @ rows_of / rows_of.sum()), weight, factor)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, threshold: float = 0.3, label: str = "toxic", max_train_rows: int = 30_000, max_terms: int = 4096) -> DataFrame:
    """doc_id, score, predicted of every row of docs; `learn_from` says which doc_ids may be learnt from."""
    model = fit(docs, labels, label, learn_from, max_train_rows, max_terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.index) if model else None
        for batch in batches:
            found = model.score([lookup.terms(t) for t in batch.column("text").to_pylist()]) if model else np.full(batch.num_rows, 0.5)
            columns = [batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(tidied(score), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "toxic", max_train_rows: int = 30_000, max_terms: int = 4096) -> DataFrame:
    """The rows of docs, as they are, whose text scores below `threshold`; without a model all of them."""
    model = fit(docs, labels, label, F.lit(True), max_train_rows, max_terms)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.index)
        for batch in batches:
            if batch.num_rows:
                scores = model.score([lookup.terms(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(tidied(choose), docs.schema)
