"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

One pass over the texts turns each document into a short vector of statistics (shares of byte classes, vocabulary,
repetition, lengths), which is stored; everything after works on these vectors. The features cos(w.x + b) approximate a
Gaussian kernel. Each partition of labelled rows adds up its normal equations, the sums of partitions meet row block by row
block, and one small system is solved. Scores of a calibration fold are counted in fixed bins, over which the
isotonic fit runs.

All labelled rows outside the held-out rows are used; what reaches the driver is the (D+1)^2 system and at most `BINS` bins.

Defined results: a null text is an empty one and is scored like any other; rows without doc_id are scored and never learnt from; a
document with several labels counts with their mean; without any usable label every score is 0.5; repeated rows stay; no rows give
no rows. Columns beyond doc_id and text (doc_id and quality of the labels) are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, tidied, whole_text

FEATURES = 256
BINS = 4096
RIDGE = 1e-4
SEED = 7
CALIBRATION_FOLDS = 5
#: Parts in which partitions' equations are added up before these are added up in turn.
SLOTS = 512
#: Rows of the system that are added up together.
STRIPE = 16

# Byte classes: 0 upper case, 1 lower case, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 other mark, 7 control, 8 beyond ASCII.
CLASSES = np.full(256, 8, dtype=np.int64)
CLASSES[:128] = 6
CLASSES[:32] = 7
CLASSES[ord("A") : ord("Z") + 1], CLASSES[ord("a") : ord("z") + 1], CLASSES[ord("0") : ord("9") + 1] = 0, 1, 2
CLASSES[[ord(" "), 9]], CLASSES[[10, 13]], CLASSES[[ord(c) for c in ".,;:'\"-?"]] = 3, 4, 5
N_STATS = 9 + 10


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all finite, also for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    shares = np.bincount(CLASSES[raw], minlength=9) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    repeats = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    return [
        *shares.tolist(),
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(counts) / n,
        len(counts) / n**0.8,
        repeats / n,
        max(counts.values(), default=0) / n,
        float(lengths.mean()),
        float(lengths.std()),
        len(set(lines)) / len(lines),
        sum(map(str.isalpha, words)) / n,
    ]


STATS = "doc_id long, stats array<double>"


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidied(count), STATS)


@dataclass(frozen=True)
class Model:
    """Standardisation, random features, ridge weights and isotonic knots."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.freq + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit to points in order of x: pool adjacent violators."""
    pools: list[list[float]] = []  # x of the first and last point, weight, mean
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a, a, w, b])
        while len(pools) > 1 and pools[-2][3] >= pools[-1][3]:
            last = pools.pop()
            total = pools[-1][2] + last[2]
            pools[-1][3] = (pools[-1][3] * pools[-1][2] + last[3] * last[2]) / total
            pools[-1][1], pools[-1][2] = last[1], total
    knots = np.array([k for p in pools for k in ([p[0], p[1]] if p[1] > p[0] else [p[0]])])
    values = np.array([p[3] for p in pools for _ in range(2 if p[1] > p[0] else 1)])
    return knots, values


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, N_STATS))


def fit(rows: DataFrame) -> Model | None:
    """The model for rows of doc_id, stats and y (0 to 1); None without rows."""
    moments = [F.struct(F.avg(F.col("stats")[k]).alias("m"), F.stddev_pop(F.col("stats")[k]).alias("s")).alias(f"f{k}") for k in range(N_STATS)]
    seen = rows.agg(F.count("*").alias("n"), *moments).first()
    if not seen["n"]:
        return None
    mean = np.array([seen[f"f{k}"]["m"] for k in range(N_STATS)])
    scale = np.array([seen[f"f{k}"]["s"] for k in range(N_STATS)])
    scale[~(scale > 1e-9)] = 1.0
    rng = np.random.default_rng(SEED)
    freq = rng.standard_normal((N_STATS, FEATURES)) / np.sqrt(N_STATS)
    blank = Model(mean, scale, freq, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    fold = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(CALIBRATION_FOLDS))
    width = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = blank.features(_matrix(batch, "stats"))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
        cut = [total[k : k + STRIPE].ravel() for k in range(0, width, STRIPE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.list_(pa.float64()))], ["i", "part"])

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(group["part"], key=lambda part: tuple(part[:3]))  # sums in one order each time
        return pd.DataFrame({"i": [int(group["i"].iloc[0])], "part": [np.sum(np.stack(parts), axis=0)]})

    parts = rows.filter(fold != 0).select("stats", "y").mapInArrow(tidied(equations), "i int, part array<double>")
    # Two levels: a group of the first holds one in SLOTS of the partitions' stripes (33 kB each), one of the second SLOTS of them.
    slotted = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    halves = slotted.groupBy("i", "slot").applyInPandas(add_up, "i int, part array<double>")
    system = halves.groupBy("i").applyInPandas(add_up, "i int, part array<double>").collect()
    total = np.zeros((width, width + 1))
    for row in system:
        stripe = np.array(row["part"]).reshape(-1, width + 1)
        total[row["i"] * STRIPE : row["i"] * STRIPE + len(stripe)] = stripe
    n = max(1.0, total[width - 1, width - 1])
    weights = np.linalg.solve(total[:, :width] + RIDGE * n * np.eye(width), total[:, width])
    model = Model(mean, scale, freq, blank.phase, weights, blank.knots, blank.values)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch, "stats"))), batch.column("y")], ["raw", "y"])

    bins = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("raw") + 0.5) / 2)) * (BINS - 1)).cast("int")
    held = rows.filter(fold == 0).select("stats", "y").mapInArrow(tidied(scored), "raw double, y double")
    points = held.groupBy(bins.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    if not points:
        return Model(mean, scale, freq, blank.phase, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    points.sort(key=lambda p: p["bin"])
    knots, values = isotonic(*(np.array([p[c] for p in points], dtype=float) for c in ("x", "y", "n")))
    return Model(mean, scale, freq, blank.phase, weights, knots, values)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", stats: DataFrame | None = None) -> Model | None:
    """The model for the labelled rows of docs that `learn_from` (over doc_id) allows."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.avg(F.col(label).cast("double")).alias("y")).filter(learn_from)
    # Moments, equations and calibration read these rows, so they are joined once.
    return fit(materialise((stats if stats is not None else statistics_table(docs)).join(known, "doc_id").select("doc_id", "stats", "y"), "quality-rows"))


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """doc_id, score, predicted of every row of docs; `learn_from` says which doc_ids may be learnt from."""
    stats = materialise(statistics_table(docs), "quality-stats")
    model = learn(docs, labels, learn_from, label, stats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_matrix(batch, "stats")) if model else np.full(batch.num_rows, 0.5)
            columns = [batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return stats.mapInArrow(tidied(score), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """The rows of docs, as they are, whose text scores `threshold` or more; without a model all of them."""
    # The statistics are used several times while fitting and are small; the texts are read again to filter.
    model = learn(docs, labels, F.lit(True), label, materialise(statistics_table(docs), "quality-stats"))
    if model is None:
        return docs
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(tidied(choose), docs.schema)
