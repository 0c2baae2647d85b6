"""Embedding whitening by hierarchical merging of singular value decompositions.

A state describes a set of vectors by its size, its exact sums, and all singular values and right vectors of its centred rows. Two
states merge by stacking their scaled vectors with one more row, the difference of the means times sqrt(n1 n2 / (n1 + n2)), and decomposing
the stack again: nothing is cut off, so the result is the decomposition of the centred rows of both, whatever the order. Partitions fold
chunks of their rows into one state, states meet in two levels, always two at a time; a state has d^2 doubles, whatever the number
of rows. Sums are integers of any size, so means and their differences are right to the last bit although entries may lie far from 0.

The fit list is each distinct vector of integers once, found by a grouping that combines before it shuffles: a vector that stands in a third of
all rows travels once from each task. What reaches the driver is one state for each length of vectors.

Defined results: vectors that are null or hold null or non-finite entries are dropped; entries beyond 2^46 count as 2^46 (so that x is exact in
double precision); repeated rows and rows without vec_id are whitened like others; vectors of different lengths are tables of their own, each
with its own n, sums and components; components of eigenvalue 0 (singular value not above 1e-12 of the largest) can't be whitened and are
left out, so that a single distinct vector, or a vector of no entries, gives no rows; deviation is null where it exceeds a long (from about
50 million distinct vectors on); of either sign of a component the one is taken whose largest entry is positive; no rows give no rows. Columns
beyond the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, tidied

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 46)
COMPONENTS = 16
#: Rows that one decomposition takes in; integers of 53 bits add up exactly over them.
CHUNK = 512
#: States of the first level meet in so many groups.
SLOTS = 256
RANK = 1e-12

STATE = "dim int, part int, n long, sums array<decimal(38,0)>, s array<double>, axes array<double>"
SCATTER = "dim int, part int, n long, mean array<double>, scatter array<double>"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class State:
    """n vectors: their exact sums, and singular values and right vectors (rows of `axes`) of the centred vectors."""

    n: int
    sums: list[int]
    s: np.ndarray
    axes: np.ndarray


def decomposed(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors."""
    _, s, axes = np.linalg.svd(stack, full_matrices=False)
    return s, axes


def state_of(x: np.ndarray) -> State:
    """The state of at most CHUNK rows of integers."""
    n, first = len(x), x[0]
    moved = x - first
    sums = moved.sum(axis=0)
    s, axes = decomposed((moved * n - sums) / n if np.abs(moved).max(initial=0) < 1 << 52 else moved - sums / n)
    return State(n, [int(a) + n * int(b) for a, b in zip(sums, first, strict=True)], s, axes)


def merged(a: State, b: State) -> State:
    """The state of the vectors of both."""
    n = a.n + b.n
    step = np.array([(p * b.n - q * a.n) / (a.n * b.n) for p, q in zip(a.sums, b.sums, strict=True)])
    correction = step * np.sqrt(a.n * b.n / n)
    s, axes = decomposed(np.vstack([a.s[:, None] * a.axes, b.s[:, None] * b.axes, correction]))
    return State(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], s, axes)


def _row(dim: int, part: int, state: State) -> dict:
    return {"dim": dim, "part": part, "n": state.n, "sums": [Decimal(v) for v in state.sums], "s": state.s, "axes": state.axes.ravel()}


def _state(row: dict) -> State:
    s = np.asarray(row["s"], dtype=float)
    return State(row["n"], [int(v) for v in row["sums"]], s, np.asarray(row["axes"], dtype=float).reshape(len(s), row["dim"]))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


STATE_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("s", pa.list_(pa.float64())), ("axes", pa.list_(pa.float64()))])
SCATTER_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


def matrices(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, places and vectors of the rows of each length, CHUNK at a time."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        places = np.flatnonzero(lengths == dim)
        for at in range(0, len(places) if dim else 0, CHUNK):
            some = places[at : at + CHUNK]
            yield int(dim), some, vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim)


def met(states: DataFrame, kind: str, schema: pa.Schema, merge: Callable[[dict, dict], dict]) -> DataFrame:
    """One row for each dim: rows of states meet in SLOTS groups, these in one, two at a time and in the order of their parts."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if held is not None and (held["dim"], held["slot"]) == (row["dim"], row["slot"]):
                    held = merge(held, row) | {"slot": row["slot"], "part": row["slot"]}
                    continue
                if held is not None:
                    yield _batch([held], schema)
                held = row | {"part": row["slot"]}
        if held is not None:
            yield _batch([held], schema)

    for slot in (F.pmod("part", F.lit(SLOTS)), F.lit(0)):
        dealt = states.withColumn("slot", slot.cast("int")).repartition("dim", "slot").sortWithinPartitions("dim", "slot", "part")
        states = dealt.mapInArrow(tidied(fold), kind)
    return states


def scaled(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x: the rows that remain, their entries as integers."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("vector", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)) * SCALE) + OFFSET)
    return rows.filter(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("x"))


def decompose(fit: DataFrame) -> dict[int, State]:
    """The state of all vectors of each length in `fit` (x)."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for batch in batches:
            for dim, _, x in matrices(batch.column(0)):
                states[dim] = merged(states[dim], state_of(x)) if dim in states else state_of(x)
        part = TaskContext.get().partitionId()
        if states:
            yield _batch([_row(dim, part, s) for dim, s in states.items()], STATE_ARROW)

    def merge(a: dict, b: dict) -> dict:
        return _row(a["dim"], a["part"], merged(_state(a), _state(b)))

    found = met(fit.select("x").mapInArrow(tidied(partition), STATE), STATE, STATE_ARROW, merge).toArrow().to_pylist()
    return {row["dim"]: _state(row) for row in found}


@dataclass(frozen=True)
class Whitening:
    """n, sums, and by component: unit axes, square roots of eigenvalues, and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    root: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, state: State, most: int) -> Whitening:
        k = min(most, int(np.count_nonzero(state.s > RANK * state.s.max(initial=0))))
        axes = state.axes[:k]
        signs = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)]) if k else np.ones(0)
        squares = state.s**2
        return cls(state.n, state.sums, axes * signs[:, None], state.s[:k] / np.sqrt(state.n), squares[:k] / max(squares.sum(), np.finfo(float).tiny))

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: integers of 64 bits where they and the sum of their squares fit, of any size elsewhere."""
        near = [v // self.n for v in self.sums]
        rest = [v - self.n * m for v, m in zip(self.sums, near, strict=True)]
        moved = x - np.array(near)
        wide = int(np.abs(moved).max(initial=0)) + 1
        if x.shape[1] * (self.n * wide) ** 2 >= 1 << 63:
            return moved.astype(object) * self.n - np.array(rest, dtype=object)
        return moved * self.n - np.array(rest)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(float) @ self.axes.T / self.root


def spread(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, for each length."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for dim, _, x in matrices(batch.column(0)):
                z = models[dim].whitened(models[dim].apart(x))
                mean = z.mean(axis=0)
                new = {"dim": dim, "part": part, "n": len(z), "mean": mean, "scatter": ((z - mean).T @ (z - mean)).ravel()}
                held[dim] = merge(held[dim], new) if dim in held else new
        if held:
            yield _batch(list(held.values()), SCATTER_ARROW)

    def merge(a: dict, b: dict) -> dict:
        n, step = a["n"] + b["n"], np.asarray(b["mean"]) - np.asarray(a["mean"])
        scatter = np.asarray(a["scatter"]) + np.asarray(b["scatter"]) + np.outer(step, step).ravel() * (a["n"] * b["n"] / n)
        return {"dim": a["dim"], "part": a["part"], "n": n, "mean": np.asarray(a["mean"]) + step * (b["n"] / n), "scatter": scatter}

    found = met(fit.select("x").mapInArrow(tidied(moments), SCATTER), SCATTER, SCATTER_ARROW, merge).toArrow().to_pylist()
    sizes = {row["dim"]: len(row["mean"]) for row in found}
    return {row["dim"]: float(np.abs(np.reshape(row["scatter"], (-1, sizes[row["dim"]])) / row["n"] - np.eye(sizes[row["dim"]])).max(initial=0)) for row in found if sizes[row["dim"]]}


def whiten(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each remaining row by its first components."""
    rows = scaled(table, vec_id, vector)
    fit = materialise(rows.groupBy("x").agg(F.count("*").alias("rows")).select("x"), "fit-list")
    models = {dim: Whitening.of(state, components) for dim, state in decompose(fit).items()}
    errors = spread(fit, models)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places, x in matrices(batch.column(1)):
                model = models[dim]
                k = len(model.root)
                if not k:
                    continue
                apart = model.apart(x)
                deviation = (apart * apart).sum(axis=1)
                if deviation.dtype == object:
                    deviation = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64())
                each = pa.array(np.repeat(np.arange(len(places)), k))
                columns = [
                    batch.column(0).take(pa.array(places)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(deviation).take(each),
                    pa.array(model.whitened(apart).ravel()),
                    pa.array(np.tile(model.explained, len(places))),
                    pa.array(np.full(len(each), errors[dim])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidied(project), WHITENED)
