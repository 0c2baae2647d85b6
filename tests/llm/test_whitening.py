import numpy as np
import pytest

from strandwell.llm import svd_whitening
from strandwell.llm.svd_whitening import State, merged, state_of, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """x, fit list, eigenvalues from the largest, eigenvectors as columns: all at once, by the covariance."""
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, e[::-1], v[:, ::-1]


def compare(spark, rows, dim):
    found = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    good = [(i, v) for i, v, _ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x, fit, e, v = plain([c for _, c in good])
    k = min(16, int((e > e[0] * 1e-12).sum()))
    found = found[found.n == len(fit)].sort_values(["component", "vec_id"])
    assert len(found) == len(good) * k
    order = np.argsort([i for i, _ in good], kind="stable")
    n, s = len(fit), fit.sum(axis=0).tolist()
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(x[i], s)) for i in order]
    for c in range(k):
        part = found[found.component == c + 1]
        assert part.deviation.tolist() == deviation
        want = ((x - fit.mean(axis=0)) @ v[:, c] / np.sqrt(e[c]))[order]
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-6
        assert part.explained.to_numpy() == pytest.approx(e[c] / e.sum(), rel=1e-9)
    assert 0 <= found.identity_error.max() < 1e-6 and found.identity_error.nunique() == 1


def test_equals_the_covariance(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(20) * np.linspace(3, 0.3, 20)).astype(np.float32).tolist(), 0) for i in range(1500)]
    # A third of the rows is one vector, ids repeat, and some vectors don't count.
    rows += [(10_000 + i, rows[0][1], 0) for i in range(500)] + [(7, None, 0), (8, [float("nan")] * 20, 0), (9, [None] + [1.0] * 19, 0), (9, [float("inf")] * 20, 1)]
    compare(spark, rows, 20)


def test_fewer_vectors_than_components(spark):
    rng = np.random.default_rng(1)
    compare(spark, [(i, rng.standard_normal(12).astype(np.float32).tolist(), 0) for i in range(5)], 12)


def test_lengths_are_tables_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3 + i % 2).astype(np.float32).tolist(), 0) for i in range(61)]
    compare(spark, rows, 3)
    compare(spark, rows, 4)


def test_odd_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, [0.5, 0.5], 0) for i in range(4)] + [(5, [], 0), (6, None, None)]
    assert whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    extra = spark.createDataFrame([(None, [0.1, 1e30], 1, 2, 3), (1, [0.9, -1e30], 1, 2, 3)], "vec_id long, embedding array<float>, n int, x int, part int")
    found = whiten(extra).toPandas()
    assert len(found) == 2 and found.component.tolist() == [1, 1] and abs(found.whitened.abs() - 1).max() < 1e-9


def test_merging_loses_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (700, 6)) + 1_000_000
    whole: State | None = None
    for at in (0, 1, 3, 300, 500):
        part = state_of(x[at : {0: 1, 1: 3, 3: 300, 300: 500, 500: 700}[at]])
        whole = part if whole is None else merged(whole, part)
    assert whole.n == 700 and whole.sums == x.sum(axis=0).tolist() and len(whole.s) == 6
    centred = x - x.mean(axis=0)
    assert np.allclose((whole.axes.T * whole.s**2) @ whole.axes, centred.T @ centred, rtol=1e-9, atol=1e-6)


def test_deviations_beyond_a_long():
    model = svd_whitening.Whitening(10**9, [0, 0], np.eye(2), np.ones(2), np.ones(2) / 2)
    apart = model.apart(np.array([[10**6, 1]]))
    assert apart.tolist() == [[10**15, 10**9]] and apart.dtype == object
