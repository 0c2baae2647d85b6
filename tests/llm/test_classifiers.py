import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwell.llm import quality_rff as R
from strandwell.llm import toxicity_fm as T
from strandwell.llm.queries import op06_toxicity, op07_quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        at = score == s
        ranks[at] = ranks[at].mean()
    positive = label == 1
    p, n = positive.sum(), (~positive).sum()
    return (ranks[positive].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize(("module", "label", "modulus", "rest", "threshold", "least"), [(op07_quality, "quality", 3, 1, 0.5, 0.98), (op06_toxicity, "toxic", 4, 2, 0.3, 0.93)])
def test_held_out_ranking(spark, module, label, modulus, rest, threshold, least):
    sf = "/root/testdata/sf0.1"
    rows = module.query(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % modulus == rest)).count() == 0
    assert rows.filter(~F.col("score").between(0, 1) | (F.col("predicted") != (F.col("score") >= threshold).cast("int"))).count() == 0
    held = rows.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", label).toPandas()
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(op06_toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(op07_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    for module, classify in ((op06_toxicity, T.classify), (op07_quality, R.classify)):
        one = classify(docs, labels, ~module.held_out()).select("doc_id", F.round("score", 9))
        two = classify(docs, turned, ~module.held_out()).select("doc_id", F.round("score", 9))
        assert one.exceptAll(two).count() == 0


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    x, w = np.arange(12.0), rng.integers(1, 5, 12).astype(float)
    y = rng.random(12) + x / 20
    knots, values = R.isotonic(x, y, w)
    fit = np.interp(x, knots, values)
    assert (np.diff(fit) >= -1e-12).all()
    means = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    wanted = [max(min(means(a, b) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]  # the max-min formula
    assert np.allclose(fit, wanted)


def test_machine_learns_pairs():
    """Neither of two terms says anything alone; together they are toxic."""
    rng = np.random.default_rng(3)
    rows = [sorted({int(a) for a in rng.choice(6, rng.integers(0, 4), replace=False)}) for _ in range(3000)]
    y = np.array([float((0 in r) == (1 in r)) for r in rows])
    model = T.Model({}, 0.0, np.zeros(6), rng.normal(0, 0.2, (6, T.FACTORS)))
    for k in range(8):
        model = T.train(model, rows, y, k)
    assert ((model.score(rows) > 0.5) == (y > 0.5)).mean() > 0.97


def test_a_pair_that_says_what_its_words_do_not_reaches_the_machine(spark):
    """Toxic is exactly one of two words: neither is associated with the label alone."""
    rng = random.Random(0)
    rows = []
    for k in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(20)] + ["alphaword"] * a + ["betaword"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = T.classify(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") < 3000)
    held = found.filter("doc_id >= 3000").join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held) / len(held) > 0.95


def test_telling_pairs_equal_plain_counts(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        here = sorted(b for b in (3, 8, 20, 31) if rng.random() < 0.5)
        rows.append((k, float((3 in here) == (20 in here)), here, k % 5))
    table = spark.createDataFrame(rows, "doc_id long, y double, buckets array<int>, worker int")
    share = sum(r[1] for r in rows) / len(rows)
    got = {(a, b): z for a, b, z in T.telling_pairs(table, [3, 8, 20, 31], share)}
    wanted = {}
    mean = lambda rest: sum(y for *_, y in rest) / len(rest)
    for a, b in combinations((3, 8, 20, 31), 2):
        one, two, both = ([(h, y) for _, y, h, _ in rows if set(x) <= set(h)] for x in ((a,), (b,), (a, b)))
        told = min(0.999, max(0.001, mean(one) + mean(two) - share))
        z = (sum(y for _, y in both) - len(both) * told) / (len(both) * told * (1 - told) + 1) ** 0.5
        if abs(z) >= T.MIN_PAIR:
            wanted[a, b] = z
    assert set(got) == set(wanted) == {(3, 20)} and all(abs(got[k] - wanted[k]) < 1e-3 for k in wanted)


def test_a_round_equals_plain_training_and_averaging(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(rng.random() < 0.3), sorted({int(t) for t in rng.integers(0, 5, 3)}), k % 3) for k in range(300)]
    start = T.Model({k: k for k in range(6)}, 0.1, rng.normal(size=6), rng.normal(0, 0.1, (6, T.FACTORS)))
    table = spark.createDataFrame(rows, "doc_id long, y double, terms array<int>, worker int")
    got = T.averaged(start, table.groupBy("worker").applyInArrow(T.local_steps(start, 4), "n long, packed array<double>").collect())
    parts = []
    for w in range(3):
        mine = sorted((i, y, t) for i, y, t, v in rows if v == w)
        parts.append((T.train(start, [t for *_, t in mine], np.array([y for _, y, _ in mine]), 4), mine))
    for t in range(6):
        met = [sum(t in terms for *_, terms in mine) for _, mine in parts]
        weight = sum(n * m.weight[t] for n, (m, _) in zip(met, parts, strict=True)) / max(1, sum(met))
        assert abs(got.weight[t] - weight) < 1e-9
    assert abs(got.bias - sum(m.bias * len(mine) for m, mine in parts) / 300) < 1e-9


def test_ridge_equals_a_direct_solve(spark, monkeypatch):
    """The equations added up over partitions give the weights of one solve over all rows."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=R.N_STATS).tolist(), float(rng.random() < 0.5)) for k in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, stats array<double>, y double")
    used = {r["doc_id"] for r in table.filter(F.pmod(F.xxhash64(F.lit(R.SEED), "doc_id"), F.lit(R.CALIBRATION_FOLDS)) != 0).collect()}
    for parts in (1, 13):
        monkeypatch.setattr(R, "SLOTS", 3)
        model = R.fit(table.repartition(parts))
        mine = [r for r in rows if r[0] in used]
        z, y = model.features(np.array([r[1] for r in mine])), np.array([r[2] for r in mine])
        direct = np.linalg.solve(z.T @ z + R.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
        assert np.allclose(model.weights, direct, atol=1e-6)


def test_fast_pairs_equal_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    model = T.Model({}, 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    x = T.dense([[0, 2, 4], [], [1]], 5)
    slow = [0.3 + sum(model.weight[i] for i in r) + sum(model.factor[i] @ model.factor[j] for i in r for j in r if i < j) for r in ([0, 2, 4], [], [1])]
    assert np.allclose(model.logits(x), slow)
    assert np.allclose(model.score([[0, 2, 4], [], [1]]), 1 / (1 + np.exp(-np.array(slow))))


def test_odd_rows(odd_docs, odd_rows, odd_labels, no_docs, spark):
    nothing = odd_labels.limit(0)
    for module, label in ((R, "quality"), (T, "toxic")):
        rows = module.classify(odd_docs, odd_labels, F.lit(True)).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["score"] for r in module.classify(odd_docs, nothing, F.lit(True)).collect()} == {0.5}
        assert module.classify(no_docs, odd_labels, F.lit(True)).count() == 0
    keep = (R.keep_good, T.drop_toxic)
    for choose in keep:
        kept = choose(odd_docs, odd_labels)
        assert kept.columns == odd_docs.columns and kept.exceptAll(odd_docs).count() == 0
        assert choose(odd_docs, nothing).count() == len(odd_rows) and choose(no_docs, odd_labels).count() == 0


def test_one_id_in_most_rows_is_no_hot_worker(spark):
    rows = [(7, f"text number {i}", "en", "a", 1) for i in range(4000)] + [(100 + i, f"other {i}", "en", "a", 1) for i in range(1000)] + [(7, "text number 1", "en", "a", 1)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(7, 1)] + [(100 + i, i % 2) for i in range(1000)] + [(10**6 + i, 0) for i in range(5000)], "doc_id long, toxic int")
    for most, least in ((400, 400), (10**5, 5000)):
        found = T.training_rows(docs, labels, "toxic", F.lit(True), most)
        workers = found.groupBy(F.pmod(F.xxhash64("doc_id", "stamp"), F.lit(T.WORKERS)).alias("w")).count().collect()
        assert sum(w["count"] for w in workers) == least and max(w["count"] for w in workers) < 2 * least / T.WORKERS
