import random
import re
from collections import Counter, defaultdict

from strandwell.llm.mixing import mix, mixed_rows, words
from pyspark.sql import functions as F


def fill_by_rounds(sizes, budget, epochs, weights):
    """Clamp and share again until nothing is above its cap."""
    cap = {s: epochs * n for s, n in sizes.items()}
    target, open_ = {}, set(sizes)
    while True:
        left = budget - sum(cap[s] for s in sizes if s not in open_)
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        above = {s for s in open_ if share[s] >= cap[s]}
        if not above:
            return {s: cap[s] for s in sizes if s not in open_} | share
        open_ -= above
        if not open_:
            return cap


def test_targets_equal_rounds_and_taken_meets_them(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice("abcdefgh")) for i in range(800)] + [(900 + i, "z " * rng.randrange(30, 90), "hot") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    wanted = fill_by_rounds(sizes, 1.5 * sum(sizes.values()), 2, weights)
    taken = defaultdict(int)
    for r in found:
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, found))
    copies = Counter(r["doc_id"] for r in mixed_rows(docs).select("doc_id").collect())
    assert all(abs(copies[r["doc_id"]] - r["whole"]) <= (r["taken"] > r["whole"] * r["size"]) for r in found if r["size"])


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in odd_rows)
    assert mix(no_docs).count() == 0 and mixed_rows(no_docs).count() == 0
    repeated = mixed_rows(odd_docs)
    assert repeated.columns == odd_docs.columns
    assert repeated.filter("text IS NULL OR trim(text) = ''").count() >= 3


def test_words(spark):
    got = spark.createDataFrame([("a b",), (" x\x1c y",), (None,), ("",)], "t string").select(words(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [2, 2, 0, 0]
