import random
import re
from itertools import combinations

import numpy as np

from strandwell.llm import jaccard_join as J
from strandwell.llm.components import components
from strandwell.llm.shingles import set_keys, shingle_sets


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Least doc_id of each row's class and its number of links, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        union = len(sets[a] | sets[b])
        if (not union) or 5 * len(sets[a] & sets[b]) >= 4 * union:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = find(k)
        known = least.get(root)
        least[root] = i if known is None else known if i is None else min(known, i)
    return ordered((rows[k][0], least[find(k)], links[k]) for k in range(len(rows)))


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def near(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = " ".join(rng.choice(vocabulary) for _ in range(150))
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    rows += [(100 + i, near(rng, base, rng.randrange(0, 7))) for i in range(90)] + [(300 + i, base) for i in range(40)]
    rows += [(400 + i, base[:200] + " " + " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(40)]
    monkeypatch.setattr(J, "BLOCK", 25)  # several blocks for the large group
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ordered((r["doc_id"], r["class_id"], r["n_links"]) for r in J.similarity_classes(docs).collect())
    assert got == brute(rows)
    kept = sorted(r["doc_id"] for r in J.one_of_each(docs).collect())
    assert kept == sorted({c for _, c, _ in got})


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = J.similarity_classes(odd_docs).collect()
    assert ordered((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute([(i, t) for i, t, *_ in odd_rows])
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t) for i, t in {(i, t) for i, t, *_ in odd_rows if i in (1, 3, 5, 6, 9, 11, 12) or t == "one two three four five six"})
    repeated = spark.createDataFrame([(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (1, "p q r s t u v!")], "doc_id long, text string")
    assert len({t.strip("!") for t in (r["text"] for r in J.one_of_each(repeated).collect())}) == 2 == J.one_of_each(repeated).count()
    assert J.similarity_classes(no_docs).count() == 0 and J.one_of_each(no_docs).count() == 0


def test_dense_and_single_intersections_agree(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    one = J.shared(sets, sets, i, j)
    monkeypatch.setattr(J, "DENSE_PAIRS", 1)
    assert (J.shared(sets, sets, i, j) == one).all()
    assert (J.shared(sets[:20], sets[20:], i[:50] % 20, j[:50] % 20) == [len(np.intersect1d(sets[a], sets[20 + b])) for a, b in zip(i[:50] % 20, j[:50] % 20)]).all()


def test_pruning_bounds():
    least = J.least_matches(0.8)
    assert all(0 < least[n] < 0.8 * n for n in least) and least[J.VALUES] > least[J.STEP]


def test_pairs_in_buckets_equal_pairs_by_bucket(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 255, (12, J.VALUES), dtype=np.uint8)
    values = base[rng.integers(0, 12, 300)]
    values = np.where(rng.random(values.shape) < 0.1, rng.integers(0, 255, values.shape, dtype=np.uint8), values)
    bucket = np.sort(rng.integers(0, 60, 300))
    least = J.least_matches(0.8)
    wanted = set()
    for k in np.unique(bucket):
        at = np.flatnonzero(bucket == k)
        i, j = J.surviving(values[at], values[at], least, True)
        wanted |= set(zip(at[i].tolist(), at[j].tolist(), strict=True))
    for most in (J.PAIRS_AT_ONCE, 7):
        monkeypatch.setattr(J, "PAIRS_AT_ONCE", most)
        i, j = J.surviving_in_buckets(values, bucket, least)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == wanted and len(i) == len(wanted) > 50


def test_chance_meetings_make_no_groups(spark):
    """Texts that share two fifths of their shingles meet in buckets, but don't become candidates."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(60)]
    texts = [" ".join([*common, *(word() for _ in range(45))]) for _ in range(300)]
    sketched = J.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nodes = sketched.select("node", "n_shingles", "bands", "values").cache()
    met = J._dealt(nodes).groupBy("bucket").count().filter("count > 1").count()
    assert met > 5 and J.candidate_edges(nodes, J.least_matches(0.8)).count() == 0


def test_hubs_and_one_hot_doc_id(spark, monkeypatch):
    """Heavy keys take another way through the joins, with the same rows; one doc_id may hold many different texts."""
    import strandwell.llm.common as common

    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(150))
    rows = [(7 if k % 3 else None, near(rng, base, k % 5)) for k in range(40)] + [(20 + k, base) for k in range(30)]
    monkeypatch.setattr(common, "HEAVY", 3)
    monkeypatch.setattr(common, "MOST_HEAVY", 10**6)
    monkeypatch.setattr(J, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered((r["doc_id"], r["class_id"], r["n_links"]) for r in J.similarity_classes(docs).collect()) == brute(rows)


def test_of_equal_rows_the_first_stays(spark):
    text = "p q r s t u v"
    docs = spark.createDataFrame([(1, text, "z"), (1, text, "a"), (1, text, "m"), (2, text, "a"), (3, "other words that stand here now", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["source"]) for r in J.one_of_each(docs).collect()) == [(1, "a"), (3, None)]


def test_shingle_sets_follow_words():
    texts = ["a b c d e f", "A, b; c d E f!", "a b", "", "a b c d e f a b c d e f"]
    values, sizes = zip(*shingle_sets(texts), strict=True)
    keys = set_keys(np.concatenate(values), np.concatenate(sizes))
    assert np.concatenate(sizes).tolist() == [len(shingles(t)) for t in texts]
    assert (keys[0] == keys[1]).all() and (keys[0] != keys[4]).any()


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"{a:03d}", f"{b:03d}") for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220))] + [(f"{k:03d}", f"{k + 1:03d}") for k in range(400, 460)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
