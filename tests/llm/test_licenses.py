import random
import re

from strandwell.llm import license_scan as L


def brute(rows, templates, threshold):
    """doc, template of every text with a window that holds enough of the template's shingles."""
    found = set()
    for number, (group, text) in enumerate((g, templates[k][1]) for g in L.plan(templates, threshold) for k in g.numbers):
        w = L.template_words(text)
        wanted = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        name = [k for g in L.plan(templates, threshold) for k in g.numbers][number]
        for doc, body in rows:
            words = re.findall(r"\w+", (body or "").lower())
            s = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
            best = max((len(wanted & set(s[a : a + group.window])) for a in range(0, len(s), group.step)), default=0)
            if best >= L.needed(len(wanted), threshold):
                found.add((doc, name, best))
    return found


def test_equals_brute_force(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice(["lorem", "license", "software", "ipsum", "the", "of", "conditions"]) for _ in range(n))
    rows = []
    for k in range(120):
        body = rng.choice(L.TEMPLATES)[1].split()
        for _ in range(rng.randrange(0, 4)):
            body[rng.randrange(len(body))] = "changed"
        rows.append((k, f"{filler(rng.randrange(0, 60))} {' '.join(body)} {filler(rng.randrange(0, 60))}"))
    rows += [(200 + k, filler(100)) for k in range(20)]
    got = {(r["doc_id"], r["template"], r["held"]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, L.TEMPLATES, L.THRESHOLD) and len(got) > 60


def test_cover_words_lose_nothing():
    words = L.cover_words()
    for _, text in L.TEMPLATES:
        w = L.template_words(text)
        shingles = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        left = [s for s in shingles if not any(c in x for c in words for x in s)]
        assert len(left) < L.needed(len(shingles), L.THRESHOLD)


def test_bands_reach_the_certainty():
    for group in L.plan():
        for k in group.numbers:
            n = len({tuple(w[i : i + 5]) for w in [L.template_words(L.TEMPLATES[k][1])] for i in range(len(w) - 4)})
            need = L.needed(n, L.THRESHOLD)
            assert 1 - (1 - need / (group.window + n - need)) ** group.bands >= L.CERTAINTY - 1e-12
            assert group.window >= n


def test_odd_rows(odd_docs, no_docs):
    rows = L.scan(odd_docs).collect()
    assert [(r["doc_id"], r["license"], r["held"]) for r in rows] == [(12, "MIT", 1)]
    assert L.scan(no_docs).count() == 0


def test_statements_shorter_than_a_shingle(spark):
    rows = [(1, "All rights reserved."), (2, "Some words before. ALL RIGHTS\nRESERVED, all rights reserved"), (3, "overall rights reserved"), (4, "all rights are reserved"), (5, "all rights reservedly"), (None, "(c) all rights reserved"), (6, None)]
    got = {(r["doc_id"], r["license"], r["first_word"], r["held"], r["template_shingles"]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, "All-rights-reserved", at, 1, 1) for i, at in ((1, 0), (2, 3), (None, 1))}
    only = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), L.STATEMENTS)
    assert only.count() == 3


def test_every_licence_is_found(spark):
    known = L.TEMPLATES + L.STATEMENTS
    assert {"ISC", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "Unlicense", "BSD-3-Clause"} <= {g for g, _ in known}
    got = {(r["doc_id"], r["template"]) for r in L.scan(spark.createDataFrame([(k, f"x {t} y") for k, (_, t) in enumerate(known)], "doc_id long, text string")).collect()}
    assert {(k, k) for k in range(len(known))} <= got
