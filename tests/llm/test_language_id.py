import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwell.llm import language_id
from strandwell.llm.language_id import END, LONGEST, Grams, Lexicon, counted_grams, grams_of, identify, learn, words_of
from strandwell.llm.queries import op13_language
from tests.llm.conftest import SCHEMA

ENGLISH = "the quick brown fox jumps over the lazy dog and then walks through the morning with nothing else to think about".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den morgen ohne an etwas anderes zu denken".split()


def corpus(n=200, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(ENGLISH if i % 2 else GERMAN, k=rng.randrange(3, 30))), "en" if i % 2 else "de", "s", 1) for i in range(n)]


def plain(rows, text, most):
    """The prediction by the definition: (lang, score)."""
    kinds = [dict() for _ in range(LONGEST + 1)]
    langs = Counter()
    for _, t, lang, *_ in rows:
        for word in words_of(t or ""):
            langs[lang] += 1
            kinds[0].setdefault(lang, Counter())[word] += 1
            for gram in grams_of(word):
                kinds[len(gram)].setdefault(lang, Counter())[gram] += 1
    order = sorted(langs, key=lambda x: (-langs[x], x))
    kept = []
    for counts in kinds:
        keep = set()
        for found in counts.values():
            least = min((n for n in found.values() if sum(m >= n for m in found.values()) <= most), default=math.inf)
            keep |= {e for e, n in found.items() if n >= least}
        kept.append(keep)
    log = lambda kind, lang, e: math.log(kinds[kind][lang][e] + 0.5) - math.log(1 + sum(kinds[kind][lang].values()) + 0.5 * len(kinds[kind][lang]))
    total = dict.fromkeys(order, 0.0)
    for word in words_of(text):
        if word in kept[0]:
            for lang in order:
                total[lang] += log(0, lang, word)
            continue
        marked, used = f"{END}{word}{END}", []
        for i in range(len(marked) - 1):
            n = next((n for n in range(LONGEST, 0, -1) if i + n <= len(marked) and marked[i : i + n] in kept[n]), 0)
            used += [marked[i : i + n]] * bool(n)
        for lang in order if used else []:
            total[lang] += sum(log(len(g), lang, g) for g in used) / len(used)
    best = max(order, key=lambda x: total[x])
    return best, 1 / sum(math.exp(total[x] - total[best]) for x in order)


@pytest.mark.parametrize("most", [20_000, 12])
def test_equals_the_definition(spark, most):
    rows = corpus()
    texts = ["the dog", "der hund", "unbekannte wörter", "unknown thinking", "zzz qqq", "漢字かな", "Thé DOG", "x"]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, F.lit(True), most).collect()}
    for i, text in enumerate(texts):
        lang, score = plain(rows, text, most)
        assert got[1000 + i][0] == lang and got[1000 + i][1] == pytest.approx(score, rel=1e-9)


def test_words_first_then_shorter_grams():
    scores = [[-1.0, -5.0], [-6.0, -2.0], [-4.0, -3.0]]
    import numpy as np

    model = Lexicon(["a", "b"], {"dog": 0}, Grams.of({"dog": 1, "g": 2}), np.array(scores))
    assert model.predict(["dog dog"])[0][0] == "a"
    assert model.unknown(["dogg", "xy"])[0].tolist() == pytest.approx([(-6.0 - 4.0 - 4.0) / 3, (-2.0 - 3.0 - 3.0) / 3]) and not model.unknown(["xy"]).any()
    assert model.predict(["dogs"])[0][0] == "b"
    assert model.predict(["xyz"]) == [("a", 0.5)]


def test_counted_grams():
    import numpy as np

    words, counts = ["ab", "a", "漢字", "abba", "ab😀c"], [2, 3, 1, 5, 1]
    want = Counter()
    for w, n in zip(words, counts, strict=True):
        for g in grams_of(w):
            want[g] += n
    assert dict(counted_grams(words, np.array(counts))) == want and counted_grams([], np.zeros(0, dtype=int)) == []


def test_texts_together_and_alone():
    import numpy as np

    texts = [" ".join(random.Random(k).choices(["dog", "g", "gdog", "ggg", "dodo", "xgx", "ogdog"], k=6)) for k in range(40)] + [None, "", "..."]
    model = Lexicon(["a", "b"], {"dog": 0}, Grams.of({"dog": 1, "g": 2}), np.random.default_rng(3).random((3, 2)))
    assert model.predict(texts) == [model.predict([t])[0] for t in texts] and model.predict([]) == []


def test_without_letters_or_learning(spark, odd_docs, no_docs, odd_rows):
    got = {r.doc_id: r for r in identify(odd_docs, F.lit(True)).filter("doc_id is not null").collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[4].score == 0
    assert got[5].lang_pred in ("en", "de", "fr") and 0 <= got[6].score <= 1
    assert identify(odd_docs, F.lit(True)).count() == len(odd_rows) and identify(no_docs, F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify(odd_docs, F.lit(False)).collect()} == {"und"}


def test_long_words_are_cut_and_forms_agree(spark):
    assert [len(w) for w in words_of("x" * 70)] == [32, 32, 6]
    assert words_of("État") == words_of("état") == ["état"] and words_of("1 2 _ ٣") == []


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(400)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    # What may not be learnt is labelled wrongly.
    docs = spark.createDataFrame([(i, t, "wrong" if h else lang, s, n) for (i, t, lang, s, n), h in zip(rows, held, strict=True)], SCHEMA)
    model = learn(docs.filter(~op13_language.held_out()))
    assert sorted(model.langs) == ["de", "en"]


def test_tables_of_many_languages_stay_small(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_CELLS", 240)
    model = learn(spark.createDataFrame(corpus(), SCHEMA))
    assert model.scores.size <= 240 and model.predict(["der hund"])[0][0] == "de"


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op13_language.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 100 and row.a > 0.97
