import re
from collections import Counter
from itertools import combinations

import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandwell.llm import quality_rff as R
from strandwell.llm import toxicity_fm as T
from strandwell.llm.tokenizer_files import tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_equal_a_plain_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    states = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, states[-1], sf).write.parquet(f"{tmp_path}/{k}")
        states.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in states[:-1])
    rows = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in states[:-1]]

    # Quality and toxicity: the scores of the fitted models, text by text.
    import numpy as np

    model = R.learn(docs, labels, F.lit(True))
    assert set(rows[1]) == {i for i, t in rows[0].items() if model.score(np.array([R.statistics(t)]))[0] >= 0.5}
    toxic = T.fit(states[1], labels, "toxic", F.lit(True), 30_000, 4096)
    look = T.Lookup(toxic.index)
    assert set(rows[2]) == {i for i, t in rows[1].items() if toxic.score([look.terms(t)])[0] < 0.3}

    # Near copies: all pairs.
    sets = {i: shingles(t) for i, t in rows[2].items()}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert set(rows[3]) == {find(i) for i in sets}

    # Mixture: copies of a source's documents come near its share.
    copies = Counter(r["doc_id"] for r in states[4].select("doc_id").collect())
    size = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in states[3].select("doc_id", "source", "text").collect()}
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 2
    total = sum(n for _, n in size.values())
    largest = max(n for _, n in size.values())
    sources = len({s for s, _ in size.values()})
    assert abs(sum(copies[i] * size[i][1] for i in size) - 1.5 * total) <= largest * sources

    # Pieces: the library's ids.
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    encoded = states[5].select("doc_id", "ids").collect()
    assert Counter(r["doc_id"] for r in encoded) == copies
    assert all(r["ids"] == library.encode(rows[3][r["doc_id"]]) for r in encoded)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path, odd_labels):
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd_docs.drop("ids"), str(tmp_path)).count() >= 0
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
