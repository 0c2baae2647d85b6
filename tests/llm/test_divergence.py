import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwell.llm import source_divergence
from strandwell.llm.queries import op12_divergence
from strandwell.llm.source_divergence import block_records, divergence, share, terms_of
from tests.llm.conftest import SCHEMA

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=10, top=10):
    """The audit as it is defined, term by term."""
    docs = [(r[2] or "", r[3] or "", [lower(t) for t in TERM.findall(r[1] or "")]) for r in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted({s for la, s, _ in docs if la == lang})

        def shares(counter):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 2) // (n + 2 * len(kept)) for t in kept}

        of = {s: shares(count[lang, s]) for s in sources}
        all_of = shares(sum((count[lang, s] for s in sources), Counter()))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(apart(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-apart(of[s][t], all_of[t]), t.encode(), t) for t in kept if count[lang, s][t] and of[s][t] > all_of[t])
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def found(docs, **kw):
    return [tuple(r) for r in divergence(docs, **kw).select("lang", "source", "part", "item", "value", "rank").collect()]


def compare(spark, rows, **kw):
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    assert len(got) == len(set(got)) and set(got) == plain(rows, **kw)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "Él", "漢字", "q-z", "x1y", "ñandú", "zebra", "end.", "ÉL", "a", "B_b"]
    return [(i, " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randrange(0, 40))), rng.choice(["en", "es"]), rng.choice(["a", "b", "c", "é"]), 1) for i in range(n)]


def test_equals_the_definition(spark):
    compare(spark, corpus(400, 0))


def test_hot_source_repeats_and_nulls(spark):
    rows = corpus(150, 1) + [(1, "the the same", "en", "a", 1)] * 150 + [(None, None, None, None, None), (3, "", "en", "lonely", 0), (4, "12 34", "xx", None, 0), (5, "!", "xx", "b", 0)]
    compare(spark, rows)
    compare(spark, rows, least=1, top=2)


def test_many_sources(spark):
    rng = random.Random(2)
    compare(spark, [(i, " ".join(rng.choices("abcdefgh", k=12)), "e\0n" if i % 9 else "e", f"s{rng.randrange(40)}", 1) for i in range(300)], least=3)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = found(odd_docs, least=2)
    assert set(got) == plain(odd_rows, least=2) and found(no_docs) == []


def test_blocks_end_anywhere(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_BYTES", 64)
    compare(spark, corpus(60, 3))


def test_terms_of_texts():
    texts = ["abc", "Def gh", "", "é漢x9Y", "---", "z"]
    terms, lengths = terms_of(pa.array([t.encode() for t in texts], pa.binary()))
    assert [t.decode() for t in terms.to_pylist()] == ["abc", "def", "gh", "é漢x", "y", "z"] and lengths.tolist() == [1, 2, 0, 2, 0, 1]
    terms, lengths = terms_of(pa.array([b"", b"ab", b"", b"cd", b"e f"], pa.binary()))
    assert terms.to_pylist() == [b"ab", b"cd", b"e", b"f"] and lengths.tolist() == [0, 1, 0, 1, 2]
    terms, lengths = terms_of(pa.array([b"ab c", b"x"], pa.binary()).slice(1))
    assert terms.to_pylist() == [b"x"] and lengths.tolist() == [1]
    assert terms_of(pa.array([b""], pa.binary()))[1].tolist() == [0]


def test_records_of_a_block():
    block = pa.RecordBatch.from_arrays([pa.array([b"a b a", b"b", b"a"]), pa.array(["en", "en", "de"]), pa.array(["s", "s", "s"])], ["text", "lang", "source"])
    assert {tuple(r.values()) for r in block_records(block).to_pylist()} == {(b"en\0a", "s", 1, 2), (b"en\0b", "s", 2, 2), (b"de\0a", "s", 1, 1)}


def test_shares_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(c + t)) for c, t in zip(rng.integers(0, 1 << 55, 50), rng.integers(0, 1 << 60, 50), strict=True)] + [(0, 1), (0, 0), (10**15, 10**15 + 3)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r.p == (1 + 1_000_000_000 * (r.c + 2) // r.t if r.t else None) for r in got)


def test_query_equals_its_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(op12_divergence.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in op12_divergence.query(spark, "/root/testdata/sf0.001").select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("name", ["term", "pair"])
def test_both_parts_are_there(spark, name):
    assert any(r[2] == name for r in found(spark.createDataFrame(corpus(100, 5), SCHEMA)))
