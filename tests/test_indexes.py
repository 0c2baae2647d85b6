"""Stored indexes: what is built, found again, rebuilt and audited, and that their answers equal a scan's."""

import glob
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwell.functions.text import accentless, strip_accents, tokens
from strandwell.operators import lexical as L
from strandwell.operators import postings as P
from strandwell.plans.indexes import index_trigrams
from strandwell.plans.lexical import bm25_or, word_index
from strandwell.sources import store


@pytest.fixture
def home(spark, tmp_path):
    spark.conf.set("spark.strandwell.index.dir", str(tmp_path / "indexes"))
    yield tmp_path
    spark.conf.unset("spark.strandwell.index.dir")


def documents(spark, folder, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "onti", "reat", "Ä", "de", "la", "la"]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(n)] + ["", None, "la la la la", "lalala"]


def test_changed_sources_give_new_answers(spark, home):
    sf = documents(spark, home, ["onti erti", "reat", "onti onti"])
    assert {r["doc_id"] for r in bm25_or(spark, sf).collect()} == {0, 1, 2}
    documents(spark, home, ["nothing", "erti"])
    assert {r["doc_id"] for r in bm25_or(spark, sf).collect()} == {1}


def test_an_index_is_built_once(spark, home):
    sf = documents(spark, home, corpus(20))
    path = word_index(spark, sf)
    other = spark.newSession()
    other.conf.set("spark.strandwell.index.dir", spark.conf.get("spark.strandwell.index.dir"))
    source = [f"{sf}/documents.parquet"]

    def never(*_):
        raise AssertionError("built twice")

    assert store.stored(other, "documents", source, {"fields": ["text"], "form": "documents"}, never) == path
    with pytest.raises(AssertionError):
        store.stored(other, "documents", source, {"fields": ["text"], "form": "other"}, never)
    # A build that failed leaves nothing behind.
    assert glob.glob(f"{os.path.dirname(path)}/*") == [path] and not glob.glob(f"{os.path.dirname(path)}/.began*")
    documents(spark, home, ["new"])
    again = word_index(spark, sf)
    assert again != path and store.expire(spark, again) == [path] and os.path.exists(again) and not os.path.exists(path)


def test_damage_is_found(spark, home):
    sf = documents(spark, home, corpus(40))
    path = word_index(spark, sf)
    assert store.violations(spark, path).count() == 0
    files = sorted(glob.glob(f"{path}/postings/*/*.parquet"))
    table = spark.read.parquet(files[1])
    name = os.path.basename(files[1])
    os.remove(files[0])
    table.limit(0 if table.count() == 1 else table.count() - 1).coalesce(1).write.parquet(f"{home}/less")
    os.replace(glob.glob(f"{home}/less/*.parquet")[0], files[1])
    crc = os.path.join(os.path.dirname(files[1]), f".{name}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    spark.read.parquet(f"{path}/totals").withColumn("n_docs", F.col("n_docs") + 1).coalesce(1).write.parquet(f"{home}/totals")
    os.replace(glob.glob(f"{home}/totals/*.parquet")[0], f"{path}/totals/part-new.parquet")
    documents(spark, home, ["changed"])
    codes = {(r["part"].split("/")[-1], r["code"]) for r in store.violations(spark, path).collect()}
    assert (os.path.basename(files[0]), "MISSING") in codes and ("part-new.parquet", "UNKNOWN") in codes and ("sources", "STALE") in codes
    assert codes & {(name, "ROWS"), (name, "MISSING")}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_positions_equal_a_scan(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(corpus(300, 1))), "doc_id long, text string")
    index = L.indexed(table, "doc_id", {"text": F.col("text")})
    L.write_postings(index, ["text"], str(tmp_path / "p"))
    phrases = [(1, ["of", "the"]), (2, ["la", "la"]), (3, ["de", "la", "reat"]), (4, ["nowhere"]), (5, ["ä"]), (6, ["the", "nowhere"])]
    scan = L.phrase_counts(table, "doc_id", F.col("text"), spark.createDataFrame(phrases, "query_id int, words array<string>"))
    got = P.phrase_counts(spark, str(tmp_path / "p"), phrases)
    assert rows(got.select("query_id", "uid", "f", "len")) == rows(scan.select("query_id", "uid", "f", "len"))
    assert got.count() > 100
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "In(term" in plan


def test_trigrams_equal_a_scan(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame(list(enumerate(corpus(300, 2))), "doc_id long, text string")
    texts = table.select(F.col("doc_id").alias("uid"), accentless(F.col("text")).alias("text"))
    P.write(P.trigram_postings(texts), texts.agg(F.count("*").alias("n_docs"), F.lit(1.0).alias("avgdl")), ["text"], str(tmp_path / "t"), 1)
    needles = [(1, "onti"), (2, "the of"), (3, "lala"), (4, "xyz"), (5, "a l"), (6, "reat onti of"), (7, "la"), (8, "la la")]
    scan = rows(L.trigram_counts(table, "doc_id", F.col("text"), spark.createDataFrame(needles, "query_id int, needle string")).select("query_id", "uid", "f", "len"))
    assert rows(P.substring_counts(spark, str(tmp_path / "t"), needles)) == scan and len(scan) > 100
    monkeypatch.setattr(P, "MOST_CANDIDATES", 1)
    assert rows(P.substring_counts(spark, str(tmp_path / "t"), needles)) == scan
    terms = [(1, "onti zebra"), (2, "the reat"), (3, "la la")]
    want = rows(L.substring_terms(table, "doc_id", F.col("text"), spark.createDataFrame(terms, "query_id int, needle string")))
    assert rows(P.substring_terms(spark, str(tmp_path / "t"), terms)) == want
    assert P.substring_counts(spark, str(tmp_path / "t"), [(1, "qqq")]).count() == 0


def test_a_cover_holds_every_character():
    for needle in ("abc", "abcd", "abcdefgh", "abcdefghijk"):
        for rare in range(len(needle) - 2):
            df = {needle[i : i + 3]: 1 if i == rare else 9 for i in range(len(needle) - 2)}
            found = P.cover(needle, df)
            assert {k + i for i, _ in found for k in range(3)} == set(range(len(needle))) and rare in dict(found)


def test_fields_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 5)
    index = spark.createDataFrame([(1, ["a", "b", "a"], ["b"]), (2, None, ["a"]), (None, [], []), (3, ["b"] * 9, None)], "uid long, x array<string>, y array<string>")
    got = {(r["term"], r["uid"]): (r["len"], r["n_x"], r["n_y"], r["p_x"], r["p_y"]) for r in P.word_postings(index, ["x", "y"]).collect()}
    assert got == {("a", 1): (4, 2, 0, [0, 2], []), ("b", 1): (4, 1, 1, [1], [0]), ("a", 2): (1, 0, 1, [], [0]), ("b", 3): (9, 9, 0, list(range(9)), [])}


def test_empty_tables(spark, tmp_path):
    index = spark.createDataFrame([], "uid long, text array<string>")
    L.write_postings(index, ["text"], str(tmp_path / "p"))
    assert L.indexed_scores(spark, str(tmp_path / "p"), [L.TextQuery(1, ("a",))], {"text": 1.0}).count() == 0
    assert P.phrase_counts(spark, str(tmp_path / "p"), [(1, ["a", "b"])]).count() == 0


def test_partitions_follow_the_source():
    assert P.buckets_for(0) == (16, 1) and P.buckets_for(10 << 30) == (160, 1)
    buckets, files = P.buckets_for(100 << 40)
    assert buckets == P.MOST and buckets * files * P.PART_BYTES >= 100 << 40


def test_a_term_that_is_everywhere_is_dealt_over_tasks(spark, tmp_path):
    """Postings of one term are written by several tasks where they are many, and found whole; the average length is as counted from the rows."""
    index = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("uid"), F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 3).cast("string")), F.lit("the")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        L.write_postings(index, ["text"], str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    found = P.read(spark, str(tmp_path / "p"), ["the"])
    assert found.count() == 60_000 and found.filter("n_text = 2 AND p_text = array(0, 2)").count() == 60_000
    assert found.select("_metadata.file_path").distinct().count() > 1
    assert P.frequencies(spark, str(tmp_path / "p"), ["the", "w1", "none"]) == {"the": 60_000, "w1": 20_000}
    totals = P.totals_of(spark, str(tmp_path / "p"))
    assert (totals["n_docs"], totals["avgdl"]) == tuple(L.lengths(index, ["text"]).first())


def test_a_block_sends_a_row_for_each_term(spark, home):
    """What is shuffled and written are rows of terms, not of postings; manifests count the postings, and each is found."""
    sf = documents(spark, home, ["la onti la", "onti", None, "la onti reat"] * 500)
    path = word_index(spark, sf)
    stored, told = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/manifest")
    blocks = spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()
    assert stored.count() <= 3 * blocks and told.filter("part LIKE 'postings/%'").agg(F.sum("rows")).first()[0] == 3000
    assert P.frequencies(spark, path, ["la", "onti", "reat"]) == {"la": 1000, "onti": 1500, "reat": 500}
    found = {r["uid"]: (r["len"], r["n_text"], r["p_text"]) for r in P.read(spark, path, ["la"]).collect()}
    assert len(found) == 1000 and found[0] == (3, 2, [0, 2]) and found[1999] == (3, 1, [0])
    assert P.read(spark, path, ["la"], ["uid"]).columns == ["term", "uid"]


def test_a_block_of_many_terms(spark):
    """More terms than two bytes can number, in two fields of three rows."""
    words = F.transform(F.sequence(F.lit(0), F.lit(70_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    index = spark.range(0, 3, 1, 1).select(F.col("id").alias("uid"), words.alias("x"), F.reverse(words).alias("y"))
    packed = P.packed_words(index, ["x", "y"])
    assert packed.count() == 70_001 and packed.filter("entries <> 3 OR tokens <> 6 OR uid <> array(0L, 1L, 2L)").count() == 0
    place = F.substring("term", 2, 9).cast("int")
    right = (F.col("p_x") == F.array(place)) & (F.col("p_y") == F.array(70_000 - place)) & (F.col("len") == 140_002)
    assert P.word_postings(index, ["x", "y"]).filter(right).count() == 210_003


def test_a_block_spans_batches(spark, monkeypatch):
    """A term of a block is one row, in however many batches the block's rows came; a block ends by its terms, and rows are sent in parts."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = spark.range(0, 100, 1, 1).select(F.col("id").alias("uid"), F.when(F.col("id") % 10 != 3, F.lit("onti de la la")).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = P.packed_words(L.indexed(texts, "uid", {"text": F.col("text")}), ["text"])
        assert sorted(map(tuple, words.select("term", "entries", "tokens").collect())) == [("de", 90, 90), ("la", 90, 180), ("onti", 90, 90)]
        assert {r["term"]: r["entries"] for r in P.trigram_postings(texts).select("term", "entries").collect()}["ont"] == 90
        monkeypatch.setattr(P, "BLOCK", 40)
        monkeypatch.setattr(P, "SENT", 2)
        cut = P.packed_words(L.indexed(texts, "uid", {"text": F.col("text")}), ["text"])
        assert cut.count() == 30 and cut.filter("tokens > 20").count() == 0 and cut.agg(F.sum("tokens")).first()[0] == 360
        assert rows(P.unpacked(cut)) == rows(P.unpacked(words)) and P.unpacked(cut).count() == 270
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_texts_are_cut_as_by_the_expression_for_words(spark, monkeypatch):
    """Words of a table of texts, many texts in one pass: marks, digits of any script, letters beyond two bytes, ends of texts, lone and null texts."""
    texts = ["Ab́c x_1 \U0001d400b ßİ Ⅰ² a\nb", "", None, "end", "start \U0001f600 日本 語-x", "   ", "É", "-", "la" * 40, None, "กำ ٣٤ ª�͸z"]
    table = spark.createDataFrame([(i, t, t if i % 2 else "la la") for i, t in enumerate(texts)], "uid long, x string, y string").coalesce(1)
    want = rows(P.word_postings(L.indexed(table, "uid", {"x": F.col("x"), "y": F.col("y")}), ["x", "y"]))
    for cut in (P.CUT, 1):
        monkeypatch.setattr(P, "CUT", cut)
        packed = P.packed_texts(table, ["x", "y"])
        assert rows(P.unpacked(packed)) == want and len(want) == 25 and packed.filter("term = 'la' AND entries = 6").count() == 1
    assert P.packed_texts(table.limit(0), ["x", "y"]).count() == 0


def test_every_letter_is_known(spark):
    """The letters of words are those of the expression, over all code points; texts of one byte a character keep what folding would leave."""
    letters = np.unpackbits(P.word_letters(spark)).astype(bool)
    some = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c,) for c in some], "c string").select("c", F.size(tokens(F.col("c"))).alias("n"), accentless(F.col("c")).alias("a"), strip_accents(F.lower("c")).alias("b")).collect()
    assert len(letters) == 0x110000 and all(letters[ord(r["c"])] == (r["n"] == 1) and r["a"] == r["b"] for r in found if len(r["c"].lower()) == 1)


def folded(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "uid long, text string").coalesce(1)


def test_trigrams_are_stored_in_little_room(spark, tmp_path):
    """A posting is a byte or two, and none is shuffled; a block's ids and lengths are told once. Before, these had 2.4 bytes each and were shuffled besides."""
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(2000)]
    texts = folded(spark, [" ".join(rng.choices(words, k=300)) for _ in range(600)])
    postings = P.trigram_postings(texts)
    path = str(tmp_path / "t")
    P.write(postings, texts.agg(F.count("*").alias("n_docs")), ["text"], path, 1 << 30)
    stored = sum(os.path.getsize(f) for f in glob.glob(f"{path}/postings/*/*.parquet"))
    n = spark.read.parquet(f"{path}/terms").agg(F.sum("n")).first()[0]
    assert n == texts.agg(F.sum(F.length("text") - 2)).first()[0] and stored < 2.2 * n
    laid, buckets = P._laid(postings, 100 << 30)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" in plan and buckets == P.FEWEST
    about = spark.read.parquet(f"{path}/postings").filter("term = ''")
    assert about.agg(F.sum(F.size("uid"))).first()[0] == 600 and about.filter("entries <> 0 OR places IS NOT NULL").count() == 0


def test_substrings_meet_in_blocks(spark, tmp_path, monkeypatch):
    """Needles don't lead from one text into the next, overlap as they do in a text, and rows of a uid are told apart; in one block and in many."""
    texts = ["abc", "def", None, "abcdef", "", "ab", "cdefab", "aaaaaaa", "x" + "é" * 5 + "\U0001d400bc", "aaaa"]
    table = spark.createDataFrame([(None if i in (1, 4) else i % 9, t) for i, t in enumerate(texts)], "uid long, text string").coalesce(1)
    needles = [(7, "abcdef"), (2, "def"), (3, "aaa"), (4, "éé\U0001d400bc"), (5, "fab"), (6, "efabcd"), (8, "éééé")]
    want = {(7, 3, 1, 4), (2, None, 1, 1), (2, 3, 1, 4), (2, 6, 1, 4), (3, 7, 2, 5), (3, 0, 1, 2), (4, 8, 1, 7), (5, 6, 1, 4), (8, 8, 1, 7)}
    for grams in (P.GRAMS, 5, 1):
        monkeypatch.setattr(P, "GRAMS", grams)
        path = str(tmp_path / str(grams))
        P.write(P.trigram_postings(table), table.agg(F.count("*").alias("n_docs")), ["text"], path, 1)
        got = [tuple(r) for r in P.substring_counts(spark, path, needles).collect()]
        assert set(got) == want and len(got) == len(want)
        held = spark.read.parquet(f"{path}/postings").filter("term <> ''")
        assert held.agg(F.sum("entries"), F.sum("tokens")).first() == (17, 24) and (held.select("block").distinct().count() > 1) == (grams < 100)


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 1 << 14, (1 << 21) - 1, 1 << 21, 1 << 28, 2**31 - 1, 5])
    packed, ends = P._shortened(values)
    assert (P._lengthened(packed.tobytes()) == np.cumsum(values)).all() and ends.tolist() == [1, 2, 3, 5, 8, 11, 15, 20, 25, 26]
    some = np.random.default_rng(1).integers(0, 1 << 40, 1000)
    assert (np.diff(some[P._sorted(some)]) >= 0).all() and P._sorted(np.array([2, 1, 2, 1])).tolist() == [1, 3, 0, 2]


def test_long_lists_of_terms_find_their_pages(spark, tmp_path):
    """Of a request with many terms, as substring_topk has, each is looked up by itself: by its first and last term alone, nearly every page would be read."""
    words = [chr(97 + i % 26) * 2 + chr(97 + i // 26) for i in range(300)]
    table = spark.createDataFrame([(i, " ".join(words)) for i in range(40)], "uid long, text string").coalesce(1)
    path = str(tmp_path / "t")
    P.write(P.trigram_postings(table), table.agg(F.count("*").alias("n_docs")), ["text"], path, 1)
    terms = sorted(words)[::20]
    found = P._of_terms(spark, path, "postings", terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    lists = [part.split("]")[0].split(",") for part in pushed.split("In(term, [")[1:]]
    assert len(terms) > 10 and lists and max(map(len, lists)) <= 10 and {t.strip() for some in lists for t in some} == set(terms)
    assert {r["term"]: r["entries"] for r in found.collect()} == dict.fromkeys(terms, 40) and P._of_terms(spark, path, "postings", []).count() == 0


def test_a_build_of_trigrams_shuffles_less_than_it_reads(spark, home):
    """index_trigrams needs the room of its files: what it shuffles are counts. Odd texts count as in the SQL."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=250)) for _ in range(800)] + [None, "", "ab", "abc", "ÀÉÔ", "\U0001d400" * 4, "aaaa"]
    sf = documents(spark, home, texts)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    got = {r["part"]: (r["rows"], r["bad"]) for r in index_trigrams(spark, sf).collect()}
    shuffled = sent() - before
    plain = ["".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c)) for t in texts[:-2]] + ["\U0001d400" * 4, "aaaa"]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in plain]
    assert got == {"postings": (sum(map(len, grams)), 0), "terms": (len(set().union(*grams)), 0), "totals": (1, 0)}
    assert 0 < shuffled < sum(len(t or "") for t in texts)
