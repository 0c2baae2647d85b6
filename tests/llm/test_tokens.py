import json
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandwell.llm import sentencepiece_fst as S
from strandwell.llm import token_counts as C
from strandwell.llm import token_shards as T
from strandwell.llm.tokenizer_files import tokenizer_path


def strange(rng, n, alphabet):
    return ["".join(rng.choice(alphabet) if rng.random() < 0.98 else chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_counts_equal_the_library(spark, odd_docs, odd_rows, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for hot in (C.HOT, 0):  # all frequent pre-tokens broadcast, or none
        got = C.count_tokens(odd_docs, path, hot=hot).collect()
        wanted = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in odd_rows)
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == wanted
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert C.count_tokens(no_docs, path).count() == 0


def test_files_that_cut_otherwise_are_refused(tmp_path):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        said = json.load(file)
    said["model"] = {}
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**said["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**said["added_tokens"][0], "lstrip": True}]}]
    for k, change in enumerate([{}, *changes]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(said | change), encoding="utf-8")
        if change:
            with pytest.raises(ValueError, match="only byte-level"):
                C.special_strings(str(path))
        else:
            assert C.special_strings(str(path)) == ("<|endoftext|>",)
    with pytest.raises(ValueError, match="only byte-level"):
        C.special_strings(tokenizer_path("word_bpe_49k.json"))


def test_pretokens_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    library, cut = Tokenizer.from_file(path), C.cutter(path)
    for text in strange(random.Random(2), 3000, " \n\t\r\x1c\x85\xa0　ab'sSd.,12٣½é漢😀<|>"):
        parts = cut(text + "<|endoftext|> x")
        assert "".join(parts) == text + "<|endoftext|> x"
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in parts) == len(library.encode(text + "<|endoftext|> x", add_special_tokens=False).ids)


def test_pieces_equal_the_library(odd_rows):
    path = tokenizer_path("piece_bpe_32k.model")
    fst, library = S.compile_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = strange(random.Random(4), 4000, "  \n\tabcdeéilnorst.,'▁漢0129") + [t for _, t, *_ in odd_rows if t and len(t) < 10_000]
    for text in texts:
        ids = library.encode(text)
        assert fst.encode(text) == ids, text
        assert fst.decode(ids) == library.decode(ids)


def test_unigram_paths_are_shortest():
    rng = random.Random(6)
    pieces = [("<unk>", 0.0, S.UNKNOWN)] + [(p, -rng.random() * 5, S.NORMAL) for p in ("▁", "a", "b", "ab", "ba", "aba", "bb", "▁a", "▁ab")]
    fst = S.Transducer(pieces, S.UNIGRAM)
    score = {p: s for p, s, _ in pieces}

    def best(text):
        if not text:
            return 0.0
        return max((score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score), default=-1e9)

    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        path = fst.path(fst.normalise(text))
        assert "".join(path) == "▁" + text
        assert abs(sum(score[p] for p in path) - best("▁" + text)) < 1e-9


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _model(pieces, kind, rules, fallback, trim=True):
    """A model file made by hand (nothing is trained), with a public character map."""
    packed = sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto() if rules else b""
    spec = dict(S._fields(dict(S._fields(packed)).get(3, b"")))
    normaliser = _field(1, b"x") + (_field(2, spec[2]) if 2 in spec else b"") + b"\x18\x01" + (b"\x20" + bytes([trim])) + b"\x28\x01"
    out = b"".join(_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t])) for p, s, t in pieces)
    trainer = b"\x18" + bytes([kind]) + _varint(35 << 3) + bytes([fallback])
    return out + _field(2, trainer) + _field(3, normaliser)


@pytest.mark.parametrize("kind", [S.UNIGRAM, S.BPE])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize(("rules", "trim"), [("nmt_nfkc", True), ("nfkc_cf", False), (None, True)])
def test_models_with_character_maps_equal_the_library(tmp_path, kind, fallback, rules, trim):
    rng = random.Random(f"{kind}{fallback}{rules}")
    letters = list("abcdeé▁,fi1") + ["漢"]
    texts = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(150)} | {"▁" + "".join(rng.choice(letters[:6]) for _ in range(3)) for _ in range(60)}
    if kind == S.BPE:  # merges build on each other
        texts = set()
        for _ in range(200):
            known = sorted(texts) + letters
            texts.add(rng.choice(known) + rng.choice(known))
        texts = {t for t in texts if len(t) <= 8}
    body = [(p, -0.37 * k if kind == S.BPE else -rng.random() * 9 - 1, S.NORMAL) for k, p in enumerate(sorted(sorted(texts), key=lambda t: (len(t), rng.random())) + letters)]
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL), *([(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)] if fallback else []), *body]
    with pytest.raises(ValueError, match="user-defined"):
        S.Transducer([*pieces, ("e,e", 0.0, S.USER)], kind)
    path = str(tmp_path / "hand.model")
    with open(path, "wb") as file:
        file.write(_model(pieces, kind, rules, fallback, trim))
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), S.Transducer(**S.read_model(path))
    weight, same = lambda ids: sum(fst.weight.get(pieces[k][0], 0.0) for k in ids), 0
    alphabet = "abcde  é,fi1漢ﬁ①Ａe\u0301㍿\u3000\u00a0\t▁<>zÉß👍"
    for text in [*strange(rng, 1500, alphabet), "e,eab<> e,e", "", " ", "zzz zzz", "  a  b  ", "x" * 300]:
        ids, wanted = fst.encode(text), library.encode(text)
        if kind == S.UNIGRAM and ids != wanted:  # another path of the same weight, to the library's precision
            assert fst.decode(ids) == fst.decode(wanted) and abs(weight(ids) - weight(wanted)) < 1e-4 > weight(ids) - weight(wanted), text
        else:
            assert ids == wanted, (text, fst.normalise(text))
        same += ids == wanted
    assert same > 1450


def test_neighbours_are_remembered_up_to_a_bound(monkeypatch):
    fst = S.Transducer(**S.read_model(tokenizer_path("piece_bpe_32k.model")))
    whole = S.Transducer(**S.read_model(tokenizer_path("piece_bpe_32k.model")))
    monkeypatch.setattr(S, "PAIRS", 50)
    for cache in (fst.known, fst.paths, fst.spaced):
        cache.most = 20
    for text in strange(random.Random(12), 400, "  abcdeéilnorst.,'漢0129"):
        assert fst.encode(text) == whole.encode(text)
        assert fst.n_pairs <= 50 >= sum(map(len, fst.pairs.values())) and len(fst.spaced) + len(fst.spaced.old) <= 40


def test_words_of_a_slice_share_their_beginnings():
    """Steps through the lattice of a common beginning are taken once, and all texts of a slice get the ids that each gets by itself."""
    path = tokenizer_path("piece_bpe_32k.model")
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), S.Transducer(**S.read_model(path))

    class Counted(list):
        taken = 0

        def __getitem__(self, at):
            Counted.taken += 1
            return list.__getitem__(self, at)

    rng = random.Random(5)
    words = ["incontrovertiblenesses" + "".join(rng.choices("abcdeé☃", k=2)) for _ in range(400)]
    texts = ["", " ".join(words), "a  b ", "▁", *words[:20], "x" * 70 + "☃" + "y" * 70, "the of"]
    fst.ends = Counted(fst.ends)
    fst.learn(set(words))
    assert Counted.taken < 24 + 3 * len(set(words))
    assert [np.frombuffer(ids, dtype="<i4").tolist() for ids in fst.encode_all(texts)] == [library.encode(t) for t in texts]


def test_kept_columns_of_the_operators_names_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", 9, 8, 7)], "doc_id long, text string, ids int, n_tokens int, _text int")
    found = S.encode_column(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "ids", "n_tokens", "_text"])
    assert found.columns == ["doc_id", "_text", "n_tokens", "ids"] and found.first()["_text"] == 7 and len(found.first()["ids"]) == found.first()["n_tokens"] > 0


def test_piece_columns(odd_docs, odd_rows, no_docs):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = S.encode_column(odd_docs, path)
    back = S.decode_column(encoded, path).collect()
    assert sorted(r["text"] for r in back) == sorted((t or "").replace("▁", " ") for _, t, *_ in odd_rows)
    trips = S.round_trips(odd_docs, path).collect()
    assert sum(not r["exact"] for r in trips) == sum("▁" in (t or "") for _, t, *_ in odd_rows)
    assert S.encode_column(no_docs, path).count() == 0 == S.round_trips(no_docs, path).count()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(T.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    if n > 500:
        assert T.feistel(np.arange(n), n, 5).tolist() != T.feistel(np.arange(n), n, 6).tolist()


def test_shards_hold_every_token(spark, odd_docs, odd_rows, no_docs):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    tok = T.tokenizer(path)
    layout = T.write_shards(odd_docs, path, 9, length=16, span=20_000)
    rows = T.read_shards(spark, layout, ids=True).collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == list(range(n))
    starts = layout.starts(spark)
    assert len(starts) > 1 and sum(rows for *_, rows in starts) == n
    assert {(r["shard"], r["slot"] - r["offset"] // layout.stride) for r in rows} == {(shard, slot) for shard, slot, _ in starts}
    wanted = sorted((i is None, i or 0, (*tok.encode(t or ""), tok.end)) for i, t, *_ in odd_rows)
    parts = {}
    for r in rows:
        parts.setdefault((r["doc_id"], r["number"]), []).append(tuple(r["ids"]))
    whole = {}
    for (doc, number), ids in sorted(parts.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1])):
        whole.setdefault(doc, []).append(ids)
    assert sorted(x for ids in parts.values() for y in ids for x in y) == sorted(x for *_, ids in wanted for x in ids)
    assert {d for d in whole} == {i for i, *_ in odd_rows}
    single = {d: tuple(x for ids in n for x in ids[0]) for d, n in whole.items() if d not in (1, None)}
    assert single == {i: ids for none, i, ids in wanted if not none and i != 1}
    for begin in (n // 2, n - 1, n):
        later = T.read_shards(spark, layout, first_slot=begin)
        assert sorted(r["slot"] for r in later.collect()) == list(range(begin, n))
        assert len(later.inputFiles()) == sum(slot + rows > begin for _, slot, rows in starts)
    assert T.read_shards(spark, T.write_shards(no_docs, path, 9)).count() == 0


def test_order_does_not_depend_on_splits(spark, sf):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = T.read_shards(spark, T.write_shards(docs, path, 3)).select("slot", "doc_id", "number", "ids_crc32")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        two = T.read_shards(spark, T.write_shards(spark.read.parquet(f"{sf}/documents.parquet"), path, 3, span=100)).select("slot", "doc_id", "number", "ids_crc32")
        assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one.filter(F.col("slot") < 0).count() == 0


def test_another_operator_frees_the_encoder(spark):
    """A worker that goes on to another operator no longer holds the encoder and its caches."""
    from pyspark.sql import functions as F

    from strandwell.llm import common, toxicity_fm
    from strandwell.llm.sentencepiece_fst import encode_column
    from strandwell.llm.tokenizer_files import tokenizer_path

    docs = spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))

    def held(batches):
        from strandwell.llm.sentencepiece_fst import compile_model

        for batch in batches:
            yield batch.set_column(0, "doc_id", common.pa.array([compile_model.cache_info().currsize] * batch.num_rows, common.pa.int64()))

    assert encode_column(docs, tokenizer_path("piece_bpe_32k.model")).count() == 40
    encode_column(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    held.__module__ = toxicity_fm.__name__
    assert {r["doc_id"] for r in docs.mapInArrow(common.tidied(held), docs.schema).collect()} == {0}
