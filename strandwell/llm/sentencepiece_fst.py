"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer.

`compile_model` reads a model file and builds three machines, which `encode` composes with an input:

* The normaliser: the model's character map (the longest rule at a place wins, as its trie says), extra white space, dummy prefix, and
  spaces to U+2581.
* The pieces: one path for each with the negated score as its weight, and a dearer path for a character without a piece, which becomes bytes or
  the unknown piece. In a unigram model they are spelt out from the last character to the first; in a BPE model from the first on, with links from each
  state to that of its longest proper ending, so that one step of a word tells all arcs into the position behind it.
* The filter of neighbours. In a unigram model it gives every pair the weight 0. In a BPE model a segmentation is the one that merging
  makes exactly if each pair of neighbouring pieces, merged alone, stays this pair; it gives all other pairs an infinite weight.

The composition is a lattice over the input's positions; the encoding is its shortest path in the tropical semiring: along an arc, weights of
state, piece and filter are added, and at a position the least sum wins. Arcs into a position are weighed until one is known to win: in a BPE model the
one that the filter leaves finite, as all others are infinite.

The lattice falls apart wherever no piece has the two neighbouring characters side by side, which is so before each word unless a
piece has U+2581 behind another character (checked when compiling); the paths of such parts are remembered in caches of two generations:
when the young one is full it takes the place of the old one, and what is asked for again moves back.

Sums are kept in double precision. The library keeps those of unigram models in single precision over the whole text, so of paths whose
weights are equal to its precision it may take another one.

Defined results: a null or empty text has no ids and decodes to the empty text; a literal U+2581 decodes to a space; repeated
rows stay; no rows give no rows; columns beyond those named are passed on or ignored as each function says. Models with user-defined pieces
are refused.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from strandwell.llm.common import KEPT, slices, tidied, whole_text

SPACE = "▁"
CACHE = 150_000
#: Length up to which the steps of a word's beginning are remembered.
SHARED = 9
#: Bytes of texts whose words are worked out together.
LEARNT = 4 << 20
#: Pairs of neighbours that the filter remembers before it starts anew.
PAIRS = 300_000
# Fixed value: by how much an unknown character is dearer than the dearest piece.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(path: str) -> dict:
    """Pieces (text, score, kind), model type and normaliser settings of a .model file."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, kind, rules = [], UNIGRAM, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
    return {"pieces": pieces, "kind": kind, "prefix": bool(rules.get(3, 1)), "trim": bool(rules.get(4, 1)), "escape": bool(rules.get(5, 1)), "rules": character_map(rules.get(2, b""))}


def character_map(packed: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: what is replaced, and by what.

    The map is the size of a double-array trie, its 32-bit units, and the replacements, each ended by a zero byte. A unit has its label in the
    low 8 bits, a mark for a leaf below it in bit 8, and the offset to its children above; a leaf's unit holds the place of its replacement."""
    if not packed:
        return {}
    size = struct.unpack("<I", packed[:4])[0]
    units, texts = np.frombuffer(packed[4 : 4 + size], dtype="<u4"), packed[4 + size :]
    step = (units >> np.uint32(10)) << ((units & np.uint32(512)) >> np.uint32(6))
    labels = np.arange(1, 256, dtype=np.uint32)
    found: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        at, prefix = todo.pop()
        base = at ^ int(step[at])
        if units[at] >> 8 & 1 and prefix:
            place = int(units[base] & 0x7FFFFFFF)
            found[prefix.decode("utf-8")] = texts[place : texts.index(b"\0", place)].decode("utf-8")
        children = base ^ labels
        inside = children[children < len(units)]
        for child in inside[(units[inside] & np.uint32(0x800000FF)) == (inside ^ np.uint32(base))].tolist():
            todo.append((child, prefix + bytes([child ^ base])))
    return found


class Recent(dict):
    """A cache of what `make` gives, of at most twice `most` entries, that forgets what wasn't asked for lately; longer keys aren't kept."""

    def __init__(self, most: int, make: Callable | None = None):
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None and self.make:
            found = self.make(key)
        if found is not None and len(key) <= 64:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def _rule_finder(rules: dict[str, str]) -> Callable | None:
    """The substitution over a text's rules, the longest at each place; None without any."""
    if not rules:
        return None
    single = {k for k in rules if len(k) == 1}
    parts = []
    by_first: dict[str, list[str]] = {}
    for key in rules:
        if len(key) > 1:
            by_first.setdefault(key[1], []).append(key)
    if by_first:  # longer rules are few places: their second characters are combining marks and the like
        seconds = "".join(map(re.escape, sorted(by_first)))
        longer = "|".join(map(re.escape, sorted((k for k in rules if len(k) > 1), key=lambda k: (-len(k), k))))
        parts.append(f"(?=.[{seconds}])(?:{longer})")
    if single:
        parts.append("[" + "".join(map(re.escape, sorted(single))) + "]")
    return re.compile("|".join(parts), re.DOTALL).sub


class Transducer:
    """The compiled transducer; `encode` composes it with a text and takes the shortest path."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = UNIGRAM, prefix: bool = True, trim: bool = False, escape: bool = True, rules: dict[str, str] | None = None):
        self.kind, self.prefix, self.trim, self.escape = kind, prefix, trim, escape
        self.pieces = pieces
        self.id = {p: k for k, (p, _, t) in enumerate(pieces) if t == NORMAL}
        scores = [s for _, s, t in pieces if t == NORMAL] or [0.0]
        self.weight = {p: -s for p, s, t in pieces if t == NORMAL}
        # An unknown character is dearer than any piece.
        self.unknown_weight = UNKNOWN_PENALTY - min(scores)
        self.byte = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((k for k, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.neighbours = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(t == USER for _, _, t in pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.arcs: dict = {}  # pieces by their characters from the last to the first; "" holds the piece that ends there
        if kind == BPE:
            self._link()
        else:
            for p in self.id:
                node = self.arcs
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p
        self.text = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces
        ]
        splits = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        self.by_space = splits and prefix and escape
        self.rules, self.find_rule = rules or {}, _rule_finder(rules or {})
        self.known = Recent(CACHE)
        self.paths = Recent(CACHE, self.ids_of)
        self.spaced = Recent(CACHE, lambda word: self.word_ids(SPACE + word))
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def _link(self) -> None:
        """States by the beginnings of pieces: `steps` has the next ones by character, `links` that of the longest proper ending which begins a piece, too,
        and `ends` the pieces that end in a state with their lengths, the longest first."""
        steps: list[dict[str, int]] = [{}]
        here: list[str | None] = [None]
        for p in self.id:
            at = 0
            for c in p:
                to = steps[at].get(c)
                if to is None:
                    to = steps[at][c] = len(steps)
                    steps.append({})
                    here.append(None)
                at = to
            here[at] = p
        links, ends = [0] * len(steps), [()] * len(steps)
        todo = list(steps[0].values())
        for at in todo:  # shorter beginnings come before longer ones
            shorter = ends[links[at]]
            ends[at] = ((here[at], len(here[at])), *shorter) if here[at] is not None else shorter
            for c, to in steps[at].items():
                if at:
                    link = links[at]
                    while link and c not in steps[link]:
                        link = links[link]
                    links[to] = steps[link].get(c, 0)
                todo.append(to)
        self.steps, self.links, self.ends = steps, links, ends

    def mapped(self, text: str) -> str:
        """The text after the character map."""
        return self.find_rule(lambda m: self.rules[m.group()], text) if self.find_rule else text

    def spelt(self, text: str) -> str:
        """A mapped text with its white space as the model wants it."""
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = " " + text if self.prefix else text
        text = text.replace(" ", SPACE) if self.escape else text
        return text.rstrip(SPACE if self.escape else " ") if self.trim else text

    def normalise(self, text: str) -> str:
        return self.spelt(self.mapped(text))

    def merged(self, text: str) -> list[str]:
        """The symbols left when neighbours of the best-scored joint piece are merged, leftmost first, until none is a piece."""
        symbols, weight = list(text), self.weight.get
        joint = [weight(a + b, math.inf) for a, b in zip(symbols, symbols[1:])]
        while joint and (best := min(joint)) < math.inf:
            at = joint.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = weight(symbols[at - 1] + symbols[at], math.inf)
            if at < len(joint):
                joint[at] = weight(symbols[at] + symbols[at + 1], math.inf)
        return symbols

    def finite(self, before: str, piece: str) -> bool:
        """The compiled filter: whether a piece may follow another. A pair is worked out when it first comes up."""
        row = self.pairs.get(before)
        if row is None:
            row = self.pairs[before] = {}
        fit = row.get(piece)
        if fit is None:
            if self.n_pairs >= PAIRS:
                for old in self.pairs.values():
                    old.clear()
                self.n_pairs = 0
            if not before or before[-1] + piece[0] not in self.neighbours:  # nothing spans the border
                fit = self.merged(piece) == [piece]
            else:
                fit = self.merged(before + piece) == [before, piece]
            row[piece] = fit
            self.n_pairs += 1
        return fit

    def path(self, word: str) -> list[str]:
        """The shortest path through the lattice of a word: its pieces, and single characters where bytes stand in."""
        last = next(self._lattices([word])) if self.kind == BPE else self._cheapest(word)
        return self._back(last, word)

    def _back(self, last: list[str], word: str) -> list[str]:
        """The pieces of a word by the last piece of the path to each of its positions."""
        out, at = [], len(word)
        while at:
            piece = last[at]
            if not piece:
                raise ValueError(f"no path through {word!r}")
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def _lattices(self, words: Iterable[str]) -> Iterator[list[str]]:
        """For each word the last piece of the path to each position of a BPE model's lattice; the list is the next word's, too.

        Only one path to a position has a finite weight, so its sum needn't be told. It depends on what lies before: the steps that a word shares
        with the one before it stay, so sorted words take few."""
        steps, links, ends, pairs, finite = self.steps, self.links, self.ends, self.pairs, self.finite
        last, rows, states, before = [""], [pairs.setdefault("", {})], [0], ""
        for word in words:
            same = min(len(word), len(before))
            while word[:same] != before[:same]:
                same -= 1
            del last[same + 1 :], rows[same + 1 :], states[same + 1 :]
            at = states[same]
            for c in word[same:]:
                to = steps[at].get(c)
                while to is None and at:
                    at = links[at]
                    to = steps[at].get(c)
                at, taken = to or 0, ""
                for piece, size in ends[at]:
                    fit = rows[-size].get(piece)
                    if finite(last[-size], piece) if fit is None else fit:
                        taken = piece
                        break
                else:
                    if c not in self.id and finite(last[-1], c):
                        taken = c
                last.append(taken)
                row = pairs.get(taken)
                rows.append(pairs.setdefault(taken, {}) if row is None else row)
                states.append(at)
            before = word
            yield last

    def _cheapest(self, word: str) -> list[str]:
        """The last piece of the shortest path to each position of a unigram model's lattice; words with a common beginning share these steps."""
        n, known, weight, ids, arcs = len(word), self.known, self.weight, self.id, self.arcs
        old = known.old
        cost, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for end in range(1, n + 1):
            state = None
            if end <= SHARED:
                prefix = word[:end]
                state = known.get(prefix)
                if state is None and (state := old.get(prefix)) is not None:
                    known[prefix] = state
            if state is None:
                best, taken = math.inf, ""
                if word[end - 1] not in ids:
                    best, taken = cost[end - 1] + self.unknown_weight, word[end - 1]
                # The arcs of pieces that end here, from the shortest on; of equal sums the longest piece's is taken.
                node, start = arcs, end
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        total = cost[start] + weight[piece]
                        if total <= best:
                            best, taken = total, piece
                state = best, taken
                if end <= SHARED:
                    known.put(prefix, state)
            cost[end], last[end] = state
        return last

    def cut(self, text: str) -> list[str]:
        """The text cut wherever no piece has the two characters next to each other, so that no arc spans the place."""
        neighbours, start, out = self.neighbours, 0, []
        for k, pair in enumerate(map(add, text, text[1:]), 1):
            if pair not in neighbours:
                out.append(text[start:k])
                start = k
        out.append(text[start:])
        return out if text else []

    def ids_of(self, word: str) -> bytes:
        return self.numbered(self.path(word))

    def numbered(self, path: list[str]) -> bytes:
        ids = self.id
        try:
            return struct.pack(f"<{len(path)}i", *[ids[p] for p in path])
        except KeyError:  # a character without a piece
            pass
        found: list[int] = []
        lost = False  # the piece before was unknown: neighbouring unknown characters are one piece
        for p in path:
            if p in ids:
                found.append(ids[p])
            elif self.byte:
                found += [self.byte[b] for b in p.encode("utf-8")]
            elif not lost:
                found.append(self.unknown)
            lost = p not in ids
        return struct.pack(f"<{len(found)}i", *found)

    def word_ids(self, word: str) -> bytes:
        """The ids of a normalised text, part by part of the lattice, from the cache where it has them."""
        if not self.byte and self.unknown_in(word):
            return self.ids_of(word)  # unknown characters of two parts may be one piece
        if len(word) <= 64:
            return self.ids_of(word)  # whoever asks remembers it
        parts = self.cut(word)
        return b"".join(map(self.paths.__getitem__, parts))

    def unknown_in(self, word: str) -> bool:
        return any(c not in self.id for c in word)

    def words(self, text: str) -> list[str] | None:
        """The words of a mapped text, if single spaces are all that lies between them: each begins with one U+2581, as the dummy prefix gives one to the first."""
        if not (self.by_space and text) or "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return None
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        """Puts short words that no cache has into it, in sorted order."""
        fresh = [SPACE + w for w in sorted(words.difference(self.spaced, self.spaced.old)) if len(w) < 64]
        for word, last in zip(fresh, self._lattices(fresh)):
            self.spaced.put(word[1:], self.numbered(self._back(last, word)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        mapped = [self.mapped(t) for t in texts]
        cut = [self.words(t) for t in mapped]
        if self.kind == BPE and self.byte:  # else unknown characters of neighbouring parts may be one piece
            self.learn(set().union(*filter(None, cut)))
        find = self.spaced.__getitem__
        return [self.word_ids(self.spelt(t)) if words is None else b"".join(map(find, words)) for t, words in zip(mapped, cut)]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@contextmanager
def calm() -> Iterator[None]:
    """Without the collector of cycles, which would go through the caches again and again; the encoder makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def compile_model(path: str) -> Transducer:
    """The transducer of a model file, compiled once in each Python process."""
    KEPT[__name__] = compile_model.cache_clear
    return Transducer(**read_model(path))


def encode_column(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default doc_id) with n_tokens and ids of each text; kept columns of these two names give way."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("n_tokens", "ids")]
    mark = "_" * (1 + max(map(len, keep), default=0))  # no kept column's name
    rows = docs.select(*keep, whole_text().alias(mark))
    schema = rows.drop(mark).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compile_model(model_path)
        for batch in batches:
            for part in slices(batch, len(keep), LEARNT):
                with calm():
                    packed = fst.encode_all(part.column(len(keep)).to_pylist())
                offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(offsets).astype(np.int64)), ids], [*keep, "n_tokens", "ids"])

    return rows.mapInArrow(tidied(encode), schema)


def decode_column(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of each row of ids; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compile_model(model_path)
        for batch in batches:
            texts = [None if ids is None else fst.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidied(decode), "doc_id long, text string")


DIGESTS = "doc_id long, n_bytes long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """For each row: the number and digest of the ids of its whole text, the digest of the text they decode to, and whether it is the same text."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compile_model(model_path)
        low, high = (min(fst.byte.values()), max(fst.byte.values())) if fst.byte else (1, 0)
        for batch in batches:
            for part in slices(batch, 1, LEARNT):
                texts, rows = part.column(1).to_pylist(), []
                with calm():
                    encoded = fst.encode_all(texts)
                for text, packed in zip(texts, encoded):
                    ids = np.frombuffer(packed, dtype="<i4")
                    back = fst.decode(ids.tolist())
                    in_bytes = int(((ids >= low) & (ids <= high)).sum())
                    raw = back.encode("utf-8")
                    rows.append((len(text.encode("utf-8")), len(ids), in_bytes, hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest(), back == text))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [c.split()[0] for c in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidied(both), DIGESTS)
