"""Language identification: words first, character n-grams where a word is unknown.

Learning counts every word of every labelled text by language, and the n-grams (1 to 4 letters, word ends marked) of these words as
often as the words stand there. Of each language the most frequent words and the most frequent n-grams of each length enter the lexicon; an entry
that one language has is scored for all, as the logarithm of its smoothed relative frequency among words, or n-grams of that length, of a language.

A text adds up the scores of its words. A known word counts with its own log frequency. An unknown one is walked letter by letter: at each
letter the longest known n-gram that begins there counts, shorter ones only where the longer are unknown, and the word gets the mean over its
letters, so that an unknown word weighs about as much as a known one. The language of the largest sum is predicted; the score is
its share when all languages start even.

N-grams are looked up as numbers: each letter of the lexicon has a number of 16 bits, so four make a long. N-grams with letters beyond the first
65,534 of the lexicon, in order of code points, are left out.

Words are runs of Unicode letters with their marks, in normal form C and lower case, cut every MOST_LETTERS letters, so a text without spaces has
words too. The size of the lexicon is a parameter: at most `most` entries for each language and kind (words, and each n-gram length); less where
there are so many languages that the table of scores would pass MOST_CELLS. Which entries are kept follows from counts over all
labelled texts. Entries of equal count at the end of a list are left out together. The lexicon is what is broadcast and what the driver sees.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learnt; rows whose lang is null
or without doc_id are never learnt from and are predicted like others; repeated rows count as often as they stand there; a lang that is an
empty string is a language; ties go to the language with more words, then the smaller name; a text of which nothing is known gets the language
with the most words; no rows give no rows. Columns beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.llm.common import materialise, tidied

LONGEST = 4
MOST_LETTERS = 32
MOST = 20_000
MOST_CELLS = 16_000_000
#: Added to every count of an entry.
SMOOTH = 0.5
#: Entries that a task counts before it sends them on.
HELD = 300_000
END = " "
UNDETERMINED = "und"

COUNTS = "lang string, entry string, n long"
WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{MOST_LETTERS - 1}}}")
#: Of ASCII only letters are in words.
LETTERS = bytes(c | 32 if chr(c).isalpha() and c < 128 else 32 for c in range(256))
LETTER_BITS = 16


def words_of(text: str) -> list[str]:
    if text.isascii():
        words = text.encode().translate(LETTERS).decode().split()
        if max(map(len, words), default=0) <= MOST_LETTERS:
            return words
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


def grams_of(word: str) -> list[str]:
    """The n-grams of all lengths up to LONGEST, the word's ends marked."""
    marked = f"{END}{word}{END}"
    return [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1) if n > 1 or marked[i] != END]


def marked_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words with their ends marked, and the word that each belongs to."""
    points = np.frombuffer("".join([f"{END}{w}{END}" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    return points, np.repeat(np.arange(len(words)), sizes)


def counted_grams(words: list[str], counts: np.ndarray) -> list[tuple[str, int]]:
    """The n-grams of words, each with the sum of its words' counts."""
    points, word = marked_words(words)
    out: list[tuple[str, int]] = []
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        inside = word[n - 1 :] == word[: len(word) - n + 1]
        if n == 1:
            inside &= points != ord(END)
        windows = np.lib.stride_tricks.sliding_window_view(points, n)[inside]
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(windows), [None, pa.py_buffer(np.ascontiguousarray(windows))]).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]) if len(codes) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(counts[word[: len(inside)][inside]][order], at) if len(at) else at
        names = b"".join(coded.dictionary.to_pylist()).decode("utf-32-le", "surrogatepass")
        out += [(names[i * n : i * n + n], int(k)) for i, k in enumerate(sums.tolist())]
    return out


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs, entries, numbers = [], [], []
    for lang, found in counts.items():
        langs += [lang] * len(found)
        entries += found.keys()
        numbers += found.values()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(entries, pa.string()), pa.array(numbers, pa.int64())], ["lang", "entry", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, entry, n: how often each word stands in the texts of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return known.mapInArrow(tidied(count), COUNTS).groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, entry, n of the n-grams of counted words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            numbers, words, of = batch.column(2).to_numpy(), batch.column(1), langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(of == i)
                found = counts.setdefault(lang, Counter())
                for gram, n in counted_grams(words.take(pa.array(mine)).to_pylist(), numbers[mine]):
                    found[gram] += n
            if sum(map(len, counts.values())) > HELD:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return words.mapInArrow(tidied(count), COUNTS).groupBy("lang", "entry").agg(F.sum("n").alias("n"))


@dataclass
class Grams:
    """n-grams as numbers: the number of each letter (0: not in the lexicon), and for each length the sorted numbers and their rows."""

    letters: np.ndarray
    keys: list[np.ndarray]
    rows: list[np.ndarray]

    @classmethod
    def of(cls, grams: dict[str, int]) -> Grams:
        letters = np.zeros(0x110000, dtype=np.uint16)
        known = sorted({c for g in grams for c in g})[: (1 << LETTER_BITS) - 2]
        letters[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        keys, rows = [], []
        for n in range(1, LONGEST + 1):
            mine = [(g, row) for g, row in grams.items() if len(g) == n and all(letters[ord(c)] for c in g)]
            points = np.array([[ord(c) for c in g] for g, _ in mine], dtype=np.int64).reshape(len(mine), n)
            key = np.zeros(len(mine), dtype=np.uint64)
            for k in range(n):
                key = key << np.uint64(LETTER_BITS) | letters[points[:, k]]
            order = np.argsort(key)
            keys.append(key[order])
            rows.append(np.array([row for _, row in mine], dtype=np.int64)[order])
        return cls(letters, keys, rows)

    def longest(self, points: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each letter the row of the longest known n-gram that begins there within its word, -1 where none does."""
        letter = self.letters[points].astype(np.uint64)
        found = np.full(len(points), -1)
        key, whole = letter, letter > 0
        for n, (keys, rows) in enumerate(zip(self.keys, self.rows, strict=True), 1):
            if n > 1:
                key = key[:-1] << np.uint64(LETTER_BITS) | letter[n - 1 :]
                whole = whole[:-1] & (letter[n - 1 :] > 0) & (word[n - 1 :] == word[: len(word) - n + 1])
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = whole & (keys[at] == key)
                found[: len(key)][hit] = rows[at[hit]]
        return found


@dataclass
class Lexicon:
    """Languages in the order of ties, the rows of words and n-grams, and their log frequencies by language."""

    langs: list[str]
    words: dict[str, int]
    grams: Grams
    scores: np.ndarray

    def unknown(self, words: list[str]) -> np.ndarray:
        """For each word the mean, over its letters, of the longest known n-gram that begins there; 0 where none does."""
        points, word = marked_words(words)
        row = self.grams.longest(points, word)
        known = np.flatnonzero(row >= 0)
        sums, sizes = np.zeros((len(words), len(self.langs))), np.bincount(word[known], minlength=len(words))
        if len(known):
            at = np.flatnonzero(np.r_[True, np.diff(word[known]) != 0])
            sums[word[known][at]] = np.add.reduceat(self.scores[row[known]], at, axis=0)
        return sums / np.maximum(1, sizes)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. The unknown words of all of them are scored together, each once."""
        docs = [Counter(words_of(t or "")) if self.langs else Counter() for t in texts]
        new = list(dict.fromkeys(w for words in docs for w in words if w not in self.words))
        place = dict(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        table = np.vstack([self.scores, self.unknown(new)]) if new else self.scores
        out = []
        for words in docs:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            rows = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            if (rows < 0).any():
                rows[rows < 0] = [place[w] for w, row in zip(words, rows.tolist(), strict=True) if row < 0]
            total = np.fromiter(words.values(), dtype=float, count=len(words)) @ table[rows]
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def learn(docs: DataFrame, most: int = MOST) -> Lexicon:
    """The lexicon of the labelled texts in `docs`."""
    words = materialise(word_counts(docs), "lang-words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    langs = [r["lang"] for r in sorted(sizes, key=lambda r: (-r["n"], r["lang"]))]
    most = min(most, MOST_CELLS // max(1, len(langs) ** 2 * (LONGEST + 1)))
    # Words are kind 0, n-grams of n letters kind n.
    grams = gram_counts(words)
    both = words.select(F.lit(0).alias("kind"), "*").unionByName(grams.select(F.char_length("entry").alias("kind"), "*"))
    entries = materialise(both, "lang-entries")
    # The least count that a list can take down to: entries of a larger or equal count are no more than `most`.
    down = Window.partitionBy("lang", "kind").orderBy(F.desc("n"))
    levels = entries.groupBy("lang", "kind", "n").agg(F.count("*").alias("entries")).withColumn("upto", F.sum("entries").over(down))
    least = levels.filter(F.col("upto") <= most).groupBy("lang", "kind").agg(F.min("n").alias("least"))
    kept = entries.join(F.broadcast(least), ["lang", "kind"]).filter("n >= least").select("kind", "entry").distinct()
    found = entries.join(kept, ["kind", "entry"]).select("kind", "entry", "lang", "n").toArrow()
    totals = entries.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).toArrow().to_pylist()

    place = {lang: i for i, lang in enumerate(langs)}
    rows: dict[tuple[int, str], int] = {}
    kinds, entry, lang, n = (found.column(c).to_pylist() for c in ("kind", "entry", "lang", "n"))
    at = [rows.setdefault(key, len(rows)) for key in zip(kinds, entry, strict=True)]
    counts = np.full((len(rows), len(langs)), SMOOTH)
    counts[at, [place[x] for x in lang]] += n
    all_of = np.full((LONGEST + 1, len(langs)), 1.0)
    for t in totals:
        all_of[t["kind"], place[t["lang"]]] += t["n"] + SMOOTH * t["entries"]
    of_kind = np.fromiter((kind for kind, _ in rows), dtype=int, count=len(rows))
    scores = np.log(counts) - np.log(all_of[of_kind]) if rows else counts
    return Lexicon(langs, {e: i for (k, e), i in rows.items() if not k}, Grams.of({e: i for (k, e), i in rows.items() if k}), scores)


def identify(docs: DataFrame, learn_from: Column, most: int = MOST) -> DataFrame:
    """doc_id, lang_pred, score of every row; `learn_from`, over doc_id, says whose lang may be learnt."""
    lexicon = learn(docs.filter(F.col("doc_id").isNotNull() & learn_from), most)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.predict(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(predict), "doc_id long, lang_pred string, score double")
