"""Normal forms and tokenization of text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Precomposed Latin letters and the plain letters below their marks."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.category(c) == "Mn" for c in base[1:]):
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked) + "đĐ", "".join(plain) + "dD"


def strip_accents(text: Column) -> Column:
    """Letters without their marks; đ becomes d. Text is taken to be composed (NFC), other marks are dropped."""
    return F.regexp_replace(F.translate(text, *_folds()), r"\p{Mn}+", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def facet_phrase(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    return F.regexp_replace(collapse(F.lower(text)), r"^[\p{P}\p{S}\s]+|[\p{P}\p{S}\s]+$", "")


def accentless(text: Column) -> Column:
    """Lower case without marks. Texts with one byte a character have none to look for."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(strip_accents(F.lower(text)))


def tokens(text: Column) -> Column:
    """Lower-case words in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def snippet(words: Column, terms: list[str], width: int = 24) -> Column:
    """The `width` words that hold the most different terms, hits in brackets, with dots where text was left out; null without a hit.

    Of equal windows the first counts. A window begins at a hit; what its last hit leaves free is shared between both sides."""
    wanted = F.array(*[F.lit(t) for t in terms])
    marked = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    hits = F.filter(marked, lambda h: F.array_contains(wanted, h["w"]))

    def window(h: Column, j: Column, every: Column) -> Column:
        inside = F.filter(F.slice(every, j + 1, width), lambda x: x["at"] < h["at"] + width)
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["w"]))).alias("n"), (-h["at"]).alias("first"), F.element_at(inside, -1)["at"].alias("last"))

    # One list of hits is bound once and looked at from each of them.
    best = F.array_max(F.flatten(F.transform(F.array(hits), lambda every: F.transform(every, lambda h, j: window(h, j, every)))))
    free = width - (best["last"] + best["first"] + 1)
    start = F.greatest(F.lit(0), F.least(-best["first"] - F.floor(free / 2), F.size(words) - width)).cast("int")
    return _cut(words, wanted, F.when(best.isNotNull(), start), width)


def _cut(words: Column, wanted: Column, start: Column, width: int) -> Column:
    part = F.transform(F.slice(words, start + 1, width), lambda w: F.when(F.array_contains(wanted, w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    before = F.when(start > 0, F.lit("… ")).otherwise(F.lit(""))
    after = F.when(start + width < F.size(words), F.lit(" …")).otherwise(F.lit(""))
    return F.when(start.isNotNull(), F.concat(before, F.concat_ws(" ", part), after))
