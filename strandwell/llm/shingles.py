"""Word shingles as sorted sets of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORD = re.compile(r"\w+")
SIZE = 5
#: Text bytes that are hashed in one go; a longer text stands alone.
AT_ONCE = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, AT_ONCE * 2)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts in order: all their shingle hashes, sorted and distinct within a text, and the number of each text.

    Words are runs of letters, digits and underscores in lower case. A text of fewer than five words has one shingle, all its words; a
    text without words has none."""
    start = 0
    while start < len(texts):
        end, used = start, 0
        found: list[list[str]] = []
        while end < len(texts) and (end == start or used + len(texts[end]) <= AT_ONCE):
            used += len(texts[end])
            found.append(WORD.findall(texts[end].lower()))
            end += 1
        yield _hashed(found)
        start = end


def _hashed(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(w) for w in found], dtype=np.int64)
    if not counts.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(len(found), dtype=np.int64)
    raw = np.frombuffer(("\n".join("\n".join(w) for w in found if w) + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    up, down = powers(len(raw) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])]
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.repeat(np.arange(len(found)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    whole = place + SIZE <= np.repeat(counts, counts)
    at = np.flatnonzero(whole)
    value = np.zeros(len(at), dtype=np.uint64)
    for k, factor in enumerate(PLACES):
        value += words[at + k] * np.uint64(factor)
    doc = owner[at]
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        joint = np.array([_short(words[first[d] : first[d] + counts[d]]) for d in short], dtype=np.uint64)
        value, doc = np.r_[value, joint], np.r_[doc, short]
    value = mix(value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    value, doc = value[keep], doc[keep]
    return value, np.bincount(doc, minlength=len(found))


def _short(words: np.ndarray) -> np.uint64:
    total = np.uint64(len(words))
    for w, factor in zip(words, PLACES, strict=False):
        total = np.uint64((int(total) * BASE + int(w) * factor) & 0xFFFFFFFFFFFFFFFF)
    return total


def set_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of two 64-bit numbers for each set that tells equal sets: sums of two mixes of their members."""
    edges = np.r_[0, np.cumsum(sizes)]
    with np.errstate(over="ignore"):
        sums = [np.r_[np.uint64(0), np.cumsum(mix(values ^ np.uint64(salt)))] for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return np.stack([mix(s[edges[1:]] - s[edges[:-1]] + sizes.astype(np.uint64)) for s in sums], axis=1)
