"""License scans in DataFrame functions: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

A text is its lower-case words; its shingles are hashes of five words in a row. Templates are grouped by length. For each
group the text is covered by overlapping windows such that every stretch as long as its longest template lies in some window, and a window has
as many MinHash bands of one value as it takes for a window that holds a template to share one with it with a probability of
`CERTAINTY` at least. A template that shares a band with a window is verified: the window must hold at least `threshold`
of the template's distinct shingles.

Before that, texts that can't match are set aside: `cover_words` gives a few words without which every template of a group has fewer
shingles left than it needs, so in a text with none of these words the group isn't looked for, and nothing is lost.

Everything happens in the row of its document, so nothing is shuffled and hot documents are no hot keys; templates are a parameter of
the query, bounded by whoever writes it.

A template of fewer than five words is one shingle of all its words, looked up word by word in the text; its `first_word` is exact.

Defined results: null texts have no matches, and texts of fewer than five words only those with templates of fewer than five; repeated rows are
scanned each; a null doc_id is kept; no rows give no rows; columns beyond doc_id and text are ignored. Templates need a word at least.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SIZE = 5
CERTAINTY = 0.9999
THRESHOLD = 0.8

# Short statements and standard notices of public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        'MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR '
        'ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE '
        'SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "BSD",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "BSD",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT '
        'HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
        'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON '
        'ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE '
        'USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        'MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY '
        'DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, '
        'ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
    ),
)

#: Statements of fewer words than a shingle; their numbers follow those of TEMPLATES.
STATEMENTS: tuple[tuple[str, str], ...] = (("All-rights-reserved", "All rights reserved."),)


def template_words(text: str) -> list[str]:
    """The words of a template, as WORD finds them in lower case."""
    return re.findall(r"\w+", text.lower())


def template_shingles(words: list[str]) -> set[tuple[str, ...]]:
    """The distinct shingles of a template; one of all its words if they are fewer than `SIZE`."""
    return {tuple(words[k : k + SIZE]) for k in range(max(1, len(words) - SIZE + 1))}


def needed(shingles: int, threshold: float) -> int:
    """How many distinct shingles of a template a window must hold."""
    return max(1, math.ceil(threshold * shingles - 1e-9))


def cover_words(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words such that a text without any of them can't match: without them each template keeps fewer shingles than it needs.

    Chosen greedily; long words count for more, as they keep more texts out."""
    open_ = {}
    for number, (_, text) in enumerate(templates):
        shingles = template_shingles(template_words(text))
        open_[number] = (shingles, len(shingles) - needed(len(shingles), threshold) + 1)
    chosen: list[str] = []
    while open_:
        gain: dict[str, float] = {}
        for shingles, wanted in open_.values():
            for word in {x for s in shingles for x in s}:
                gain[word] = gain.get(word, 0) + min(wanted, sum(word in s for s in shingles)) / wanted
        best = max(gain, key=lambda w: (gain[w] * min(len(w), 8) ** 3, w))
        chosen.append(best)
        for number, (shingles, wanted) in list(open_.items()):
            left = {s for s in shingles if best not in s}
            wanted -= len(shingles) - len(left)
            if wanted > 0:
                open_[number] = (left, wanted)
            else:
                del open_[number]
    # A text that has a word has every part of it.
    return sorted(w for w in chosen if not any(v != w and v in w for v in chosen))


@dataclass(frozen=True)
class Group:
    """Templates of similar length: their numbers, the window and step in shingles, and the number of bands."""

    numbers: tuple[int, ...]
    window: int
    step: int
    bands: int


def plan(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[Group]:
    """Groups of templates by doubling length, with their windows and bands; templates shorter than a shingle need none."""
    lengths = [len(template_words(t)) - SIZE + 1 for _, t in templates]
    if min(lengths) <= 1 - SIZE:
        raise ValueError("templates need a word at least")
    groups: dict[int, list[int]] = {}
    for number, n in enumerate(lengths):
        if n >= 1:
            groups.setdefault((n + 3).bit_length(), []).append(number)
    out = []
    for members in groups.values():
        longest = max(lengths[k] for k in members)
        step = max(2, longest // 2)
        window = longest + step - 1
        distinct = {k: len({tuple(w[i : i + SIZE]) for w in [template_words(templates[k][1])] for i in range(lengths[k])}) for k in members}
        # The least Jaccard similarity of a window that passes: it holds what is needed and nothing else of the template.
        least = min(needed(d, threshold) / (window + d - needed(d, threshold)) for d in distinct.values())
        bands = math.ceil(math.log(1 - CERTAINTY) / math.log(1 - least)) if least < 1 else 1
        out.append(Group(tuple(members), window, step, bands))
    return out


def shingles_of(words: Column) -> Column:
    """Hashes of five words in a row; empty for fewer words."""
    last = F.size(words) - SIZE + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SIZE)))).otherwise(F.array().cast("array<bigint>"))


def bands_of(shingles: Column, bands: int) -> Column:
    """The MinHash value of each band, joined with the band's number in one hash."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k)))))


def compiled(spark: SparkSession, templates: tuple[tuple[str, str], ...], groups: list[Group], threshold: float) -> list[list[dict]]:
    """For each group its templates' licence, distinct shingles, bands and needed shingles, computed by the functions that scan."""
    out = []
    for group in groups:
        rows = [(number, templates[number][0], template_words(templates[number][1])) for number in group.numbers]
        table = spark.createDataFrame(rows, "number int, license string, words array<string>").withColumn("shingles", F.array_distinct(shingles_of(F.col("words"))))
        found = table.select("number", "license", "shingles", bands_of(F.col("shingles"), group.bands).alias("bands")).orderBy("number").collect()
        out.append([r.asDict() | {"need": needed(len(r["shingles"]), threshold)} for r in found])
    return out


def _literal(entry: dict) -> Column:
    """A template as a constant."""
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    return F.struct(
        F.lit(entry["number"]).alias("number"), F.lit(entry["license"]).alias("license"), longs(entry["shingles"]).alias("shingles"),
        longs(entry["bands"]).alias("bands"), F.lit(entry["need"]).alias("need"),
    )


def windows_of(shingles: Column, group: Group) -> Column:
    """start (from 0), shingles and bands of every window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1, F.lit(0)), F.lit(group.step))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_distinct(F.slice(shingles, s + 1, group.window)).alias("held")))
    return F.transform(cut, lambda w: F.struct(w["start"].alias("start"), w["held"].alias("held"), bands_of(w["held"], group.bands).alias("bands")))


def matches_of(windows: Column, entries: list[dict]) -> Column:
    """Verified matches: license, template, word (from 0) and share of the template's shingles."""
    known = F.array(*[_literal(e) for e in entries])

    def in_window(w: Column) -> Column:
        near = F.filter(known, lambda t: F.arrays_overlap(w["bands"], t["bands"]))
        shares = F.transform(near, lambda t: F.struct(
            t["license"].alias("license"), t["number"].alias("template"), w["start"].alias("word"),
            F.size(F.array_intersect(w["held"], t["shingles"])).alias("held"), F.size(t["shingles"]).alias("size"), t["need"].alias("need"),
        ))
        return F.filter(shares, lambda m: m["held"] >= m["need"])

    return F.flatten(F.transform(windows, in_window))


def statement_matches(words: Column, templates: tuple[tuple[str, str], ...]) -> Column:
    """Matches, as in matches_of, of the templates of fewer words than a shingle: each at the first place where its words stand in a row."""
    short = [(number, license, w) for number, (license, w) in enumerate((g, template_words(t)) for g, t in templates) if len(w) < SIZE]

    def match(line: Column, number: int, license: str, w: list[str]) -> Column:
        at = F.instr(line, f" {' '.join(w)} ")
        before = F.substring(line, F.lit(1), at - 1)
        return F.struct(
            F.lit(license).alias("license"), F.lit(number).alias("template"), (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).alias("word"),
            F.when(at > 0, 1).otherwise(0).alias("held"), F.lit(1).alias("size"), F.lit(1).alias("need"),
        )

    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.flatten(F.transform(F.array(line), lambda x: F.filter(F.array(*[match(x, *t) for t in short]), lambda m: m["held"] >= m["need"])))


def best_matches(found: Column) -> Column:
    """One match for each template: the first of those with the most shingles."""
    better = lambda a, b: F.when(a["held"] != b["held"], b["held"] - a["held"]).otherwise(a["word"] - b["word"])
    first = lambda t: F.element_at(F.array_sort(F.filter(found, lambda m: m["template"] == t), better), 1)
    return F.transform(F.array_distinct(F.transform(found, lambda m: m["template"])), first)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + STATEMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, license, first_word, held, template_shingles: a row for each template that a document matches.

    `first_word` is the first word of the first of the template's best windows, `held` the template's shingles in it."""
    groups = plan(templates, threshold)
    entries = compiled(docs.sparkSession, templates, groups, threshold)
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    short = tuple(t for t in templates if len(template_words(t[1])) < SIZE)
    members = [tuple(templates[k] for k in g.numbers) for g in groups] + ([short] if short else [])
    # A group of templates is looked for only in texts that hold one of its own cover words.
    may = [functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in cover_words(m, threshold)]) for m in members]
    words = F.regexp_extract_all(text, F.lit(WORD), 0).alias("words")
    rows = docs.filter(functools.reduce(operator.or_, may)).select(F.col("doc_id").cast("long").alias("doc_id"), words, *[m.alias(f"g{k}") for k, m in enumerate(may)])
    # One column after the other, and no filter on a computed one: pushed down, it would compute the column anew for each use.
    looked = [c for c in rows.columns if c.startswith("g")]
    rows = rows.select("doc_id", *looked, shingles_of(F.col("words")).alias("shingles"), *([F.when(F.col(looked[-1]), statement_matches(F.col("words"), templates)).alias("short")] if short else []))
    found = [F.when(F.col(f"g{k}"), matches_of(windows_of(F.col("shingles"), g), e)) for k, (g, e) in enumerate(zip(groups, entries, strict=True))] + ([F.col("short")] if short else [])
    rows = rows.select("doc_id", F.flatten(F.array_compact(F.array(*found))).alias("found"))
    matches = rows.select("doc_id", F.explode_outer(best_matches(F.col("found"))).alias("m")).filter(F.col("m").isNotNull())
    return matches.select(
        "doc_id", F.col("m.template").alias("template"), F.col("m.license").alias("license"), F.col("m.word").alias("first_word"), F.col("m.held").alias("held"), F.col("m.size").alias("template_shingles")
    )
