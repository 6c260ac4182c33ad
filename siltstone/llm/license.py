"""Licence scans by patience alignment.

A template's words are searched in a text: positions of its telling words (those that are no stop words) are grouped into
regions, and each region is aligned with the template. The alignment anchors on words that occur once in both parts,
keeps the longest increasing subsequence of the anchors, and aligns the gaps between them the same way; where a gap has no
anchor, equal words are matched from its two ends. Coverage is the share of the template's words that are matched; in
short templates one word may be missing that is not of the licence's own name. An automaton over all telling words finds in
one pass which templates a text can hold at all.

Defined results: null and empty texts hold no licence; templates without words match nothing; repeated rows are each
reported; an empty table gives no rows. All places of a licence in a text are reported that don't overlap, the best covered
first, of equal ones the earlier. Texts are scanned whole, however long; extra columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Licence texts and notices to look for; the part of a name before a blank is the licence.
TEMPLATES = {
    "AGPL-3.0 name": "GNU Affero General Public License version 3",
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSD-3-Clause name": "Released under the BSD 3-Clause License.",
    "BSL-1.0 name": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 name": "Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 name": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0 name": "CC0 1.0 Universal",
    "GPL-2.0 name": "GNU General Public License version 2",
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 name": "GNU General Public License v3",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS."
    ),
    "LGPL-2.1 name": "GNU Lesser General Public License version 2.1",
    "LGPL-3.0 name": "GNU Lesser General Public License version 3",
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "all rights reserved": "All rights reserved.",
}

#: Words that do not start a region.
STOP_WORDS = set("a an and any at be by in is may not of on or the this to under with without you".split())

#: Words that short notices can lack.
LOOSE_WORDS = {"the", "this", "work", "is", "under", "licensed", "released", "distributed", "license"}

#: Templates of so many words at most are short.
SHORT = 12

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    """(lower-case word, start, end) of a text."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by the first part, whose second parts increase."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists by patience alignment, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = [(name, [w for w, _, _ in words(text)]) for name, text in templates.items()]
        self.telling = [set(t) - STOP_WORDS for _, t in self.templates]
        self.automaton = ahocorasick.Automaton()
        for word in set().union(*self.telling):
            self.automaton.add_word(word, word)
        if len(self.automaton):
            self.automaton.make_automaton()

    def covers(self, template: list[str], matched: list[tuple[int, int]]) -> bool:
        """Are enough of the template's words matched?"""
        if len(matched) >= self.least * len(template):
            return True
        missing = set(range(len(template))) - {k for _, k in matched}
        return len(template) <= SHORT and len(missing) == 1 and template[missing.pop()] in LOOSE_WORDS and len(template) > 2

    def scan(self, text: str) -> Iterator[tuple[str, float, int, int]]:
        """(licence, coverage, first and last character) of the licences in a text."""
        lower = text.lower()
        there = {w for _, w in self.automaton.iter(lower)} if len(self.automaton) else set()
        found = None
        for (name, template), telling in zip(self.templates, self.telling, strict=True):
            # matched words are counted below; without enough telling words the coverage can't be reached
            missing = sum(w in telling and w not in there for w in template)
            if not template or missing > max((1 - self.least) * len(template), len(template) <= SHORT):
                continue
            found = found or words(text)
            places = []
            for first, last in self._regions(found, telling, len(template)):
                matched = align([w for w, _, _ in found[first:last]], template)
                if matched and self.covers(template, matched):
                    places.append((-len(matched) / len(template), first + matched[0][0], first + matched[-1][0]))
            taken: list[tuple[int, int]] = []
            for share, first, last in sorted(set(places)):
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    yield name, -share, found[first][1], found[last][2]

    @staticmethod
    def _regions(found: list[tuple[str, int, int]], telling: set[str], size: int) -> Iterator[tuple[int, int]]:
        """Overlapping stretches of about twice the template's length around its telling words."""
        at = [k for k, (w, _, _) in enumerate(found) if w in telling]
        done = -1
        for k in at:
            if k > done:
                yield max(0, k - size // 2 - 2), min(len(found), k + size + size // 2 + 2)
                done = k + size // 2 if size > 16 else k


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.9) -> DataFrame:
    """doc_id, license, coverage, first_char, last_char of every licence whose template is covered by `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scanner(templates or TEMPLATES, least)
        for batch in common.slices(batches):
            hits = [(k, *hit) for k, text in enumerate(batch.column("text").to_pylist()) if text for hit in tool.scan(text)]
            columns = list(zip(*hits, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(columns[0], pa.int64())), *arrays], ["id", "license", "coverage", "first_char", "last_char"])

    rows = common.own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, license string, coverage double, first_char long, last_char long").withColumnRenamed("id", id_col)
