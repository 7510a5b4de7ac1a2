"""Licence scans by patience alignment.

Text and template are sequences of words. Anchors are words unique to both sides; the longest
increasing run of anchors is kept, common words next to a gap's ends are matched, and each gap
between anchors is aligned the same way. Coverage is the share of the template's words that are
matched in order.

Where to align comes first: every place of a template word in the text votes for the start the
template would have there. Only starts with votes from enough of the template's words can reach
the coverage asked for, and each of them is one window, so a text that holds a licence twice is
reported twice. What lies between the matches is searched again with starts that may drift by the
template's length, for licences with other words inside; two of these within that length may hide
each other.

Templates are notices, the paragraphs of short licences, and their whole texts. Long licences
(Apache, GPL, MPL, CC) are known by their notices alone.

Defined results: a null, empty or licence-free text has no rows; of overlapping matches the one of
most matched words less foreign words inside stays, then the better covered, then the first, then
the first by name; ``purity`` is the share of matched words among the text's words from the match's
first to its last; repeated rows are scanned each; null ids pass through; other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame

from abundex.llm.common import map_rows

MIN_COVERAGE = 0.8
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# The wording of public licences and of the notices that name them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

# The clauses that whole BSD licences are made of.
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES["BSD"] += (_BSD_WARRANTY,)
TEMPLATES["BSD-2-Clause"] = (" ".join([TEMPLATES["BSD"][0], *_BSD_CLAUSES[:2], _BSD_WARRANTY]),)
TEMPLATES["BSD-3-Clause"] = (" ".join([TEMPLATES["BSD"][0], *_BSD_CLAUSES, _BSD_WARRANTY]),)
# Whole texts: the paragraphs of a licence one after another, without its one-line notices.
TEMPLATES |= {
    name: (*TEMPLATES[name], " ".join(TEMPLATES[name][first:]))
    for name, first in (("MIT", 2), ("ISC", 0), ("Zlib", 0), ("Unlicense", 0))
}


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places in the text."""
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text.lower())]


def _increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (a, b) points, in order of a, with rising b."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(points):
        at = bisect_left(tails, b)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(points[i])
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1 and mine.get(w) == 1}
        points = [(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where]
        anchors = _increasing(points)
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Match(NamedTuple):
    name: str
    matched: int
    coverage: float
    first: int
    last: int

    @property
    def foreign(self) -> int:
        return self.last + 1 - self.first - self.matched


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], min_coverage: float):
        self.min_coverage = min_coverage
        self.templates = [(name, [w for w, _, _ in words(t)]) for name, texts in templates.items() for t in texts]
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, template) in enumerate(self.templates):
            for i, w in enumerate(template):
                self.places[w].append((number, i))

    def scan(self, text: str) -> list[tuple[str, float, float, int, int]]:
        """(licence, coverage, purity, start, end) of every match, in text order."""
        if not self._possible(set(_WORD.findall(text.lower()))):
            return []
        found = words(text)
        plain = [w for w, _, _ in found]
        kept = self._best(self._search(plain, 0, len(plain), False))
        ends = [0, *(m.last + 1 for m in kept)]
        starts = [*(m.first for m in kept), len(plain)]
        rest = [m for a, b in zip(ends, starts, strict=True) for m in self._search(plain, a, b, True)]
        return [
            (m.name, m.coverage, m.matched / (m.matched + m.foreign), found[m.first][1], found[m.last][2])
            for m in sorted(kept + self._best(rest), key=lambda m: m.first)
        ]

    def _possible(self, present: set[str]) -> set[int]:
        """Templates that share enough words with a text to be covered by a part of it."""
        present = present & self.places.keys()
        return {
            number
            for number, (_, template) in enumerate(self.templates)
            if sum(w in present for w in template) >= self.min_coverage * len(template)
        } if present else set()

    def _search(self, plain: list[str], a: int, b: int, drift: bool) -> list[Match]:
        """Matches among the words from ``a`` to ``b``; with ``drift`` as many foreign words as the template has may be inside."""
        possible = self._possible(set(plain[a:b]))
        if not possible:
            return []
        votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for at in range(a, b):
            for number, i in self.places.get(plain[at], ()):
                if number in possible:
                    votes[number][(at - i) // max(4, len(self.templates[number][1]) // 4)].add(i)
        matches = []
        for number, starts in votes.items():
            name, template = self.templates[number]
            size, width = len(template), max(4, len(template) // 4)
            reach = 1 + (-(-size // width) if drift else 0)
            for slot in sorted(starts):
                near = set().union(*(starts[k] for k in range(slot, slot + reach + 1) if k in starts))
                if len(near) < self.min_coverage * size:
                    continue
                low, high = max(a, slot * width), min(b, (slot + 1 + reach) * width + size)
                pairs = align(plain[low:high], template)
                if len(pairs) >= self.min_coverage * size:
                    match = Match(name, len(pairs), len(pairs) / size, low + pairs[0][0], low + pairs[-1][0])
                    if match.foreign <= size:
                        matches.append(match)
        return matches

    @staticmethod
    def _best(matches: list[Match]) -> list[Match]:
        """Matches that do not overlap, in text order; the best are taken first."""
        kept: list[Match] = []
        for match in sorted(matches, key=lambda m: (m.foreign - m.matched, -m.coverage, m.first, m.name)):
            at = bisect_left(kept, match.first, key=lambda k: k.first)
            if (at == 0 or kept[at - 1].last < match.first) and (at == len(kept) or match.last < kept[at].first):
                kept.insert(at, match)
        return kept


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, licence, coverage, purity and the character range of every licence text found."""
    chosen = TEMPLATES if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        scanner = Scanner(chosen, min_coverage)
        return lambda doc_id, text: [(doc_id, *match) for match in scanner.scan(text)] if text else []

    return map_rows(
        docs.select("doc_id", "text"), make, f"doc_id {kind}, licence string, coverage double, purity double, start int, end int"
    )
