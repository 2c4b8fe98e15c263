"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Texts and templates are sequences of words: runs without white space, lower-cased, with only letters and digits kept.
Winnowing hashes every run of ``GRAM`` words and keeps the least hash of every ``WINDOW`` neighbours, so a run of
``GRAM + WINDOW - 1`` words that a text shares with a template shares a fingerprint; of templates of up to ``SHORT``
words, where edits may leave no such run, every hash is a fingerprint. The templates' fingerprints form an inverted
index, hash to (template, position), which is as large as the templates are. Words that no template has end a run, so
almost all of an ordinary text costs one lookup a word.

Hits of one template on neighbouring diagonals, that lie within a template's length of each other, form a candidate. The
whole template is aligned with some run of the words around them (match +1, mismatch and gap -1) in a band of ``BAND``
words on both sides, or half the template's words. Its matched words over the template's words are the coverage, and the
span goes from the first to the last of them. Matches
of ``FLOOR`` or more are rows, and ``passes`` says whether they reach ``LEAST``. With up to 15% of a template's words
exchanged some run of words is left that shares a fingerprint, so no match that passes is missed.

Defined results: null and empty texts match nothing; a template found several times in a text gives several rows, and
overlapping templates a row each; repeated rows give repeated matches; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import staging
from quern.llm.words import Memo, per_worker, text_slices

GRAM, WINDOW, BAND, SHORT = 3, 2, 8, 8
LEAST, FLOOR = 0.85, 0.5

# Texts, notices and headers of common public licenses.
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": BSD_CONDITIONS + BSD_WARRANTY,
    "bsd-3-clause": BSD_CONDITIONS + BSD_ENDORSE + BSD_WARRANTY,
    "bsd (line)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0 (line)": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "gpl-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit (line)": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc0-1.0 (line)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "reserved": "All rights reserved.",
}

KEEP = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    return KEEP.sub("", word.lower())


def mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def grams(code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all runs of GRAM codes without 0, a word of no template."""
    if len(code) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = code != 0
    run = known[: len(code) - GRAM + 1].copy()
    for k in range(1, GRAM):
        run &= known[k : len(code) - GRAM + 1 + k]
    at = np.flatnonzero(run)
    value = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        value = value * np.uint64(words + 1) + code[at + k].astype(np.uint64)
    return at, mixed(value)


def winnow(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the hashes at these positions are the least of WINDOW neighbours; a gap counts as larger than all."""
    chosen = np.zeros(len(at), bool)
    for a in range(1 - WINDOW, 1):  # windows that start a places before each gram
        least = value.copy()
        for k in range(WINDOW):
            near = np.minimum(np.searchsorted(at, at + a + k), max(0, len(at) - 1))
            least = np.minimum(least, np.where(at[near] == at + a + k, value[near], np.uint64(2**64 - 1)))
        chosen |= value <= least
    return chosen


class Index:
    """Templates as codes, and their fingerprints' inverted index."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        sequences = [[p for p in map(plain, text.split()) if p] for _, text in templates]
        self.code = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.templates = [np.array([self.code[w] for w in s], np.int64) for s in sequences]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        always: set[int] = set()  # what texts must keep beside their winnowed fingerprints
        for t, code in enumerate(self.templates):
            at, h = grams(code, len(self.code))
            if len(code) <= SHORT:
                always.update(h.tolist())
            else:
                chosen = winnow(at, h)
                at, h = at[chosen], h[chosen]
            for i, x in zip(at.tolist(), h.tolist()):
                self.postings.setdefault(x, []).append((t, i))
        self.known, self.always = np.array(sorted(self.postings), np.uint64), np.array(sorted(always), np.uint64)
        self.memo, self.codes = Memo(), np.zeros(1 << 12, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Codes of ``words``; 0 for words of no template, -1 for those without letters and digits."""
        at = self.memo.numbers(words)
        if new := self.memo.new:
            self.memo.new = []
            need = len(self.memo)
            if need > len(self.codes):
                self.codes = np.concatenate([self.codes, np.zeros(max(need, 2 * len(self.codes)) - len(self.codes), np.int64)])
            self.codes[need - len(new) : need] = [self.code.get(p, 0) if p else -1 for p in map(plain, new)]
        code = self.codes[at]
        self.memo.tidy()
        return code

    def matches(self, words: list[str], least: float) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, matched words, first word, last word) of every match in a text's words."""
        code = self.numbers(words)
        place = np.flatnonzero(code >= 0)
        code = code[place]
        at, h = grams(code, len(self.code))
        hit = np.isin(h, self.known)
        if not hit.any():
            return []
        hit &= winnow(at, h) | np.isin(h, self.always)
        hits: dict[int, list[tuple[int, int]]] = {}
        for i, x in zip(at[hit].tolist(), h[hit].tolist()):
            for t, j in self.postings[x]:
                hits.setdefault(t, []).append((i - j, i))
        found = []
        for t, pairs in sorted(hits.items()):
            n = len(self.templates[t])
            reach = min(BAND, n // 2)
            best = []
            for group in self._candidates(sorted(pairs), n, min(2 * reach, n - 1)):
                best += self._aligned(self.templates[t], code, *group, reach, least)
            found += [(t, *m) for m in self._apart(best)]
        return [(t, m / len(self.templates[t]), m, int(place[a]), int(place[b])) for t, m, a, b in found]

    @staticmethod
    def _candidates(pairs: list[tuple[int, int]], n: int, gap: int) -> list[tuple[int, int]]:
        """Least and largest diagonal of each group of hits: neighbouring diagonals, cut where they grow beyond 4 n."""
        groups: list[list[int]] = []
        for d, _ in pairs:
            if groups and d - groups[-1][1] <= gap and d - groups[-1][0] <= 4 * n:
                groups[-1][1] = d
            elif groups and d - groups[-1][1] <= gap:  # so long a run is gone over in overlapping parts
                groups.append([groups[-1][1] - 2 * gap, d])
            else:
                groups.append([d, d])
        return [(a, b) for a, b in groups]

    def _aligned(self, template, code, low: int, high: int, reach: int, least: float) -> list[tuple[int, int, int]]:
        """Matches of the template whose diagonals lie between ``low`` and ``high``, give or take ``reach``."""
        n, best = len(template), []
        open_ = [(max(low - reach, 0), min(len(code), high + n + reach))]
        whole = np.bincount(template, minlength=len(self.code) + 1)
        while open_:
            first, last = open_.pop()
            part = code[first:last]
            if np.minimum(whole, np.bincount(part, minlength=len(self.code) + 1))[1:].sum() < least * n:
                continue  # no alignment can have enough matches
            m, x, y = align(template, part, low - reach - first, high + reach - first)
            if m >= least * n:
                best.append((m, first + x, first + y))
                open_ += [(first, first + x), (first + y + 1, last)]  # the template again, before and after
        return best

    @staticmethod
    def _apart(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of matches that overlap the best one, in order of place."""
        kept: list[tuple[int, int]] = []  # first and last place, in order
        out = []
        for m, a, b in sorted(set(matches), key=lambda r: (-r[0], r[2] - r[1], r[1])):
            i = bisect.bisect_right(kept, (b, 1 << 60))
            if i and kept[i - 1][1] >= a:
                continue
            kept.insert(i, (a, b))
            out.append((m, a, b))
        return sorted(out, key=lambda r: r[1])


def align(template: np.ndarray, part: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Matched words, first and last matched place in ``part`` of the best alignment of the whole template with any run of
    ``part``, with diagonals from low to high. What lies beyond the ends of ``part`` matches nothing."""
    width, words = high - low + 1, dict(enumerate(part.tolist()))
    outside = (-(1 << 60), 0, 0, 0)
    above = [(0, 0, 0, 0)] * (width + 1)  # score, matches, minus the first and the last place; a tuple's order is the preference
    for i, want in enumerate(template.tolist()):
        line, left = [], outside
        for k in range(width):
            j = i + low + k
            s, m, f, e = above[k]
            left = (left[0] - 1, *left[1:])
            if words.get(j) == want:
                left = max((s + 1, m + 1, f if m else -j, -j), left)
            else:
                s, m, f, e = max((s, m, f, e), above[k + 1])  # exchanged or missing
                left = max((s - 1, m, f, e), left)
            line.append(left)
        above = [*line, outside]
    _, matched, first, last = max(above)
    return matched, -first, -last


WORD = re.compile(r"\S+")


def _scan(batches, templates: tuple, least: float, floor: float):
    index = per_worker(Index, templates)
    names = ["doc_id", "license", "coverage", "n_matched", "start_char", "end_char", "passes"]
    for batch in text_slices(batches):
        rows, out = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if not text:
                continue
            if found := index.matches(text.split(), floor):
                spans = [m.span() for m in WORD.finditer(text)]
                for t, coverage, matched, a, b in found:
                    rows.append(i)
                    out.append((index.names[t], coverage, matched, spans[a][0], spans[b][1], coverage >= least))
        if rows:
            license_, coverage, matched, start, end, passes = zip(*out)
            columns = [batch.column("doc_id").take(pa.array(rows)), pa.array(license_), pa.array(coverage), pa.array(matched, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(passes)]
            yield pa.RecordBatch.from_arrays(columns, names)


TEMPLATE_BYTES = 64 << 20


def scanned(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = LEAST, floor: float = FLOOR) -> DataFrame:
    """One row per match: doc_id, license, coverage, n_matched, start_char, end_char (exclusive), passes.

    ``templates`` maps names to texts, or is a table (name, text); every worker holds all of them, so a table of more than
    TEMPLATE_BYTES of text is refused. Rows with a coverage from ``floor`` on are given; ``passes`` is true from ``least`` on.
    """
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"{size} bytes of templates are more than a worker should hold")
        templates = {r["name"]: r["text"] for r in templates.where("text IS NOT NULL").collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = TEMPLATES if templates is None else templates
    scan = functools.partial(_scan, templates=tuple(sorted(chosen.items())), least=least, floor=min(floor, least))
    schema = f"doc_id {kind}, license string, coverage double, n_matched int, start_char long, end_char long, passes boolean"
    return staging.small_batches(docs.select("doc_id", "text")).mapInArrow(scan, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(staging.table(spark, sf_dir, "documents"))
