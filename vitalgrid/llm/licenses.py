"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and texts are read as words (letters and digits, A-Z in lower case).  Of every WINDOW neighbouring hashes of
K words the least is a fingerprint, so any common run of K + WINDOW - 1 words shares one.  Fingerprints of the templates
form an inverted index, which is small and goes to every task.  Matches of one template on nearby diagonals are one
candidate; around its diagonal the words are aligned, and what covers enough of the template is reported with its span.

In a notice, which names a license in a few words, the words that tell licenses apart (NAMES) must be those of the
template, none missing and none added; the others only have to reach the coverage.  Of hits that overlap the one of most
words is reported: a notice inside a longer text of the same license is part of it.

Edge cases: null or empty text matches nothing; repeated rows, also without an id, are reported alike, each for itself;
every occurrence in a text is reported once; very long texts are scanned in whole, in parts that overlap by more than the
longest template; templates of fewer than K words are met word by word; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, text_parts
from .ngram_join import _mix, _word_codes

K, WINDOW, BAND, COVERAGE = 3, 3, 16, 0.8
#: Words that tell licenses apart.
NAMES = frozenset("mit x11 apache gnu gpl lgpl agpl affero lesser library bsd isc mozilla mpl eclipse epl unlicense cc0 cc creative commons attribution sharealike noncommercial noderivatives noderivs by nc sa nd 0 1 2 3 4 5".split())

#: Wordings of licenses and of notices that name one.
TEMPLATES = {
    ("MIT", "notice"): "Released under the MIT License.",
    ("MIT", "licensed"): "Licensed under the MIT License.",
    ("Apache-2.0", "notice"): "Licensed under the Apache License, Version 2.0.",
    ("GPL-3.0", "notice"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-2.0", "notice"): "This work is licensed under the GNU General Public License, version 2.",
    ("LGPL-3.0", "notice"): "This work is licensed under the GNU Lesser General Public License, version 3.",
    ("AGPL-3.0", "notice"): "This work is licensed under the GNU Affero General Public License, version 3.",
    ("BSD-3-Clause", "notice"): "Licensed under the BSD 3-Clause License.",
    ("BSD-2-Clause", "notice"): "Licensed under the BSD 2-Clause License.",
    ("CC-BY-4.0", "short"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "short"): "Licensed under CC BY-SA 4.0.",
    ("CC-BY-NC-SA-4.0", "short"): "Licensed under CC BY-NC-SA 4.0.",
    ("CC-BY-NC-4.0", "notice"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "notice"): "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ("CC-BY-SA-4.0", "notice"): "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ("MPL-2.0", "header"): """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ("LGPL-3.0", "header"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ("AGPL-3.0", "header"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ("MIT", "grant"): """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ("BSD", "disclaimer"): """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ("ISC", "text"): """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ("BSD-2-Clause", "text"): """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    ("BSD-3-Clause", "text"): """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ("Apache-2.0", "header"): """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied.""",
    ("GPL-3.0", "header"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ("Unlicense", "text"): """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means.""",
}

TEMPLATES["MIT", "text"] = TEMPLATES["MIT", "grant"] + """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

#: Templates of fewer words are notices.
NOTICE_BELOW = 16

_LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """The text in UTF-8, of the same length, with a space for every ASCII character that is no letter or digit."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS) if isinstance(text, str) else b""


def _grams(codes: np.ndarray) -> np.ndarray:
    h = np.full(max(0, len(codes) - K + 1), 3, np.uint64)
    for i in range(K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - K + 1 + i]
    return _mix(h)


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among the hashes: of every WINDOW neighbours the least, the last of equals."""
    if len(h) < WINDOW:
        return np.flatnonzero(h == h.min())[-1:] if len(h) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1]
    at = np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1)
    return at[np.r_[True, at[1:] != at[:-1]]]


class Index:
    """Words of the templates, and which fingerprints stand where in which."""

    def __init__(self, templates: dict[tuple[str, str], str]):
        self.names = list(templates)
        words = [plain(templates[n]).split() for n in self.names]
        self.words = [_word_codes(w) for w in words]
        self.telling = [sum(w.decode("utf-8", "replace") in NAMES for w in own) if len(own) < NOTICE_BELOW else None for own in words]
        self.apart = frozenset(_word_codes([w.encode() for w in sorted(NAMES)]).tolist())
        self.longest = max(map(len, self.words), default=0)
        rows = [(int(h[p]), t, int(p)) for t, w in enumerate(self.words) for h in [_grams(w)] for p in winnow(h)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def band(self, t: int) -> int:
        """Diagonals looked at on each side: fewer for short templates, whose next occurrence may be near."""
        return min(BAND, len(self.words[t]) // 3)

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest, highest diagonal) of groups of matching fingerprints."""
        h = _grams(codes)
        at = winnow(h)
        low, high = np.searchsorted(self.keys, h[at]), np.searchsorted(self.keys, h[at], side="right")
        hit = np.flatnonzero(high > low)
        pairs = {(int(self.template[k]), int(at[i] - self.place[k])) for i in hit for k in range(low[i], high[i])}
        for t, w in enumerate(self.words):
            if 0 < len(w) < K <= len(codes) + K:  # too short for a fingerprint
                same = np.logical_and.reduce([codes[i : len(codes) - len(w) + 1 + i] == w[i] for i in range(len(w))])
                pairs |= {(t, int(d)) for d in np.flatnonzero(same)}
        out: list[list[int]] = []
        for t, d in sorted(pairs):
            if out and out[-1][0] == t and d - out[-1][2] <= self.band(t) // 2:
                out[-1][2] = d
            else:
                out.append([t, d, d])
        return [tuple(x) for x in out]

    def holds(self, t: int, words: list[int], same: int, telling: int, first: int, last: int, coverage: float) -> bool:
        """Whether an alignment makes a hit of the template."""
        if first < 0 or same < coverage * len(self.words[t]):
            return False
        wanted = self.telling[t]
        return wanted is None or telling == wanted == sum(w in self.apart for w in words[first : last + 1])


def align(template: list[int], words: list[int], low: int, high: int, band: int, apart: frozenset = frozenset()) -> tuple[int, int, int, int]:
    """Best local alignment within ``band`` of the diagonals: equal words, those of them in ``apart``, first and last word of it (-1 if none)."""
    best = (0, 0, 0, -1, -1)
    before: dict[int, tuple[int, int, int, int]] = {}
    for i, want in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        telling = want in apart
        for j in range(max(0, i + low - band), min(len(words), i + high + band + 1)):
            score, same, told, start = before.get(j - 1, (0, 0, 0, j))
            equal = words[j] == want
            cell = (score + 2, same + 1, told + telling, start if score else j) if equal else (score - 1, same, told, start)
            for near in (before.get(j), row.get(j - 1)):
                if near and near[0] - 1 > cell[0]:
                    cell = (near[0] - 1, *near[1:])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (*cell, j)
        before = row
    return best[1], best[2], best[3], best[4]


@lru_cache(maxsize=4)
def _index(items: tuple) -> Index:
    return Index(dict(items))


def find(text: str | None, index: Index, coverage: float = COVERAGE, at_once: int = 1 << 19) -> list[tuple[str, str, float, int, int, int]]:
    """(license, form, coverage, matched words, start, end) of the licenses in a text; start and end in characters."""
    raw = plain(text)
    words = raw.split()
    found = []
    lap = 2 * (index.longest + 2 * BAND)  # a hit, with the words around it, lies in one part whole
    step = max(at_once, 2 * lap)
    for base in range(0, max(1, len(words)), step - lap):
        codes = _word_codes(words[base : base + step])
        for t, low, high in index.candidates(codes):
            own, band = index.words[t], index.band(t)
            a, b = max(0, low - band), high + len(own) + band
            near = codes[a:b].tolist()
            same, telling, first, last = align(own.tolist(), near, low - a, high - a, band, index.apart)
            if index.holds(t, near, same, telling, first, last, coverage):
                found.append((same, -t, base + a + first, base + a + last))
        if base + step >= len(words):
            break
    best: list[tuple[int, int, int, int]] = []
    for hit in sorted(set(found), key=lambda h: (-h[0], h[2], -h[1])):  # the most words, then the first place, then the order of templates
        k = bisect_left(best, hit[2], key=lambda h: h[2])
        if (k == len(best) or best[k][2] > hit[3]) and (k == 0 or best[k - 1][3] < hit[2]):
            best.insert(k, hit)
    if not best:
        return []
    offsets = [m.span() for m in re.finditer(rb"\S+", raw)]
    source, out = text.encode("utf-8", "surrogatepass"), []
    at = chars = 0

    def place(byte: int) -> int:
        nonlocal at, chars
        chars += len(source[at:byte].decode("utf-8", "surrogatepass"))
        at = byte
        return chars

    for same, t, first, last in best:  # in order of places, which do not overlap
        out.append((*index.names[-t], same / len(index.words[-t]), same, place(offsets[first][0]), place(offsets[last][1])))
    return out


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: dict[tuple[str, str], str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``id_col``, license, form, coverage, matched_words, start and end (characters) of every license found."""
    items = tuple(templates.items())

    names, types = ["id", "license", "form", "coverage", "matched_words", "start", "end"], [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for part in (part for batch in batches for part in text_parts(batch)):
            rows = [(i, *hit) for i, text in zip(part["id"].to_pylist(), part["text"].to_pylist()) for hit in find(text, index, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * 7, types)], names)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, license string, form string, coverage double, matched_words long, start long, end long").withColumnRenamed("id", id_col)
