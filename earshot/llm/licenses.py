"""License scans by patience alignment.

A place is pinned where the words that name the license stand. Around them, words that occur once in the text and once in
the template are anchors; the longest increasing run of them is kept, and the gaps between them are aligned in the same
way. The share of template words matched in order is the coverage.
"""

from __future__ import annotations

import bisect
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import batch_words, hash_text, word_spans

# Public license texts and the notices by which works name them. Words in braces name the license: they must
# stand in a text as they are, with nothing between them; a name that ends in a number must not go on with another.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the {Apache License, Version 2.0}.",
        "Licensed under the {Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the {MIT License}.",
        "Licensed under the {MIT License}.",
        "{Permission is hereby granted, free of charge}, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "{Permission is hereby granted, free of charge}, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-2.0": [
        "This work is licensed under the {GNU General Public License, version 2}.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation; either {version 2 of the License}, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the {GNU General Public License, version 3}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either {version 3 of the License}, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the {GNU Affero General Public License, version 3}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either {version 3 of the License}, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version 2.1 of the License}, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation, either {version 3 of the License}, or (at your option) any later version."],
    "BSD-2-Clause": ["{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote products derived from this software} without specific prior written permission."],
    "ISC": ["{Permission to use, copy, modify, and/or distribute this software} for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is {free and unencumbered software released into the public domain}."],
    "CC0-1.0": ["Licensed under {CC0 1.0}.", "This work is dedicated to the public domain under the {Creative Commons CC0 1.0 Universal} Public Domain Dedication."],
    "CC-BY-4.0": ["Licensed under {CC BY 4.0}.", "This work is licensed under a {Creative Commons Attribution 4.0} International License."],
    "CC-BY-SA-4.0": ["Licensed under {CC BY-SA 4.0}.", "This work is licensed under a {Creative Commons Attribution-ShareAlike 4.0} International License."],
    "CC-BY-NC-4.0": ["Licensed under {CC BY-NC 4.0}.", "This work is licensed under a {Creative Commons Attribution-NonCommercial 4.0} International License."],
    "CC-BY-ND-4.0": ["Licensed under {CC BY-ND 4.0}.", "This work is licensed under a {Creative Commons Attribution-NoDerivatives 4.0} International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under {CC BY-NC-SA 4.0}.", "This work is licensed under a {Creative Commons Attribution-NonCommercial-ShareAlike 4.0} International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under {CC BY-NC-ND 4.0}.", "This work is licensed under a {Creative Commons Attribution-NonCommercial-NoDerivatives 4.0} International License."],
}
HITS = "array<struct<license:string,template:int,coverage:double,start:int,end:int>>"


# ---- alignment ---------------------------------------------------------------------------------------------------------


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (sorted by the first) that also grows in the second: patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(tops, j)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (text, template), growing in both. Gaps without words unique to both match equal ends only."""
    out, work = [], [(0, len(text), 0, len(template))]
    while work:
        tl, th, pl, ph = work.pop()
        while tl < th and pl < ph and text[tl] == template[pl]:
            out.append((tl, pl))
            tl, pl = tl + 1, pl + 1
        while tl < th and pl < ph and text[th - 1] == template[ph - 1]:
            th, ph = th - 1, ph - 1
            out.append((th, ph))
        if tl == th or pl == ph:
            continue
        where: dict = {}
        for i in range(tl, th):
            where[text[i]] = -1 if text[i] in where else i
        once: dict = {}
        for j in range(pl, ph):
            once[template[j]] = -1 if template[j] in once else j
        anchors = _increasing(sorted((where[w], j) for w, j in once.items() if j >= 0 and where.get(w, -1) >= 0))
        if not anchors:
            continue
        out += anchors
        edges = [(tl - 1, pl - 1), *anchors, (th, ph)]
        work += [(a + 1, c, b + 1, d) for (a, b), (c, d) in zip(edges, edges[1:])]
    return sorted(out)


def parse_template(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without braces, and the words (first, last + 1) of each part in braces; the whole text if there is none."""
    from .words import words_of

    plain, spans, words = "", [], 0
    for k, part in enumerate(re.split("[{}]", text)):
        size = len(words_of(part))
        if k % 2 and size:
            spans.append((words, words + size))
        plain, words = plain + part, words + size
    return plain, spans or [(0, words)]


class _Library:
    """Word numbers of all templates, their naming parts, and for each word the templates' counts."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [(name, k) for name, texts in templates.items() for k in range(len(texts))]
        parsed = [parse_template(text) for texts in templates.values() for text in texts]
        words = [hash_text(text) for text, _ in parsed]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.templates = [self.ids(w) for w in words]
        self.parts = [[(a, b) for a, b in spans if b > a] for _, spans in parsed]
        self.need = np.zeros((len(words), len(self.vocabulary) + 1), dtype=np.int64)  # the last column: no template word
        for t, ids in enumerate(self.templates):
            np.add.at(self.need[t], ids, 1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)


@lru_cache(maxsize=4)
def _library(key: tuple) -> _Library:
    return _Library({name: list(texts) for name, texts in key})


def _places(ids: np.ndarray, part: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Where ``part`` stands in ``ids`` word by word, but for places at which its last number goes on."""
    at = np.flatnonzero(ids[: len(ids) - len(part) + 1] == part[0]) if len(part) <= len(ids) else np.zeros(0, np.int64)
    for k in range(1, len(part)):
        at = at[ids[at + k] == part[k]]
    return at[~goes_on[at + len(part)]]


def _least(words: int, coverage: float) -> int:
    return math.ceil(coverage * words - 1e-9)


def find_templates(ids: np.ndarray, library: _Library, coverage: float = 0.8, reach: float = 1.5, goes_on: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word + 1) of every non-overlapping place of every template in a text.

    A place is pinned at the template's naming parts (the first wherever it stands, each further one at its first place
    after that); the words before, between and after them are aligned. Words before and after are looked for within
    ``reach`` times as many words as the template has there, and the parts stand within ``reach`` times their distance.
    ``goes_on`` marks words that continue a number before them (one flag more than words).
    """
    hits = []
    goes_on = np.zeros(len(ids) + 1, dtype=bool) if goes_on is None else goes_on
    enough = np.minimum(library.need, np.bincount(ids, minlength=len(library.vocabulary) + 1)).sum(axis=1)
    wide = lambda n: math.ceil(reach * n)
    for t, template in enumerate(library.templates):
        least, parts = _least(len(template), coverage), library.parts[t]
        if not parts or enough[t] < least:
            continue
        places = [_places(ids, template[a:b], goes_on) for a, b in parts]
        found = []
        for first in places[0].tolist():
            pins = [first]
            for (a, b), (c, _), where in zip(parts, parts[1:], places[1:]):
                k = int(np.searchsorted(where, pins[-1] + b - a))
                if k == len(where) or where[k] - pins[-1] > wide(c - a):
                    break
                pins.append(int(where[k]))
            if len(pins) < len(parts):
                continue
            matched, low, high = sum(b - a for a, b in parts), first, pins[-1] + parts[-1][1] - parts[-1][0]
            edges = [(max(0, first - wide(parts[0][0])), 0)]
            for pin, (a, b) in zip(pins, parts):
                edges += [(pin, a), (pin + b - a, b)]
            edges.append((min(len(ids), high + wide(len(template) - parts[-1][1])), len(template)))
            for k in range(0, len(edges), 2):
                (p, q), (r, s) = edges[k], edges[k + 1]
                pairs = align(ids[p:r].tolist(), template[q:s].tolist())
                matched += len(pairs)
                if pairs:
                    low, high = min(low, p + pairs[0][0]), max(high, p + pairs[-1][0] + 1)
            if matched >= least:
                found.append((matched, low, high))
        taken: list[tuple[int, int]] = []
        for matched, low, high in sorted(found, key=lambda h: (-h[0], h[2] - h[1], h[1])):
            if all(high <= a or b <= low for a, b in taken):
                taken.append((low, high))
                hits.append((t, matched, low, high))
    return hits


def license_column(text: Column, templates: dict[str, list[str]] = TEMPLATES, coverage: float = 0.8) -> Column:
    """Licenses in a text: license, template, coverage, and the code points it spans. Of overlapping hits that with most words stays."""
    key = tuple((name, tuple(texts)) for name, texts in sorted(templates.items()))

    @F.arrow_udf(HITS)
    def run(texts):
        import pyarrow as pa

        library = _library(key)
        starts, ends, hashes, first, raw = batch_words(texts)
        ids = library.ids(hashes)
        known = np.concatenate([[0], np.cumsum(ids < len(library.vocabulary))])
        shortest = min((_least(len(w), coverage) for w in library.templates), default=1)
        # a word of digits that a dot joins to the word before it continues a version, but for a zero
        digits = np.zeros(len(starts) + 1, dtype=bool)
        if len(starts) > 1:
            joined = (starts[1:] == ends[:-1] + 1) & (raw[np.minimum(ends[:-1], len(raw) - 1)] == ord("."))
            places = np.flatnonzero(joined) + 1
            digits[places] = [(word := raw[s:e].tobytes()).isdigit() and word.strip(b"0") != b"" for s, e in zip(starts[places].tolist(), ends[places].tolist())]
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for k in np.flatnonzero(known[first[1:]] - known[first[:-1]] >= shortest).tolist():
            own = slice(int(first[k]), int(first[k + 1]))
            found = find_templates(ids[own], library, coverage, goes_on=digits[own.start : own.stop + 1] & (np.arange(own.stop - own.start + 1) < own.stop - own.start))
            if not found:
                continue
            body = texts[k].as_py().encode()
            at, _ = word_spans(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
            base = int(starts[own.start]) - int(at[0])
            chosen: list[dict] = []
            for t, matched, low, high in sorted(found, key=lambda h: (-h[1], h[3] - h[2], h[2], h[0])):
                name, number = library.names[t]
                s, e = (len(body[: int(b) - base].decode("utf-8", "ignore")) for b in (starts[own.start + low], ends[own.start + high - 1]))
                if not any(s < c["end"] and c["start"] < e for c in chosen):
                    chosen.append({"license": name, "template": number, "coverage": round(matched / len(library.templates[t]), 6), "start": s, "end": e})
            out[k] = sorted(chosen, key=lambda c: (c["start"], c["end"], c["license"]))
        kind = pa.struct([("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.list_(kind))

    return run(text)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per license found: key, license, template, coverage, start, end.

    Null, empty and blank texts have none; repeated rows give repeated results; an empty table gives no rows; extra
    columns are not read. Words are compared without case and punctuation.
    """
    found = docs.select(F.col(f"`{key}`").alias("doc_id"), F.explode(license_column(F.col(f"`{text}`"), **options)).alias("h"))
    return found.select("doc_id", "h.*")
