"""License scans by patience alignment.

Words that occur exactly once in a stretch of text and exactly once in the license template are anchors; the longest
increasing run of their positions fixes them, and the gaps between neighbouring anchors are aligned in the same way,
where more words are unique.  The share of the template's words that end up aligned is its coverage.

Whole texts are scanned, a window at a time: windows are somewhat longer than the template and overlap, so that any
stretch that could be the license lies within one.  A window is aligned only if it shares enough words with the template,
each counted as often as both have it; fewer could not reach the coverage asked for, so nothing is lost.  That bound is
taken of the text, then of its windows, so texts of some thousand words can be templates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU "
    "{} along with this program. If not, see <https://www.gnu.org/licenses/>."
)

# Texts and notices of common licenses, as their public texts have them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. " + _GNU_TAIL.format("General Public License", "General Public License"),
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. " + _GNU_TAIL.format("Lesser General Public License", "Lesser General Public License"),
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. " + _GNU_TAIL.format("Affero General Public License", "Affero General Public License"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
    "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
    "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice "
    "may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
    "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to "
    "<https://unlicense.org>",
}
#: What tells a license from its neighbours.  A match must have each of these runs of words, word after word.
NAMING = {
    "MIT-line": ["MIT License"],
    "Apache-2.0-line": ["Apache License", "2.0"],
    "GPL-3.0-line": ["GNU General Public License", "3"],
    "CC-BY-NC-4.0-line": ["CC BY-NC 4.0"],
    "Apache-2.0": ["Apache License"],
    "GPL-3.0": ["GNU General Public License"],
    "LGPL-3.0": ["GNU Lesser General Public License"],
    "AGPL-3.0": ["GNU Affero General Public License"],
    "MPL-2.0": ["Mozilla Public License"],
    "BSD-3-Clause": ["Neither the name of"],
}


@cache
def whole_texts() -> dict[str, str]:
    """The public texts of longer licenses, from the folder license_texts, under the name of the license and ``-text``."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return {f.name.removesuffix(".txt") + "-text": f.read_text("utf-8") for f in files}


_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_LIMIT = 1 << 20


def words_of(text: str) -> list[str]:
    """Lower-case words: letters and digits, with single dots and hyphens inside."""
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given by rising first positions, whose second positions rise too: patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[k], ends[k] = b, i
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned positions, rising in both: anchors unique to both sides, then the gaps between them, each again.  Where a
    gap has no anchor, its equal beginnings and endings are aligned."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d:
            continue
        seen: dict = {}
        for j in range(c, d):
            seen[template[j]] = -1 if template[j] in seen else j
        at: dict = {}
        for i in range(a, b):
            if text[i] in seen:
                at[text[i]] = -1 if text[i] in at else i
        pairs = sorted((i, seen[w]) for w, i in at.items() if i >= 0 and seen[w] >= 0)
        run = _increasing(pairs)
        if run:
            out += run
            edges = [(a - 1, c - 1), *run, (b, d)]
            stack += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False)]
            continue
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
    return sorted(out)


def _named(found: list[tuple[int, int]], runs: list[list[int]]) -> bool:
    """Whether each run of words (its places in the template, and its length) is aligned, word after word in the text."""
    if not found:
        return False
    at = {t: i for i, t in found}
    return all(any(all(at.get(p + k, -1) == at.get(p, -2) + k for k in range(size)) for p in places) for *places, size in runs)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str], coverage: float, naming: dict[str, list[str]] | None = None) -> None:
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.templates = []
        for name, text in templates.items():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            runs = []
            for words in map(words_of, (naming or {}).get(name, [])):
                own = [self.vocabulary.get(w, -1) for w in words]
                runs.append([i for i in range(len(ids)) if ids[i : i + len(own)] == own] + [len(own)])
            self.templates.append((name, ids, runs))
        # How often each template has each word; words of none are 0.
        self.counts = np.zeros((len(self.templates), len(self.vocabulary) + 1), np.int32)
        for k, (_, ids, _) in enumerate(self.templates):
            np.add.at(self.counts[k], ids, 1)
        self.members = self.counts > 0

    def _shared(self, ids: np.ndarray, k: int) -> int:
        """How many words the two have in common, repeats counted: no alignment has more."""
        return int(np.minimum(np.bincount(ids, minlength=self.counts.shape[1]), self.counts[k]).sum())

    def _words(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = at + _LIMIT
            while end < len(text) and not text[end].isspace():
                end += 1
            yield words_of(text[at:end])
            at = end

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """``(license, coverage, first word, word after the last)`` of each template with enough coverage, at its best
        window (the first of these)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for ws in self._words(text) for w in ws), np.int32)
        if not ids.any():
            return []
        out = []
        have = np.bincount(ids)
        known = np.flatnonzero(have)
        most = np.minimum(self.counts[:, known], have[known]).sum(axis=1)
        for k, (name, template, runs) in enumerate(self.templates):
            size = len(template)
            need = self.coverage * size - 1e-9
            if most[k] < need:
                continue
            inside = np.concatenate([[0], np.cumsum(self.members[k][ids])])
            if inside[-1] < need:
                continue
            step, width = max(1, size // 2), 2 * size + size // 2
            starts = np.arange(0, max(1, len(ids) - width + step), step)
            ends = np.minimum(starts + width, len(ids))
            best = (0.0, 0, 0)
            for s, e in zip(starts[inside[ends] - inside[starts] >= need].tolist(), ends[inside[ends] - inside[starts] >= need].tolist(), strict=True):
                if self._shared(ids[s:e], k) < need:
                    continue
                for lo, hi in self._stretches(ids[s:e], size, need, k):
                    found = align(ids[s + lo : s + hi].tolist(), template)
                    share = len(found) / size
                    if share > best[0] and _named(found, runs):
                        best = (share, s + lo + found[0][0], s + lo + found[-1][0] + 1)
            if best[0] >= self.coverage - 1e-12:
                out.append((name, *best))
        return out

    def _stretches(self, ids: np.ndarray, size: int, need: float, k: int) -> Iterator[tuple[int, int]]:
        """The window, and parts of the template's length where it is dense, so that what comes twice is unique in one."""
        yield 0, len(ids)
        inside = np.concatenate([[0], np.cumsum(self.members[k][ids])])
        for lo in range(0, len(ids) - size + 1, max(1, size // 8)):
            if inside[lo + size] - inside[lo] >= need and self._shared(ids[lo : lo + size], k) >= need:
                yield lo, lo + size


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", naming: dict[str, list[str]] | None = None
) -> DataFrame:
    """``(doc_id, license, coverage, start_word, end_word, n_licenses, licenses)`` for each row of docs.

    licenses has each template with ``coverage`` or more, as structs of license, coverage, start_word and end_word: its
    best place in the text's words, the first of equals.  They come by falling coverage, of equals the longest template,
    then the first.  Templates are TEMPLATES and whole_texts(), unless others are given.  The four columns before show the head of that list (null, with coverage 0, where it is empty), and
    n_licenses is its length.  A template counts only where its naming words are aligned.  Null and empty texts have none.
    Repeated rows stay repeated; an empty table gives an empty result; other columns play no part.
    """
    chosen = TEMPLATES | whole_texts() if templates is None else dict(templates)
    names = NAMING if naming is None and templates is None else naming or {}
    order = {name: (-len(words_of(t)), i) for i, (name, t) in enumerate(chosen.items())}
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage, names)
        for b in batches:
            found = [sorted(scanner.scan(text or ""), key=lambda x: (-x[1], order[x[0]])) for text in b.column(1).to_pylist()]
            rows = [[dict(zip(("license", "coverage", "start_word", "end_word"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(match))], ["doc_id", "licenses"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = picked.mapInArrow(run, "doc_id long, licenses array<struct<license: string, coverage: double, start_word: long, end_word: long>>")
    head = F.get("licenses", 0)
    return found.select(
        "doc_id", head["license"].alias("license"), F.coalesce(head["coverage"], F.lit(0.0)).alias("coverage"), head["start_word"].alias("start_word"),
        head["end_word"].alias("end_word"), F.size("licenses").alias("n_licenses"), "licenses",
    )
