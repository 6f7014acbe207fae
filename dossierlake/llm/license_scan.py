"""License scan by patience alignment against license texts.

A text and a template are aligned on words that occur once in both: the longest
increasing subsequence of those anchors is kept, and the gaps between anchors are
aligned the same way, with equal words at their edges first.  Coverage is the
share of template words that found their place.

Before that, every whole text passes an exact bound: a template can only be
covered as far as the text has its words, counted with multiplicity.  The bound
is a vectorised lookup over all words; only texts that can reach the threshold
are aligned.

A match may span at most ``STRETCH`` times the template's words; one that is spread
more thinly is not seen.  Alignment by anchors finds at most the longest common
subsequence of words and may fall short of it where a text repeats them: of changed
texts that reach the threshold by that measure it finds all but a few in a hundred.

The work is one pass over the rows without a shuffle.

Defined results
  * null or empty text: no match.  Very long texts: whole.  Every place where a
    template fits is a match; of overlapping matches the best covered one stays,
    then the longer.
  * repeated rows: each is scanned.  Empty table: an empty result.
  * extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as X
from .store import small_batches

COVERAGE = 0.8
#: A match may span so many times the template's words.
STRETCH = 2.0

# Public license notices and texts.
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_PERMISSION = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC_PERMISSION = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
TEMPLATES: dict[str, str] = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause (conditions)": _BSD_CONDITIONS,
    "BSD-2-Clause (text)": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "BSD-3-Clause (text)": _BSD_CONDITIONS + _BSD_ENDORSEMENT + _BSD_DISCLAIMER,
    "BSL-1.0 (text)": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies "
        "or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING "
        "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 (header)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": _ISC_PERMISSION,
    "ISC (text)": _ISC_PERMISSION
    + (
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": _MIT_PERMISSION,
    "MIT (text)": _MIT_PERMISSION
    + (
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT (notice)": "Released under the MIT License.",
    "MPL-2.0 (header)": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense (text)": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
        "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib (text)": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. This notice may not be removed or altered from any source distribution."
    ),
}

_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Every byte that ends a word becomes a blank, letters become lower-case.
_NORMAL = np.where(_PART, X.LOWER, 32).astype(np.uint8)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    part = _NORMAL[data]
    starts, ends, counts = X.word_spans(part, at)
    return X.span_hashes(part, starts, ends), starts, ends, counts


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = last[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list, slack: float = STRETCH) -> list[tuple[int, int]]:
    """Matched index pairs of ``a`` (text) and ``b`` (template), increasing in both.

    Outside the outermost anchors only as much text is searched as the rest of
    the template can stretch over.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), True)]
    while todo:
        a0, a1, b0, b1, whole = todo.pop()
        if not whole:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                found.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b.get(w) == 1}
        pairs = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where]
        if not pairs:
            continue
        pairs = [pairs[k] for k in longest_increasing([i for i, _ in pairs])]
        found += pairs
        for (i, j), (i2, j2) in zip(pairs, pairs[1:], strict=False):
            todo.append((i + 1, i2, j + 1, j2, False))
        (i, j), (i2, j2) = pairs[0], pairs[-1]
        todo.append((max(a0, i - int(slack * (j - b0))), i, b0, j, False))
        todo.append((i2 + 1, min(a1, i2 + 1 + int(slack * (b1 - j2 - 1))), j2 + 1, b1, False))
    return sorted(found)


def _densest(pairs: list[tuple[int, int]], length: float) -> list[tuple[int, int]]:
    """The most pairs whose text positions lie within ``length`` words."""
    best, k = (0, 0), 0
    for m, (i, _) in enumerate(pairs):
        while i - pairs[k][0] >= length:
            k += 1
        if m + 1 - k > best[1] - best[0]:
            best = (k, m + 1)
    return pairs[best[0] : best[1]]


def places(text: list[int], template: list[int], coverage: float = COVERAGE) -> list[list[tuple[int, int]]]:
    """The alignments that reach ``coverage``, one for each place of the text.

    The template word that the text has least often marks the places; each is
    searched as far as the template can stretch, up to the marks beside it, so
    that a text with several copies has its anchors in each.
    """
    have, own = Counter(text), Counter(template)
    marks = [(have[w], j) for j, w in enumerate(template) if own[w] == 1 and have[w]]
    need, out = coverage * len(template), []
    for _, j in sorted(marks)[: max(1, int(len(template) - need) + 1)]:
        # A covered template may lack some words, so more than one kind of mark is tried.
        at = [-1, *(i for i, w in enumerate(text) if w == template[j]), len(text)]
        for before, i, after in zip(at, at[1:], at[2:], strict=False):
            lo, hi = max(before + 1, i - int(STRETCH * (j + 1))), min(after, i + int(STRETCH * (len(template) - j)) + 1)
            pairs = _densest([(x + lo, y) for x, y in patience(text[lo:hi], template)], STRETCH * len(template))
            if len(pairs) >= need:
                out.append(pairs)
    return out


def _apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches (coverage, matched, ..., first, last) the best ones."""
    busy = bytearray(max((m[-1] for m in found), default=-1) + 1)
    taken = []
    for m in sorted(found, key=lambda m: (-m[0], -m[1], m[-2], m[2])):
        # A match is at most STRETCH times as long as its template, so a look is cheap.
        if busy.find(1, m[-2], m[-1] + 1) < 0:
            busy[m[-2] : m[-1] + 1] = b"\1" * (m[-1] + 1 - m[-2])
            taken.append(m)
    return sorted(taken, key=lambda m: m[-2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per match, of overlapping ones the best: ``doc_id, license, coverage, matched, template_words, start, end``.

    ``start`` and ``end`` are code-point offsets of the match in the original text.
    """
    small_batches(docs.sparkSession)
    names = sorted(templates or TEMPLATES)
    hashes = []
    for name in names:
        data = np.frombuffer((templates or TEMPLATES)[name].encode(), np.uint8)
        hashes.append(_words(data, np.array([0, len(data)]))[0])
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    wanted = [np.searchsorted(vocabulary, h) for h in hashes]
    multiplicity = np.stack([np.bincount(w, minlength=len(vocabulary)) for w in wanted]) if names else np.zeros((0, 0), int)
    lengths = multiplicity.sum(1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.buffer_of(batch.column(1))
            at_row: list[int] = []
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for a, b in X.steps(offsets):
                raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, starts, ends, counts = _words(raw, at)
                if not len(words) or not names:
                    continue
                place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                ids = np.where(vocabulary[place] == words, place, -1)
                doc = np.repeat(np.arange(b - a), counts)
                hit = ids >= 0
                # Counts of template words for documents that have any.
                some, local = np.unique(doc[hit], return_inverse=True)
                have = np.bincount(local * len(vocabulary) + ids[hit], minlength=len(some) * len(vocabulary)).reshape(len(some), -1)
                first = np.cumsum(counts) - counts
                able = np.stack([np.minimum(have, m).sum(1) >= coverage * n for m, n in zip(multiplicity, lengths, strict=True)], 1)
                for k in np.flatnonzero(able.any(1)).tolist():
                    i = int(some[k])
                    own = ids[first[i] : first[i] + counts[i]].tolist()
                    found = [(len(p) / int(lengths[t]), len(p), t, p[0][0], p[-1][0]) for t in np.flatnonzero(able[k]).tolist() for p in places(own, wanted[t].tolist(), coverage)]
                    if not found:
                        continue
                    points = np.concatenate(([0], np.cumsum((raw[at[i] : at[i + 1]] & 0xC0) != 0x80)))
                    for share, matched, t, lo, hi in _apart(found):
                        lo, hi = (int(points[x - at[i]]) for x in (starts[first[i] + lo], ends[first[i] + hi]))
                        at_row.append(a + i)
                        for column, x in zip(out, (names[t], share, matched, int(lengths[t]), lo, hi), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at_row, pa.int64())), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), *(pa.array(x, pa.int64()) for x in out[2:])],
                ["doc_id", "license", "coverage", "matched", "template_words", "start", "end"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(find, f"doc_id {kind}, license string, coverage double, matched long, template_words long, start long, end long")
