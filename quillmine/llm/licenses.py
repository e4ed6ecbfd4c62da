"""License scan: winnowed fingerprints, an inverted index and banded alignment.

Templates are cut into shingles of three words; of each window of two shingles
the smallest hash is kept, so every run of four template words that a document
repeats holds a kept one. The index from kept hashes to (template, place) is
looked up with every shingle of the whole text. Hits of one template on close
diagonals are one candidate, and a banded alignment of the template with the
words around tells how many template words are matched, in order, and where the
match begins and ends. Matches that cover ``min_coverage`` of their template are
reported, the better of two that overlap.

Cases: words are runs of letters and digits in lower case, so line breaks and
punctuation do not count; null or empty texts match nothing; several notices in
a document are reported each; repeated rows are reported each; templates of
fewer than three words are refused; of templates that match a place equally well
the first by name order of the table counts; texts of any length are scanned
whole; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import text_groups
from .words import lowered, words_of, words_of_texts

SHINGLE, WINDOW = 3, 2
#: Words from which a template is aligned by long integers.
LONG = 120
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. {third}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)

#: Notices by which works are licensed; license_texts has whole licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(
        third="Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GNU.format(what="This program", name="General Public License", version="3"),
    "GPL-2.0-header": _GNU.format(what="This program", name="General Public License", version="2"),
    "LGPL-3.0-header": _GNU.format(what="This library", name="Lesser General Public License", version="3"),
    "LGPL-2.1-header": _GNU.format(what="This library", name="Lesser General Public License", version="2.1"),
    "AGPL-3.0-header": _GNU.format(what="This program", name="Affero General Public License", version="3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def default_templates() -> dict[str, str]:
    """TEMPLATES and the whole texts, by file name, of license_texts."""
    whole = {f.name.removesuffix(".txt") + "-text": f.read_text("utf-8") for f in (files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | dict(sorted(whole.items()))


@dataclass(frozen=True)
class Index:
    names: list[str]
    words: list[list[bytes]]
    counts: list[tuple[np.ndarray, np.ndarray]]  # hashes of a template's words, sorted, and how often it has each
    keys: np.ndarray  # sorted
    template: np.ndarray
    place: np.ndarray


def shingles(h: np.ndarray) -> np.ndarray:
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def make_index(templates: dict[str, str]) -> Index:
    names, words, counts, keys, owner, place = [], [], [], [], [], []
    for t, (name, text) in enumerate(templates.items()):
        raw = lowered(text)
        start, end, h = words_of(raw)
        if len(h) < SHINGLE:
            raise ValueError(f"{name}: a template needs {SHINGLE} words")
        grams = shingles(h)
        kept = {i + int(np.argmin(grams[i : i + WINDOW])) for i in range(max(1, len(grams) - WINDOW + 1))}
        names.append(name)
        counts.append(np.unique(h, return_counts=True))
        words.append([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
        for i in sorted(kept):
            keys.append(grams[i])
            owner.append(t)
            place.append(i)
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    return Index(names, words, counts, np.array(keys, np.uint64)[order], np.array(owner)[order], np.array(place)[order])


def banded_alignment(template: list[bytes], text: list[bytes], centre: int, band: int) -> tuple[int, int, int]:
    """Most template words matched in order with the text's, among alignments
    that stay within `band` of the diagonal text - template = centre; of these the
    tightest span: (matched, first text word, text word after the last)."""
    width = 2 * band + 1
    # state: (matched, -(begin .. end) slack); kept as (matched, begin, end)
    none = (0, -1, -1)
    prev = [none] * width
    for i, word in enumerate(template):
        row = [none] * width
        for d in range(width):
            j = i + centre + d - band
            best = prev[d + 1] if d + 1 < width else none  # a template word without partner
            if d and row[d - 1][0] > best[0] or d and row[d - 1][0] == best[0] and row[d - 1][1] > best[1]:
                best = row[d - 1]  # a text word without partner
            if 0 <= j < len(text) and text[j] == word:
                was = prev[d]
                got = (was[0] + 1, j if was[1] < 0 else was[1], j + 1)
                if got[0] > best[0] or got[0] == best[0] and got[1] > best[1]:
                    best = got
            elif prev[d][0] > best[0]:
                best = prev[d]
            row[d] = best
        prev = row
    return max(prev, key=lambda s: (s[0], s[1] - s[2]))


def _common(template: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Most template words matched in order with the text's, and the first place
    in the text by which they are: a row of the table is one long integer."""
    bits: dict[bytes, int] = {}
    for i, word in enumerate(template):
        bits[word] = bits.get(word, 0) | 1 << i
    full = (1 << len(template)) - 1
    state, most, end = full, 0, 0
    for j, word in enumerate(text):
        if m := bits.get(word):
            u = state & m
            state = (state + u | state - u) & full
            if (matched := len(template) - state.bit_count()) > most:
                most, end = matched, j + 1
    return most, end


def whole_alignment(template: list[bytes], text: list[bytes]) -> tuple[int, int, int]:
    """As banded_alignment, without a band, for long templates."""
    matched, end = _common(template, text)
    _, length = _common(template[::-1], text[:end][::-1])
    return matched, end - length, end


def scan_group(index: Index, texts: list[str | None], min_coverage: float) -> list[tuple[int, int, float, int, int, int, int]]:
    """(text, template, coverage, first word, words, first byte, bytes) of each match; bytes of the lower-cased UTF-8."""
    raw, start, end, h, limits = words_of_texts(texts)
    grams = shingles(h)
    low = np.searchsorted(index.keys, grams, "left")
    at = np.flatnonzero((low < len(index.keys)) & (index.keys[np.minimum(low, len(index.keys) - 1)] == grams))
    if not len(at):
        return []
    offset = np.cumsum([0, *(len(lowered(t)) + 1 for t in texts)])
    found: dict[int, list] = {}
    done: dict[tuple[int, int, int], int] = {}
    owner = np.searchsorted(limits, at, "right") - 1
    for p, text in zip(at.tolist(), owner.tolist()):
        k = int(low[p])
        while k < len(index.keys) and index.keys[k] == grams[p]:
            t, diagonal = int(index.template[k]), p - int(index.place[k])
            k += 1
            words = index.words[t]
            band = max(2, len(words) // 5)
            near = diagonal // band
            if any(abs(diagonal - done.get((text, t, n), 1 << 60)) < band for n in (near - 1, near, near + 1)):
                continue  # an alignment close by has seen this diagonal
            done[text, t, near] = diagonal
            a, b = max(int(limits[text]), diagonal - band), min(int(limits[text + 1]), diagonal + len(words) + band)
            # words that the place has at all, in any order, are no fewer than those in order
            known, count = index.counts[t]
            here = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
            here = np.bincount(here[known[here] == h[a:b]], minlength=len(known))
            if np.minimum(here, count).sum() < min_coverage * len(words):
                continue
            place = [raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())]
            matched, first, last = banded_alignment(words, place, diagonal - a, band) if len(words) <= LONG else whole_alignment(words, place)
            if matched >= min_coverage * len(words):
                found.setdefault(text, []).append((t, matched / len(words), a + first, a + last, matched))
    out = []
    for text, matches in sorted(found.items()):
        # of a license and a longer one that holds most of it, the one with fewer words missing
        matches.sort(key=lambda m: (len(index.words[m[0]]) - 2 * m[4], -m[1], m[2], m[0]))
        taken: list[tuple] = []  # by place; none overlap
        for m in matches:
            k = bisect(taken, m[2], key=lambda x: x[2])
            if (not k or taken[k - 1][3] <= m[2]) and (k == len(taken) or m[3] <= taken[k][2]):
                taken.insert(k, m)
        for t, coverage, a, b, _ in taken:
            out.append((text, t, coverage, a - int(limits[text]), b - a, int(start[a] - offset[text]), int(end[b - 1] - start[a])))
    return out


def scan_licenses(
    spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, license, coverage, first_word, n_words, first_byte, n_bytes of each
    notice found; places are those in the lower-cased text."""
    shared = spark.sparkContext.broadcast(make_index(templates or default_templates()))  # the templates' size

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_groups(texts, 1_000_000):
                found = scan_group(shared.value, texts[a:b], min_coverage)
                if found:
                    text, template, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[a + t] for t in text], pa.int64()),
                            pa.array([shared.value.names[t] for t in template], pa.string()),
                            pa.array(rest[0], pa.float64()),
                            *(pa.array(x, pa.int64()) for x in rest[1:]),
                        ],
                        names=["doc_id", "license", "coverage", "first_word", "n_words", "first_byte", "n_bytes"],
                    )

    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, license string, coverage double, first_word long, n_words long, first_byte long, n_bytes long")
