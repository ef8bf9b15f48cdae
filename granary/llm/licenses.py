"""License scans: winnowed fingerprints pick candidates, alignment confirms them.

Templates are few and fixed, so their fingerprints form a small inverted index that is broadcast
(its size depends on the templates alone). A text's fingerprints are looked up a batch at a time;
only texts with enough hits of one template in a stretch are candidates, and a local alignment of
the stretch gives the matched words, the share of the template that is covered, and the span in the text.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import samples
from granary.llm import words as W

#: Short notices, and the openings and warranty parts of well-known public license texts.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

GRAM, WINDOW = 2, 2
#: Words that may stand between two parts of a template, and what they cost at most.
INSERT, JUMP = 200, 6
LONGEST = 4_000_000  #: words aligned in one go
_ONE, _SAME = 1 << 40, (2 << 40) + (1 << 24)
_STRIP = b".,;:!?()[]{}\"'`<>*#|%$&~_-/\\"


class PlainIds(W.WordIds):
    """Words without their punctuation, in lower case; punctuation alone is 0."""

    def __missing__(self, word: bytes) -> int:
        plain = word.lower().strip(_STRIP)
        v = (xxhash.xxh3_64_intdigest(plain) | 1) if plain else 0
        if len(self) < self.bound:
            self[word] = v
        return v


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of every window of ``window`` places, rightmost on ties."""
    if len(g) <= window:
        return np.array([int(np.flatnonzero(g == g.min())[-1])]) if len(g) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], window)
    at = view.argmin(axis=1) + np.arange(len(view))
    return np.unique(len(g) - 1 - at)


class Index:
    def __init__(self, templates: Mapping[str, str]):
        ids = PlainIds()
        self.names = sorted(templates)
        self.words = [(a := ids.array(templates[n].encode().split()))[a != 0] for n in self.names]
        rows = [(int(g[i]), t, int(i)) for t, w in enumerate(self.words) for g in [W.grams(w, GRAM)] for i in winnow(g)]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        #: The first of equal hashes, for lookups.
        self.keys, self.begin = np.unique(self.hash, return_index=True)
        self.end = np.append(self.begin[1:], len(self.hash))
        #: Hits that make a candidate: a fifth of the template's fingerprints.
        self.need = np.maximum(1, np.bincount(self.template, minlength=len(self.names)) // 5)


def align(text: np.ndarray, lo: int, hi: int, template: np.ndarray, jump: bool = False, enough: int | None = None) -> tuple[int, int, int]:
    """Best local alignment (match 2, mismatch -1, gap -1) of text[lo:hi]; ``jump``: words added to the text in a row cost ``JUMP`` at most.

    Returns matched words and the span [from, to) in the text; ties go to the earliest end. A cell
    is one number: the score, then the matched words, then the start, from ``lo`` on. With
    ``enough`` matched words the first such alignment is returned once it can't be bettered by going
    on, so the texts behind it aren't read.
    """
    n = len(template)
    steps = np.arange(n, dtype=np.int64) * _ONE
    row, far = np.zeros(n + 1, np.int64), np.full(n + 1, -(1 << 60), np.int64)
    best, end = 0, lo
    for i in range(lo, hi):
        old = np.where(row < _ONE, i - lo, row)  # nothing so far: an alignment may start here
        new = np.maximum(old[:-1] + np.where(template == text[i], _SAME, -_ONE), old[1:] - _ONE)
        if jump:
            new = np.maximum(new, far[1:])
            far = np.maximum(far, row - JUMP * _ONE)
        new = np.maximum.accumulate(new + steps) - steps
        row[1:] = new
        top = int(new.max())
        if top >> 24 > best >> 24:
            best, end = top, i + 1
        elif enough is not None and i - end > 2 * n + INSERT * jump:
            if (best >> 24) & 0xFFFF >= enough:
                break
            best, end = 0, i  # what came so far is too little and over
    return (best >> 24) & 0xFFFF, lo + (best & 0xFFFFFF), end


def matches(ids: np.ndarray, places: np.ndarray, hits: list[tuple[int, int, int]], index: Index, least: float) -> list[tuple[str, int, float, int, int]]:
    """(license, matched words, coverage, first word, end word) of one text; of overlapping spans the one with more matched words stays.

    Of the hits (place, template, stretch), a stretch is aligned as it stands, then what is left of it with jumps over added words.
    """
    by: dict[tuple[int, int], list[int]] = defaultdict(list)
    for place, t, stretch in hits:
        by[t, stretch].append(place)
    found = []
    for (t, _), at in by.items():
        template, at = index.words[t], np.array(sorted(at))
        n = len(template)
        enough = int(np.ceil(least * n - 1e-9))
        first, last = max(0, int(at[0]) - n), min(len(ids), int(at[-1]) + GRAM + n)
        # A cell counts 2^24 places: longer stretches in parts that overlap by what a match can span.
        todo = [(lo, min(last, lo + LONGEST + 4 * n + 8 * INSERT)) for lo in range(first, last, LONGEST)]
        for jump in (False, True):
            rest = []
            while todo:
                lo, hi = todo.pop()
                if np.searchsorted(at, hi - GRAM, side="right") - np.searchsorted(at, lo) < index.need[t] or hi - lo < enough:
                    continue
                m, a, b = align(ids, lo, hi, template, jump, enough)
                if m and m >= enough:
                    found.append((index.names[t], m, m / n, int(places[a]), int(places[b - 1]) + 1))
                    todo += [(lo, a), (b, hi)]
                else:
                    rest.append((lo, hi))
            todo = rest
    found.sort(key=lambda r: (-r[1], r[3], r[0]))
    kept: list[tuple[int, int, tuple]] = []  # by place; spans don't overlap
    for r in found:
        i = bisect.bisect(kept, r[3], key=lambda k: k[0])
        if (i == 0 or kept[i - 1][1] <= r[3]) and (i == len(kept) or kept[i][0] >= r[4]):
            kept.insert(i, (r[3], r[4], r))
    return [k[2] for k in kept]


def scan_texts(texts: list[bytes], index: Index, least: float) -> list[list[tuple[str, int, float, int, int]]]:
    words, starts = W.split_all(texts)
    ids = W.worker_cache("licenses", PlainIds).array(words)
    real = np.flatnonzero(ids)
    plain = ids[real]
    bounds = np.searchsorted(real, starts)
    g = W.grams(plain, GRAM)
    out: list[list] = [[] for _ in texts]
    if not len(g) or not len(index.keys):
        return out
    at = np.minimum(np.searchsorted(index.keys, g), len(index.keys) - 1)
    hit = np.flatnonzero(index.keys[at] == g)
    doc = np.searchsorted(bounds, hit, side="right") - 1
    inside = hit + GRAM <= bounds[doc + 1]
    hit, doc = hit[inside], doc[inside]
    n = (index.end - index.begin)[at[hit]]
    row = np.repeat(index.begin[at[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit, doc = np.repeat(hit, n), np.repeat(doc, n)
    template = index.template[row]
    # The hits of a template with at most INSERT words between them must be enough for it.
    order = np.lexsort((hit, template, doc))
    hit, doc, template = hit[order], doc[order], template[order]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(template) != 0) | (np.diff(hit) > INSERT)
    stretch = np.cumsum(new) - 1
    ok = np.bincount(stretch)[stretch] >= index.need[template] if len(hit) else new
    hit, doc, template, stretch = hit[ok], doc[ok], template[ok], stretch[ok]
    docs, begin = np.unique(doc, return_index=True)
    for d, x, y in zip(docs.tolist(), begin.tolist(), [*begin[1:].tolist(), len(doc)]):
        a, b = int(bounds[d]), int(bounds[d + 1])
        rows = [(p - a, t, g) for p, t, g in zip(hit[x:y].tolist(), template[x:y].tolist(), stretch[x:y].tolist())]
        out[d] = matches(plain[a:b], real[a:b] - starts[d], rows, index, least)
    return out


def _scan(batches, shared, least: float):
    for b in W.slices(batches):
        rows = [(i, *m) for i, found in zip(b.column(0).to_pylist(), scan_texts(W.raw(b.column(1)), shared.value, least)) for m in found]
        c = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "license", "matched", "coverage", "first_word", "end_word"])


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.75, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, license, matched (words), coverage (of the template) and the span [first_word, end_word).

    One row for each place where at least ``least`` of a template aligns, in order, with up to 200
    words added between two parts of it; where such spans overlap,
    the one with most matched words stays (then the earlier, then the name that sorts first). Words
    are compared in lower case and without punctuation at their ends. Null or empty texts have no
    rows; a null id stays null; repeated rows are scanned each; only the two named columns are read.
    No templates, or an empty table, give no rows. Long texts are scanned whole, in time that grows
    with their length; every copy of a notice is found, also where copies touch.
    """
    shared = spark.sparkContext.broadcast(Index(templates))
    own = docs.select(samples.long_id(docs, ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(partial(_scan, shared=shared, least=least), "doc_id long, license string, matched long, coverage double, first_word long, end_word long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, runtime.table(spark, sf_dir, "documents"))


QUERIES = {"op8_license_scan": op8_license_scan}
SQL: dict[str, str] = {}
