"""Operator 7: license scans by winnowed fingerprints and banded alignment.

A template's fingerprints are the winnowed hashes of its k-word shingles: of every ``window``
consecutive hashes the least (the last of equal ones).  The inverted index maps a fingerprint
to templates and positions.  A document's shingles are all looked up, so any copied run of
window + k - 1 template words is met.  Every meeting votes for a diagonal (document place less
template place).  Votes of one template whose diagonals lie within a band of each other are one
candidate copy, which is aligned with the template in the band around its diagonals (match 1,
others -1, local); what remains of its part of the document on either side is aligned again, as
long as it has votes, so adjacent copies are each found.  A match is reported with its document
word span and its coverage (matched words / the greater of template and span words) if that is
``min_coverage`` or more or if ``min_matched`` words or more match.  Templates of fewer words than
``min_matched`` must match whole, as a word more names another license ("CC BY", "CC BY-NC").
Spans of a template don't overlap.

The templates are the full texts in ``license_texts`` and the usual short notices, NOTICES; they
are a parameter and small: they are broadcast, at most ``max_template_bytes`` of text, beyond
which the call is refused.  Licenses that share passages each report what they share.

Defined results: null and empty texts match nothing; a template of fewer than k words is one
shingle; templates without words and null names or texts are left out; repeated rows are each
scanned; texts of any length are scanned whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import textops as T

# The usual notices and one-line statements of common licenses.
NOTICES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 long line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 short line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 short line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT line": "Released under the MIT License.",
    "MIT short line": "Licensed under the MIT License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def full_texts() -> dict[str, str]:
    """License name to full text, of the files in ``license_texts``."""
    files = (f for f in resources.files("tactus.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files}


def default_templates() -> dict[str, str]:
    return full_texts() | NOTICES


def _tokens(text: str) -> T.Words:
    raw = text.encode()
    return T.words(np.frombuffer(raw + bytes(16), np.uint8), np.array([0, len(raw)]), T.ALNUM)


def winnow(h: np.ndarray, window: int) -> list[int]:
    """Positions of the least hash of every window (the last of equal ones)."""
    if len(h) <= window:
        return [len(h) - 1 - int(np.argmin(h[::-1]))] if len(h) else []
    return sorted({i + window - 1 - int(np.argmin(h[i : i + window][::-1])) for i in range(len(h) - window + 1)})


@dataclass
class Index:
    """Sorted fingerprints with their template and word position; the templates' word hashes."""

    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray
    template: np.ndarray
    place: np.ndarray
    k: int


def build(templates: dict[str, str], k: int = 3, window: int = 2, max_template_bytes: int = 16 << 20) -> Index:
    """The inverted index of all templates' fingerprints."""
    if sum(len(t.encode()) for t in templates.values() if t) > max_template_bytes:
        raise ValueError("templates exceed max_template_bytes")
    names, hashes, rows = [], [], []
    for name in sorted(n for n in templates if n is not None):
        w = _tokens(templates[name] or "")
        if len(w.hash):
            h, _ = T.kmers(w, k)
            rows += [(int(h[i]), len(names), i) for i in winnow(h, window)]
            names.append(name)
            hashes.append(w.hash)
    rows.sort()
    cols = [np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint64, np.int64, np.int64))]
    return Index(names, hashes, *cols, k)


def align(doc: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with document less template place in [low, high]: matched words, document
    start, document end.  Of equal scores the first end counts.  One numpy row a template word."""
    width, n = high - low + 1, len(doc)
    ramp = np.arange(width)
    rows = np.zeros((len(template) + 1, width), np.int32)
    place = low - 1 + ramp  # document place of each cell of the row before
    for q, word in enumerate(template):
        place = place + 1
        inside = (place >= 0) & (place < n)
        hit = np.zeros(width, bool)
        hit[inside] = doc[place[inside]] == word
        best = rows[q] + np.where(hit, 1, -1)  # both one on
        best[:-1] = np.maximum(best[:-1], rows[q, 1:] - 1)  # a template word more
        best = np.maximum(best, 0)
        best[~inside] = 0
        rows[q + 1] = np.maximum.accumulate(best + ramp) - ramp  # document words more
        rows[q + 1, ~inside] = 0
    q, d = np.unravel_index(int(rows.argmax()), rows.shape)
    if not rows[q, d]:
        return 0, 0, 0
    matched, end = 0, low + q - 1 + d + 1
    while q and rows[q, d]:
        p = low + q - 1 + d
        here = rows[q, d]
        hit = doc[p] == template[q - 1]
        if here == rows[q - 1, d] + (1 if hit else -1):
            matched, q, start = matched + hit, q - 1, p
        elif d + 1 < width and here == rows[q - 1, d + 1] - 1:
            q, d = q - 1, d + 1
        else:
            d -= 1
    return int(matched), int(start), int(end)


def dense_runs(doc: np.ndarray, template: np.ndarray, a: int, b: int, low: int, high: int, need: float) -> list[tuple[int, int]]:
    """The parts of document words a to b that can hold an alignment of ``need`` matched words in the
    band: as every beginning of a local alignment scores above 0, so does the count of words that the
    band can match less those that it can't, since it last was 0."""
    hit = np.zeros(b - a, bool)
    for d in range(low, high + 1):
        x, y = max(a, d), min(b, d + len(template))
        if x < y:
            hit[x - a : y - a] |= doc[x:y] == template[x - d : y - d]
    total = np.concatenate([[0], np.cumsum(np.where(hit, 1, -1))])
    above = total > np.minimum.accumulate(total)
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], above[1:], [False]]).astype(np.int8)))
    met = np.concatenate([[0], np.cumsum(hit)])
    return [(a + int(x), a + int(y)) for x, y in zip(cuts[0::2], cuts[1::2]) if met[y] - met[x] >= need]


def align_run(doc: np.ndarray, template: np.ndarray, a: int, b: int, low: int, high: int) -> tuple[int, int, int]:
    """``align`` of document words a to b with the template words that the band can meet there."""
    q = max(0, a - high)
    got, s, e = align(doc[a:b], template[q : max(q, b - low)], low - a + q, high - a + q)
    return got, a + s, a + e


def candidates(index: Index, h: np.ndarray, first: np.ndarray, band: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, template, document places, diagonals) of the votes for each candidate copy, most votes first
    within a row and template."""
    lo, hi = np.searchsorted(index.prints, h, "left"), np.searchsorted(index.prints, h, "right")
    hit = np.flatnonzero(lo < hi)
    if not len(hit):
        return
    n = (hi - lo)[hit]
    at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shingle = np.repeat(hit, n)
    row = np.searchsorted(first, shingle, "right") - 1
    place, template = shingle - first[row], index.template[at]
    diagonal = place - index.place[at]
    order = np.lexsort((place, diagonal, template, row))
    row, template, place, diagonal = (x[order] for x in (row, template, place, diagonal))
    near = np.minimum(band, np.array([len(w) for w in index.words])[template] // 4)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > near[1:])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(row))
    for k in np.lexsort((start - end, template[start], row[start])).tolist():
        a, b = start[k], end[k]
        yield int(row[a]), int(template[a]), place[a:b], diagonal[a:b]


def matches(index: Index, w: T.Words, min_coverage: float, min_matched: int, band: int) -> Iterator[tuple[int, str, float, int, int, int, int]]:
    """(row, template, coverage, matched words, template words, start, end) of every match."""
    h, first = T.kmers(w, index.k)
    if not len(h) or not len(index.prints):
        return
    taken: list[tuple[int, int]] = []
    of = None
    for r, t, places, diagonals in candidates(index, h, first, band):
        if (r, t) != of:
            of, taken = (r, t), []
        doc, tw = w.hash[w.first[r] : w.first[r + 1]], index.words[t]
        need = min(min_matched, len(tw) * min_coverage)
        near = min(band, len(tw) // 4)
        low, high = int(diagonals.min()) - near, int(diagonals.max()) + near
        free = [(max(0, low), min(len(doc), high + len(tw)))]
        for s, e in taken:
            free = [x for a, b in free for x in ((a, min(b, s)), (max(a, e), b)) if x[0] < x[1]]
        while free:
            a, b = free.pop()
            if not ((places >= a) & (places < b)).any():
                continue
            found = max((align_run(doc, tw, x, y, low, high) for x, y in dense_runs(doc, tw, a, b, low, high, need)), default=(0, 0, 0))
            got, s, e = found
            coverage = got / max(len(tw), e - s)
            if got and (coverage >= min_coverage and len(tw) >= min_matched or got >= min_matched or coverage == 1):
                taken.append((s, e))
                free += [(a, s), (e, b)]
                yield r, index.names[t], coverage, got, len(tw), s, e


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, min_matched: int = 20, band: int = 8, k: int = 3, window: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, template, coverage, matched, template_words, start, end (document words)."""
    index = docs.sparkSession.sparkContext.broadcast(build(default_templates() if templates is None else templates, k, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches):
            rows = [*matches(index.value, T.words(c.data, c.offs, T.ALNUM), min_coverage, min_matched, band)]
            if rows:
                r, *cols = zip(*rows)
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([c.rows.column(0).take(pa.array(r)), *(pa.array(x, t) for x, t in zip(cols, kinds))], names=["doc_id", "template", "coverage", "matched", "template_words", "start", "end"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, template string, coverage double, matched long, template_words long, start long, end long")
