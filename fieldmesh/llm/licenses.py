"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Texts are normalised (ASCII lower case, runs of anything but letters, digits and bytes over 127 become one space).
A k-gram's hash is kept where it is the least of a window of w, so a template and a text that share k + w - 1
normalised bytes share a fingerprint. An inverted index from fingerprint to (template, place) names candidates and
the diagonals they lie on; word sequences are then aligned within a band around those diagonals. A match that covers
enough of a template's words is reported with its coverage and its span in the text, in code points.

Null and empty texts have no matches; repeated rows give repeated matches; an empty table gives an empty table;
other columns are left behind. Overlapping matches of one template are reported once, the best; a span that lies
within a match of a longer template is left to that one.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, lean, mix64, pieces

K, W = 12, 8
#: Words of a template that a match has to cover.
COVERAGE = 0.8
#: Cells of alignments that are walked at once.
CELLS = 400_000
SCHEMA = "doc_id long, license string, coverage double, n_matched long, start long, end long"

# Public notices and license texts.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_class = np.arange(256, dtype=np.uint8)
_class[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]
_words = re.compile(r"[^\W_]+")


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and where each was."""
    x = _class[data]
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return x[at], at


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    n = len(x) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.ascontiguousarray(x)
    a = np.ndarray((n,), "<u8", x, 0, (1,))
    b = np.ndarray((n,), "<u4", x, K - 4, (1,))
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F))


def winnow(h: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some W in a row (all of them where there are fewer than W)."""
    if len(h) <= W:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, int)
    least = np.lib.stride_tricks.sliding_window_view(h, W).min(1)
    best = np.zeros(len(h), np.uint64)
    for d in range(W):
        np.maximum(best[d : d + len(least)], least, out=best[d : d + len(least)])
    return np.flatnonzero(h == best)


class Index:
    """Templates by fingerprint."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_words.findall(templates[n].lower()) for n in self.names]
        self.post: dict[int, set[tuple[int, int]]] = {}
        for t, n in enumerate(self.names):
            x, at = normal(np.frombuffer(templates[n].encode(), np.uint8))
            h = grams(x)
            starts = [len(templates[n][: m.start()].encode()) for m in _words.finditer(templates[n])]
            for k in winnow(h):
                self.post.setdefault(int(h[k]), set()).add((t, int(np.searchsorted(starts, at[k], "right")) - 1))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[[f & 0xFFFF for f in self.post]] = True

    def candidates(self, data: np.ndarray, off: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """For each row with a template's fingerprint: the templates, and the bytes where fingerprints begin with their words in the template."""
        x, at = normal(data)
        h = grams(x)
        if not len(h):
            return {}
        near = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        near = near[[int(v) in self.post for v in h[near]]] if len(near) else near
        out: dict[int, dict[int, list[int]]] = {}
        row = np.searchsorted(off, at[near], "right") - 1
        last = np.searchsorted(off, at[near + K - 1], "right") - 1
        for r in np.unique(row[row == last]):
            # the text's own winnowing, by itself, so that it doesn't hang on its neighbours
            y, where = normal(data[off[r] : off[r + 1]])
            g = grams(y)
            for k in winnow(g):
                for t, word in self.post.get(int(g[k]), ()):
                    out.setdefault(int(r), {}).setdefault(t, []).append((int(where[k]), word))
        return out


def align(template: np.ndarray, words: np.ndarray, diagonals: np.ndarray, band: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each diagonal (the word of the texts where the template would begin; its text is words[begin:end]): matched
    words, first and last matched word of the best local alignment (match 1, gap or mismatch -0.5) of the template with
    the text's words within band of it. All diagonals are walked at once, a template's word at a time."""
    d, wide = diagonals[:, None], 2 * band + 1
    low, high = np.maximum(begin[:, None], d - band), np.minimum(end[:, None], d + len(template) + band)
    steps, rows = np.arange(wide), np.arange(len(diagonals))
    score = np.zeros((len(diagonals), wide))
    first, count = np.full(score.shape, -1), np.zeros(score.shape, int)
    best, where = np.zeros(len(diagonals)), (np.zeros(len(diagonals), int), np.zeros(len(diagonals), int), np.zeros(len(diagonals), int))
    for i, w in enumerate(template.tolist()):
        j = d + (i - band) + steps
        inside = (j >= low) & (j < high)
        same = inside & (words[np.clip(j, 0, len(words) - 1)] == w)
        new, lead, many = np.where(same, score + 1, score - 0.5), np.where(same & (first < 0), j, first), count + same
        # a word of the template left out: from the row above, same word of the text
        up = np.zeros(score.shape, bool)
        up[:, :-1] = score[:, 1:] - 0.5 > new[:, :-1]
        if up.any():
            r, c = np.nonzero(up)
            new[r, c], lead[r, c], many[r, c] = score[r, c + 1] - 0.5, first[r, c + 1], count[r, c + 1]
        low_ = (new <= 0) | ~inside
        new[low_], lead[low_], many[low_] = 0, -1, 0
        # words of the text left out: the best to the left, less a half for each
        tilted = new + 0.5 * steps
        top = np.maximum.accumulate(tilted, 1)
        source = np.maximum.accumulate(np.where(tilted == top, steps, 0), 1)
        new = top - 0.5 * steps
        lead, many = np.take_along_axis(lead, source, 1), np.take_along_axis(many, source, 1)
        low_ = (new <= 0) | ~inside
        new[low_], lead[low_], many[low_] = 0, -1, 0
        score, first, count = new, lead, many
        hit = np.where(same, score, -1.0)
        at = hit.argmax(1)
        more = np.flatnonzero(hit[rows, at] > best)
        best[more] = hit[more, at[more]]
        for x, y in zip(where, (count, first, j)):
            x[more] = y[more, at[more]]
    return where


def disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(matched words, first, last): the best spans that don't overlap, most words first, then the shortest, then the leftmost."""
    taken: list[tuple[int, int]] = []
    out = []
    for c, a, b in sorted(spans, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        k = bisect_left(taken, (a, b))
        if (k == len(taken) or taken[k][0] > b) and (k == 0 or taken[k - 1][1] < a):
            taken.insert(k, (a, b))
            out.append((c, a, b))
    return out


Match = tuple[str, float, int, int, int]


def scan_texts(texts: list[str], places: list[dict[int, list[tuple[int, int]]]], index: Index, least: float) -> list[list[Match]]:
    """For each text (with the places of its fingerprints) its matches: license, coverage, matched words, start, end."""
    number: dict[str, int] = {}
    spots, words, begins = [], [], [0]
    diagonals: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[int]] = {}
    for r, (text, some) in enumerate(zip(texts, places)):
        raw = np.frombuffer(text.encode(), np.uint8)
        points = np.cumsum((raw & 0xC0) != 0x80)  # code points that begin up to each byte
        own = [(m.start(), m.end()) for m in _words.finditer(text)]
        starts = np.array([a for a, _ in own])
        words += [number.setdefault(text[a:b].lower(), len(number)) for a, b in own]
        for t, where in some.items():
            # each fingerprint names the diagonal it lies on: the text's word where the template would begin
            byte, word = np.array(where).T
            d = np.unique(np.searchsorted(starts, points[byte] - 1, "right") - 1 - word)
            diagonals.setdefault(t, []).append(d + begins[-1])
            owners.setdefault(t, []).append(r)
        spots += own
        begins.append(len(words))
    words, bounds = np.array(words), np.array(begins)
    found: list[dict[int, list[tuple[int, int, int, int]]]] = [{} for _ in texts]
    for t, parts in diagonals.items():
        template = np.array([number.get(w, -1) for w in index.words[t]])
        m, band = len(template), max(4, len(template) // 5)
        d, owner = np.concatenate(parts), np.repeat(owners[t], [len(x) for x in parts])
        spans: dict[int, set[tuple[int, int, int]]] = {}
        for part in np.array_split(np.arange(len(d)), -(-len(d) * (2 * band + 1) // CELLS)):
            c, a, b = align(template, words, d[part], band, bounds[owner[part]], bounds[owner[part] + 1])
            for k in np.flatnonzero(c >= least * m).tolist():
                spans.setdefault(int(owner[part[k]]), set()).add((int(c[k]), int(a[k]), int(b[k])))
        for r, own in spans.items():
            found[r][t] = sorted((spots[a][0], spots[b][1], c, m) for c, a, b in disjoint([*own]))
    return [left_over(own, index.names) for own in found]


def left_over(found: dict[int, list[tuple[int, int, int, int]]], names: list[str]) -> list[Match]:
    """Matches (by template: start, end, matched words, words of the template) but those within one of a longer template."""
    out = []
    for t, mine in found.items():
        longer = [o for o in found if (found[o][0][3], names[o]) > (mine[0][3], names[t])]
        for start, end, c, m in mine:
            if not any((k := bisect_left(found[o], (start + 1,)) - 1) >= 0 and found[o][k][1] >= end for o in longer):
                out.append((names[t], c / m, c, start, end))
    return sorted(out, key=lambda f: (f[3], f[4], f[0]))


def templates_in(spark: SparkSession, path: str, most: int = 5_000_000) -> dict[str, str]:
    """Templates from a folder of license texts, by file name without ending; at most so many characters of them."""
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    if (texts.agg(F.sum(F.length("value"))).first()[0] or 0) > most:
        raise ValueError("templates are sent to every task; these are too many")
    return {r["name"].rsplit(".", 1)[0] if r["name"].endswith(".txt") else r["name"]: r["value"] for r in texts.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """One row for each match: doc_id, license, coverage, n_matched, start, end."""
    templates = TEMPLATES if templates is None else templates

    @lean
    def run(batches):
        index = Index(templates)
        for b in batches:
            rows = []
            ids = b.column("doc_id")
            for i, _, data, off in pieces(b):
                places = index.candidates(data, off)
                texts = [data[off[r] : off[r + 1]].tobytes().decode() for r in places]
                for r, found in zip(places, scan_texts(texts, [*places.values()], index, least)):
                    rows += [(ids[i + r].as_py(), *f) for f in found]
            cols = [*zip(*rows)] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "license", "coverage", "n_matched", "start", "end"])

    return id_text(docs).mapInArrow(run, SCHEMA)
