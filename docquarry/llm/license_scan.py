"""License scans by patience alignment.

A text and a license template are anchored on the words that are unique to both: of these the longest increasing
subsequence of places is taken, and the gaps between neighbouring anchors are aligned in the same way, where
other words have become unique, after equal words at the gap's ends. Coverage is the share of the template's
words that are aligned.

In a long text no word of a short notice may be unique, so alignments are made in windows: stretches of the text
that hold enough of the template's words to reach the coverage wanted. All such stretches of the whole text are
tried, so a license anywhere is found.

Templates that are much alike (versions 2 and 3, with and without NC) all cover one another's notices. So an
alignment must have each word that tells its template from one alike, and no word that tells one alike from it;
and alignments that overlap compete: the one with the most aligned words stays, less the words missing from the
template and those left over in the stretch. Nor may another number lie where one of the template is missing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import as_text, slices, table, text_column, words

COVERAGE = 0.8
#: Templates that share this part of the longer one's words in order are alike.
ALIKE = 0.6

_NUMBER = re.compile(rb"\d").search

# Names and notices of widely used licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, in which the second rises too."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1] = [b]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of a and b, both rising."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _rising([(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if not anchors:
            continue
        at, bt = a0, b0
        for p, q in [*anchors, (a1, b1)]:
            todo.append((at, p, bt, q))
            at, bt = p + 1, q + 1
        out += anchors
    return sorted(out)


def closest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of neighbouring pairs with the most pairs (twice) less the words of the text between them: what lies far off is no part of the place."""
    best = (0, 0, 0)
    total = start = 0
    for k, (p, _) in enumerate(pairs):
        gap = p - pairs[k - 1][0] - 1 if k else 0
        if total <= gap:
            total, start = 0, k
        else:
            total -= gap
        total += 2
        best = max(best, (total, -start, -k - 1))
    return pairs[-best[1] : -best[2]]


class Templates:
    """Templates as words, and what a text must have of each to be aligned with it."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float):
        self.all = [(name, w) for name, t in templates if (w := words(t))]
        self.coverage = coverage
        self.index = {w: k for k, w in enumerate(sorted({w for _, t in self.all for w in t}), 1)}
        self.member = np.zeros((len(self.all), len(self.index) + 1), np.int32)
        for k, (_, t) in enumerate(self.all):
            self.member[k, [self.index[w] for w in t]] = 1
        # If `coverage` of the words are aligned, so many kinds of words at least must be there.
        self.kinds = self.member.sum(1) - np.array([int((1 - coverage) * len(t) + 1e-9) for _, t in self.all], np.int32)
        # What tells templates that are alike from each other: words that must be aligned, and words that must not lie between.
        self.own: list[set] = [set() for _ in self.all]
        self.foreign: list[set] = [set() for _ in self.all]
        for k, (_, t) in enumerate(self.all):
            for _, other in self.all[:k] + self.all[k + 1 :]:
                if min(len(t), len(other)) >= ALIKE * max(len(t), len(other)):
                    pairs = patience(other, t)
                    if len(pairs) >= ALIKE * max(len(t), len(other)):
                        theirs, ours = ({x[side] for x in pairs} for side in (0, 1))
                        self.own[k] |= {w for at, w in enumerate(t) if at not in ours}
                        self.foreign[k] |= {w for at, w in enumerate(other) if at not in theirs} - set(t)

    def windows(self, k: int, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of the text with enough places of template k's words; those that overlap are one."""
        t = self.all[k][1]
        span, need = len(t) + len(t) // 2 + 8, max(1, int(np.ceil(self.coverage * len(t) - 1e-9)))
        at = np.nonzero(self.member[k, ids])[0]
        if len(at) < need:
            return
        first = np.nonzero(at[need - 1 :] - at[: len(at) - need + 1] < span)[0]
        begin = end = None
        for f in first.tolist():
            a, b = max(0, int(at[f]) - 2), min(len(ids), int(at[f]) + span)
            if begin is None or a > end:
                if begin is not None:
                    yield begin, end
                begin = a
            end = b
        if begin is not None:
            yield begin, end

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """name, coverage, first and last aligned word of the text, number of places: the best place of each template that won any."""
        tokens = words(text)
        get = self.index.get
        ids = np.array([get(w, 0) for w in tokens], np.int64)
        there = np.zeros(len(self.index) + 1, np.int32)
        there[ids] = 1
        there[0] = 0
        found: list[tuple[int, float, int, int, int]] = []
        for k in np.nonzero(self.member @ there >= np.maximum(self.kinds, 1))[0].tolist():
            for a, b in self.windows(k, ids):
                found += self._in_stretch(tokens, k, a, b)
        won: dict[int, list[tuple[float, int, int]]] = {}
        firsts: list[int] = []  # places that are taken, in order
        lasts: list[int] = []
        for _, coverage, k, first, last in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            at = bisect_left(firsts, first)
            if (at and lasts[at - 1] >= first) or (at < len(firsts) and firsts[at] <= last):
                continue
            firsts.insert(at, first), lasts.insert(at, last)
            won.setdefault(k, []).append((coverage, first, last))
        return [(self.all[k][0], *max(places, key=lambda x: (x[0], -x[1])), len(places)) for k, places in sorted(won.items())]

    def _in_stretch(self, tokens: list, k: int, a: int, b: int) -> list[tuple[int, float, int, int, int]]:
        """worth, coverage, template, first and last word of alignments along the stretch, each in a window a little longer than the template."""
        t, found = self.all[k][1], []
        span = len(t) + len(t) // 2 + 8
        while a < b:
            pairs = closest(patience(tokens[a : min(b, a + span)], t))
            if len(pairs) >= self.coverage * len(t) - 1e-9 and pairs:
                aligned, first, last = {p for p, _ in pairs}, pairs[0][0], pairs[-1][0]
                between = [tokens[a + p] for p in range(first, last + 1) if p not in aligned]
                there = {t[q] for _, q in pairs}
                other_number = any(_NUMBER(w) for w in between) and any(_NUMBER(w) and w not in there for w in t)
                if self.own[k] <= there and self.foreign[k].isdisjoint(between) and not other_number:
                    found.append((2 * len(pairs) - len(t) - len(between), len(pairs) / len(t), k, a + first, a + last))
                    if not between:
                        a += last + 1
                        continue
            a += max(1, len(t) // 4)
        return found


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, places: one row for each document and template that covers it best somewhere.

    Each place of a text is given to one template: of those that reach the coverage there the one with most words
    aligned less those missing and left over, of equal ones the one with the higher coverage, then the first of
    the list. Of several places of a template the best is given (the first of equal ones), and how many there
    are. A text of any length is scanned whole. Null and empty texts and templates match nothing; repeated rows
    are scanned each; a null id stays null; other columns do not matter, whatever their names; an empty table
    gives no rows. The templates go to every worker; they are the caller's list, not data.
    """
    known = Templates(TEMPLATES if templates is None else templates, coverage)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(r, *x) for r, t in enumerate(as_text(batch.column(1))) for x in known.scan(t)]
            where, *columns = zip(*rows) if rows else ((),) * 6
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "license", "coverage", "first_word", "last_word", "places"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_column(text)).mapInArrow(of, "doc_id long, license string, coverage double, first_word long, last_word long, places long")


def op3_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_patience_licenses": op3_patience_licenses}
ORACLES: dict[str, str] = {}
