"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chronofold.llm import kernels as K

#: Share of a template's words that must be aligned.
COVERAGE = 0.8

#: Notices by license (fixed values: the wording is the licenses' own).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
            " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
            " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
            " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
            " shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
                   " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
                   " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
                   " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
                   " permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
                 " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
                 " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Released under the BSD License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
                " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
                " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
                 " License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later"
                 " version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
                " with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
                     " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions"
                     " and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
                     " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3."
                     " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
                     " derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
                     " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions"
                     " and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
                     " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
            " that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("All-Rights-Reserved", "All rights reserved."),
]

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[48:58], _LETTER[97:123], _LETTER[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_LETTER[65:91] = np.arange(97, 123)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts; ASCII other than letters and digits parts words, A-Z are small letters."""
    return K.words(_LETTER[data], offsets)


def longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        below.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """(text position, template position) of aligned words, in order.

    Words that both sides hold once are anchors; the longest run of anchors
    whose order agrees is kept, and the gaps between them are aligned in the
    same way.  A gap without anchors aligns its common beginning and end, and between them the
    first of its template words that still come in order.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        seen_a, seen_c = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if seen_c[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where and seen_a[w] == 1]
        if anchors:
            kept = [anchors[i] for i in longest_rise([j for _, j in anchors])]
            pairs += kept
            for (i, j), (m, n) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
                if i + 1 < m and j + 1 < n:
                    gaps.append((i + 1, m, j + 1, n))
        else:
            i = a
            for j in range(c, d):
                at = next((k for k in range(i, b) if text[k] == template[j]), None)
                if at is not None:
                    pairs.append((at, j))
                    i = at + 1
    return sorted(pairs)


#: Words in a short notice: where so few are said, each word that is not one of COMMON tells licenses apart.
SHORT = 14
#: Words of notices that tell no license (fixed values).
COMMON = ("a an all and any are available distributed free in is licensed license made materials accompanying of or program released rights"
          " reserved software source terms the this to under unencumbered v version work").split()
#: Words that name a license or its version: one of them inside a match, beyond those of the template, makes it another license (fixed values).
NAMING = "affero lesser library attribution sharealike noncommercial noderivatives by sa nc nd mit bsd isc apache gnu mozilla boost eclipse creative commons".split()


def hashes_of(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_codes(data, np.array([0, len(data)]))[0].tolist()


_COMMON, _NAMING = frozenset(hashes_of(" ".join(COMMON))), frozenset(hashes_of(" ".join(NAMING)))


@dataclass
class Notice:
    license: str
    words: list[int]
    counts: Counter

    def __post_init__(self) -> None:
        """own: template positions that must be aligned; foreign: words that may not stand between aligned ones."""
        short = len(self.words) <= SHORT
        self.own = frozenset(j for j, w in enumerate(self.words) if (short and w not in _COMMON) or w in _NAMING)
        # Where all words are common, as in "All rights reserved", none is left out.
        if short and not self.own:
            self.own = frozenset(range(len(self.words)))
        self.foreign = _NAMING - set(self.words)

    def states(self, window: list[int], pairs: list[tuple[int, int]]) -> bool:
        """Whether the aligned words name this license and no other."""
        if not self.own <= {j for _, j in pairs}:
            return False
        aligned = {i for i, _ in pairs}
        inserted = [w for i, w in enumerate(window[pairs[0][0]:pairs[-1][0] + 1], pairs[0][0]) if i not in aligned]
        return not (len(self.words) <= SHORT and self.foreign.intersection(inserted)) and not _between(self, window, pairs)


def _between(notice: Notice, window: list[int], pairs: list[tuple[int, int]]) -> bool:
    """Whether a naming word of another license stands between two words that the template has side by side."""
    return any(m == j + 1 and notice.foreign.intersection(window[i + 1:k]) for (i, j), (k, m) in zip(pairs, pairs[1:]))


class Scanner:
    """All templates, looked for in the words of a text."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float) -> None:
        self.notices = []
        for name, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            words = word_codes(data, np.array([0, len(data)]))[0].tolist()
            if words:
                self.notices.append(Notice(name, words, Counter(words)))
        self.coverage = coverage
        self.vocabulary = np.unique(np.array([w for n in self.notices for w in n.words], np.uint64))
        v = len(self.vocabulary)
        self.caps = np.zeros((len(self.notices), v), np.int64)
        for i, n in enumerate(self.notices):
            for w, c in n.counts.items():
                self.caps[i, np.searchsorted(self.vocabulary, np.uint64(w))] = c
        self.need = np.array([max(1, int(np.ceil(coverage * len(n.words) - 1e-9))) for n in self.notices])

    def candidates(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, list[int]]]:
        """(text, templates) whose words the text holds often enough for the coverage."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == words)
        text_of = np.searchsorted(firsts, known, "right") - 1
        out = []
        if len(known):
            starts = np.flatnonzero(np.concatenate([[True], text_of[1:] != text_of[:-1]]))
            for s, e in zip(starts, np.append(starts[1:], len(known))):
                held = np.bincount(at[known[s:e]], minlength=len(self.vocabulary))
                ok = np.flatnonzero(np.minimum(self.caps, held).sum(axis=1) >= self.need)
                if len(ok):
                    out.append((int(text_of[s]), ok.tolist()))
        return out

    def find(self, words: list[int], which: list[int]) -> Iterator[tuple[int, float, int, int]]:
        """(template, coverage, first word, last word) of every window that states a template, each span once.

        The words before and behind a window's match are searched again, so that a notice repeated in one window is seen.
        """
        for t in which:
            notice, size = self.notices[t], len(self.notices[t].words)
            span, seen, tried = 2 * size, set(), set()
            sums = np.concatenate([[0], np.cumsum([w in notice.counts for w in words])])
            for start in range(0, max(1, len(words) - span + size // 2 + 1), max(1, size // 2)):
                end = min(len(words), start + span)
                # What a match leaves before and behind it is looked at in its turn.
                rest = [(start, end)]
                while rest:
                    lo, hi = rest.pop()
                    if (lo, hi) in tried:
                        continue
                    tried.add((lo, hi))
                    if sums[hi] - sums[lo] < self.need[t]:
                        continue
                    window = words[lo:hi]
                    held = Counter(w for w in window if w in notice.counts)
                    if sum(min(c, notice.counts[w]) for w, c in held.items()) < self.need[t]:
                        continue
                    pairs = align(window, notice.words)
                    if len(pairs) < self.need[t]:
                        continue
                    first, last = lo + pairs[0][0], lo + pairs[-1][0]
                    # Inserted words count against a match.
                    if notice.states(window, pairs) and (
                            last - first + 1 - len(pairs) <= (size if size > SHORT else size // 2)) and (first, last) not in seen:
                        seen.add((first, last))
                        yield t, len(pairs) / size, first, last
                    if last < hi - 1 or first > lo:
                        rest += [(lo, first), (last + 1, hi)]
                        # A stretched alignment may hide a whole notice: its two ends apart.
                        if last - first + 1 > size and (first, last) not in seen:
                            rest += [(first + 1, hi), (lo, last)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, n_words): a row for each document and license that it states.

    Words are runs of ASCII letters, digits and bytes beyond ASCII, in small letters.  A template
    is stated when some window of twice its length holds `coverage` of its words in
    order, by patience alignment; windows overlap, so that no notice spread over one and a half
    lengths is cut.  A short notice (SHORT words) must have its own words, name and version, aligned, and no
    word that names another license may stand inside; inserted words may be half as many as a short notice has, as
    many as a longer one has.  All windows that state a template compete: of those whose spans overlap the one with the
    larger coverage, then the longer template, then the shorter span, then the first counts; a license has one row.  first_word and last_word number the document's words from 0.
    A document without a notice has one row with a null license; so have null and
    empty texts, with n_words 0.  Null doc_ids and repeated rows are rows like others.
    templates: (license, text) pairs, a few hundred at most, as every task holds them.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                           T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("n_words", T.LongType())])

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in batches:
            for lo, hi, data, offsets in K.texts_of(batch.column("text")):
                words, firsts = word_codes(data, offsets)
                rows: list[tuple] = []
                stated = set()
                for i, which in scanner.candidates(words, firsts):
                    hits = [(c, len(scanner.notices[t].words), a - b, -a, scanner.notices[t].license, b)
                            for t, c, a, b in scanner.find(words[firsts[i]:firsts[i + 1]].tolist(), which)]
                    taken: list[tuple[int, int, str]] = []
                    for c, _, _, a, name, b in sorted(hits, reverse=True):
                        if all(b < lo_ or hi_ < -a for lo_, hi_, _ in taken):
                            taken.append((-a, b, name))
                            if any(name == n for *_, n in taken[:-1]):
                                continue  # a license stated again: its span is taken, its row is there
                            rows.append((i, name, c, -a, b))
                            stated.add(i)
                rows += [(i, None, None, None, None) for i in range(hi - lo) if i not in stated]
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi].take(pa.array(at)), pa.array(rest[0], pa.string()), pa.array(rest[1], pa.float64()),
                     pa.array(rest[2], pa.int64()), pa.array(rest[3], pa.int64()), pa.array(np.diff(firsts)[list(at)].astype(np.int64))],
                    ["doc_id", "license", "coverage", "first_word", "last_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
