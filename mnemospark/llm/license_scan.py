"""Licence scans with a generalised suffix automaton.

The words of all templates go into one automaton. A text streams through it
and yields matching statistics: at each word the longest match that ends there
and its state. Maximal matches of ``min_match`` words or more become anchors;
per template the anchors are chained in the order of both text and template,
and a chain that covers enough of the template is a span. Base phrases are
templates too: one occurs wherever it is a suffix of the current match.

A match of two words needs a word pair that some template has, so only runs of
such pairs, and phrases of one word, walk through the automaton; this leaves out
no match. Anchors have two words at least.

Edge cases: a null or empty text has no words and scores 0; phrases and templates
without words never match; repeated rows are scanned alike; other columns are
ignored; texts of any length are read whole, in time that follows their words.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import alnum_words, map_batches, utf8

# Phrases and labels that the contract names.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wordings of public licence notices, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-4.0": "licensed under CC BY 4.0",
    "cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "cc-by-long": "licensed under a Creative Commons Attribution 4.0 International License",
    "mit-notice": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "all-rights-reserved": "All rights reserved",
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
        "at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "isc-warranty": (
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty."
    ),
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"
    ),
    "cc-by-sa-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
}


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids; state 0 is the root."""

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    move: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, link: int, move: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.move.append(move)
        return len(self.length) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """Give the strings of ``target`` that come from ``at`` a state of their own."""
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.move[target]))
        self.link[target] = copy
        while at >= 0 and self.move[at].get(word) == target:
            self.move[at][word] = copy
            at = self.link[at]
        return copy

    def extend(self, last: int, word: int) -> int:
        """Append a word to the string that ends in state ``last``."""
        target = self.move[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.move[at]:
            self.move[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.move[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def add(self, words: list[int]) -> None:
        at = 0
        for w in words:
            at = self.extend(at, w)

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Matching statistics: the longest match after one more word."""
        while state and word not in self.move[state]:
            state = self.link[state]
            length = self.length[state]
        target = self.move[state].get(word)
        return (target, length + 1) if target is not None else (0, 0)


class Scanner:
    """Automaton, word ids and what ends in each state, for a set of templates."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str], min_match: int, max_gap: int, coverage: float):
        if min_match < 2:
            raise ValueError("anchors have two words at least")
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage
        self.ids: dict[bytes, int] = {}
        self.phrases = [(self._known(p), label) for p, label in phrases.items()]
        self.templates = [(self._known(text), label) for label, text in templates.items()]
        self.machine = Automaton()
        strings = [words for words, _ in (*self.phrases, *self.templates)]
        for words in strings:
            self.machine.add(words)
        k = len(self.ids) + 1
        self.pairs = np.array(sorted({a * k + b for words in strings for a, b in zip(words, words[1:])}), np.int64)
        self.alone = np.zeros(k, bool)  # phrases of one word
        self.alone[[words[0] for words, _ in self.phrases if len(words) == 1]] = True
        n = len(self.machine.length)
        by_length = sorted(range(1, n), key=self.machine.length.__getitem__)
        #: Per state: (phrase, its words) that are a suffix of the state's strings.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i, (words, _) in enumerate(self.phrases):
            if words:
                self.ends[self._walk(words)].append((i, len(words)))
        for s in by_length:
            self.ends[s] = self.ends[s] + self.ends[self.machine.link[s]]
        #: Per state: (template, index after its last word) of all its occurrences.
        places: list[set[tuple[int, int]]] = [set() for _ in range(n)]
        for i, (words, _) in enumerate(self.templates):
            at = 0
            for j, w in enumerate(words):
                at = self.machine.move[at][w]
                places[at].add((i, j + 1))
        for s in reversed(by_length):
            places[self.machine.link[s]] |= places[s]
        self.places = [sorted(p) for p in places]

    def _known(self, text: str) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids) + 1) for w in alnum_words(text.encode())]

    def _walk(self, words: list[int]) -> int:
        at = 0
        for w in words:
            at = self.machine.move[at][w]
        return at

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word ids and the maximal runs of word pairs that templates have, or of one word that is a phrase."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        link = np.zeros(len(ids) + 1, bool)  # word i - 1 to word i
        if len(ids) > 1 and len(self.pairs):
            key = ids[:-1] * (len(self.ids) + 1) + ids[1:]
            link[1:-1] = self.pairs[np.searchsorted(self.pairs, key).clip(max=len(self.pairs) - 1)] == key
        active = link[:-1] | link[1:] | self.alone[ids]
        starts, stops = np.flatnonzero(active & ~link[:-1]), np.flatnonzero(active & ~link[1:]) + 1
        return ids, list(zip(starts.tolist(), stops.tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(start, phrase) of base places; (template, text start, template start, words) anchors."""
        ids, runs = self.runs(words)
        base: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int, int]] = []
        for start, stop in runs:
            state = length = 0
            for at, w in enumerate(ids[start:stop].tolist(), start):
                before, size = state, length
                state, length = self.machine.step(state, length, w)
                if length <= size and size >= self.min_match:
                    anchors += self._anchors(before, size, at)
                base += [(at + 1 - n, p) for p, n in self.ends[state] if n <= length]
            if length >= self.min_match:
                anchors += self._anchors(state, length, stop)
        return base, anchors

    def _anchors(self, state: int, size: int, end: int) -> list[tuple[int, int, int, int]]:
        return [(t, end - size, after - size, size) for t, after in self.places[state]]

    def spans(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of the chains that cover enough."""
        found = []
        for t in sorted({a[0] for a in anchors}):
            own = sorted((d, p, n) for u, d, p, n in anchors if u == t)
            whole = len(self.templates[t][0])
            best: list[tuple[int, int]] = []  # covered words, start of the chain
            reach: dict[int, tuple[int, int]] = {}  # by start of the chain: most covered, its end
            first = 0
            longest = max(n for _, _, n in own)
            for i, (d, p, n) in enumerate(own):
                while own[first][0] + longest + self.max_gap < d:
                    first += 1
                covered, start = n, d
                for j in range(first, i):
                    d0, p0, n0 = own[j]
                    lap = max(0, d0 + n0 - d, p0 + n0 - p)  # words that both anchors would cover
                    if d0 < d and p0 < p and lap < n and d - d0 - n0 <= self.max_gap and p - p0 - n0 <= self.max_gap and best[j][0] + n - lap > covered:
                        covered, start = best[j][0] + n - lap, best[j][1]
                best.append((covered, start))
                if covered >= self.coverage * whole:
                    reach[start] = max(reach.get(start, (0, 0)), (covered, d + n))
            found += [(self.templates[t][1], start, end, min(1.0, covered / whole)) for start, (covered, end) in sorted(reach.items())]
        return found


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE_PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    min_match: int = 3,
    max_gap: int = 8,
    coverage: float = 0.6,
) -> DataFrame:
    """One row per row of ``docs`` with base counts, labels, score and spans.

    ``score`` is the best covered share of a template, and 0.5 at least where a
    base phrase stands. ``spans`` lists the covered template spans by word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, min_match, max_gap, coverage))  # grows with the templates alone

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = shared.value
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            words = alnum_words(text)
            base, anchors = scanner.scan(words)
            spans = scanner.spans(anchors)
            base_labels = {scanner.phrases[p][1] for _, p in base}
            starts = [s for s, _ in base]
            score = max([0.5 * bool(base), *(s[3] for s in spans)])
            rows.append(
                (doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                 ",".join(sorted(base_labels | {s[0] for s in spans})), score,
                 [{"label": a, "start": b, "end": c, "covered": d} for a, b, c, d in spans])
            )
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label:string,start:bigint,end:bigint,covered:double>>"
    )
    return map_batches(docs, ["doc_id", "text"], run, schema)
