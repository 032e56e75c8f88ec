"""License scan: winnowed fingerprints of templates select candidates, a banded alignment decides.

Templates are cut into words; of every ``window`` neighbouring word triples the one with the least hash is a fingerprint.
The inverted index from triples to (template, place) is small and fixed, and travels with the tasks. A document's triples are
looked up in it; hits of one template on neighbouring diagonals are one candidate, if they cover enough of its fingerprints.
A candidate is aligned with the template inside a band around its diagonal (match 2, others -1, local), and reported with
the share of template words that match and the span in the text (code points) when the share is at least ``least``.

Null texts count as empty and have no match. Every row is scanned by itself, whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from levyscope.llm.common import rows, texts

#: Texts of common licences and notices.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
A_WORD = re.compile(r"[A-Za-z0-9]+")


class Match(NamedTuple):
    template: str
    start: int
    end: int
    coverage: float

    def __str__(self):
        return f"{self.template}:{self.start}:{self.end}:{self.coverage:.3f}"


class Index:
    """Inverted index of winnowed triples."""

    def __init__(self, templates: dict[str, str], window: int = 4):
        self.names = list(templates)
        cut = [[w.lower() for w in A_WORD.findall(t)] for t in templates.values()]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for words in cut for w in words), 1)}
        self.base = len(self.ids) + 1
        self.words = [np.array([self.ids[w] for w in words]) for words in cut]
        places = defaultdict(list)
        self.size = []
        for number, words in enumerate(self.words):
            triples = self.triples(words)
            hashes = [xxhash.xxh64_intdigest(int(t).to_bytes(8)) for t in triples]
            chosen = set()
            for i in range(max(1, len(hashes) - window + 1)):
                part = hashes[i : i + window]
                chosen.add(i + max(k for k, h in enumerate(part) if h == min(part)))
            self.size.append(len(chosen))
            for i in sorted(chosen):
                places[int(triples[i])].append((number, i))
        self.keys = np.array(sorted(places))
        self.places = [places[int(k)] for k in self.keys]

    def triples(self, ids: np.ndarray) -> np.ndarray:
        """Number of every three neighbouring words; -1 if one is in no template."""
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        key = (a * self.base + b) * self.base + c
        return np.where((a > 0) & (b > 0) & (c > 0), key, -1)

    def candidates(self, ids: np.ndarray, band: int, least_hits: float) -> list[tuple[int, int]]:
        """(template, diagonal) of groups of hits that cover ``least_hits`` of a template's fingerprints."""
        if len(ids) < 3:
            return []
        triples = self.triples(ids)
        at = np.minimum(np.searchsorted(self.keys, triples), len(self.keys) - 1)
        diagonals = defaultdict(list)
        for i in np.flatnonzero(self.keys[at] == triples).tolist():
            for number, place in self.places[at[i]]:
                diagonals[number].append((i - place, place))
        found = []
        for number, hits in diagonals.items():
            hits.sort()
            group: list[tuple[int, int]] = []
            for hit in [*hits, None]:
                if group and (hit is None or hit[0] - group[-1][0] > band):
                    if len({p for _, p in group}) >= least_hits * self.size[number]:
                        found.append((number, group[len(group) // 2][0]))
                    group = []
                group.append(hit)
        return found


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and one after last word in ``doc`` of the best local alignment within the band."""
    width = 2 * band + 1
    # a cell is (score, matches, first word); cell k of row i is doc word i + diagonal + k - band
    none = (0, 0, -1)
    above, best = [none] * (width + 1), (0, 0, 0, 0)
    t, n = template.tolist(), len(doc)
    for i, word in enumerate(t):
        row, left = [], none
        for k in range(width):
            j = i + diagonal + k - band
            if not 0 <= j < n:
                row.append(none)
                left = none
                continue
            s, m, f = above[k]
            if doc[j] == word:
                cell = (s + 2, m + 1, f if f >= 0 else j)
            else:
                cell = max((s - 1, m, f), (above[k + 1][0] - 1, *above[k + 1][1:]), (left[0] - 1, *left[1:]))
                if cell[0] <= 0:
                    cell = none
            row.append(cell)
            left = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        above = [*row, none]
    return best[1:]


def scan_text(text: str, index: Index, band: int = 8, least_hits: float = 0.3, least: float = 0.8) -> list[Match]:
    """Matches by start, end and template, without those that lie in a longer or equally long better one."""
    ids = np.array([index.ids.get(w, 0) for w in A_WORD.findall(text.lower())] if text.isascii() else index_words(text, index), np.int64)
    matches, spots = set(), None
    for number, diagonal in index.candidates(ids, band, least_hits):
        words = index.words[number]
        n, first, last = align(words, ids, diagonal, band)
        if n >= least * max(len(words), last - first):  # words left out of the template count like words missing
            if spots is None:
                spots = [m.span() for m in A_WORD.finditer(text)]
            share = n / max(len(words), last - first)
            matches.add(Match(index.names[number], spots[first][0], spots[last - 1][1], share))

    def hidden(m: Match, by: Match) -> bool:
        inside = by.start <= m.start and m.end <= by.end
        return inside and (by.end - by.start, by.coverage) > (m.end - m.start, m.coverage)

    return sorted((m for m in matches if not any(hidden(m, o) for o in matches)), key=lambda m: (m.start, m.end, m.template))


def index_words(text: str, index: Index) -> list[int]:
    """Word numbers; letters beyond ASCII could change length in lower case, so words are lowered one by one."""
    return [index.ids.get(w.lower(), 0) for w in A_WORD.findall(text)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, n_matches and matches (template:start:end:coverage, comma-joined) for every row of ``docs``."""
    index = Index(TEMPLATES if templates is None else templates)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            found = [scan_text(t, index, least=least) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(map(str, f)) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_matches", "matches"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_matches long, matches string")
