"""License scans: MinHash retrieval of notice templates over overlapping windows, then exact shingle containment.

Words are runs of ASCII letters and digits and of bytes above 127, in lower case; shingles are five words, a template
with fewer words is one shingle. Templates are put into classes by shingle count; a class's windows are twice its
largest template, a window starting at every such length, so every stretch as long as a template lies whole in one.
A stretch with containment of at least ``THRESHOLD`` has a Jaccard similarity of at least THRESHOLD / (2 + 1 -
THRESHOLD) with its window if its template is the class's largest, and of half of it if it is the smallest. With
bands of one row, ``HASHES`` bands miss it with a probability under (1 - that) ** HASHES. Retrieved pairs are
verified exactly: matches are the maximal runs of positions where a stretch holds enough of the template's shingles.

One row per document and template that matches, with the number of separate places and the best containment; templates
with equal containment have one each, repeated rows give repeated results. Null, empty and blank texts and an empty table
match nothing; texts of any length are read whole. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups_of, shingles, utf8, word_hashes

WORDS = 5
THRESHOLD = 0.8
HASHES = 24

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Default templates: public notices and short licence texts by SPDX-like name. Callers pass their own for more.
TEMPLATES: dict[str, str] = {
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + _BSD_THIRD + _BSD_END,
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC-text": _ISC,
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-text": _MIT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission",
}

_keep = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(text.lower().translate(_keep))


class Index:
    """Templates by class, with the minimum of each hash over each template's shingles."""

    def __init__(self, templates: dict[str, str], words: int = WORDS, hashes: int = HASHES) -> None:
        self.names, self.words = sorted(templates), words
        rng = np.random.default_rng(7)
        self.mult = rng.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        self.sets, self.sizes = [], []
        for n in self.names:
            h = words_of(templates[n].encode())[0]
            self.sizes.append(max(1, len(h) - words + 1))
            self.sets.append((np.unique(shingles(h, words)), min(words, len(h))))
        self.classes: dict[tuple[int, int], list[int]] = {}
        for i, (s, k) in enumerate(self.sets):
            if len(s):
                self.classes.setdefault((k, 1 << (len(s) - 1).bit_length()), []).append(i)
        self.minima = {c: [np.array([self._hash(j, self.sets[i][0]).min() for i in m]) for j in range(hashes)] for c, m in self.classes.items()}

    def _hash(self, j: int, s: np.ndarray) -> np.ndarray:
        x = (s ^ (s >> np.uint64(29))) * self.mult[j]
        return x ^ (x >> np.uint64(32))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first and end shingle of a window, words of a shingle) over a sequence of words."""
        out = []
        for k in sorted({k for k, _ in self.classes}):
            if len(words) < k:
                continue
            s = shingles(words, k)
            for j in range(len(self.mult)):
                h = self._hash(j, s)
                for (own_k, span), members in self.classes.items():
                    if own_k != k:
                        continue
                    low = np.minimum.reduceat(h, np.arange(0, len(h), span)) if span > 1 else h
                    both = np.minimum(low, np.append(low[1:], low[-1]))
                    minima = self.minima[own_k, span][j]
                    order = np.argsort(minima)
                    own = minima[order]
                    at = np.minimum(np.searchsorted(own, both), len(own) - 1)
                    for w in np.flatnonzero(own[at] == both):
                        out += [(members[m], int(w) * span, (int(w) + 2) * span, k) for m in np.flatnonzero(minima == both[w])]
        return out

    def matches_many(self, texts: list[bytes], threshold: float = THRESHOLD) -> list[tuple[int, str, int, float]]:
        """(text, template, places, best containment). Windows run on over the texts' ends, which only adds candidates."""
        words = [words_of(t)[0] for t in texts]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        pairs = set()
        for i, a, b, k in self.candidates(np.concatenate(words) if words else np.zeros(0, np.uint64)):
            lo, hi = np.searchsorted(first, [a, b + k], "right") - 1
            pairs.update((d, i, k) for d in range(max(lo, 0), min(hi, len(texts) - 1) + 1))
        out = []
        for d, i, k in sorted(pairs):
            if len(words[d]) >= k and (found := self._verify(shingles(words[d], k), i, threshold)):
                out.append((d, self.names[i], *found))
        return sorted(out)

    def matches(self, text: bytes, threshold: float = THRESHOLD) -> list[tuple[str, int, float]]:
        return [m[1:] for m in self.matches_many([text], threshold)]

    def _verify(self, s: np.ndarray, i: int, threshold: float) -> tuple[int, float] | None:
        template = self.sets[i][0]
        at = np.flatnonzero(np.isin(s, template))
        need, wide = int(np.ceil(threshold * len(template) - 1e-9)), int(np.ceil(self.sizes[i] * (2 - threshold)))
        if len(at) < need:
            return None
        places, best, i, last = 0, 0, 0, -1
        for a in range(len(at)):
            b = int(np.searchsorted(at, at[a] + wide))
            if b - a < need:
                continue
            n = len(np.unique(s[at[a:b]]))
            if n >= need:
                best = max(best, n)
                if at[a] > last:
                    places += 1
                    last = at[b - 1]
        return (places, best / len(template)) if places else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, places and containment. The templates are a parameter and are sent with the code."""
    index = Index(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch)
            rows = [(i + m[0], *m[1:]) for i, j in groups_of([len(t) for t in texts], 1 << 18) for m in index.matches_many(texts[i:j], threshold)]
            yield pa.record_batch({
                "doc_id": batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                "template": pa.array([r[1] for r in rows], pa.string()),
                "places": pa.array([r[2] for r in rows], pa.int64()),
                "containment": pa.array([r[3] for r in rows], pa.float64()),
            })

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, template string, places long, containment double")
