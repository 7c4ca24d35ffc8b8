"""License scans by Dice coefficient over word bigrams (operator 9).

Texts and templates are normalised alike: lower case, words of letters and digits, a few spellings unified. A template's
bigrams mark the places of a text where it can occur. A passage with b bigrams can reach a Dice coefficient of t against a
template with m bigrams only if t / (2 - t) <= b / m <= (2 - t) / t and if it holds m * t / (2 - t) marked places, however
far apart; starts without so many places within the bound are pruned by a sliding count before any bigrams are compared.
From every other start all ends within the bound are compared, so inserts and replacements of any length that leave the
coefficient at t or above do not hide a passage.

Every whole text is read in one pass; the templates are a fixed list of notices and short licenses in this module, or a table
(:func:`template_table`), for full texts and further versions. Defined results: null, empty and
blank texts have no licenses; of ties the earlier and then the longer passage is reported, and every passage that does
not overlap a better one that is reported is reported too; repeated rows are scanned each for itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_SPELLING = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "noncommercial": "nc", "v2": "2.0", "v3": "3"}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD3 = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
#: (license, text); several texts a license may have.
TEMPLATES = (
    ("MIT", _MIT),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-2.0", _GPL.format(v="2")),
    ("GPL-3.0", _GPL.format(v="3")),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
        such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "EPL-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
    ),
    (
        "PostgreSQL",
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written
        agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all
        copies.""",
    ),
    (
        "LGPL-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
        A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
        A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    ),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
)


#: Characters of a template table that are sent to the workers.
MOST_CHARACTERS = 50_000_000


def template_table(templates: DataFrame) -> tuple[tuple[str, str], ...]:
    """Templates from a table (license, text), of any number of licenses and versions; its size is summed before it is read to the driver."""
    rows = templates.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"the templates have {size} characters, and {MOST_CHARACTERS} are sent to every worker at most")
    return tuple(sorted((r["license"], r["text"]) for r in rows.collect()))


def words_of(text: str | None) -> list[str]:
    return [_SPELLING.get(w, w) for w in _WORD.findall((text or "").lower())]


def dice(a: Counter, b: Counter) -> float:
    """2 |A and B| / (|A| + |B|) over multisets."""
    total = a.total() + b.total()
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total if total else 0.0


class Templates:
    """Bigrams of a list of templates, with an index from bigram to the templates that hold it."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least, self.names, self.bags = least, [], []
        self.index: dict[tuple[str, str], tuple[int, ...]] = {}
        for name, text in templates:
            w = words_of(text)
            bag = Counter(zip(w, w[1:], strict=False))
            if bag:
                for b in bag:
                    self.index[b] = (*self.index.get(b, ()), len(self.names))
                self.names.append(name)
                self.bags.append(bag)
        self.sizes = [b.total() for b in self.bags]

    def _best(self, k: int, at: list[int], i: int, bigrams: list[tuple[str, str]], limit: int) -> tuple[float, int] | None:
        """(dice, end word) of the best passage from hit i of template k that ends by word limit; of ties the longer."""
        size, bag, first = self.sizes[k], self.bags[k], at[i]
        spare = 2 * size * (1 - self.least) / self.least + 1e-9  # bigrams beside the template's that a passage of least can hold
        left: dict[tuple[str, str], int] = {}
        common, best = 0, None
        for j in range(i, len(at)):
            p = at[j]
            length = p - first + 1
            if p + 2 > limit or length - common - 1 > spare:
                break
            b = bigrams[p]
            n = left.get(b)
            if n is None:
                n = bag[b]
            if n:  # a passage that ends at another bigram is worse than its part
                left[b] = n - 1
                common += 1
                score = 2 * common / (size + length)
                if score >= self.least and (best is None or score >= best[0]):
                    best = score, p + 2
        return best

    def find(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(license, dice, first word, end word) of the passages of a text."""
        places: dict[int, list[int]] = {}
        get = self.index.get
        bigrams = list(zip(words, words[1:], strict=False))
        for i, b in enumerate(bigrams):
            for k in get(b, ()):
                places.setdefault(k, []).append(i)
        # The best passage of a place wins; whole templates beat the short notices inside them.
        heap: list[tuple] = []

        def offer(k: int, i: int, limit: int) -> None:
            if best := self._best(k, places[k], i, bigrams, limit):
                score, end = best
                heappush(heap, (-(score * min(1, self.sizes[k] / 8)), -self.sizes[k], places[k][i], -end, self.names[k], k, i, score))

        for k, at in places.items():
            size = self.sizes[k]
            need = ceil(size * self.least / (2 - self.least) - 1e-9)  # the bound on |A and B| that goes with the bound on sizes
            high = size * (2 - self.least) / self.least + 1e-9
            for i in range(len(at) - need + 1):
                if at[i + need - 1] - at[i] < high:
                    offer(k, i, len(words))
        starts: list[int] = []
        taken: list[tuple[str, float, int, int]] = []  # by first word, as starts
        while heap:
            _, _, a, end, name, k, i, score = heappop(heap)
            t = bisect_right(starts, a)
            if t and a < taken[t - 1][3]:
                continue
            limit = starts[t] if t < len(starts) else len(words)
            if -end > limit:
                offer(k, i, limit)
            else:
                starts.insert(t, a)
                taken.insert(t, (name, round(score, 6), a, -end))
        return taken


def licenses(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, first_word, end_word of every passage found."""
    known = Templates(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc, *x) for x in known.find(words_of(text))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "license", "dice", "first_word", "end_word"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, dice double, first_word long, end_word long"
    )
