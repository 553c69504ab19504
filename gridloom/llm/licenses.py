"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Of every `window` neighbouring
hashes of `gram`-word grams the least are kept (all of them in a tie), for templates and texts alike, so any common
run of `gram + window - 1` words shares a fingerprint. The templates' fingerprints form an inverted index.
Fingerprints that a text shares with a template are grouped by diagonal; around each group an alignment in a
band of `band` words on either side finds the most template words in order. A match has at least `coverage`
of the template's words. The band is a third of the template's words where that is less than `band`, so that two
places of a one-line notice next to each other are two matches.

Templates are few and fixed by the caller, so their index is part of every task; `most_template_words` bounds
it, and more than that is an error.

The default templates are whole short licenses, and the notices and one-line references that files carry for long ones.
The bodies of long licenses (Apache, GPL, MPL and the like) aren't among them; give those as `templates`.

Defined results: null, empty and short texts match nothing. Every document row gives its own matches; rows
without a match have none. Overlapping groups of one template give one match, the better one. Ties: the
first place, then the template's name. Input columns with the name of an output column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NOT_ALNUM, Rolling, Words, chunks, others, quoted, sliding_min, spread, table, texts

ADDED = ["licenses"]
MATCH = "array<struct<template:string,matched:int,coverage:double,start:int,stop:int,spans:array<struct<start:int,stop:int>>>>"

#: Short licenses in whole, and notices as they stand in files, without names and years.
TEMPLATES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "AGPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General
Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR
OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public
Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.""",
    "EPL-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def winnowed(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window inside one text."""
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = Rolling(words.buffer).spans(words.begin[:n], words.end[gram - 1 :])
    whole = words.document[:n] == words.document[gram - 1 :]
    padded = np.where(whole, h, np.uint64(2**64 - 1))
    # a gram is kept if it is least among some `window` grams; texts with fewer grams keep their least
    wide = np.concatenate([np.full(window - 1, np.uint64(2**64 - 1)), padded, np.full(window - 1, np.uint64(2**64 - 1))])
    keep = np.zeros(n, dtype=bool)
    least = sliding_min(wide, window)
    for k in range(window):
        keep |= least[k : k + n] == padded
    at = np.flatnonzero(keep & whole)
    return at, h[at]


def banded(template: list[bytes], text: list[bytes], shift: int, band: int) -> list[tuple[int, int]]:
    """Most equal words in order, as (template index, text index), within `band` of the diagonal
    `text = template + shift`. Ties prefer the diagonal, so blocks stay whole."""
    width = 2 * band + 1
    best = [[0] * (width + 2) for _ in range(len(template) + 1)]
    for i in range(len(template) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for b in range(width - 1, -1, -1):
            j = i + shift + b - band
            take = below[b + 1] + 1 if 0 <= j < len(text) and template[i] == text[j] else -1
            row[b + 1] = max(take, below[b], row[b + 2])  # (i+1, j) is one place lower in the band
    i, b, out = 0, 0, []
    while i < len(template) and b < width:
        j = i + shift + b - band
        here = best[i][b + 1]
        if not here:
            break
        if 0 <= j < len(text) and template[i] == text[j] and best[i + 1][b + 1] + 1 == here:
            out.append((i, j))
            i += 1
        elif best[i][b + 2] == here:
            b += 1
        else:
            i, b = i + 1, b - 1
            if b < 0:
                b = 0
    return out


class Index:
    def __init__(self, templates: dict[str, str], gram: int, window: int, most_words: int):
        self.gram, self.window = gram, window
        self.names = sorted(templates)
        words = Words([templates[n].encode() for n in self.names], NOT_ALNUM, lower=True)
        if len(words) > most_words:
            raise ValueError(f"templates have {len(words)} words; most_template_words is {most_words}")
        self.words = [[words.bytes[words.begin[i] : words.end[i]] for i in range(words.first[t], words.first[t + 1])] for t in range(len(self.names))]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, h in zip(*(x.tolist() for x in winnowed(words, gram, window)), strict=True):
            t = int(words.document[i])
            self.places[h].append((t, i - int(words.first[t])))
        self.hashes = np.array(sorted(self.places), dtype=np.uint64)

    def candidates(self, words: Words):
        """(text, template) to the (template place, text place) of shared fingerprints."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        at, h = winnowed(words, self.gram, self.window)
        if len(self.hashes) and len(at):
            near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[near] == h
            for i, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                d = int(words.document[i])
                for t, p in self.places[x]:
                    out[d, t].append((p, i - int(words.first[d])))
        return out

    def matches(self, words: Words, d: int, t: int, shared: list[tuple[int, int]], band: int, coverage: float) -> list[dict]:
        template, first, stop = self.words[t], int(words.first[d]), int(words.first[d + 1])
        band = min(band, max(1, len(template) // 3))  # so that two places of a short template stay apart
        shifts = sorted({j - p for p, j in shared})
        groups, start = [], shifts[0]
        for a, b in zip(shifts, [*shifts[1:], None], strict=True):
            if b is None or b - start > band:
                groups.append((start + a) // 2)
                start = b
        found = []
        for shift in groups:
            low = max(0, shift - band)
            high = min(stop - first, shift + len(template) + band)
            text = [words.bytes[words.begin[first + j] : words.end[first + j]] for j in range(low, high)]
            pairs = banded(template, text, shift - low, band)
            if len(pairs) >= coverage * len(template) and pairs:
                spans: list[dict] = []
                for _, j in pairs:
                    if spans and spans[-1]["stop"] == j + low:
                        spans[-1]["stop"] += 1
                    else:
                        spans.append({"start": j + low, "stop": j + low + 1})
                found.append({"template": self.names[t], "matched": len(pairs), "coverage": len(pairs) / len(template), "start": spans[0]["start"], "stop": spans[-1]["stop"], "spans": spans})
        out: list[dict] = []  # by start, none overlapping
        for m in sorted(found, key=lambda m: (-m["matched"], m["start"])):
            k = bisect_left(out, m["start"], key=lambda o: o["start"])
            if (k == 0 or out[k - 1]["stop"] <= m["start"]) and (k == len(out) or m["stop"] <= out[k]["start"]):
                out.insert(k, m)
        return out


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, gram: int = 3, window: int = 3, band: int = 8, coverage: float = 0.8, most_template_words: int = 200_000, keep: list[str] | None = None) -> DataFrame:
    """All rows, of them the columns `keep` or else all, with `licenses`: matches with word spans."""
    templates = dict(TEMPLATES if templates is None else templates)
    Index(templates, gram, window, most_template_words)  # an error here if they are too long
    keep = others(docs, ADDED) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(templates)  # plain texts, of `most_template_words` words at most
    kind = pa.list_(pa.struct([("template", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))

    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, gram, window, most_template_words)
        for column in columns:
            out = []
            for part in chunks([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
                words = Words(texts(part), NOT_ALNUM, lower=True)
                rows: list[list] = [[] for _ in range(part.num_rows)]
                for (d, t), places in sorted(index.candidates(words).items()):
                    rows[d] += index.matches(words, d, t, places, band, coverage)
                out += [sorted(r, key=lambda m: (m["start"], m["template"])) for r in rows]
            yield pa.array(out, kind)

    found.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}  # as types, which the decorator reads
    scanned = F.arrow_udf(found, MATCH)
    return docs.select(*quoted(keep), scanned(F.col(f"`{text}`").cast("string")).alias("licenses"))


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # a plain explode would have the optimiser filter by the scan's result first, and so scan twice
    hits = scan(docs, keep=["doc_id"]).select("doc_id", F.explode_outer("licenses").alias("m")).where("m IS NOT NULL")
    return hits.select("doc_id", "m.template", "m.matched", "m.coverage", "m.start", "m.stop")
