"""Licence scan: Dice coefficient of word bigrams between normalised text and licence templates.

Text is lower-cased, words are runs of letters and digits. A template with b distinct bigrams is held against each
stretch of the text that starts at one of its bigrams and is as long as the template. The Dice
coefficient 2c / (a + b) can reach t only if the c common bigrams are at least t / (2 - t) times b
and times a; that size bound drops templates for a text, and stretches for a template, before any
set is built. Word and bigram hashes of a batch are made in numpy, so a text without enough template
bigrams costs no Python loop.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _vec
from ._base import need, quoted

#: What licences have in common that disclaim all warranty.
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Licences by SPDX identifier: the whole text of short ones, and the notices that the publishers of all ask for.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD_CONDITIONS),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_THIRD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_THIRD + _BSD_WARRANTY),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _MIT_WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the bigram that starts at each word but a text's last, number of the first bigram of each text, starts and ends of words)."""
    starts, ends, firsts = _vec.words(data, offsets, _vec.NOT_WORD)
    h = _vec.hashes(data, starts, ends)
    counts = np.diff(firsts)
    n = np.maximum(counts - 1, 0)
    first = np.concatenate(([0], np.cumsum(n)))
    if not len(h):
        return np.zeros(0, np.uint64), first, starts, ends
    at = np.arange(int(first[-1])) + np.repeat(firsts[:-1] - first[:-1], n)
    return _vec.join_hashes([h[at], h[at + 1]]) if len(at) else np.zeros(0, np.uint64), first, starts, ends


@dataclass(frozen=True)
class Template:
    name: str
    grams: np.ndarray  # sorted distinct
    length: int  # bigrams with repeats


def prepare(templates: tuple[tuple[str, str], ...]) -> tuple[list[Template], np.ndarray]:
    """The templates, and the sorted distinct bigrams of all."""
    out = []
    for name, text in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        g = bigrams(data, np.array([0, len(data)]))[0]
        if len(g):
            out.append(Template(name, np.unique(g), len(g)))
    return out, np.unique(np.concatenate([t.grams for t in out])) if out else np.zeros(0, np.uint64)


def _undone(found: list[tuple], grams: int) -> list[tuple]:
    """The matches but those that an overlapping match of another licence outdoes, whose template holds all of theirs: it finds most of what it has
    beyond that."""
    kinds = {x[5]: x[6] for x in found}
    holds = {(i, j) for i, t in kinds.items() for j, u in kinds.items() if t.name != u.name and len(t.grams) < len(u.grams) and np.isin(t.grams, u.grams).all()}
    if not holds:
        return found

    def outdone(x: tuple) -> bool:
        for j, u in kinds.items():
            if (x[5], j) not in holds:
                continue
            if (x[5], j) not in strong:
                small = len(x[6].grams)
                strong[x[5], j] = sorted(y[2] for y in found if y[5] == j and 2 * (y[4] - small) > len(u.grams) - small)
            near = strong[x[5], j]
            at = bisect_left(near, x[2] - u.length)
            if at < len(near) and near[at] <= x[3] and min(near[at] + u.length, grams) >= x[2]:
                return True
        return False

    strong: dict[tuple[int, int], list[int]] = {}
    return [x for x in found if not outdone(x)]


def scan_text(grams: np.ndarray, hits: np.ndarray, templates: list[Template], least: float) -> list[tuple[float, str, int, int]]:
    """(dice, licence, first bigram, end) of the stretches that match, best first of those that overlap; grams: of the
    text, hits: places in it of bigrams of any template."""
    found = []
    share = least / (2 - least)
    for number, t in enumerate(templates):
        need_ = math.ceil(share * len(t.grams) - 1e-9)
        if len(hits) < need_:
            continue
        at = hits[np.isin(grams[hits], t.grams)]
        if len(at) < need_:
            continue
        enough = np.searchsorted(at, at + t.length) - np.arange(len(at)) >= need_
        for s in at[enough].tolist():
            part = np.unique(grams[s : s + t.length])
            common = len(np.intersect1d(part, t.grams, assume_unique=True))
            dice = 2 * common / (len(part) + len(t.grams))
            if dice >= least:
                found.append((dice, t.name, s, min(s + t.length, len(grams)), common, number, t))
    found = sorted((x[:4] for x in _undone(found, len(grams))), key=lambda x: (-x[0], x[2] - x[3], x[2], x[1]))
    out: list[tuple[float, str, int, int]] = []
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for x in found:
        at = bisect_left(taken, (x[2], x[3]))
        if (at == 0 or taken[at - 1][1] < x[2]) and (at == len(taken) or x[3] < taken[at][0]):
            taken.insert(at, (x[2], x[3]))
            out.append(x)
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(id, matches, licenses, best_license, best_dice) for each row of docs.

    matches: array of (license, dice, start, end), places in bytes of the UTF-8 text, from the first matching word to the end of the last, in
    their order; of overlapping stretches the best stays. licenses: their distinct names, sorted. Null texts and texts without matches have
    none, and best_license null. The best of a tie is the first by name. Rows are scanned one by one, repeated ones and null ids
    too; very long texts are scanned whole, in time that grows with their length and the stretches worth a look. An empty
    table gives an empty table. Other columns are ignored.
    """
    need(docs, (id_col, text_col), "licenses.scan")
    match = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("matches", match), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("best_license", T.StringType()), T.StructField("best_dice", T.DoubleType())])
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, known = prepare(templates)
        maybe = np.zeros(1 << 16, bool)  # of the high bits: most bigrams end here
        maybe[(known >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            rows: list[list[dict]] = []
            for _, data, offsets in _vec.slices(batch.column(1)):
                g, first, starts, ends = bigrams(data, offsets)
                hit = np.flatnonzero(maybe[(g >> np.uint64(48)).astype(np.int64)])
                hit = hit[np.isin(g[hit], known)]
                cut = np.searchsorted(hit, first)
                words = np.searchsorted(starts, offsets)
                for i in range(len(offsets) - 1):
                    got = scan_text(g[first[i] : first[i + 1]], hit[cut[i] : cut[i + 1]] - first[i], ready, least) if cut[i + 1] > cut[i] else []
                    rows.append([{"license": n, "dice": d, "start": int(starts[words[i] + a] - offsets[i]), "end": int(ends[words[i] + b] - offsets[i])} for d, n, a, b in got])
            best = [min(((-m["dice"], m["license"]) for m in r), default=(None, None)) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array([sorted({m["license"] for m in r}) for r in rows], pa.list_(pa.string())), pa.array([b[1] for b in best], pa.string()), pa.array([None if b[0] is None else -b[0] for b in best], pa.float64())], out.names)

    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
