"""Scans for licenses: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A text is cut into windows of twice as many shingles as a template has, which
overlap so that each stretch of 1.25 times its length lies wholly inside one of
them.  Windows that agree with a template in one MinHash band at least are
candidates.  Templates of five words or fewer are one shingle, of that many
words, and found exactly.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import as_bytes

SHINGLE = 5
#: A template is found where this share of its shingles is.
CONTAINMENT = 0.8
#: Chance that a window with this share of a template agrees with it in no band.
MISS = 1e-5
#: Shingles that are permuted at once (those of a long text, or of several), texts whose shingles a task holds, bits of the tables of band keys.
BLOCK = 1 << 13
TEXTS = 256
TABLE_BITS = 16


def resemblance(containment: float) -> float:
    """The least resemblance of a template of m shingles and a window of 2 m that has such a share of them, whatever m is."""
    return containment / (3 - containment)


#: A band is one MinHash value: at a resemblance of 0.36, two values a band would need three times the permutations for the same MISS.
BANDS = math.ceil(math.log(MISS) / math.log(1 - resemblance(CONTAINMENT)))

#: Licenses and notices as their authors publish them (fixed values).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "boost-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the runs of SHINGLE words (ASCII letters lower-cased, punctuation aside); of all words if there are fewer."""
    return _runs(_word_hashes(text), SHINGLE)


def _word_hashes(text: bytes) -> np.ndarray:
    words = _TOKEN(text.translate(_LOWER))
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, given those of the words; of all words if there are fewer."""
    size = min(size, len(h))
    if not size:
        return np.empty(0, np.uint64)
    n = len(h) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + n]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _permuted(h: np.ndarray) -> np.ndarray:
    """(BANDS, n): 32 bits of the hashes under as many random permutations (multiply and add, odd factors)."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, BANDS, dtype=np.uint64)
    x = h ^ (h >> np.uint64(32))
    out = np.empty((BANDS, len(h)), np.uint32)
    for k in range(BANDS):
        out[k] = (x * a[k] + b[k]) >> np.uint64(32)
    return out


class Bands:
    """The bands of templates of one size, by key; a table of the keys' last bits tells at once that most keys aren't there."""

    def __init__(self, sets: Mapping[int, np.ndarray]):
        keys = np.stack([_permuted(s).min(axis=1) for s in sets.values()])
        flat, band, owner = keys.ravel(), np.tile(np.arange(BANDS), len(sets)), np.repeat(list(sets), BANDS)
        order = np.argsort(flat, kind="stable")
        self.keys, self.band, self.owner = flat[order], band[order], owner[order]
        self.last = np.uint32((1 << TABLE_BITS) - 1)
        self.there = np.zeros(1 << TABLE_BITS, bool)
        self.there[flat & self.last] = True

    def agreeing(self, keys: np.ndarray) -> set[tuple[int, int]]:
        """(window, template) that agree in a band, given the windows' keys (BANDS, windows)."""
        band, window = np.nonzero(self.there[keys & self.last])
        wanted = keys[band, window]
        first, end = np.searchsorted(self.keys, wanted), np.searchsorted(self.keys, wanted, side="right")
        found = set()
        for k in np.flatnonzero(first < end).tolist():
            for at in range(first[k], end[k]):
                if self.band[at] == band[k]:
                    found.add((int(window[k]), int(self.owner[at])))
        return found


class Scanner:
    """Templates, their bands, and the search for them in texts."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.sets = [np.unique(shingles(templates[n].encode())) for n in self.names]
        #: Templates of one shingle by its words, found where it is; all others by their number of shingles.
        self.single: dict[int, list[int]] = defaultdict(list)
        classes: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for k, s in enumerate(self.sets):
            if len(s) == 1:
                self.single[min(SHINGLE, len(_word_hashes(templates[self.names[k]].encode())))].append(k)
            elif len(s):
                classes[len(s)][k] = s
        self.bands = {m: Bands(members) for m, members in sorted(classes.items())}
        self.longest = 2 * max(self.bands, default=0)

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first shingle, end) of the windows of one text that agree with a template in a band."""
        return [c[1:] for c in self.retrieved([h])]

    def retrieved(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, first shingle, end) of the windows that agree with a template in a band.

        Texts, given by their shingles, are searched many at once; long ones
        block by block, where a window that begins in one may end in the next.
        """
        pieces, held = [], 0
        for t, h in enumerate(texts):
            for base in range(0, len(h) if self.bands else 0, BLOCK):
                piece = h[base : base + BLOCK + self.longest]
                if held and held + len(piece) > BLOCK:
                    yield from self._in_pieces(pieces)
                    pieces, held = [], 0
                pieces.append((t, base, piece))
                held += len(piece)
        if pieces:
            yield from self._in_pieces(pieces)

    def _in_pieces(self, pieces: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
        """Minima over all windows of a size come from minima over stretches of half to all of it, doubled from size to size."""
        n = np.array([len(h) for *_, h in pieces])
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        block, size = _permuted(np.concatenate([h for *_, h in pieces])), 1
        whole = np.minimum.reduceat(block, at, axis=1)
        for m, bands in self.bands.items():
            length, step = 2 * m, m - m // 4 + 1
            # Texts that are no longer than a window are one; of others, the last window ends with the text.
            short, long = np.flatnonzero(n <= length), np.flatnonzero(n > length)
            count = -(-(n[long] - length) // step) + 1
            piece = np.concatenate((short, np.repeat(long, count)))
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.concatenate((np.zeros(len(short), np.int64), np.minimum(k * step, np.repeat(n[long] - length, count))))
            keys = whole[:, short]
            if len(long):
                while 2 * size <= length:
                    block, size = np.minimum(block[:, :-size], block[:, size:]), size * 2
                first = (at[piece] + start)[len(short) :]
                keys = np.concatenate((keys, np.minimum(block[:, first], block[:, first + length - size])), axis=1)
            for w, template in sorted(bands.agreeing(keys)):
                text, base, _ = pieces[piece[w]]
                begin = int(start[w])
                yield text, template, base + begin, base + min(begin + length, int(n[piece[w]]))

    def scan(self, text: bytes) -> list[tuple[str, int, float]]:
        """(template, first word of the best place, containment) for each template found in one text."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[bytes]) -> list[list[tuple[str, int, float]]]:
        """What is found in each text: bands retrieve templates, their exact shingles verify them."""
        words = [_word_hashes(t) for t in texts]
        runs = [_runs(w, SHINGLE) for w in words]
        best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for size, members in self.single.items():
            for t, w in enumerate(words):
                short = runs[t] if size == SHINGLE else _runs(w, size)
                for k in members:
                    at = np.flatnonzero(short == self.sets[k][0])
                    if len(at):
                        best[t][k] = (1.0, -int(at[0]))
        for t, template, start, end in self.retrieved(runs):
            self._verify(runs[t], template, start, end, best[t])
        return [[(self.names[k], -at, share) for k, (share, at) in sorted(b.items())] for b in best]

    def _verify(self, h: np.ndarray, template: int, start: int, end: int, best: dict[int, tuple[float, int]]) -> None:
        """Note the best place in a window at which there is the wanted share of a template's shingles."""
        wanted = self.sets[template]
        length = len(wanted) + len(wanted) // 4
        near = h[start : end + length]
        where = np.minimum(np.searchsorted(wanted, near), len(wanted) - 1)
        there = wanted[where] == near
        if there.sum() < CONTAINMENT * len(wanted):
            return
        # A template's place may begin anywhere in the window, so its own length is looked at from each start.
        inside = there[: end - start]
        for s in np.flatnonzero(inside):
            if s and inside[s - 1] and (template in best) and best[template][0] == 1.0:
                continue
            share = len(np.unique(where[s : s + length][there[s : s + length]])) / len(wanted)
            if share >= CONTAINMENT:
                best[template] = max(best.get(template, (0.0, 0)), (share, -(start + int(s))))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Templates found in each document: ``doc_id, license, first_word, containment``, a row for each.

    A template is found where a stretch of at most 1.25 times its length has
    80 % of its five-word shingles (one of under five words: where these stand
    in a row); ``containment`` is the largest share,
    ``first_word`` (from 0, punctuation aside) the first place with it.  Words
    are compared in lower case without punctuation.  Documents without any,
    null and empty texts among them, give no row; repeated rows give theirs
    again; null ids stay null; further columns are ignored.  Templates are a
    fixed list held by each task; very long texts are searched block by block.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    names = dict(templates)

    @F.pandas_udf("array<struct<license:string,first_word:bigint,containment:double>>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(names)
        for batch in batches:
            out: list[list[dict]] = []
            for at in range(0, len(batch), TEXTS):
                out += [[{"license": n, "first_word": w, "containment": c} for n, w, c in found] for found in scanner.scan_all(batch.iloc[at : at + TEXTS].to_list())]
            yield pd.Series(out, dtype=object)

    return source.select("doc_id", F.explode(scanned("text")).alias("found")).select("doc_id", "found.license", "found.first_word", "found.containment")
