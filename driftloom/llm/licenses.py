"""Operator 4: licence scans by the Dice coefficient over word bigrams.

A passage (a line, a block of lines between blank ones, a whole text, or the run of words anywhere in it that is nearest
to a template) is normalised to lower-case words and compared with each template: twice the shared bigrams over all bigrams, counted with repeats. A coefficient of ``LEAST`` bounds the size:
a passage with fewer than LEAST / (2 - LEAST) or more than (2 - LEAST) / LEAST times the bigrams of a template can't
reach it, and the passage must hold that first share of the template's own bigrams. So it holds one of any words
that cover the rest of them, and texts without any such word are passed over by one pattern search. The nearest run
begins and ends with a bigram of the template, so only such bounds are tried, all of them where enough bigrams follow.

The templates are a parameter; the default ones are notices and whole texts of common licences (the long ones are files in
``templates``). They are sent to the executors, bounded by
``MOST_TEMPLATES`` of at most ``MOST_WORDS`` words (more raise an error).

Defined results: null, empty and blank texts hold no licence; one row per text and licence found, with its best
passage (ties: the earliest, then the shortest); repeated rows are scanned apart; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, spread, table

LEAST = 0.8
MOST_TEMPLATES, MOST_WORDS = 1000, 20_000

# Public licence texts and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}

TEMPLATES |= {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted(files(__package__).joinpath("templates").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}

_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    """Word pairs with repeats; a single word is its own."""
    return Counter(zip(words[:-1], words[1:], strict=True)) if len(words) != 1 else Counter([(words[0], "")])


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        words = {k: normalised(t) for k, t in templates.items()}
        if len(words) > MOST_TEMPLATES or any(len(w) > MOST_WORDS for w in words.values()):
            raise ValueError("too many or too long templates to send to every executor")
        self.least = least
        self.templates = sorted((k, bigrams(w)) for k, w in words.items() if w)
        self.share = least / (2 - least)
        self.anchors: set[str] = set()
        for _, b in sorted(self.templates, key=lambda x: x[1].total()):
            self._anchor(b)
        # Whole words; letters beyond ASCII count as none here, which only lets more texts through.
        self.pattern = "(?i)(?:^|[^a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(self.anchors)) + ")(?:[^a-z0-9]|$)" if self.anchors else "$^"
        self.fewest = min((b.total() for _, b in self.templates), default=0) * self.share
        self.most = max((b.total() for _, b in self.templates), default=0) / self.share
        #: Templates by bigram: number of the template, and repeats of the bigram in it.
        self.holders: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, (_, b) in enumerate(self.templates):
            for pair, n in b.items():
                self.holders.setdefault(pair, []).append((i, n))
        self.singles = {w for w, second in self.holders if not second}

    def _anchor(self, pairs: Counter) -> None:
        """Add words that touch, with those there already, more than 1 - share of the bigrams: a match must hold one of them.

        Words of seven letters or more come first, those that touch most of what is left before others.
        """
        left = Counter(pairs)
        for w in self.anchors:
            left = Counter({p: n for p, n in left.items() if w not in p})
        while left.total() and left.total() >= pairs.total() * self.share:
            touched: Counter = Counter()
            for pair, n in left.items():
                for w in {*pair} - {""}:
                    touched[w] += n
            w = max(touched, key=lambda w: (touched[w] * (len(w) >= 7), len(w), w))
            self.anchors.add(w)
            left = Counter({p: n for p, n in left.items() if w not in p})

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, start, end) of the best passage of each licence that is found."""
        best: dict[str, tuple[float, int, int]] = {}
        for a, b in passages(text, self):
            words = normalised(text[a:b])
            n = max(1, len(words) - 1)
            if not words or not self.fewest <= n <= self.most or self.anchors.isdisjoint(words):
                continue
            own = bigrams(words)
            for name, pairs in self.templates:
                size = pairs.total()
                if self.share * size <= n <= size / self.share:
                    d = dice(own, pairs)
                    if d >= self.least and (name not in best or (-d, a, b) < (-best[name][0], *best[name][1:])):
                        best[name] = (d, a, b)
        return [(k, *v) for k, v in sorted(best.items())]


def passages(text: str, scanner: Scanner | None = None) -> Iterator[tuple[int, int]]:
    """``parts`` of the text and the runs of words nearest to each of the templates, but for runs that are a part's words."""
    scanner = scanner or _default()
    own = list(parts(text))
    yield from own
    words, begin, end = [], [], []
    for m in _WORD.finditer(text):
        for w in normalised(m[0]):
            words.append(w)
            begin.append(m.start())
            end.append(m.end())
    runs = windows(words, scanner)
    if runs:
        known = {(bisect_left(begin, a), bisect_left(begin, b)) for a, b in own}
        yield from sorted({(begin[i], end[j - 1]) for i, j in runs if (i, j) not in known})


def parts(text: str) -> Iterator[tuple[int, int]]:
    """Lines, blocks of two or more lines between blank ones, and the whole text if it isn't one of these."""
    at, block, lines = 0, None, 0
    found = set()
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            block, lines = at if block is None else block, lines + 1
            last = end
            found.add((at, end))
            yield at, end
        elif block is not None:
            if lines > 1:
                found.add((block, last))
                yield block, last
            block, lines = None, 0
        at = end + 1
    if lines > 1:
        found.add((block, last))
        yield block, last
    if text.strip() and (0, len(text)) not in found:
        yield 0, len(text)


@cache
def _default() -> Scanner:
    return Scanner(TEMPLATES)


def windows(words: list[str], scanner: Scanner) -> set[tuple[int, int]]:
    """(first word, one past the last) of the run nearest to each template that is reached: the earliest, then shortest."""
    at: dict[int, list[tuple[int, int]]] = {}  # by template: place of a bigram, place of its n-th last repeat
    seen: dict[tuple[str, str], list[int]] = {}
    for p, pair in enumerate(zip(words, words[1:], strict=False)):
        if pair in scanner.holders:
            earlier = seen.setdefault(pair, [])
            for i, n in scanner.holders[pair]:
                at.setdefault(i, []).append((p, earlier[-n] if len(earlier) >= n else -1))
            earlier.append(p)
    out = set()
    for w in scanner.singles.intersection(words):
        out.add((words.index(w), words.index(w) + 1))
    for i, found in at.items():
        size = scanner.templates[i][1].total()
        if len(found) < scanner.share * size:
            continue
        place, before = np.array(found).T
        most = int(size / scanner.share)
        last = np.searchsorted(place, place + most)  # the run has ``most`` bigrams at most
        best = None
        for k in np.flatnonzero(last - np.arange(len(place)) >= scanner.share * size).tolist():
            ends = slice(k, last[k])
            shared = np.cumsum(before[ends] < place[k])
            d = 2 * shared / (place[ends] - place[k] + 1 + size)
            m = int(d.argmax())
            if d[m] >= scanner.least - 1e-9 and (best is None or d[m] > best[0]):
                best = d[m], int(place[k]), int(place[k + m]) + 2
        if best:
            out.add(best[1:])
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, dice, start, end): code points of the best passage."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, least))
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            held = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), scanner.pattern), False))
            rows = [(i, *x) for i, t in zip(held.column("doc_id").to_pylist(), held.column("text").to_pylist(), strict=True) for x in scanner.scan(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "dice", "start", "end"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, dice double, start long, end long")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))


QUERIES = {"op4_licenses": op4_licenses}
ORACLES: dict[str, str] = {}
