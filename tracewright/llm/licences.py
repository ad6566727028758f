"""License scans: normalised text against licence templates (operator 5).

Text and templates are lower-cased words. A template is compared by the Dice coefficient
over word bigrams (twice the common ones over the sum of both counts, as multisets) with
windows of words, wherever they stand in lines. A window of w bigrams can only reach the
threshold t with templates of between t w / (2 - t) and (2 - t) w / t bigrams, and has
t m / (2 - t) of a template's m bigrams at least. The best windows begin and end with a
bigram of the template, so only places where so many are near each other are looked at.
Windows of whole lines (scan) are kept beside them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

# Notices and short licence texts in public use, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "LicenseRef-all-rights-reserved": ["All rights reserved."],
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(ws: list[str]) -> Counter:
    """Pairs of neighbours; a single word is a pair with nothing."""
    return Counter(zip(ws, ws[1:], strict=False)) if len(ws) > 1 else Counter((w, "") for w in ws)


def dice(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return 2 * common / (sum(a.values()) + sum(b.values())) if common else 0.0


class Scanner:
    """Templates by size, with the lines that can matter to any of them."""

    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD):
        self.t = threshold
        forms = sorted(((bigrams(words(x)), name) for name, xs in templates.items() for x in xs if words(x)), key=lambda f: sum(f[0].values()))
        self.forms, self.sizes = forms, [sum(f[0].values()) for f in forms]
        self.known = {g for f, _ in forms for g in f}
        self.words = {g[0] for g in self.known}
        self.using: dict[tuple[str, str], list[int]] = {}
        for k, (f, _) in enumerate(forms):
            for g in f:
                self.using.setdefault(g, []).append(k)
        self.single = {g[0]: ks for g, ks in self.using.items() if not g[1]}
        self.longest = max(self.sizes, default=0) * (2 - threshold) / threshold

    def fitting(self, n: int) -> list[tuple[Counter, str]]:
        lo = bisect_left(self.sizes, self.t * n / (2 - self.t) - 1e-9)
        return self.forms[lo : bisect_right(self.sizes, (2 - self.t) * n / self.t + 1e-9)]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first line, last line) of the best window of each licence; of
        equal ones the first and shortest."""
        if not text or not self.forms:
            return []
        lines = [WORD.findall(x) for x in text.lower().split("\n")]
        known, hit, before = self.known, set(), -1
        for k, ws in enumerate(lines):
            if not ws:
                continue
            if len(ws) > 1:
                if not self.words.isdisjoint(ws) and not known.isdisjoint(zip(ws, ws[1:], strict=False)):
                    hit.add(k)
            elif (ws[0], "") in known:
                hit.add(k)
            # a pair over the end of a line makes both its lines hits
            if before >= 0 and (lines[before][-1], ws[0]) in known:
                hit |= {before, k}
            before = k
        hits = sorted(hit)
        best: dict[str, tuple[str, float, int, int]] = {}
        for i, lo in enumerate(hits):
            ws: list[str] = []
            at = lo
            for hi in hits[i:]:
                while at <= hi:
                    ws = ws + lines[at]
                    at += 1
                if len(ws) - 1 > self.longest:
                    break
                grams = None
                for form, name in self.fitting(max(1, len(ws) - 1)):
                    grams = grams if grams is not None else bigrams(ws)
                    d = dice(grams, form)
                    if d >= self.t and d > best.get(name, ("", 0.0))[1]:
                        best[name] = (name, d, lo, hi)
        return sorted(best.values(), key=lambda b: (-b[1], b[0]))

    def scan_words(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first line, last line) of the best window of words of each licence;
        of equal ones the first and shortest."""
        if not text or not self.forms:
            return []
        ws: list[str] = []
        line: list[int] = []
        for k, x in enumerate(text.lower().split("\n")):
            found = WORD.findall(x)
            ws += found
            line += [k] * len(found)
        pairs = list(zip(ws, ws[1:], strict=False))
        known, at = self.known, {}
        for k, g in enumerate(pairs):
            if g in known:
                for f in self.using[g]:
                    at.setdefault(f, []).append(k)
        best: dict[str, tuple[float, int, int]] = {}

        def better(name: str, d: float, lo: int, hi: int) -> None:
            best[name] = min(best.get(name, (0.0, 0, 0)), (-d, lo, hi))

        for k, w in enumerate(ws if self.single else ()):
            for f in self.single.get(w, ()):
                better(self.forms[f][1], 1.0, k, k)
        for f, places in at.items():
            (form, name), m = self.forms[f], self.sizes[f]
            need, most = math.ceil(self.t * m / (2 - self.t) - 1e-9), (2 - self.t) * m / self.t + 1e-9
            for i in range(len(places) - need + 1):
                lo = places[i]
                if places[i + need - 1] - lo + 1 > most:
                    continue
                seen: dict[tuple[str, str], int] = {}
                common = 0
                for k in range(i, len(places)):
                    n = places[k] - lo + 1
                    if n > most:
                        break
                    g = pairs[places[k]]
                    seen[g] = seen.get(g, 0) + 1
                    common += seen[g] <= form[g]
                    d = 2 * common / (n + m)
                    if d >= self.t:
                        better(name, d, lo, places[k] + 1)
        return sorted(((name, -d, line[lo], line[hi]) for name, (d, lo, hi) in best.items()), key=lambda b: (-b[1], b[0]))


def op5_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licences, licences (sorted), best, dice, first_line and last_line of every row.

    Texts that are null or empty, or match no template, have no licences and null in the
    columns of the best match. Of equally good licences the first by name is the best."""
    templates = TEMPLATES if templates is None else templates
    src = docs.select("doc_id", F.col("text").alias("__text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner.scan_words(t) for t in b.column(1).to_pylist()]
            top = [f[0] if f else (None, None, None, None) for f in found]
            cols = [b.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([sorted(x[0] for x in f) for f in found], pa.list_(pa.string()))]
            cols += [pa.array([t[k] for t in top], kind_) for k, kind_ in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_licences", "licences", "best", "dice", "first_line", "last_line"])

    return src.mapInArrow(run, f"doc_id {kind}, n_licences int, licences array<string>, best string, dice double, first_line int, last_line int")
