"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, struct, utf8
from driftline.llm.decontam import WORD, words_of
from driftline.llm.quality_rules import CONTINUATION

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_LAST = " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_END = " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BSL = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
_GNU_END = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = (("", ""), ("-NC", "-NonCommercial"), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))

#: Common license notices, by SPDX-like id.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", _MIT),
    ("ISC", _ISC + _ISC_KEEP),
    ("ISC", _ISC + _ISC_KEEP + _ISC_END),
    ("0BSD", _ISC + "." + _ISC_END),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BSL),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD", _BSD + _BSD_END),
    ("BSD", _BSD + _BSD_NAME + _BSD_END),
    ("BSD", _BSD + _BSD_END + _BSD_LAST),
    ("BSD", _BSD + _BSD_NAME + _BSD_END + _BSD_LAST),
    *[(name, _GNU.format(of, kind, v) + _GNU_END.format(of, kind)) for name, of, kind, v in (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"))],
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("program", "", "2")),
    ("LGPL-2.0", _GNU.format("library", "Library ", "2")),
    *[(f"LGPL-{v}", x) for v in ("2.1", "3.0") for n in [v.removesuffix(".0")] for x in (f"This work is licensed under the GNU Lesser General Public License, version {n}.", _GNU.format("library", "Lesser ", n))],
    *[("AGPL-3.0", x) for x in ("This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("program", "Affero ", "3"))],
    *[
        (f"CC-BY{short}-{v}", x)
        for v in ("4.0", "3.0", "2.5", "2.0")
        for short, long in _CC
        for x in (f"Licensed under CC BY{short} {v}.", f"This work is licensed under a Creative Commons Attribution{long} {v} {'International' if v == '4.0' else 'Unported'} License.")
        if (f"CC-BY{short}-{v}", x[:12]) not in (("CC-BY-NC-4.0", "Licensed und"), ("CC-BY-4.0", "This work is"))
    ],
)
#: Words, besides digits, that tell licenses with nearly the same notice apart.
TELLING = frozenset(b"nc sa nd noncommercial sharealike noderivatives noderivs lesser affero".split())
#: Notices of fewer words must hold all their telling words.
SHORT_NOTICE = 20


def telling(words: list[bytes]) -> set[bytes]:
    return {w for w in words if w in TELLING or (len(w) == 1 and w.isdigit())}


@dataclass
class TemplateIndex:
    """Inverted index from winnowed k-word fingerprints to (template, position)."""

    notices: tuple[tuple[str, str], ...]
    k: int = 3
    window: int = 4
    band: int = 8
    names: list[str] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    index: dict[tuple[bytes, ...], list[tuple[int, int]]] = field(default_factory=dict)
    vocabulary: set[bytes] = field(default_factory=set)

    def __post_init__(self):
        for name, text in self.notices:
            words = words_of(text.encode())
            if len(words) < self.k:
                continue
            t = len(self.names)
            self.names.append(name)
            self.words.append(words)
            for i in self.winnowed(words):
                gram = tuple(words[i : i + self.k])
                self.index.setdefault(gram, []).append((t, i))
                self.vocabulary.update(gram)

    def winnowed(self, words: list[bytes]) -> list[int]:
        """Positions of the least hash of each window of grams, the rightmost of equals.

        A run of window + k - 1 shared words always holds one of them.
        """
        codes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + self.k])) for i in range(len(words) - self.k + 1)]
        last = max(1, len(codes) - self.window + 1)
        return sorted({min(range(i, min(i + self.window, len(codes))), key=lambda j: (codes[j], -j)) for i in range(last)})

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, word where it would begin) for clusters of seeds near one diagonal."""
        known = bytes(map(self.vocabulary.__contains__, words))
        run, at, seeds = b"\x01" * self.k, 0, set()
        while (at := known.find(run, at)) >= 0:
            for t, i in self.index.get(tuple(words[at : at + self.k]), ()):
                seeds.add((t, at - i))
            at += 1
        out: list[tuple[int, int]] = []
        for t, start in sorted(seeds):
            if not out or out[-1][0] != t or start - out[-1][1] > self.reach(t):
                out.append((t, start))
        return out

    def reach(self, t: int) -> int:
        """Half the band's width: a third of a short template at most."""
        return min(self.band, len(self.words[t]) // 3)

    def align(self, words: list[bytes], t: int, start: int) -> tuple[int, int, int]:
        """(matched template words, first, last + 1 matched word of the text).

        Global in the template, free at both ends of the text, within the band: a
        match gains 2, a gap or mismatch costs 1.
        """
        tpl, band, floor = self.words[t], self.reach(t), -(1 << 30)
        if start >= 0 and words[start : start + len(tpl)] == tpl:
            return len(tpl), start, start + len(tpl)
        # Cell of row i and offset d: template word i against text word start + i + d.
        row = {d: (0, 0, -1, -1) for d in range(-band, band + 1)}  # score, matched, first, last
        for i, w in enumerate(tpl):
            new: dict[int, tuple[int, int, int, int]] = {}
            for d in range(-band, band + 1):
                p = start + i + d
                same = 0 <= p < len(words) and words[p] == w
                s, n, a, b = row[d]
                best = (s + 2, n + 1, a if a >= 0 else p, p + 1) if same else (s - 1, n, a, b)
                s, n, a, b = row.get(d + 1, (floor, 0, -1, -1))  # template word left out
                best = max(best, (s - 1, n, a, b))
                if d - 1 in new:  # text word left out
                    s, n, a, b = new[d - 1]
                    best = max(best, (s - 1, n, a, b))
                new[d] = best
            row = new
        _, n, a, b = max(row.values())
        return n, a, b

    def same_license(self, span: list[bytes], t: int) -> bool:
        """No telling word in the span that the template lacks, nor the other way in a short one; longer ones without any may hold stray digits."""
        own, there = telling(self.words[t]), telling(span)
        if len(self.words[t]) >= SHORT_NOTICE:
            return not own or there <= own
        return own == there

    def scan(self, words: list[bytes], min_coverage: float) -> list[tuple[str, int, int, float]]:
        """(license, first word, last word + 1, coverage), by position.

        Of overlapping matches the one with most matched words stays, so a short notice
        inside a matched longer one isn't reported again.
        """
        found = []
        for t, start in self.candidates(words):
            n, a, b = self.align(words, t, start)
            if n >= min_coverage * len(self.words[t]) and self.same_license(words[a:b], t):
                found.append((-n, -n / len(self.words[t]), a, b, self.names[t]))
        out: list[tuple[int, int, str, float]] = []  # disjoint, by position
        for _, less, a, b, name in sorted(found):
            i = bisect_left(out, (a, b))
            if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or b <= out[i][0]):
                out.insert(i, (a, b, name, -less))
        return [(name, a, b, share) for a, b, name, share in out]


def code_points(text: bytes, places: list[int]) -> list[int]:
    """The numbers of characters before ascending byte places, in one pass."""
    out, at, n = [], 0, 0
    for p in places:
        n += len(text[at:p].translate(None, CONTINUATION))
        at = p
        out.append(n)
    return out


def find_licenses(
    docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, min_coverage: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_spans, licenses, spans.

    licenses: the distinct ids, sorted and comma-joined; spans: license:start:end:percent
    of template words matched, by start, in code points of the text, end exclusive.
    Null and empty texts have none; templates under three words are ignored. Of
    overlapping findings that match equally many words the one with the higher share
    stays, then the earlier one, then the first by name. Texts are scanned whole;
    alignments cost a template's length times its band each, one per cluster of seeds.
    Repeated rows give repeated results.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make():
        index = TemplateIndex(tuple(notices))

        def work(texts):
            n, names, spans = [], [], []
            for t in utf8(texts):
                found = index.scan(words_of(t), min_coverage)
                at = [m.span() for m in WORD.finditer(t)] if found else []
                where = code_points(t, [x for _, a, b, _ in found for x in (at[a][0], at[b - 1][1])])
                n.append(len(found))
                names.append(",".join(sorted({f[0] for f in found})))
                spans.append(",".join([f"{f}:{s}:{e}:{int(100 * c)}" for (f, _, _, c), s, e in zip(found, where[::2], where[1::2], strict=True)]))
            return [pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())]

        return work

    out = struct(("n_spans", T.LongType()), ("licenses", T.StringType()), ("spans", T.StringType()))
    return arrow_columns(named, ["text"], out, make, ["doc_id"])
