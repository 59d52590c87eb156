"""License scan by conditional compression.

Texts with a licensing word are searched whole, as words without list numbers,
so line breaks and what stands around a notice make no difference. A template
is a notice's forms ("released under the ...") and a license's own text. Blocks
of ``BLOCK`` words, every ``STEP`` words, are compressed alone and given each
template as a zstandard raw dictionary; where that saves ``SAVED`` bytes, the
template is a candidate. In candidate blocks only, from a form's "under" or a run
of ``RUN`` words of a text, the words are aligned with it and cut to the matched
stretch. A stretch is confirmed if at
least ``ALIKE`` of its wording agrees, no word that tells licenses apart (names,
version numbers, "non-commercial" and the like) differs between its first and
last matched word (parts of over ``PART`` words that are left out are listed, and
count against the template in rank only), the form's license is named in full, and of a license's text
the opening or ``SHARE`` of the grant is there. All templates are tried. Of
overlapping stretches the one with most words agreed wins, then the one that
skips fewest of its template's, then the one whose template, as a zstandard raw dictionary, makes the stretch smaller, then the one
that stands first. Stretches of one license side by side are one row. What
differs is returned.

Null, empty and unlicensed texts give no rows, and very long ones or very long
lines are searched whole. Empty tables give empty results. A name without its version counts
as the first license of that name. Repeated rows give repeated results. Other
columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from strandgraph.llm.common import as_table

ALIKE = 0.75
RUN = 4
#: Blocks overlap by more than a form is long, so one holds a form whole.
BLOCK, STEP, SAVED = 64, 32, 4
OPENING, SHARE = 6, 0.3
#: Words of a template that may be another wording; more are a part left out.
PART = 8
LEVEL = 3

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_NAMED = "This work is licensed under the {0}. Licensed under the {0}. Released under the {0}. Distributed under the terms of the {0}. Available under {0}. SPDX-License-Identifier: {1}"

#: Notices and their licenses' own wording, public texts.
TEMPLATES = {
    "MIT": [_NAMED.format("MIT License", "MIT"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY],
    "Apache-2.0": [_NAMED.format("Apache License, Version 2.0", "Apache-2.0"), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": [_NAMED.format("BSD 2-Clause License", "BSD-2-Clause"), _BSD],
    "BSD-3-Clause": [_NAMED.format("BSD 3-Clause License", "BSD-3-Clause"), _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": [_NAMED.format("ISC License", "ISC"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": [_NAMED.format("GNU General Public License, version 2", "GPL-2.0-only GPL-2.0-or-later"), _GNU.format(name="General Public License", version="2")],
    "GPL-3.0": [_NAMED.format("GNU General Public License, version 3", "GPL-3.0-only GPL-3.0-or-later"), _GNU.format(name="General Public License", version="3")],
    "LGPL-3.0": [_NAMED.format("GNU Lesser General Public License, version 3", "LGPL-3.0-only"), _GNU.format(name="Lesser General Public License", version="3")],
    "LGPL-2.1": [_NAMED.format("GNU Lesser General Public License, version 2.1", "LGPL-2.1-only"), _GNU.format(name="Lesser General Public License", version="2.1")],
    "AGPL-3.0": [_NAMED.format("GNU Affero General Public License, version 3", "AGPL-3.0-only"), _GNU.format(name="Affero General Public License", version="3")],
    "MPL-2.0": [_NAMED.format("Mozilla Public License 2.0", "MPL-2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": [_NAMED.format("CC BY 4.0", "CC-BY-4.0"), _NAMED.format("Creative Commons Attribution 4.0 International License", "CC-BY-4.0")],
    "CC-BY-SA-4.0": [_NAMED.format("CC BY-SA 4.0", "CC-BY-SA-4.0"), _NAMED.format("Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0")],
    "CC-BY-NC-4.0": [_NAMED.format("CC BY-NC 4.0", "CC-BY-NC-4.0"), _NAMED.format("Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0")],
    "CC-BY-ND-4.0": [_NAMED.format("CC BY-ND 4.0", "CC-BY-ND-4.0"), _NAMED.format("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0")],
    "CC0-1.0": [_NAMED.format("CC0 1.0", "CC0-1.0"), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": [_NAMED.format("Unlicense", "Unlicense"), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}

#: What follows a license's grant: shared by licenses, so no evidence by itself.
TAILS = {"MIT": _WARRANTY, "Unlicense": _WARRANTY, "BSD-2-Clause": _DISCLAIMER, "BSD-3-Clause": _DISCLAIMER}

#: Words by which licenses differ.
TELLING = frozenset("""mit apache bsd isc gnu gpl lgpl agpl lesser affero library mozilla mpl cc cc0 by nc sa nd noncommercial sharealike
noderivatives unlicense public domain 1 2 3 4 0 clause endorse promote not without neither""".split())
#: Words that a form's license is named by without them.
VAGUE = frozenset("the terms of license version clause international only or later".split())
RIDERS = frozenset("nc nd sa noncommercial noderivatives sharealike".split())
DENIALS = frozenset("not nor never neither without t".split())
CANDIDATE = re.compile(r"licen[cs]e|licen[cs]ed|spdx-|redistribut|copyright holder|permission is hereby|permission to use, copy|without warrant|as is\"|public domain|waived all copyright|\bcc[ -]?(?:by|0)|creative\s+commons", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_POINT = re.compile(r"(?:\A|\n|(?<![vV])[.:;]\s)[\s*#/>\-]*\(?([0-9]{1,2})[.)](?=\s)")
_END = re.compile(r"[.!?;][^\w\s]*\s|\n[^\S\n]*\n")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("alike", pa.float64()), ("differences", pa.list_(pa.string()))])
FOUND_DDL = "doc_id bigint, start int, end int, license string, reduction double, alike double, differences array<string>"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def placed_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words without list numbers, and where they start and end in the text."""
    points = {m.start(1) for m in _POINT.finditer(text)}
    found = [m for m in _WORD.finditer(text.translate(_LOWER)) if m.start() not in points]
    return [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]


class Unit(NamedTuple):
    """A form or a license's text; ``need`` are a form's words that name it and
    ``grant`` the length of a text's own part."""

    name: str
    words: list[str]
    need: frozenset
    grant: int
    packer: zstandard.ZstdCompressor
    sieve: zstandard.ZstdCompressor


class Templates:
    def __init__(self):
        self.units: list[Unit] = []
        for name, (named, text) in TEMPLATES.items():
            forms = [f for t in (named, text) if t.startswith("This work") for f in self.forms(t)]
            packer, sieve = self.packer(named), self.packer(" ".join(words(named)))
            for form in forms:
                w = words(form)
                at = w.index("under" if "under" in w else "identifier") + 1
                self.units.append(Unit(name, w, frozenset(x for x in w[at:] if not x.isdigit() and x not in VAGUE), 0, packer, sieve))
            if not text.startswith("This work"):
                for t in [text, text.replace("This program", "This library")] if "This program" in text else [text]:
                    w = words(t.removesuffix(_WARRANTY))
                    t = t.removesuffix(_WARRANTY) + " " + TAILS.get(name, "")
                    self.units.append(Unit(name, words(t), frozenset(), len(w), self.packer(t), self.packer(" ".join(words(t)))))
        self.runs: dict[tuple, dict[int, list]] = {}
        for u, unit in enumerate(self.units):
            for a in range(len(unit.words) - RUN + 1) if unit.grant else ():
                self.runs.setdefault(tuple(unit.words[a : a + RUN]), {}).setdefault(u, []).append(a)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    @staticmethod
    def packer(text: str):
        d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    @staticmethod
    def forms(named: str) -> list[str]:
        head, _, spdx = named.partition(" SPDX-License-Identifier: ")
        return re.split(r"\. (?=[A-Z][a-z]+ under|Distributed)", head.rstrip(".")) + ["SPDX-License-Identifier: " + x for x in spdx.split()]

    def candidates(self, mine: list[str]) -> list[set[int]]:
        """For each unit the steps of ``STEP`` words that are in a block which its
        words, as a dictionary, make smaller by ``SAVED`` bytes or more."""
        steps: dict[int, set[int]] = {id(unit.sieve): set() for unit in self.units}
        sieves = {id(unit.sieve): unit.sieve for unit in self.units}
        for k in range(0, max(1, len(mine) - BLOCK + STEP), STEP):
            raw = " ".join(mine[k : k + BLOCK]).encode()
            alone = len(self.plain.compress(raw))
            for key, sieve in sieves.items():
                if alone - len(sieve.compress(raw)) >= SAVED:
                    steps[key].update(range(k // STEP, (k + BLOCK) // STEP))
        return [steps[id(unit.sieve)] for unit in self.units]

    def windows(self, mine: list[str], ends_sentence):
        """(unit, first word, end) of the places where a unit may stand, among the
        steps where compression makes it a candidate; a form starts in the sentence
        of its "under"."""
        steps = self.candidates(mine)
        for i, w in enumerate(mine):
            if w == "under" or w == "identifier":
                near = set(mine[i + 1 : i + 24])
                lo = i
                while lo > max(0, i - 6) and not ends_sentence(lo - 1):
                    lo -= 1
                for u, unit in enumerate(self.units):
                    if not unit.grant and i // STEP in steps[u] and w in unit.words and unit.need <= near:
                        yield u, lo, i + len(unit.words) + 8
        last: dict[int, tuple] = {}
        for b in range(len(mine) - RUN + 1):
            for u, places in self.runs.get(tuple(mine[b : b + RUN]), {}).items():
                if b // STEP not in steps[u]:
                    continue
                first, at, end = last.get(u, (b, -1, b))
                a = next((a for a in places if a > at), places[0])
                if b - end > 60 or a < at - 8:
                    yield u, max(0, first - 10), end + RUN + 10
                    first = b
                last[u] = first, a, b
        for u, (first, _, end) in last.items():
            yield u, max(0, first - 10), end + RUN + 10

    def confirmed(self, text: str) -> list[tuple]:
        """(start, end, license, reduction, alike, differences) of a text's notices."""
        mine, starts, ends = placed_words(text)
        found = []
        ends_sentence = lambda i: _END.search(text[ends[i] : starts[i + 1]])
        for u, lo, hi in set(self.windows(mine, ends_sentence)):
            unit = self.units[u]
            if not (got := stretch(mine[lo:hi], unit)):
                continue
            b, e, same, skipped, then, differences = got
            b, e = b + lo, e + lo
            # the first words of the next sentence, equal by chance
            if k := next((k for k in range(1, min(RUN, e - b)) if unit.grant and ends_sentence(e - 1 - k)), 0):
                e, same, then = e - k, same - k, then - k
            after = text[ends[e - 1] : ends[e - 1] + 10]
            if not DENIALS.isdisjoint(mine[max(0, b - 2) : b]) or (not unit.grant and re.match(r"-\w", after) and not after.startswith(("-only", "-or-later"))):
                continue
            # another version than the template goes on with, or a rider
            said = [w for v, w in zip(mine[e - 1 : e + 16], mine[e : e + 17]) if w.isdigit() and v in ("version", "v")] + [w for w in mine[e : e + 2] if w.isdigit()]
            wanted = [w for w in unit.words[then : then + 3] if w.isdigit()]
            if (wanted and said and said[0] != wanted[0]) or (mine[e : e + 1] and mine[e] in RIDERS and not ends_sentence(e - 1)):
                continue
            raw = text[starts[b] : ends[e - 1]].encode("utf-8", "replace")
            reduction = 1 - len(unit.packer.compress(raw)) / len(self.plain.compress(raw))
            found.append((-same, skipped, -reduction, u, b, e, differences))
        taken, out = [], []
        for same, _, reduction, u, b, e, differences in sorted(found):
            if all(e <= x or b >= y for x, y, *_ in taken):
                taken.append((b, e, self.units[u].name, -reduction, -same, differences))
        for b, e, name, reduction, same, differences in sorted(taken):
            if out and out[-1][2] == name and b - out[-1][1] <= 3:
                x, end, _, first, n, said = out.pop()
                b, reduction, same, differences = x, max(first, reduction), n + same, said + ["+" + w for w in mine[end:b]] + differences
            out.append((b, e, name, reduction, same, differences))
        close = lambda at: at + len(re.match(r"[^\w\s]*", text[at : at + 8])[0])
        return [(starts[b], close(ends[e - 1]), name, round(x, 6), round(same / (e - b), 6), d) for b, e, name, x, same, d in out]


def stretch(mine: list[str], unit: Unit):
    """(first word, end, words agreed, unit's words skipped, unit's word after the
    last, differences) of the words that match the unit, or None where they do not
    confirm it: "+word" is only in the text, "-word"
    only in the template."""
    theirs = unit.words
    parts = [p for p in difflib.SequenceMatcher(None, theirs, mine, autojunk=False).get_matching_blocks() if p.size]
    # ends that are further away than they are long are chance, as are a few words
    # that stand elsewhere in a license's text
    stray = lambda end, gap: end.size < gap or (unit.grant and end.size < RUN)
    while len(parts) > 1 and stray(parts[0], parts[1].b - parts[0].b - parts[0].size):
        parts.pop(0)
    while len(parts) > 1 and stray(parts[-1], parts[-1].b - parts[-2].b - parts[-2].size):
        parts.pop()
    if not parts:
        return None
    b, e, same = parts[0].b, parts[-1].b + parts[-1].size, sum(p.size for p in parts)
    if same < ALIKE * (e - b):
        return None
    differences = []
    for p, q in zip(parts, parts[1:]):
        left_out = theirs[p.a + p.size : q.a]
        added = mine[p.b + p.size : q.b]
        # a longer stretch that is missing is a part left out, not another wording
        if not TELLING.isdisjoint(added) or len(left_out) <= PART and not TELLING.isdisjoint(left_out):
            return None
        differences += ["-" + w for w in left_out] + ["+" + w for w in added]
    agreed = [k for p in parts for k in range(p.a, p.a + p.size)]
    if unit.grant:
        enough = set(range(OPENING)) <= set(agreed) or sum(k < unit.grant for k in agreed) >= max(OPENING, SHARE * unit.grant)
    else:
        said = [theirs[k] for k in agreed]
        enough = unit.need <= set(said) and ("under" in said or "identifier" in said)
    then = parts[-1].a + parts[-1].size
    return (b, e, same, then - parts[0].a - same, then, differences) if enough else None


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per confirmed stretch: place, license, size reduction, agreement
    and wording differences."""

    def run(batches):
        templates = Templates()
        for b in batches:
            out = {f.name: [] for f in FOUND}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for won in templates.confirmed(text) if text and CANDIDATE.search(text) else ():
                    for k, v in zip(out, (doc_id, *won)):
                        out[k].append(v)
            yield from as_table(FOUND, **out).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, FOUND_DDL)
