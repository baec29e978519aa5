"""License scans by conditional compression.

Around each trigger word as many words are taken as the longest stretch of any template without one, and
overlaps are joined into candidate blocks, so that line breaks, indents and comment marks don't matter.
Each block (long ones in overlapping windows, in which every notice is whole once) is compressed with
every template as a zstandard raw dictionary; templates are ranked by how many bytes that saves, as a
share of the template's own compressed size without the frame, and must reach the share `least`. All that
do, and whose words the block has, are confirmed by their exact wording: a word alignment gives the words
of the template that the text lacks and those it has besides, and a template counts as found if the
similarity reaches `similarity`. Confirmed spans are taken out of the block, and the rest is scanned
again, so that one block can hold several notices.

Whole licences of more than LONG words (wordings/, up to their end of terms) go first, in texts that have as
many trigger words as one needs; a wording that stands there word for word needs no alignment.

Nulls: a null text has no notices. A text's notices come in order of their start; of templates that fit equally
well the one that saves more, then the first, is taken. Repeated rows give repeated results, an empty table
an empty one, and very long texts are scanned whole. A carried column named notices is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumengrid.llm.common import map_text

TRIGGER = re.compile(r"licen[sc]e|copyright|\(c\)|©|permission[\W_]+is|redistribut|warrant|as[\W_]+is|spdx|public[\W_]+domain|creative[\W_]+commons|\bcc0\b|\bcc[\W_]+by", re.I)
#: What a text with a trigger word has, casefolded: one of these, or a match of the pattern; both are fast to look for.
_NEEDED = ("licen", "copyright", "(c)", "©", "permission", "redistribut", "warrant", "spdx", "public", "creative", "cc0")
_OR = re.compile(r"as[\W_]+is|cc[\W_]+by")
#: Letters that match i or s where case is ignored, but aren't these when casefolded.
_ODD = re.compile("[ıİſ]")
_WORD = re.compile(r"[^\W_]+(?:[.\-+'][^\W_]+)*\+?")
#: A placeholder of a template, which stands for up to this many words.
ANY, ANY_WORDS = "<any>", 8

_BSD_END = """THIS SOFTWARE IS PROVIDED BY <any> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <any> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of <any> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""

#: (licence, wording). Fixed wordings of the public licences and of the short notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    *[(f"{code}-{version}.0-or-later", _GNU.format(name=name, version=version)) for code, name, versions in (("GPL", "General Public License", (2, 3)), ("LGPL", "Lesser General Public License", (2, 3)), ("AGPL", "Affero General Public License", (3,))) for version in versions],
    *[(f"{code}-{version}.0", f"under the GNU {name}, version {version}") for code, name, versions in (("GPL", "General Public License", (1, 2, 3)), ("LGPL", "Lesser General Public License", (2, 3)), ("AGPL", "Affero General Public License", (3,))) for version in versions],
    ("MIT", "under the MIT License"),
    ("ISC", "under the ISC License"),
    ("Apache-2.0", "under the Apache License, Version 2.0"),
    ("MPL-2.0", "under the Mozilla Public License, Version 2.0"),
    ("BSD-2-Clause", "under the 2-Clause BSD License"),
    ("BSD-3-Clause", "under the 3-Clause BSD License"),
    ("BSD-3-Clause", "under the BSD 3-Clause License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("public-domain", "released into the public domain"),
    *[(f"CC-{kind}-{version}", f"under CC {kind} {version}") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for version in ("2.0", "3.0", "4.0")],
    *[(f"CC-BY{code}-{version}", f"under a Creative Commons Attribution{name} {version} International License") for code, name in (("", ""), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC", "-NonCommercial")) for version in ("3.0", "4.0")],
    *[(code, f"SPDX-License-Identifier: {code}") for code in ("MIT", "ISC", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")],
]

#: A template with more words is looked for in a pass of its own.
LONG = 600


@lru_cache(maxsize=1)
def whole_licences() -> tuple[tuple[str, str], ...]:
    """(licence, wording) of the texts in wordings/: fixed wordings, up to the end of their terms."""
    files = sorted((f for f in resources.files("lumengrid.llm").joinpath("wordings").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8").split("END OF TERMS AND CONDITIONS")[0]) for f in files)


NOTICE = T.ArrayType(
    T.StructType(
        [T.StructField("licence", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reduction", T.DoubleType())]
        + [T.StructField("similarity", T.DoubleType()), T.StructField("exact", T.BooleanType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("extra", T.ArrayType(T.StringType()))]
    )
)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def trigger_places(text: str) -> list[int]:
    """Where the trigger words of a text start."""
    folded = text.casefold()
    if not any(map(folded.__contains__, _NEEDED)) and not _OR.search(folded) and not _ODD.search(text):
        return []
    return [m.start() for m in TRIGGER.finditer(text)]


def stretch(wording: str) -> int:
    """The most words of a template before, between or after its trigger words."""
    text = wording.replace(ANY, " x" * ANY_WORDS)
    starts = [m.start() for m in _WORD.finditer(text)]
    cuts = [0, *[bisect_right(starts, m.start()) for m in TRIGGER.finditer(text)], len(starts)]
    return max(b - a for a, b in zip(cuts, cuts[1:], strict=False))


def blocks(text: str, triggers: list[int], reach: int) -> list[list[tuple[int, int]]]:
    """The words' spans in characters of each candidate block: `reach` words around each of the places of trigger words."""
    if not triggers:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    spans: list[list[int]] = []
    for t in triggers:
        at = bisect_right(starts, t)
        lo, hi = max(0, at - reach - 1), min(len(words), at + reach + 1)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    return [words[lo:hi] for lo, hi in spans if lo < hi]


class Scanner:
    """Templates with their dictionaries, in one task."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, similarity: float = 0.9, least: float = 0.25):
        import zstandard

        self.similarity, self.least = similarity, least
        options = dict(level=3, write_content_size=False, write_checksum=False)
        self.plain = zstandard.ZstdCompressor(**options)
        self.templates = []
        self.reach, self.longest = [1, 1], [1, 1]  # of short templates and of long ones
        self.triggers: list[int] = []  # that a text needs, by template
        for licence, wording in [*TEMPLATES, *whole_licences()] if templates is None else templates:
            parts = wording.replace(ANY, " \0 ")
            words = [ANY if w == "\0" else w for w in re.findall(r"\0|" + _WORD.pattern, parts)]
            words = [w if w == ANY else w.lower() for w in words]
            data = " ".join(w for w in words if w != ANY).encode()
            # A raw dictionary must have 8 bytes at least.
            raw = zstandard.ZstdCompressionDict(data.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = len(self.plain.compress(data)) - len(self.plain.compress(b""))
            self.templates.append((licence, words, zstandard.ZstdCompressor(dict_data=raw, write_dict_id=False, **options), own, Counter(w for w in words if w != ANY)))
            # A text may have more words than the template, as far as the similarity allows.
            long = len(words) > LONG
            self.reach[long] = max(self.reach[long], math.ceil(stretch(wording) / similarity))
            self.longest[long] = max(self.longest[long], math.ceil(len(words) / similarity) + ANY_WORDS * words.count(ANY))
            # Each word that differs changes one trigger at most.
            self.triggers.append(len(TRIGGER.findall(wording)) - math.floor((1 - similarity) * len(words)) if long else 1)
        self.sets = [[k for k, t in enumerate(self.templates) if (len(t[1]) > LONG) == long] for long in (False, True)]

    def ranked(self, words: list[str], among: list[int]) -> list[tuple[float, int, float]]:
        """(share of the template saved, template, share of the block saved) of the templates that reach `least`."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        found = []
        for k in among:
            _, _, compressor, own, _ = self.templates[k]
            saved = alone - len(compressor.compress(data))
            if saved >= self.least * own:
                found.append((saved / own, k, saved / alone))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def possible(self, k: int, counts: Counter) -> bool:
        """Whether a text of these words can have so many of the template's that it is confirmed."""
        wanted = self.templates[k][4]
        return sum(min(n, counts[w]) for w, n in wanted.items()) >= self.similarity * wanted.total()

    def align(self, template: list[str], words: list[str], matcher: SequenceMatcher | None = None) -> tuple[int, int, float, list[str], list[str]] | None:
        """Span of words that the template covers best, similarity, and its missing and extra words there."""
        if ANY not in template:
            text, wanted = f" {' '.join(words)} ", f" {' '.join(template)} "
            if (at := text.find(wanted)) >= 0:
                first = text.count(" ", 0, at)
                return first, first + len(template), 1.0, [], []
        matcher = matcher or SequenceMatcher(None, template, words, autojunk=False)
        matcher.set_seq1(template)
        pieces = [m for m in matcher.get_matching_blocks() if m.size]
        if not pieces:
            return None
        wanted = sum(w != ANY for w in template)
        more = [[]]  # what the text has before each piece
        for m, n in zip(pieces, pieces[1:], strict=False):
            between = words[m.b + m.size : n.b]
            more.append(between[ANY_WORDS:] if ANY in template[m.a + m.size : n.a] else between)
        best, ends = (-1.0, 0), (0, 0)
        for i in range(len(pieces)):  # stray words before and after aren't part of the notice
            kept = extra = 0
            for j in range(i, len(pieces)):
                kept += pieces[j].size
                extra += len(more[j]) if j > i else 0
                if (score := (kept / (wanted + extra), kept)) > best:
                    best, ends = score, (i, j)
        i, j = ends
        at, missing = 0, []
        for m in pieces[i : j + 1]:
            missing += [w for w in template[at : m.a] if w != ANY]
            at = m.a + m.size
        missing += [w for w in template[at:] if w != ANY]
        return pieces[i].b, pieces[j].b + pieces[j].size, best[0], missing, [w for x in more[i + 1 : j + 1] for w in x]

    @staticmethod
    def closer(text: str, start: int, end: int, level: int, reach: int = 200) -> list[tuple[int, int]]:
        """Smaller spans with trigger words: the lines of a block, or what is near each word, overlaps joined."""
        if level == 0:
            cuts = [start, *[start + m.end() for m in re.finditer("\n", text[start:end])], end]
            return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if TRIGGER.search(text, a, b)]
        spans: list[list[int]] = []
        if level == 1:
            for m in TRIGGER.finditer(text, start, end):
                a, b = max(start, m.start() - reach), min(end, m.end() + reach)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        return [tuple(s) for s in spans]

    def scan(self, text: str | None) -> list[dict]:
        text = text or ""
        triggers = trigger_places(text)
        if not triggers:
            return []
        found = []
        if self.sets[True] and len(triggers) >= min(self.triggers[k] for k in self.sets[True]):
            counts = Counter(_words(text))
            if among := [k for k in self.sets[True] if self.possible(k, counts)]:
                found = self.search(text, triggers, True, among)
                for n in found:
                    text = text[: n["start"]] + " " * (n["end"] - n["start"]) + text[n["end"] :]
                    triggers = [t for t in triggers if not n["start"] <= t < n["end"]]
        return sorted(found + self.search(text, triggers, False, self.sets[False]), key=lambda n: n["start"])

    def search(self, text: str, triggers: list[int], long: bool, among: list[int]) -> list[dict]:
        """The notices of some templates, short or long ones."""
        found: list[dict] = []
        longest = self.longest[long]
        for words in blocks(text, triggers, self.reach[long]):
            lo, size = 0, 4 * longest
            while lo < len(words):
                hi = min(len(words), lo + size)
                # What starts later may be cut by the window's end: it is left to the next one.
                border = hi if hi == len(words) else hi - longest
                last = words[border - 1][1]
                kept = [n for n in self.window(text, words[lo][0], words[hi - 1][1], long, among) if n["start"] < last]
                found += kept
                done = max([last, *[n["end"] for n in kept]])
                lo = border
                while lo < len(words) and words[lo][0] < done:
                    lo += 1
        return found

    def window(self, text: str, lo: int, hi: int, long: bool, among: list[int]) -> list[dict]:
        """The notices between two places of the text."""
        found, todo = [], [(lo, hi, 0)]
        while todo:
            start, end, level = todo.pop()
            tokens = [(m.start() + start, m.end() + start) for m in _WORD.finditer(text[start:end])]
            words = [text[a:b].lower() for a, b in tokens]
            if not words:
                continue
            hits = []
            counts, matcher = Counter(words), None
            for _, k, reduction in self.ranked(words, [k for k in among if self.possible(k, counts)] if long else among):
                if not self.possible(k, counts):
                    continue
                matcher = matcher or SequenceMatcher(None, "", words, autojunk=long)
                licence, template = self.templates[k][:2]
                if (a := self.align(template, words, matcher)) and a[2] >= self.similarity:
                    hits.append((a[2] * len(template), reduction, licence, a))
            if not hits and long:
                continue
            if not hits:  # what surrounds a short notice may hide it: look at lines, then near the trigger words
                todo += [(a, b, level + 1) for a, b in self.closer(text, start, end, level) if (a, b) != (start, end)]
                continue
            _, reduction, licence, (first, last, similarity, missing, extra) = max(hits, key=lambda h: h[:2])
            a, b = tokens[first][0], tokens[last - 1][1]
            found.append({"licence": licence, "start": a, "end": b, "reduction": reduction, "similarity": similarity, "exact": not missing and not extra, "missing": missing, "extra": extra})
            todo += [(start, a, level), (b, end, level)]
        return found


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The carried columns (all but the text, if None) and `notices`, an array of NOTICE."""

    def make():
        scanner = Scanner(templates)
        return lambda texts: [[scanner.scan(t) for t in texts]]

    carry = [c for c in docs.columns if c != text] if carry is None else carry
    return map_text(docs, text, make, [("notices", NOTICE)], carry)
