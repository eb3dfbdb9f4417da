"""License scans by conditional compression: zstandard with each template as raw dictionary, then exact wording."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_CC = "This work is licensed under a Creative Commons {name} 4.0 International License."
_BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_DISCLAIMED = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."

#: Wordings by which licenses are stated or printed, by SPDX name. Each is also stated by an SPDX tag.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        _GPL.format(name="General Public License", version="either version 3 of the License, or (at your option) any later version"),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _GPL.format(name="General Public License", version="either version 2 of the License, or (at your option) any later version"),
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _GPL.format(name="Lesser General Public License", version="either version 3 of the License, or (at your option) any later version"),
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        _GPL.format(name="Lesser General Public License", version="either version 2.1 of the License, or (at your option) any later version"),
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _GPL.format(name="Affero General Public License", version="either version 3 of the License, or (at your option) any later version"),
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format(name="Attribution")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format(name="Attribution-ShareAlike")),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", _CC.format(name="Attribution-NoDerivatives")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format(name="Attribution-NonCommercial")),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", _CC.format(name="Attribution-NonCommercial-ShareAlike")),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", _CC.format(name="Attribution-NonCommercial-NoDerivatives")),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        _BSD2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": ("Released under the 2-Clause BSD License.", _BSD2),
    "ISC": ("Released under the ISC License.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _DISCLAIMED),
    "0BSD": ("Released under the Zero-Clause BSD License.", _ISC + ". " + _DISCLAIMED),
    "Zlib": (
        "Released under the Zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.",),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Words by which a statement of one license may differ from its template; any other word may name another license.
HARMLESS = frozenset(
    "a an and all are available be been code conditions content details distributed document each file files following for from full had has have "
    "here in international is it its item licence licenced license licensed made material materials more of on or our package page part please program "
    "project provided published released repository see source software subject terms text that the their these this to under v version was were which work works you your".split()
)
#: Words that no license text may lose or gain and still be that license.
TELLING = frozenset("affero attribution lesser library mit apache bsd isc zlib mozilla eclipse boost gnu noncommercial noderivatives sharealike unlicense no non not never nor without except cannot only".split())
#: Said shortly before a statement, these deny it.
DENIED = re.compile(r"(?i)\b(?:not|no|never|neither|nor|cannot|without|instead of|other than|rather than|except)\b|n['\u2019]t\b")
#: A line with one of these starts a candidate block.
MARK = r"(?i)licen[sc]e|copyright|redistribut|permission (?:is|to)\b|\bspdx\b|creative commons|\bCC[ -]?(?:BY|0)\b|public domain|warrant(?:y|ies)|merchantab|sublicens|\bGNU\b|mozilla|apache"
#: Share of a text's words that may differ from the template's, the least size reduction of a candidate, and how many
#: statements and how many texts are compared word by word.
DIFFER, REDUCTION, CANDIDATES = 0.2, 0.2, 6
#: Templates of fewer words are statements, others license texts; a part of a license text tells it from this many words on.
STATEMENT, PART = 20, 8
#: A statement may differ in this share of its words, all of them harmless, if one of these is in it or shortly before.
LOOSE, GRANTS, SHORTLY = 0.6, frozenset(("under", "spdx-license-identifier", "waived", "subject")), 8
#: A line next to a block joins it if this share of its words is in the templates.
FAMILIAR = 0.8
SCAN = "doc_id long, block int, start int, end int, license string, reduction double, edits int, words int, difference string"

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_MARK = re.compile(MARK)
_TAG = "SPDX-License-Identifier:"
_TAGGED = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\n\r*<>\"']+)")
_STOP = re.compile(r"[.;!?]")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def tag_names(name: str) -> tuple[str, ...]:
    """The names of a license in SPDX tags."""
    return (name, f"{name}-only", f"{name}-or-later", f"{name}+") if "GPL" in name else (name,)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``words_of`` are; a letter may have a longer lower case."""
    low = text.lower()
    where = range(len(text) + 1) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(where[m.start()], where[m.end() - 1] + 1) for m in _WORD.finditer(low)]


def aligned(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(edits, begin, end): the stretch of ``b`` that all of ``a`` differs from by the fewest word edits, the shortest of equals."""
    prev = [(0, -j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        cur = [(i, 0)]
        for j, y in enumerate(b, 1):
            s, u, left = prev[j - 1], prev[j], cur[-1]
            cur.append(min((s[0] + (x != y), s[1]), (u[0] + 1, u[1]), (left[0] + 1, left[1])))
        prev = cur
    end = min(range(len(b) + 1), key=lambda j: (prev[j][0], j + prev[j][1], j))
    return prev[end][0], -prev[end][1], end


def difference(a: list[str], b: list[str]) -> str:
    """What turns ``a`` into ``b``, as -removed +added words."""
    out = []
    for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal":
            out += [f"-{w}" for w in a[i:j]] + [f"+{w}" for w in b[k:m]]
    return " ".join(out)


def denied(text: str, at: int) -> bool:
    """Whether the few words before ``at`` in its sentence deny what follows."""
    before = re.split(r"[.;!?\n](?:\s|$)", text[max(0, at - 200) : at])[-1]
    return bool(DENIED.search(" ".join(before.split()[-5:])))


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.forms = []
        for name, texts in templates.items():
            for text in (*texts, *(f"{_TAG} {n}" for n in tag_names(name))):
                w = words_of(text)
                d = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.forms.append((name, w, zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False)))
        self.vocabulary = {w for _, ws, _ in self.forms for w in ws}
        self.known: dict[str, tuple | None] = {}

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of lines with a mark, grown over neighbours in the templates' words."""
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        familiar: dict[int, bool] = {}

        def grows(i: int) -> bool:
            if i not in familiar:
                w = words_of(text[lines[i][0] : lines[i][1]])
                familiar[i] = bool(w) and sum(x in self.vocabulary for x in w) >= FAMILIAR * len(w)
            return familiar[i]

        done = -1
        for i, (a, b) in enumerate(lines):
            if i <= done or not _MARK.search(text, a, b):
                continue
            lo = hi = i
            while lo - 1 > done and grows(lo - 1):
                lo -= 1
            while hi + 1 < len(lines) and (grows(hi + 1) or bool(_MARK.search(text, *lines[hi + 1])) and grows(i)):
                hi += 1
            done = hi
            yield lines[lo][0], lines[hi][1]

    def compared(self, words: list[str], form: list[str]) -> tuple[bool, float, int, int, str, int, int] | None:
        """(in part, share of edits, edits, words, difference, begin, end) if ``words`` hold the template or, of a
        license text, are a part of it; else None. begin and end tell the words that are aligned.

        Another number is another version; a statement may only differ in harmless words, as any other word, added
        or missing, may make it another license's or deny it; a text may not lose or gain a telling word.
        """
        part = len(words) < len(form)
        if part and (len(form) < STATEMENT or len(words) < PART):
            # a shorter wording of a statement, aligned from end to end
            edits, a, b = aligned(form, words)[0], 0, len(words)
            part = False
        elif part:
            edits, a, b = aligned(words, form)
        else:
            edits, a, b = aligned(form, words)
        stated = len(form) < STATEMENT
        if edits > (LOOSE if stated else DIFFER) * (len(words) if part else len(form)) or stated and GRANTS.isdisjoint(words[max(0, a - SHORTLY) : b]):
            return None
        told = difference(words, form[a:b]) if part else difference(words[a:b], form)
        differ = {w[1:] for w in told.split()}
        if re.search(r"\d", told) or (not differ <= HARMLESS if stated else differ & TELLING):
            return None
        return part, edits / max(1, min(len(words), len(form))), edits, len(words) if part else b - a, told, *((0, len(words)) if part else (a, b))

    def judge(self, words: list[str]) -> tuple[str, float, int, int, str, int, int] | None:
        """(license, reduction, edits, words, difference, begin, end) of the best confirmed template, or None.

        Templates are ranked by how much smaller the block gets with them as dictionary; of the best statements and the
        best texts, those that hold word by word are confirmed. A template held in whole counts before a part of one, then the fewest edits per
        word, then the longest. A part that texts of several licenses share tells none of them.
        """
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        ranked = sorted(((alone - len(z.compress(data))) / alone, -i) for i, (_, _, z) in enumerate(self.forms))[::-1]
        best, tried = None, Counter()
        for cut, i in ranked:
            if cut < REDUCTION:
                break
            name, form, _ = self.forms[-i]
            tried[len(form) < STATEMENT] += 1
            if tried[len(form) < STATEMENT] <= CANDIDATES and (got := self.compared(words, form)) and (best is None or (*got[:2], -len(form)) < best[0]):
                best = ((*got[:2], -len(form)), (name, cut, *got[2:]))
        if best and best[0][0]:
            for name, form, _ in self.forms:
                if name != best[1][0] and (got := self.compared(words, form)) and (not got[0] or got[1] <= best[0][1]):
                    return None
        return best and best[1]

    def scan(self, text: str | None) -> Iterator[tuple]:
        """(block, start, end, license, reduction, edits, words, difference) for each confirmed block."""
        if not text or not _MARK.search(text):
            return
        n, tagged = 0, []
        for m in _TAGGED.finditer(text):
            tagged.append(m.span())
            for name in _NAME.finditer(text, *m.span(1)):
                if name.group() not in ("AND", "OR", "WITH") and (got := self._seen(f"{_TAG} {name.group()}")):
                    yield n, *name.span(), *got[:5]
                    n += 1
        # tags are told; what is left keeps its place
        for a, b in tagged:
            text = text[:a] + " " * (b - a) + text[b:]
        for a, b in self.blocks(text):
            for x, y, got in self.statements(text, a, b):
                yield n, x, y, *got
                n += 1

    def statements(self, text: str, a: int, b: int, told: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, tuple]]:
        """(start, end, hit) of each license in a span: it as a whole, else by lines, then what lies around each hit.

        What lies around a hit that has no mark, or states a license again, belongs to the hit. A denied statement
        is no hit.
        """
        if got := self._seen(text[a:b]):
            *hit, lo, hi = got
            at = [(a + x, a + y) for x, y in spans(text[a:b])]
            if hit[0] not in told and not denied(text, at[lo][0]):
                yield a, b, tuple(hit)
                told |= {hit[0]}
            for x, y in ((a, at[lo][0]), (at[hi - 1][1], b)):
                if _MARK.search(text, x, y):
                    yield from self.statements(text, x, y, told)
        elif "\n" in text[a:b]:
            for line in text[a:b].split("\n"):
                yield from self.statements(text, a, a + len(line), told)
                a += len(line) + 1
        else:
            for x, y in self.within(text[a:b]):
                if (got := self._seen(text[a + x : a + y])) and got[0] not in told and not denied(text, a + x):
                    yield a + x, a + y, got[:5]

    def within(self, line: str) -> list[tuple[int, int]]:
        """The stretches of a line that are near to a whole template around one of its marks, to be judged by themselves.

        The share of a size reduction falls with the words around a statement, so each template is looked for in the
        window of its length on both sides of a mark. No template that may hold is passed over: a text shares all but
        ``DIFFER`` of its words with the window, a statement all that are not harmless. Of stretches that overlap, the nearest is taken.
        """
        at, words = spans(line), words_of(line)
        starts = [x for x, _ in at]
        found = set()
        for mark in {max(0, bisect_right(starts, m.start()) - 1) for m in _MARK.finditer(line)}:
            for name, form, _ in self.forms:
                far = len(form) + int(DIFFER * len(form))
                lo, hi = max(0, mark - far), min(len(words), mark + far + 1)
                window = words[lo:hi]
                need = Counter(w for w in form if w not in HARMLESS) if len(form) < STATEMENT else None
                if len(form) < 3 or (not need <= Counter(window) if need is not None else (Counter(form) & Counter(window)).total() < (1 - DIFFER) * len(form)):
                    continue
                edits, x, y = aligned(form, window)
                # the harmless words before, in the same sentence, belong to a statement
                first = x
                while need is not None and lo + x > 0 and x > max(0, first - SHORTLY) and window[x - 1] in HARMLESS and not _STOP.search(line, at[lo + x - 1][1], at[lo + x][0]):
                    x -= 1
                if y > x and self.compared(window[x:y], form):
                    got = self._seen(line[at[lo + x][0] : at[lo + y - 1][1]])
                    if got and got[0] == name:
                        found.add((edits / len(form), -len(form), lo + x, lo + y))
        free, out = [True] * len(words), []
        for _, _, x, y in sorted(found):
            if all(free[x:y]):
                free[x:y] = [False] * (y - x)
                out.append((at[x][0], at[y - 1][1]))
        return sorted(out)

    def _seen(self, raw: str):
        words = words_of(raw)
        key = " ".join(words)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self.judge(words) if words else None
        return self.known[key]


def _scan(templates):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in scanner.scan(text.as_py())]
            cols = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "block", "start", "end", "license", "reduction", "edits", "words", "difference"])

    return scan


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license statement: (doc_id, block, start, end, license, reduction, edits, words, difference).

    Candidate blocks are lines with a word of licensing, grown over neighbouring lines in the templates' vocabulary;
    each is compressed alone and with every template as raw dictionary, templates are ranked by the reduction, and
    the best six statements and six texts are compared word by word, see ``Scanner.compared``: a license text may differ in 20% of its words,
    none of them a number or a word that tells licenses apart; a statement only in words such as "this project is".
    Part of a license text counts if no other license has it. A denied statement is none; an SPDX tag states each
    license of its expression. What lies around a statement in its block is judged in turn, and a line that is
    not confirmed is searched for whole templates around its marks. ``difference`` lists the differing words; start and
    end are character offsets in the whole text.

    Nothing is shuffled; the scan for marks runs before Python and is the cost of a text without any. Null and empty
    texts give no rows, an empty table an empty result; texts are scanned whole, however long; a null id is reported
    as null; repeated rows are reported each; of wordings that hold equally well the longest counts. Columns of other
    names are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.where(F.col("text").rlike(MARK)).mapInArrow(_scan(templates), SCAN)


def op9_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license statement in all documents; see ``license_scan`` for nulls, empty and very long texts, ties, repeated
    rows, empty tables and other columns."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
