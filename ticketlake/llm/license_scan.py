"""License scan by conditional compression.

A document is one sequence of words, across its lines.  A template of m words is confirmed
by a stretch of that sequence that aligns with it with at most d = MAX_DIFF * m words
inserted, deleted or replaced; what stands before and after the stretch doesn't count, so a
notice is found beside other sentences and wrapped over lines.

Cut into d+1 pieces, a template has one piece that d differences leave whole.  Only
documents with a piece of a template are aligned, and only around the piece, which loses
nothing.  The stretch, called block, is compressed alone and with the template as zstandard
raw dictionary; of blocks that overlap, the one with the largest share of bytes saved stays.

Some words decide which license a notice is: names, versions, clause letters, and a "not".
A stretch that differs in one of these is near to the template but isn't its license; it is
reported as ``near`` and counts for no license.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import pieces
from ticketlake.llm.spark import bounded_batches

# Wordings of public license notices, file headers and whole short licenses: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
}
# Words that decide which license is meant: names of licenses and their parts, denials.
NAMES = re.compile(
    r"(apache|mit|isc|bsd|gnu|gpl|lgpl|agpl|lesser|affero|general|mozilla|mpl|eclipse|artistic|boost|zlib|creative|commons|cc|cc0|public|domain|unlicense"
    r"|attribution(-\w+)*|share-?alike|non-?commercial|no-?derivatives|by(-(nc|sa|nd))+|nc|sa|nd|x11|clear|sleepycat|(l|a)?gplv?\d\S*)")
DENIALS = {"not", "no", "never", "cannot", "isn't", "nobody", "neither", "nor"}
VERSION_BEFORE = {"version", "v", "v.", "license", "licence", "gpl", "by", "clause"}
MAX_DIFF = 0.2
LEVEL = 3
WORD = re.compile(r"\w+(?:[.-]\w+)*")
END = re.compile(r"[^\w\s]*")  # what belongs to a block after its last word


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def allowed(m: int) -> int:
    """Differing words for a template of m words."""
    return int(MAX_DIFF * m + 1e-9)


def align(a: list[str], b: list[str], most: int) -> tuple[int, int, int, list[str]] | None:
    """(begin, end, differing words, differences as ``-deleted +inserted``) of the first
    stretch of ``b`` nearest to ``a``, or None if it has more than ``most`` differences."""
    m, n = len(a), len(b)
    cost = [[0] * (n + 1)]
    for i, w in enumerate(a, 1):
        up, row = cost[-1], [i]
        for j, x in enumerate(b):
            row.append(min(up[j] + (w != x), up[j + 1] + 1, row[j] + 1))
        cost.append(row)
    least = min(cost[m])
    if least > most:
        return None
    j = cost[m].index(least)
    while j < n and cost[m][j + 1] == least:  # a replaced last word rather than a deleted one
        j += 1
    i, end, out, gone, come = m, j, [], [], []
    while i or gone or come:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                gone.append("-" + a[i])
                come.append("+" + b[j])
                continue
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            gone.append("-" + a[i])
            continue
        elif i:
            j -= 1
            come.append("+" + b[j])
            continue
        if gone or come:
            out.append(" ".join(gone[::-1] + come[::-1]))
            gone, come = [], []
    return j, end, least, out[::-1]


def deciding(words: list[str], diff: list[str]) -> bool:
    """Whether one of the differences changes the license: a name or denial comes or goes, a
    version of the template (a number after a name or ``version``, or one with a dot) goes,
    or another one comes in its place."""
    versions = {w for before, w in zip(["", *words], words)
                if w[0].isdigit() and ("." in w or before in VERSION_BEFORE or NAMES.fullmatch(before))}
    for change in diff:
        parts = change.split(" ")
        gone, come = [p[1:] for p in parts if p[0] == "-"], [p[1:] for p in parts if p[0] == "+"]
        if any(NAMES.fullmatch(w) or w in DENIALS for w in (*gone, *come)):
            return True
        if any(w in versions for w in gone) or any(w[:1].isdigit() and "." in w for w in come):
            return True
    return False


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: w for name, text in templates.items() if (w := words_of(text))}
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = {
            name: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(
                text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, text in templates.items()}
        # first word -> (piece, its place in the template, template)
        self.pieces: dict[str, list[tuple[list[str], int, str]]] = {}
        self.needed: set[str] | None = set()  # a text without any of these has no piece
        for name, words in self.words.items():
            parts = allowed(len(words)) + 1
            for k in range(parts):
                at, to = k * len(words) // parts, (k + 1) * len(words) // parts
                self.pieces.setdefault(words[at], []).append((words[at:to], at, name))
                plain = [w for w in words[at:to] if w.isascii()]  # lower case of others may depend on what is around
                if plain and self.needed is not None:
                    self.needed.add(max(plain, key=len))
                else:
                    self.needed = None

    def saved(self, name: str, block: str) -> float:
        """Share of the block's bytes that the template saves."""
        data = " ".join(block.lower().split()).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        return (alone - len(self.given[name].compress(data))) / alone

    def blocks(self, text: str, gated: bool = True) -> list[tuple[int, str, str, float, int, list[str]]]:
        """(place in the text, block, template, share of bytes saved, differing words,
        differences, near) of the confirmed blocks and of those that are only near.  Of
        blocks that overlap a confirmed one stays, then the one that saves most; equal
        savings: the smaller difference, then the template's name.  Without the gate all of
        the text is aligned."""
        if gated and self.needed is not None:
            low = text.lower()
            if not any(w in low for w in self.needed):
                return []
        spans = [x.span() for x in WORD.finditer(text)]
        words = [text[lo:hi].lower() for lo, hi in spans]
        windows: dict[str, list[tuple[int, int]]] = {}
        if gated:
            for i, w in enumerate(words):
                for piece, at, name in self.pieces.get(w, ()):
                    if words[i:i + len(piece)] == piece:
                        m = len(self.words[name])
                        d = allowed(m)
                        windows.setdefault(name, []).append((max(0, i - at - d), min(len(words), i - at + m + d)))
        else:
            windows = {name: [(0, len(words))] for name in self.words}
        found = []
        for name, todo in windows.items():
            taken: list[tuple[int, int]] = []  # disjoint stretches in order
            todo = sorted(set(todo), reverse=True)
            while todo:
                lo, hi = todo.pop()
                k = bisect_right(taken, lo, key=lambda x: x[0])
                if k and taken[k - 1][1] > lo:  # what a stretch has already covered
                    lo = taken[k - 1][1]
                k = bisect_left(taken, hi, key=lambda x: x[0])
                if k and taken[k - 1][0] >= lo and taken[k - 1][1] >= hi:
                    hi = taken[k - 1][0]
                k = bisect_left(taken, lo, key=lambda x: x[0])
                if k < len(taken) and taken[k][1] <= hi:
                    todo += [(taken[k][1], hi), (lo, taken[k][0])]
                    continue
                m = len(self.words[name])
                if hi - lo < max(1, m - allowed(m)):
                    continue
                if (got := align(self.words[name], words[lo:hi], allowed(m))) is None:
                    continue
                s, e, count, diff = got[0] + lo, got[1] + lo, got[2], got[3]
                insort(taken, (s, e))
                todo += [(e, hi), (lo, s)]
                begin, end = spans[s][0], END.match(text, spans[e - 1][1]).end()
                near = deciding(self.words[name], diff)
                found.append((near, -self.saved(name, text[begin:end]), count, name, s, e, begin, text[begin:end], diff))
        out, used = [], []
        for near, share, count, name, s, e, begin, block, diff in sorted(found):
            k = bisect_right(used, s, key=lambda x: x[0])
            if (not k or used[k - 1][1] <= s) and (k == len(used) or e <= used[k][0]):
                used.insert(k, (s, e))
                out.append((begin, block, name, -share, count, diff, near))
        return sorted(out)

    def best(self, block: str) -> tuple[str, float, int, list[str]] | None:
        """(template, share of bytes saved, differing words, differences) of the confirmed
        block of a text that saves most, or None."""
        found = [x[2:6] for x in self.blocks(block) if not x[6]]
        return min(found, key=lambda x: (-x[1], x[2], x[0])) if found else None


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in pieces(batches, "text"):
            rows = []
            for doc, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                at = line = 0
                for begin, *hit in scanner.blocks(text or ""):
                    line, at = line + text.count("\n", at, begin), begin
                    rows.append((doc, line, *hit, begin))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "pos", "block", "license", "saved", "n_diff", "diff", "near", "start"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per block: id, pos (number of the line it begins in), block, license, saved,
    n_diff, diff, near (the block differs in a deciding word and isn't this license), start
    (its place in the text).

    Null and empty texts have no blocks.  Rows that repeat an id are scanned alike and
    give repeated results, a row without id gives results without id.  Other columns are
    ignored; an empty table or template list gives an empty result."""
    bounded_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = plain.mapInArrow(
        _scan(templates), "id long, pos int, block string, license string, saved double, n_diff long, diff array<string>, near boolean, start long")
    return found.withColumnRenamed("id", id_col)


def document_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_blocks, licenses (sorted, distinct), n_diff (of
    all blocks).  A document without a confirmed block has 0, an empty list and 0; so has
    a row without id, whose blocks can't be told from other rows'."""
    hits = (scan(docs, id_col, text_col, templates).where(F.col(id_col).isNotNull() & ~F.col("near"))
            .dropDuplicates([id_col, "start", "block"])
            .groupBy(F.col(id_col).alias("_id"))
            .agg(F.count("*").alias("n_blocks"), F.sort_array(F.collect_set("license")).alias("licenses"), F.sum("n_diff").alias("n_diff")))
    ids = docs.select(F.col(id_col))
    return ids.join(hits, ids[id_col] == hits["_id"], "left").select(
        id_col, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_diff", F.lit(0)).alias("n_diff"))
