"""License scan: fixed phrases and license templates with optional and replaceable regions.

A template is wording with marks: ``<<opt>> ... <<end>>`` may be left out, ``<<any N>>`` stands for up to
N words of any kind. It is compiled into an automaton over words; a text is accepted where its words
lead from the first state to the last, so all mandatory wording must be there exactly and in order.
From each place where the first word stands the longest accepted run is taken, runs of one template do
not overlap. Templates are at most a few hundred words long and a run ends at its first wrong word, so the scan
is linear in the text. Licenses that are usually given in full (MIT, BSD, ISC, the Apache and GNU notices, the Unlicense) are accepted
with all of their mandatory wording only: a text with an altered or missing clause does not get the label.

The scan is one pass of Arrow batches inside Spark's tasks, without a shuffle.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined results: a null or empty text has no words, no labels, null places and score 0; repeated rows
get the same result; very long texts are read whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value

#: Fixed phrases: (label, words).
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

_GNU = "you can redistribute it and/or modify it under the terms of {} as published by the Free Software Foundation"
_LATER = "<<opt>> of the License <<end>> <<opt>> or (at your option) any later version <<end>>"

#: License wording of public licenses: (label, template). Fixed values.
TEMPLATES = (
    ("agpl-3.0", f"{_GNU.format('the GNU Affero General Public License')} <<opt>> either <<end>> version 3 {_LATER}"),
    ("apache-2.0", "Licensed under the Apache License <<opt>> Version <<end>> 2.0"),
    (
        "apache-2.0-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at <<any 8>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<opt>> 1. <<end>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<opt>> 2. <<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 12>>
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<opt>> 1. <<end>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<opt>> 2. <<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. <<opt>> 3. <<end>> Neither the name of <<any 12>> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<any 12>>
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
        OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("cc-by-4.0", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> CC BY 4.0"),
    ("cc-by-4.0", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> Creative Commons Attribution 4.0 <<opt>> International <<end>> License"),
    ("cc-by-nc-4.0", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> CC BY-SA 4.0"),
    ("cc0-1.0", "to the extent possible under law <<any 12>> waived all copyright and related or neighboring rights to <<any 12>>"),
    ("copyright-notice", "Copyright <<opt>> (c) <<end>> <<any 12>> all rights reserved"),
    ("gpl-2.0", f"{_GNU.format('the GNU General Public License')} <<opt>> either <<end>> version 2 {_LATER}"),
    ("gpl-2.0", "licensed under the <<opt>> terms of the <<end>> GNU General Public License <<opt>> as published by the Free Software Foundation <<end>> <<opt>> either <<end>> version 2"),
    ("gpl-3.0", f"{_GNU.format('the GNU General Public License')} <<opt>> either <<end>> version 3 {_LATER}"),
    ("gpl-3.0", "licensed under the <<opt>> terms of the <<end>> GNU General Public License <<opt>> as published by the Free Software Foundation <<end>> <<opt>> either <<end>> version 3"),
    (
        "isc",
        """Permission to use, copy, modify, and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND <<any 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("lgpl-2.1", f"{_GNU.format('the GNU Lesser General Public License')} <<opt>> either <<end>> version 2.1 {_LATER}"),
    ("lgpl-3.0", f"{_GNU.format('the GNU Lesser General Public License')} <<opt>> either <<end>> version 3 {_LATER}"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>
        (including the next paragraph) <<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("mit", "licensed under the MIT License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License <<opt>> v. <<end>> <<opt>> version <<end>> 2.0"),
    ("spdx", "SPDX-License-Identifier <<any 1>>"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label:string,start:long,length:long>>"
)

#: every byte that belongs to no word becomes a space
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


class Automaton:
    """A template as states joined by words (None: any word), with the ways that need no word worked out."""

    def __init__(self, label: str, template: str):
        self.label = label
        edges: list[list[tuple[bytes | None, int]]] = [[]]
        free: list[set[int]] = [set()]
        opened: list[int] = []
        words: list[bytes] = []

        def state() -> int:
            edges.append([])
            free.append(set())
            return len(edges) - 1

        for mark, part in re.findall(r"<<\s*(.*?)\s*>>|(\S+)", template):
            here = len(edges) - 1
            if part:
                for word in part.lower().encode().translate(_WORD_BYTES).split():
                    edges[len(edges) - 1].append((word, state()))
                    if not opened:
                        words.append(word)
            elif mark == "opt":
                opened.append(here)
            elif mark == "end":
                after = state()
                free[here].add(after)
                free[opened.pop()].add(after)
            elif mark.startswith("any "):
                steps = [here]
                for _ in range(int(mark[4:])):
                    edges[steps[-1]].append((None, nxt := state()))
                    steps.append(nxt)
                for s in steps[:-1]:
                    free[s].add(steps[-1])
            else:
                raise ValueError(f"unknown mark <<{mark}>>")
        if opened or not words:
            raise ValueError("a template needs mandatory words and an end for each optional region")
        self.edges, self.last = edges, len(edges) - 1
        self.closure = [self._reach(free, s) for s in range(len(edges))]
        self.first = {w for s in self.closure[0] for w, _ in edges[s]}
        if None in self.first or self.last in self.closure[0]:
            raise ValueError("a template must begin with a word")
        self.mandatory = len(words)
        self.rare = max(words, key=len)

    @staticmethod
    def _reach(free: list[set[int]], start: int) -> frozenset[int]:
        seen, todo = {start}, [start]
        while todo:
            for nxt in free[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return frozenset(seen)

    def longest(self, words: Sequence[bytes], start: int) -> int:
        """Length of the longest accepted run from ``start``, 0 if there is none."""
        states, found = self.closure[0], 0
        for i in range(start, len(words)):
            word, after = words[i], set()
            for s in states:
                for label, target in self.edges[s]:
                    if label is None or label == word:
                        after |= self.closure[target]
            if not after:
                break
            if self.last in after:
                found = i - start + 1
            states = after
        return found

    def runs(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        out, free_from = [], 0
        for i, word in enumerate(words):
            if word in self.first and i >= free_from and (n := self.longest(words, i)):
                out.append((i, n))
                free_from = i + n
        return out


def places(words: Sequence[bytes], phrase: Sequence[bytes]) -> list[int]:
    """All places where the phrase's words stand consecutively."""
    n, first = len(phrase), phrase[0]
    return [i for i, w in enumerate(words) if w == first and list(words[i : i + n]) == list(phrase)]


def _scanner(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        automata = [Automaton(*t) for t in templates]
        fixed = [(label, phrase.encode().split()) for label, phrase in phrases]
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                plain = (text or b"").lower().translate(_WORD_BYTES)
                words = plain.split()
                base = {label: at for label, p in fixed if p[-1] in plain and (at := places(words, p))}
                found = [(a, r) for a in automata if a.rare in plain for r in a.runs(words)]
                at = [i for starts in base.values() for i in starts]
                size = max([0, *(len(p) for label, p in fixed if label in base), *(a.mandatory for a, _ in found)])
                for column, value in zip(
                    columns,
                    (
                        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                        ",".join(sorted({*base, *(a.label for a, _ in found)})), size / (size + 3),
                        [{"label": a.label, "start": s, "length": n} for a, (s, n) in found],
                    ),
                ):
                    column.append(value)
            match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    return run


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Per row of (doc_id, text): word and place counts, labels, score and the templates' matches.

    The score is m / (m + 3) for the most mandatory words m that a phrase or template in the text has.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanner(phrases, templates), SCHEMA)


by_value(__name__)
