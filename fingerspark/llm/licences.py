"""Licence scans with a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template. A document streams through it,
which gives for each template the longest runs that it shares with the document; long runs are
chained, in the order of the document and of the template, into the heaviest covered template
spans. Of overlapping spans that which covers most gives its label. Words that no template has
end a run at once, so only stretches of known words are streamed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fingerspark.llm.texts import map_texts, tokens_of

# The base phrases with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices of public licences, as their authors ask them to be put into files.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
            "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
            "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
            "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
            "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
            "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
             "License, or (at your option) any later version."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met: Redistributions of source code must retain the above "
            "copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "This work is licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("reserved", "All rights reserved."),
)

#: Words of a match at least, words between two matches of a chain at most, and the share of
#: a template that a chain must cover to give its label.
LEAST_MATCH = 4
MOST_GAP = 12
LEAST_COVER = 0.6
FIRST = 0x10000

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType()), T.StructField("words", T.LongType())]))),
])


class SuffixAutomaton:
    """All runs of some sequences. A state stands for runs with the same ends.

    ``ends[state]`` maps a sequence to all places where the state's runs end in it.
    """

    def __init__(self, sequences: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, letter in enumerate(sequence):
                last = self._extend(last, letter)
                self.ends[last].setdefault(number, set()).add(at + 1)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            above = self.ends[self.link[state]]
            for number, ends in self.ends[state].items():
                above.setdefault(number, set()).update(ends)

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, state: int, letter: str, old: int) -> int:
        """The state for runs of ``old`` no longer than those that ``state`` leads to."""
        if self.length[state] + 1 == self.length[old]:
            return old
        clone = self._state(self.length[state] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = clone
        while state >= 0 and self.next[state].get(letter) == old:
            self.next[state][letter] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, letter: str) -> int:
        if letter in self.next[last]:                        # a run that an earlier sequence had
            return self._split(last, letter, self.next[last][letter])
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and letter not in self.next[last]:
            self.next[last][letter] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, letter, self.next[last][letter])
        return new

    def _holding(self, state: int, length: int, least: int) -> dict[int, tuple[int, int]]:
        """For each sequence, the longest run that ends here and it holds: its length and state."""
        out: dict[int, tuple[int, int]] = {}
        while length >= least:
            for number in self.ends[state]:
                out.setdefault(number, (length, state))
            state = self.link[state]
            length = self.length[state]
        return out

    def matches(self, text: str, least: int):
        """Matching statistics: (sequence, end, length, state) of runs of at least ``least`` that cannot go on.

        Each sequence has its own runs: one may end while that of another goes on.
        """
        state = length = 0
        going: dict[int, tuple[int, int]] = {}
        for at, letter in enumerate(text):
            while state and letter not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if letter in self.next[state]:
                state = self.next[state][letter]
                length += 1
            here = self._holding(state, length, least)
            for number, (held, place) in going.items():
                if here.get(number, (0, 0))[0] != held + 1:
                    yield number, at, held, place
            going = here
        for number, (held, place) in going.items():
            yield number, len(text), held, place


#: A chain: where it starts and ends in the document, and how many words of the template it covers.
Chain = tuple[int, int, int]


def best_chains(matches: list[tuple[int, int, int]]) -> list[Chain]:
    """Chains of one template's matches (end, length, end in the template), the heaviest first, none overlapping.

    A chain goes on in the order of document and template, over gaps of at most ``MOST_GAP``
    words of the document. Words that an earlier match has covered, here or in the template,
    count once. Every match is tried after every other that it may follow.
    """
    matches = sorted(matches)
    weight, start = [], []
    first = 0                                                # matches before end too far ahead of those to come
    longest = max(length for _, length, _ in matches)
    for end, length, place in matches:
        while matches[first][0] < end - longest - MOST_GAP:
            first += 1
        best = (length, -(end - length))
        for i in range(first, len(weight)):
            end_, _, place_ = matches[i]
            if end_ < end and place_ < place and end - length - end_ <= MOST_GAP:
                new = weight[i] + min(length, end - end_, place - place_)
                best = max(best, (new, -start[i]))
        weight.append(best[0])
        start.append(-best[1])
    out: list[Chain] = []                                    # in order of place
    for covered, begin, end in sorted(((-w, s, m[0]) for w, s, m in zip(weight, start, matches))):
        at = bisect_left(out, (begin,))
        if (at == 0 or out[at - 1][1] <= begin) and (at == len(out) or end <= out[at][0]):
            out.insert(at, (begin, end, -covered))
    return out


def apart(matches: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The matches in groups between which no chain can go on."""
    group: list[tuple[int, int, int]] = []
    reach = 0
    for match in sorted(matches, key=lambda m: (m[0] - m[1], m)):
        if group and match[0] - match[1] - reach > MOST_GAP:
            yield group
            group = []
        group.append(match)
        reach = max(reach, match[0])
    if group:
        yield group


def decided(spans: list[dict]) -> list[dict]:
    """Spans without those that overlap one of another label which covers more words, or more of its template.

    Notices of one family share most of their words; the one that stands there covers most.
    """
    def beats(x: dict, y: dict) -> bool:
        return (x["label"] != y["label"] and x["start"] < y["end"] and y["start"] < x["end"]
                and (x["words"], x["cover"]) > (y["words"], y["cover"]))

    spans = sorted(spans, key=lambda s: (s["start"], s["end"], s["label"]))
    out: list[dict] = []
    group: list[dict] = []                                   # spans that overlap one after the other
    reach = -1
    for span in [*spans, None]:
        if span is None or span["start"] >= reach:
            out += [s for s in group if not any(beats(o, s) for o in group)]
            group = []
        if span is not None:
            group.append(span)
            reach = max(reach, span["end"])
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        words = [tokens_of(text) for _, text in templates]
        asked = [phrase.encode().split() for phrase, _ in phrases]
        vocabulary = sorted({w for ws in [*words, *asked] for w in ws})
        letters = {w: chr(FIRST + i) for i, w in enumerate(vocabulary)}
        self.letter = letters.get
        spelled = ["".join(letters[w] for w in ws) for ws in words]
        self.automaton = SuffixAutomaton(spelled)
        self.labels = [label for label, _ in templates]
        self.lengths = [len(s) for s in spelled]
        self.phrases = [("".join(letters[w] for w in ws), label) for ws, (_, label) in zip(asked, phrases)]
        least = min([LEAST_MATCH, *self.lengths])
        self.known = re.compile(r"[^\0]{%d,}" % least)
        self.least = LEAST_MATCH

    def chains(self, read: str) -> list[tuple[int, int, int, int]]:
        """(template, start, end, words covered) of the heaviest chains, for each template on its own."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for run in self.known.finditer(read):
            for template, end, length, state in self.automaton.matches(run.group(), self.least):
                found[template] += [(run.start() + end, length, place) for place in self.automaton.ends[state][template]]
        return [(template, *chain) for template, matches in sorted(found.items()) for group in apart(matches)
                for chain in best_chains(group)]

    def scan(self, text: str | None) -> tuple:
        words = tokens_of(text)
        letter = self.letter
        read = "".join([letter(w, "\0") for w in words])
        starts, base = [], set()
        for phrase, label in self.phrases:
            at = read.find(phrase)
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = read.find(phrase, at + 1)
        spans, score = [], 0.0
        for template, start, end, covered in self.chains(read):
            cover = covered / self.lengths[template]
            score = max(score, cover)
            if cover >= LEAST_COVER:
                spans.append({"label": self.labels[template], "start": start, "end": end, "cover": cover, "words": covered})
        spans = decided(spans)
        if starts:
            score = max(score, LEAST_COVER)
        labels = base | {s["label"] for s in spans}
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)


def find_licences(df: DataFrame, text: str = "text", into: str = "licences", keep: list[str] | None = None,
                  templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Add struct ``into``: words, base places and labels, all labels, score, template spans.

    ``score`` is the largest share of a template that one chain covers, and at least
    ``LEAST_COVER`` where a base phrase stands. A null text is an empty one, without words,
    places and labels. Whole texts are read, of any length; rows are independent, so repeated rows give
    repeated results and an empty table an empty one. Of equally heavy chains the first in the text
    counts; labels whose spans cover equally much all stand. ``keep`` names the columns to pass
    on, all by default; a column called ``into`` is replaced.
    """
    def start():
        scan = Scanner(templates, phrases).scan
        return lambda texts: [scan(t) for t in texts]

    return map_texts(df, text, into, FOUND, start, keep)
