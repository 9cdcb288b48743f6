"""License scan: template markup compiled into token automata.

A template is wording with ``<<beginOptional>> ... <<endOptional>>`` regions (nested
at will) and ``<<var;MIN;MAX>>`` regions, which stand for MIN to MAX words of any
kind. It is compiled into a nondeterministic automaton over words whose state sets
are cached as they are met, so a text costs one step per word. A text is accepted
where all mandatory words stand in order, nothing else between them.

A template can only match where its longest run of mandatory words stands, so the
automaton runs only on texts that hold this run (a plain substring search).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.

Defined results: a null or empty text has no words, no labels and score 0; repeated
rows are scanned each; overlapping places all count; an empty table gives an empty
result; other columns are ignored. The scan is a narrow pass with one row in memory
at a time beside its Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: bytes.translate table: A-Z lowered, digits, letters and bytes from 0x80 kept, all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_LICENSED = "<<beginOptional>>released<<endOptional>><<beginOptional>>licensed<<endOptional>> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> "
_LATER = " <<beginOptional>>or <<beginOptional>>at your option any<<endOptional>> <<beginOptional>>any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>>"
_NO_WARRANTY = (
    "this software is provided by <<var;1;12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed in no event shall <<var;1;12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
    "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
#: Whole licences and notices; their wording, not its layout, is what is matched.
WHOLE = {
    "0bsd-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this "
    "software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
    "use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "<<var;1;8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause-text": _BSD_TWO + _NO_WARRANTY,
    "bsd-3-clause-text": _BSD_TWO + "<<beginOptional>>3<<endOptional>> neither the name of <<var;1;12>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission " + _NO_WARRANTY,
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "either version <<var;1;2>> of the license <<beginOptional>>or at your option any later version<<endOptional>> this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details <<beginOptional>>you should have received a copy of the gnu general public license along with this program "
    "if not see <<var;1;6>><<endOptional>>",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<var;1;6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;1;6>> be liable for any special "
    "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the "
    "use or performance of this software",
    "mit-whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
    "copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without "
    "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;1;12>> be liable for any claim damages or "
    "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means <<beginOptional>>in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to "
    "the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present "
    "and future rights to this software under copyright law<<endOptional>>",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use "
    "this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be "
    "misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "<<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or "
    "altered from any source distribution",
}
#: Label and template of short references to a licence.
TEMPLATES = {
    "apache-2.0": _LICENSED + "apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted <<beginOptional>>provided that the following conditions are met<<endOptional>>",
    "cc-by-4.0": _LICENSED + "<<beginOptional>>creative commons<<endOptional>> cc by <<beginOptional>>international<<endOptional>> 4 0",
    "cc-by-nc-4.0": _LICENSED + "cc by nc <<beginOptional>>international<<endOptional>> 4 0",
    "cc-by-sa-4.0": _LICENSED + "cc by sa <<beginOptional>>international<<endOptional>> 4 0",
    "copyright": "copyright <<beginOptional>>c<<endOptional>> <<var;1;8>> all rights reserved",
    "gpl-2.0": _LICENSED + "gnu general public license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>" + _LATER,
    "gpl-3.0": _LICENSED + "gnu general public license <<beginOptional>>version<<endOptional>> 3 <<beginOptional>>0<<endOptional>>" + _LATER,
    "lgpl": _LICENSED + "gnu lesser general public license <<beginOptional>>version <<var;1;2>><<endOptional>>",
    "mit": _LICENSED + "mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of <<var;1;6>> to deal in <<var;1;4>> without restriction",
    "mpl-2.0": _LICENSED + "mozilla public license <<beginOptional>>version<<endOptional>> 2 0",
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def parse(template: str) -> list:
    """Nested lists: a word as bytes, an optional region as a list, a variable as a pair."""
    stack: list[list] = [[]]
    for mark, word in re.findall(r"<<([^>]*)>>|([^<\s]+)", template):
        if mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            region = stack.pop()
            stack[-1].append(region)
        elif mark:
            _, low, high = mark.split(";")
            stack[-1].append((int(low), int(high)))
        else:
            stack[-1] += word.encode().translate(LETTERS).split()
    if len(stack) != 1:
        raise ValueError(f"unbalanced optional region: {template}")
    return stack[0]


class Automaton:
    """States are numbers; ``moves[s]`` has (word or None for any word, next state), ``free[s]`` moves that read nothing."""

    def __init__(self, template: str):
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        tree = parse(template)
        self.accept = self._add(tree, 0)
        run, best = [], []
        for x in [*tree, []]:
            if isinstance(x, bytes):
                run.append(x)
                best = max(best, run, key=lambda r: len(b" ".join(r)))
            else:
                run = []
            best = list(best)
        #: Bytes that every accepted text holds; without words outside all regions there are none, and every text is tried.
        self.anchor = b" " + b" ".join(best) + b" " if best else b""
        self.cache: dict[tuple[frozenset, bytes], frozenset] = {}
        self.start = self._close({0})
        self.first = {w for s in self.start for w, _ in self.moves[s]}

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _add(self, tree: list, at: int) -> int:
        for x in tree:
            if isinstance(x, bytes):
                to = self._state()
                self.moves[at].append((x, to))
                at = to
            elif isinstance(x, tuple):
                steps = [at]
                for _ in range(x[1]):
                    to = self._state()
                    self.moves[steps[-1]].append((None, to))
                    steps.append(to)
                for s in steps[x[0] : -1]:
                    self.free[s].append(steps[-1])
                at = steps[-1]
            else:
                end = self._add(x, at)
                to = self._state()
                self.free[end].append(to)
                self.free[at].append(to)
                at = to
        return at

    def _close(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def _step(self, states: frozenset, word: bytes) -> frozenset:
        found = self.cache.get((states, word))
        if found is None:
            found = self._close({t for s in states for w, t in self.moves[s] if w is None or w == word})
            if len(self.cache) > 100_000:  # any-word regions meet many words; what is dropped is computed again
                self.cache.clear()
            self.cache[states, word] = found
        return found

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, end) of the longest match at each start, not overlapping."""
        i = 0
        while i < len(words):
            end = 0
            if None in self.first or words[i] in self.first:
                states, j = self.start, i
                while states:
                    if self.accept in states:
                        end = j
                    if j == len(words):
                        break
                    states = self._step(states, words[j])
                    j += 1
            if end > i:
                yield i, end
            i = max(end, i + 1)


def phrase_places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which the phrase's words stand; ``joined`` has one space around every word."""
    needle, at, counted, n = b" " + phrase + b" ", 0, 0, -1
    while (at := joined.find(needle, at)) >= 0:
        n += joined.count(b" ", counted, at + 1)
        counted = at = at + 1
        yield n


def scan(text: str | None, automata: dict[str, Automaton]) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()
    joined = b" " + b" ".join(words) + b" "
    n_base, first, last, base, more, covered = 0, None, None, set(), set(), []
    for phrase, label in PHRASES.items():
        key = phrase.encode()
        if b" " + key + b" " not in joined:
            continue
        width = key.count(b" ") + 1
        for i in phrase_places(joined, key):
            n_base += 1
            first, last = i if first is None else min(first, i), i if last is None else max(last, i)
            base.add(label)
            covered.append((i, i + width))
    for label, automaton in automata.items():
        if automaton.anchor in joined:
            for place in automaton.places(words):
                more.add(label)
                covered.append(place)
    n_covered, reach = 0, 0
    for i, j in sorted(covered):
        n_covered += max(0, j - max(i, reach))
        reach = max(reach, j)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), n_covered / len(words) if words else 0.0


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Base places, labels and the share of words inside license wording, for every row."""
    markup = dict(templates or TEMPLATES | WHOLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {k: Automaton(v) for k, v in markup.items()}
        for batch in batches:
            rows = [scan(t.as_py(), automata) for t in batch.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)
