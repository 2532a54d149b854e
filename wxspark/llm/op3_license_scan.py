"""License scans: templates with optional and replaceable regions, compiled into token automata.

Template markup: plain words must stand as they are; [[ ... ]] is optional; {n} is a replaceable region of at most n
words. A template is compiled into a nondeterministic automaton over word hashes; it accepts a run of words whose
mandatory wording matches exactly. Automata run from the places of a template's first words only. Hashes only find the places: a word
whose hash is a template's or a phrase's counts only if it is that word, so nothing is matched by a hash alone.

Base labels are plain phrases; the templates' labels are added to them. The score is 1 where a template accepts,
0.5 where only a base phrase stands, else 0.

Defined cases: a null text is empty (no words, null places, score 0); repeated rows are scanned alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import Words, hash_spans, small_batches, text_steps

#: Phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and template.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[version]] 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]] {6} you may not use this file except in compliance with the license"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "licensed under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {4} to deal in {3} without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license version 2 [[or [[at your option]] any later version]]"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license version 3 [[or [[at your option]] any later version]]"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] cc by 4 0"),
    ("copyright", "copyright [[c]] {1} [[by]] {6} all rights reserved"),
    # whole licences and notices
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {4} to deal in {3} without restriction including without limitation the rights to use copy modify merge publish"
     " distribute sublicense and or sell copies of {2} and to permit persons to whom {3} furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies"
     " or substantial portions of {2} {2} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {8} be liable for any"
     " claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with {2} or the use or other dealings in {2}"),
    ("isc-text", "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted [[provided that the above copyright notice and this permission notice appear in all copies]] {2} is provided as is and {6} disclaims"
     " all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or"
     " profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1} redistributions of source code must retain the above copyright notice this list of conditions and the"
     " following disclaimer {1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
     " [[{1} neither the name of {10} nor the names of {4} contributors may be used to endorse or promote products derived from this software without specific prior written permission]] this software is provided by {8} as is and any express or implied warranties"
     " including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to"
     " procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of"
     " this software even if advised of the possibility of such damage"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed to in writing software"
     " distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", "redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free software foundation either version {2} of the license or at your option any later version {3} is distributed in the"
     " hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] general public license for more details"),
    ("mpl-2.0-notice", "source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {8} mozilla org mpl 2 0"),
    ("unlicense-text", "unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial"
     " and by any means"),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


class Automaton:
    """moves[state] maps a word hash to states; any_[state] holds states reached by any word; skips are closed beforehand."""

    def __init__(self, template: str):
        self.words = re.findall(r"[^\s\[\]{}]+", re.sub(r"\{\d+\}", " ", template))
        self.moves, self.any_, self._skip = [{}], [set()], [set()]
        at = 0
        opened: list[int] = []
        for token in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self._skip[opened.pop()].add(at)
            elif token[0] == "{":
                begin, inner = at, []
                for _ in range(int(token[1:-1])):
                    nxt = self._new()
                    self.any_[at].add(nxt)
                    inner.append(at)
                    at = nxt
                for state in (begin, *inner):
                    self._skip[state].add(at)
            else:
                nxt = self._new()
                self.moves[at].setdefault(word_hash(token), set()).add(nxt)
                at = nxt
        self.end = at
        self.closed = [self._close(s) for s in range(len(self.moves))]
        self.first = {h for s in self.closed[0] for h in self.moves[s]}

    def _new(self) -> int:
        for x in (self.moves, self.any_, self._skip):
            x.append({} if x is self.moves else set())
        return len(self.moves) - 1

    def _close(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for nxt in self._skip[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def accepts(self, words: list[int], at: int) -> bool:
        """Whether some run of words from `at` on is accepted."""
        states = self.closed[0]
        while states:
            if self.end in states:
                return True
            if at >= len(words):
                return False
            states = frozenset(t for s in states for n in (*self.moves[s].get(words[at], ()), *self.any_[s]) for t in self.closed[n])
            at += 1
        return False


class Spelling:
    """The words that automata and phrases know, so that a hash counts only where the word stands."""

    def __init__(self, words: list[str]):
        known = {word_hash(x): x.encode() for x in words}
        self.hash = np.array(sorted(known), np.uint64)
        self.size = np.array([len(known[x]) for x in self.hash.tolist()], np.int64)
        self.letters = np.zeros((len(known), int(self.size.max(initial=0))), np.uint8)
        for row, x in zip(self.letters, self.hash.tolist()):
            row[: len(known[x])] = np.frombuffer(known[x], np.uint8)

    def of(self, w: Words) -> np.ndarray:
        """The words' hashes, 0 for words that aren't known."""
        out = np.zeros(len(w.hash), np.uint64)
        if not len(self.hash) or not len(w.hash):
            return out
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == w.hash)
        at = at[hit]
        same = (w.ends - w.starts)[hit] == self.size[at]
        for k in range(self.letters.shape[1]):
            some = np.flatnonzero(same & (k < self.size[at]))
            same[some] = w.data[w.starts[hit[some]] + k] == self.letters[at[some], k]
        out[hit[same]] = w.hash[hit[same]]
        return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row a document: its words, the places and labels of base phrases, all labels and the score."""

    def run(batches):
        base = [([np.uint64(word_hash(x)) for x in phrase.split()], label) for phrase, label in phrases]
        automata = [(label, Automaton(t)) for label, t in templates]
        spelling = Spelling([*(x for phrase, _ in phrases for x in phrase.split()), *(x for _, a in automata for x in a.words)])
        openers = np.array(sorted({h for _, a in automata for h in a.first}), np.uint64)
        for rows, data, offsets in text_steps(batches):
            w = Words(data, offsets, SEPARATOR, lower=True)
            h, n = spelling.of(w), len(w.first) - 1
            row_of = np.repeat(np.arange(n), np.diff(w.first))
            places, kinds = [], []
            for k, (phrase, _) in enumerate(base):
                m = len(phrase)
                if len(h) >= m:
                    hit = row_of[: len(h) - m + 1] == row_of[m - 1 :]
                    for j, x in enumerate(phrase):
                        hit &= h[j : len(h) - m + 1 + j] == x
                    places.append(np.flatnonzero(hit))
                    kinds.append(np.full(len(places[-1]), k))
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            kind = np.concatenate(kinds) if kinds else place
            starts = np.flatnonzero(np.isin(h, openers))
            found: dict[int, set[str]] = {}
            for row in np.unique(row_of[starts]).tolist():
                own = h[w.first[row] : w.first[row + 1]].tolist()
                for at in (starts[(starts >= w.first[row]) & (starts < w.first[row + 1])] - w.first[row]).tolist():
                    for label, automaton in automata:
                        if own[at] in automaton.first and label not in found.get(row, ()) and automaton.accepts(own, at):
                            found.setdefault(row, set()).add(label)
            out = []
            order = np.argsort(row_of[place], kind="stable") if len(place) else place
            place, kind, rows_ = place[order], kind[order], row_of[place][order] if len(place) else place
            edges = np.searchsorted(rows_, np.arange(n + 1))
            for row in range(n):
                own = place[edges[row] : edges[row + 1]] - w.first[row]
                labels = {base[k][1] for k in kind[edges[row] : edges[row + 1]].tolist()}
                more = found.get(row, set())
                out.append((int(w.first[row + 1] - w.first[row]), len(own), int(own.min()) if len(own) else None, int(own.max()) if len(own) else None, ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if more else 0.5 if labels else 0.0))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds_ = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds_))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
