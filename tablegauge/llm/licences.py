"""Licence texts in documents, by a suffix automaton over the words of all templates.

The automaton reads a document's words and knows, at each word, the longest run ending there that stands in some template: its
matching statistics. Long matches are chained, in the order of both the document and a template, into spans; the share of the
template's words that a chain covers decides. Short phrases are read off the same automaton.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tablegauge.llm.words import blocks, hashes

# Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Words of public licences and of the notices that name them, by label.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
        "public license for more details you should have received a copy of the gnu general public license along with this program",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation either version 2 1 of the license or at your option any later version",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
        "obtain one at",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
        "the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
        "and redistribute it freely",
    ],
}

#: Words of the shortest match that a chain takes up.
LEAST_MATCH = 3
#: Words that a chain may skip, in the document or in the template, between two matches.
MOST_GAP = 12
#: A span gives its label when it covers this share of its template, or so many words of it.
LEAST_SHARE = 0.75
LEAST_WORDS = 30

_SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, letters, digits and what is not ASCII, and the first word of each row (one more than rows)."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Automaton:
    """A generalised suffix automaton: every run of words of every template is a path from state 0."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(texts):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[last].append((t, k + 1))
        # longest first, so that a state has all its ends before they go on to its suffix
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            ends[self.link[state]] = sorted({*ends[self.link[state]], *ends[state]})
        self.ends = ends

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """``target`` for the runs that are one word longer than those of ``at``."""
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._new(self.length[at] + 1, self.link[target], dict(self.next[target]))
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        self.link[target] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.next[at][word])
        return new

    def state_of(self, words: list[int]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def read(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield state, length


class LicenceScan:
    """Templates and phrases in one automaton, and the words and neighbours it knows."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.labels = [label for label, texts in templates.items() for _ in texts]
        texts = [t.split() for own in templates.values() for t in own]
        self.sizes = [len(t) for t in texts]
        known = {w: k for k, w in enumerate(sorted({w for t in [*texts, *(p.split() for p in phrases)] for w in t}))}
        coded = [[known[w] for w in t] for t in [*texts, *(p.split() for p in phrases)]]
        self.automaton = Automaton(coded)
        own = {}
        for p, label in phrases.items():
            own.setdefault(self.automaton.state_of([known[w] for w in p.split()]), []).append((len(p.split()), label))
        self.ends = [[(t, e) for t, e in ends if t < len(texts)] for ends in self.automaton.ends]
        self.phrases: list[list[tuple[int, str]]] = [[]]
        for state in range(1, len(self.automaton.next)):
            found, at = [], state
            while at > 0:
                found += own.get(at, [])
                at = self.automaton.link[at]
            self.phrases.append(found)
        raw = b" ".join(w.encode() for w in known)
        data, cuts = np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(w.encode()) + 1 for w in known)])
        keys = hashes(data, cuts[:-1], cuts[1:] - 1)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        pairs = np.zeros((len(known), len(known)), bool)
        for t in coded:
            pairs[t[:-1], t[1:]] = True
        self.pairs = pairs

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that no template has."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def runs(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words whose neighbours are also neighbours in some template. Matches of two words or more lie in one each."""
        if len(codes) < 2:
            return
        near = (codes[:-1] >= 0) & (codes[1:] >= 0)
        near[near] = self.pairs[codes[:-1][near], codes[1:][near]]
        inner = first[(first > 0) & (first < len(codes))]
        near[inner - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield a, b + 1

    def document(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple], float]:
        """(label, base, start, end, covered, share) of all spans of a document, and the share of its best covered template.

        ``runs`` are its stretches with their first word's place. A base phrase is a template that is covered whole.
        """
        matches, base = [], []
        for start, words in runs:
            before = (0, 0)
            for k, now in enumerate(self.automaton.read(words)):
                if now[1] <= before[1] and before[1] >= LEAST_MATCH:
                    matches.append((start + k, *before))
                for size, label in self.phrases[now[0]]:
                    if size <= now[1]:
                        base.append((label, True, start + k + 1 - size, start + k + 1, size, 1.0))
                before = now
            if before[1] >= LEAST_MATCH:
                matches.append((start + len(words), *before))
        spans, best = self._chains(matches)
        return sorted(base, key=lambda s: s[2]) + spans, 1.0 if base else best

    def _chains(self, matches: list[tuple[int, int, int]]) -> tuple[list[tuple], float]:
        """Chains of matches (end, state, length), by template: a match follows one that ends shortly before it in both texts."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, size in matches:
            for t, e in self.ends[state]:
                by_template.setdefault(t, []).append((end, e, size))
        out, best = [], 0.0
        for t, own in by_template.items():
            covered, root = [], []
            low = 0
            for k, (end, e, size) in enumerate(own):
                top, of = size, k
                while own[low][0] < end - size - MOST_GAP:
                    low += 1
                for j in range(low, k):
                    end2, e2, _ = own[j]
                    if end2 < end and e2 < e and e - size - e2 <= MOST_GAP:
                        gain = size - max(0, end2 - (end - size), e2 - (e - size))
                        if gain > 0 and covered[j] + gain > top:
                            top, of = covered[j] + gain, root[j]
                covered.append(top)
                root.append(of)
            ends: dict[int, int] = {}
            for k, r in enumerate(root):
                if r not in ends or covered[k] > covered[ends[r]]:
                    ends[r] = k
            found = sorted(((covered[k], own[r][0] - own[r][2], own[k][0]) for r, k in ends.items()), key=lambda c: (-c[0], c[1]))
            best = max(best, found[0][0] / self.sizes[t])
            taken: list[tuple[int, int]] = []
            for words, a, b in found:
                if words < min(LEAST_SHARE * self.sizes[t], LEAST_WORDS):
                    break
                at = bisect.bisect(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    out.append((self.labels[t], False, a, b, words, words / self.sizes[t]))
        return sorted(out, key=lambda s: (s[2], s[3], s[0], -s[4])), min(best, 1.0)

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, float, list[tuple]]]:
        """Words, score and spans of each text."""
        for _, data, offsets in blocks(texts):
            starts, ends, first = word_spans(data, offsets)
            codes = self.codes(hashes(data, starts, ends)) if len(starts) else np.zeros(0, np.int64)
            of_row: dict[int, list[tuple[int, list[int]]]] = {}
            for a, b in self.runs(codes, first):
                row = int(np.searchsorted(first, a, "right")) - 1
                of_row.setdefault(row, []).append((a - int(first[row]), codes[a:b].tolist()))
            for row, words in enumerate(np.diff(first).tolist()):
                spans, score = self.document(of_row[row]) if row in of_row else ([], 0.0)
                yield words, score, spans


@lru_cache(1)
def _scan() -> LicenceScan:
    return LicenceScan(TEMPLATES, PHRASES)


@F.arrow_udf(from_arrow_type(_FOUND))
def _find(texts: pa.Array) -> pa.Array:
    names = [f.name for f in _SPAN]
    rows = [{"n_words": n, "score": score, "spans": [dict(zip(names, s)) for s in spans]} for n, score, spans in _scan().texts(texts)]
    return pa.array(rows, _FOUND)


def find_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, score and spans (label, base, start, end, covered, share), in words from 0, end exclusive.

    A word is a run of ASCII letters, digits and characters outside ASCII; A-Z count as a-z. Base spans are the places of the fixed phrases; the others
    are chains that cover enough of a template. ``score`` is the largest share of a template that a chain covers, 1 where a
    phrase stands. A null or empty text has no words and no spans, score 0; a null doc_id stays null; repeated rows each give a row; of
    chains with equal cover that overlap, the first in the text stays; extra columns are ignored; an empty table gives an empty
    one. Whole texts are read, one word at a time, so a long one costs no more a word than a short one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", _find("text").alias("found")).select("doc_id", "found.n_words", "found.score", "found.spans")


def licence_labels(found: DataFrame) -> DataFrame:
    """One row per row of ``find_licences``: n_words, n_base, first_word, last_word, base_labels, labels and score."""
    base = F.filter("spans", lambda s: s["base"])
    names = [F.array_join(F.array_sort(F.array_distinct(F.transform(s, lambda x: x["label"]))), ",") for s in (base, F.col("spans"))]
    starts = F.transform(base, lambda s: s["start"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        names[0].alias("base_labels"), names[1].alias("labels"), "score")
