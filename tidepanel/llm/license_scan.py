"""License scans with a generalised suffix automaton.

The automaton holds the words of license notices (``TEMPLATES``) and of the
plain phrases (``PHRASES``). A text is streamed through it; after each word it
gives the longest run of words ending there that stands in some template (the
matching statistic), and where that is. Long matches of one template are chained
in rising order on both sides, with gaps; the share of the template's words that
a chain covers decides on its label and gives the span in the text; every place where
a template stands is a span. Places of the
plain phrases are read off the same states.

Only words of the automaton's vocabulary can be part of a match, and a match of
two words or more needs two that follow each other somewhere; stretches of such
words are found with arrays and only they are streamed, which loses no match of
two words or more.

Defined cases: null and empty texts have no words, no places, empty labels and
score 0; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.shared import ALNUM_TABLE, Words, hash_of_words, rounds_of

#: Phrases whose every place counts, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The notices by which public licenses are usually applied.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


class SuffixAutomaton:
    """Of several sequences of numbers; ``ends`` of a state: where the strings of
    the state end, as (sequence, place)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, c in enumerate(sequence):
                last = self._extend(last, c, own)
                own[last].append((number, place))
        self.ends: list[set[tuple[int, int]]] = [set(x) for x in own]
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _clone(self, p: int, c: int, q: int, own: list) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        own.append([])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int, own: list) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q, own)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        own.append([])
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, own)
        return new

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each place."""
        state, size = 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            yield state, size


@dataclass
class Scanner:
    """A compiled set of templates and phrases."""

    templates: list[tuple[str, str]]
    phrases: dict[str, str]
    least_words: int = 4
    most_gap: int = 12
    least_share: float = 0.5
    least_cover: int = 10

    def __post_init__(self):
        texts = [t.split() for _, t in self.templates] + [p.split() for p in self.phrases]
        self.names = [name for name, _ in self.templates]
        self.sizes = [len(t) for t in texts[: len(self.templates)]]
        vocab = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocab)}
        h = hash_of_words(vocab)
        order = np.argsort(h)
        self.hashes, self.number = h[order], order
        self.door = np.zeros(1 << 16, bool)
        self.door[(h >> np.uint64(48)).astype(np.int64)] = True
        coded = [[number[w] for w in t] for t in texts]
        self.follows = np.zeros((len(vocab), len(vocab)), bool)
        for t in coded:
            self.follows[t[:-1], t[1:]] = True
        self.automaton = SuffixAutomaton(coded)
        n = len(self.templates)
        at: dict[int, list[tuple[int, int, str]]] = {}
        for i, (phrase, label) in enumerate(self.phrases.items()):
            size = len(phrase.split())
            for state, ends in enumerate(self.automaton.ends):
                # The phrase ends wherever the strings of this state end.
                if state and self.automaton.length[state] >= size and (n + i, size - 1) in self._ends_of(coded[n + i]) and ends <= self._ends_of(coded[n + i]):
                    at.setdefault(state, []).append((size, i, label))
        self.phrase_at = at

    def _ends_of(self, sequence: list[int]) -> set[tuple[int, int]]:
        state = 0
        for c in sequence:
            state = self.automaton.next[state][c]
        return self.automaton.ends[state]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.door[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[maybe]
        out[maybe[same]] = self.number[place[same]]
        return out

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """From one text's stretches (first word, numbers): the places of phrases
        as (first word, label), and the spans as (label, first, last, share)."""
        places, matches = [], []
        for begin, sequence in runs:
            before: tuple[int, int, int] | None = None
            for i, (state, size) in enumerate(self.automaton.stream(sequence)):
                for length, _, label in self.phrase_at.get(state, ()):
                    if size >= length:
                        places.append((begin + i - length + 1, label))
                # A match is kept where it stops growing.
                if before is not None and size <= before[1] and before[1] >= self.least_words:
                    matches.append(before)
                before = (state, size, begin + i)
            if before is not None and before[1] >= self.least_words:
                matches.append(before)
        return places, self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for state, size, last in matches:
            for number, end in self.automaton.ends[state]:
                if number < len(self.names):
                    by.setdefault(number, []).append((last - size + 1, end - size + 1, size))
        spans = []
        for number, found in by.items():
            found = sorted(set(found))
            while taken := self._take(found, self.sizes[number]):
                spans += [(self.names[number], first, last, share) for first, last, share in taken]
                edges = sorted((first, last) for first, last, _ in taken)
                found = [m for m in found if not _meets(edges, m)]
        return sorted(spans, key=lambda s: s[1:3])

    def _take(self, found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, float]]:
        """The best chains of one template, (first, last, share), that pass a limit and
        do not overlap, best first."""
        best: list[tuple[int, int]] = []
        reach = self.most_gap + max((n for _, _, n in found), default=0)
        for j, (d, t, n) in enumerate(found):
            score, prev = n, -1
            for i in range(j - 1, -1, -1):
                d0, t0, n0 = found[i]
                if d - d0 > reach:
                    break
                if 0 <= d - (d0 + n0) <= self.most_gap and 0 <= t - (t0 + n0) <= self.most_gap and best[i][0] + n > score:
                    score, prev = best[i][0] + n, i
            best.append((score, prev))
        passes = lambda score: score / size >= self.least_share or score >= self.least_cover
        queue = [(-score, j) for j, (score, _) in enumerate(best) if passes(score)]
        heapify(queue)
        edges: list[tuple[int, int]] = []
        out = []
        while queue:
            score, top = heappop(queue)
            if _meets(edges, found[top]):
                continue
            first, whole = top, found[top][2]
            while (i := best[first][1]) >= 0 and not _meets(edges, found[i]):
                first, whole = i, whole + found[i][2]
            if whole < -score:  # its beginning went to a better chain
                if passes(whole):
                    heappush(queue, (-whole, top))
                continue
            span = (found[first][0], found[top][0] + found[top][2] - 1)
            insort(edges, span)
            out.append((*span, min(1.0, whole / size)))
        return out


def _meets(edges: list[tuple[int, int]], match: tuple[int, int, int]) -> bool:
    """Whether a match overlaps one of the ranges, which are apart and in order."""
    i = bisect_right(edges, (match[0] + match[2] - 1, float("inf"))) - 1
    return i >= 0 and edges[i][1] >= match[0]


_OUT_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"


def _rows(scanner: Scanner, texts: pa.Array) -> list[tuple]:
    words = Words(texts, ALNUM_TABLE)
    known = scanner.known(words.hashes())
    n = len(known)
    pair = np.zeros(n, bool)  # this word and the next can be in one match
    if n > 1:
        pair[:-1] = (known[:-1] >= 0) & (known[1:] >= 0)
        pair[:-1] &= scanner.follows[known[:-1], known[1:]]
    cut = words.of[1:-1] - 1
    pair[cut[(cut >= 0) & (cut < n)]] = False
    begin = np.flatnonzero(pair & ~np.concatenate([[False], pair[:-1]]))
    end = np.flatnonzero(pair & ~np.concatenate([pair[1:], [False]])) + 2
    which = np.searchsorted(words.of, begin, "right") - 1
    runs: dict[int, list[tuple[int, list[int]]]] = {}
    for text, a, b in zip(which.tolist(), begin.tolist(), end.tolist()):
        runs.setdefault(text, []).append((a - int(words.of[text]), known[a:b].tolist()))
    out = []
    for i, count in enumerate(words.counts().tolist()):
        places, spans = scanner.scan(runs[i]) if i in runs else ([], [])
        starts, base = [p for p, _ in places], sorted({label for _, label in places})
        labels = sorted({*base, *(s[0] for s in spans)})
        score = max([s[3] for s in spans] + [1.0] * bool(base), default=0.0)
        out.append((count, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [dict(zip(("label", "first", "last", "share"), s)) for s in spans]))
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, the number and outer places of the base
    phrases, base_labels, labels, score, and the covered template spans."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, phrases or PHRASES))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                rows = _rows(sent.value, texts)
                yield pa.record_batch([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_OUT_DDL}")
