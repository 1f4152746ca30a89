"""Licence scan with a generalised suffix automaton over licence tokens.

The automaton accepts every substring (in words) of every template: known
licence notices and the base phrases.  A text's words are streamed through it;
the matching statistic at a word is the longest run of words ending there that
occurs in some template.  A base phrase ends at a word exactly if its state is
the current state or one of its suffix-link ancestors (and the statistic is long enough).  Matches
that cannot be extended and have at least ``min_match`` words are laid onto
their templates and chained in order (text and template positions both rise) by
dynamic programming over all matches and places; pieces of a chain at most ``max_gap``
words apart are one span.  A template whose chained spans together cover at least
``min_cover`` of its words, however far apart in the text, gives its label; the spans
of every such chain, also of further copies, are reported, each with its own cover.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over whole texts.
Only runs of licence words enter the automaton (any other word resets it), so a
text costs one split and one dictionary look-up a word.  Plan: one shuffle-free scan.

Defined cases: a null or empty text has no words, no places and no labels (empty
strings, null first_word and last_word, score 0); repeated rows are each
reported; a tie between templates is resolved by name (labels are a sorted set).
"""

from __future__ import annotations

from functools import cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quietab.llm.common import WORD_TABLE, map_text, table

# The base phrases and the public licence notices that serve as templates.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "rights-reserved-line": "All rights reserved",
}

MIN_MATCH = 3
MAX_GAP = 8
MIN_COVER = 0.75

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
          T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
          T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
          T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([
              T.StructField("template", T.StringType()), T.StructField("start", T.LongType()),
              T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())])))]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences (one state per class of end positions)."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: places[state]: (sequence, end) where the state's strings end
        self.places: list[list] = [[] for _ in self.next]
        for k, seq in enumerate(sequences):
            state = 0
            for end, w in enumerate(seq, 1):
                state = self.next[state][w]
                self.places[state].append((k, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]].extend(self.places[state])
        self.places = [sorted(set(p)) for p in self.places]
        self.words = {w for seq in sequences for w in seq}

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def stream(self, seq: list[bytes]):
        """(state, matching statistic) after each word."""
        state, n = 0, 0
        for w in seq:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            yield state, n


class Scanner:
    def __init__(self, phrases: dict, templates: dict, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
                 min_cover: float = MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.names = sorted(templates)
        seqs = [words_of(templates[n].encode()) for n in self.names]
        self.sizes = [len(s) for s in seqs]
        base = [words_of(p.encode()) for p in phrases]
        self.gsa = Automaton(seqs + base)
        self.least_run = min([min_match, *(len(b) for b in base)])
        #: ends[state]: (length, label) of the base phrases that are suffixes of the state's strings
        whole = {}
        for k, (seq, label) in enumerate(zip(base, phrases.values())):
            state = 0
            for w in seq:
                state = self.gsa.next[state][w]
            whole.setdefault(state, []).append((len(seq), label))
        self.ends: list[tuple] = [()] * len(self.gsa.next)
        for state in sorted(range(1, len(self.gsa.next)), key=lambda s: self.gsa.length[s]):
            self.ends[state] = tuple(whole.get(state, ())) + self.ends[self.gsa.link[state]]

    def runs(self, words: list[bytes]):
        """(start, words) of the maximal runs of licence words that can hold a phrase or match."""
        known = self.gsa.words
        at = [i for i, w in enumerate(words) if w in known]
        for _, grp in groupby(enumerate(at), lambda x: x[1] - x[0]):
            run = [i for _, i in grp]
            if len(run) >= self.least_run:
                yield run[0], words[run[0]:run[-1] + 1]

    def scan(self, words: list[bytes]) -> dict:
        places, labels, matches = [], set(), []
        for start, run in self.runs(words):
            before = (0, 0)
            for at, now in enumerate(self.gsa.stream(run), start):
                state, n = now
                for size, label in self.ends[state]:
                    if size <= n:
                        places.append(at - size + 1)
                        labels.add(label)
                if before[1] >= self.min_match and n <= before[1]:
                    matches.append((at - before[1], before[1], before[0]))
                before = now
            if before[1] >= self.min_match:
                matches.append((start + len(run) - before[1], before[1], before[0]))
        score, spans = self.chained(matches)
        own = {s[0] for s in spans}
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
                "last_word": max(places, default=None), "base_labels": ",".join(sorted(labels)),
                "labels": ",".join(sorted(labels | own)),
                "score": 1.0 if labels else score,
                "spans": [dict(zip(("template", "start", "end", "cover"), s)) for s in spans]}

    def chained(self, matches: list) -> tuple[float, list[tuple]]:
        """Largest cover of a template, and (template, start, end, cover) of the spans of the chains with enough."""
        of: dict = {}
        for start, n, state in matches:
            for k, end in self.gsa.places[state]:
                if k < len(self.names) and n <= end:
                    of.setdefault(k, []).append((start, start + n, end))
        score, spans = 0.0, []
        for k, segments in of.items():
            def part(covered, size=self.sizes[k]):
                return round(min(1.0, covered / size), 6)
            most = part(max(chains(segments)[0]))
            score = max(score, most)
            if most < self.min_cover:
                continue
            for far in (False, True):  # whole copies first, then copies in pieces
                found, segments = self.taken(segments, far, part)
                spans.extend((self.names[k], a, b, part(c)) for a, b, c in found)
        return score, sorted(spans)

    def taken(self, segments: list, far: bool, part) -> tuple[list, list]:
        """Spans (start, end, covered words) of the chains with enough cover that
        share no word of the text, best first, and the segments apart from them."""
        spans = []
        while segments:
            covered, back = chains(segments, None if far else self.max_gap)
            used = bytearray(segments[-1][1])
            for i in sorted(range(len(segments)), key=lambda i: -covered[i]):
                if part(covered[i]) < self.min_cover:
                    break
                pieces: list = []
                while i >= 0:
                    a, b, _ = segments[i]
                    c = covered[i] - (covered[back[i]] if back[i] >= 0 else 0)
                    if pieces and pieces[-1][0] - b <= self.max_gap:
                        pieces[-1] = (a, pieces[-1][1], pieces[-1][2] + c)
                    else:
                        pieces.append((a, b, c))
                    i = back[i]
                if not any(1 in used[a:b] for a, b, _ in pieces):
                    spans.extend(pieces)
                    for a, b, _ in pieces:
                        used[a:b] = b"\1" * (b - a)
            if 1 not in used:
                break
            segments = [s for s in segments if 1 not in used[s[0]:s[1]]]
        return spans, segments


def chains(segments: list, max_gap: int | None = None) -> tuple[list, list]:
    """Of (text start, text end, template end) with rising starts and ends: the
    template words covered by the best chain up to each, and its last segment but
    one (-1: none; ties: the nearest).  Chains up to a template end that lie wholly
    before a segment differ in cover only, so the work is linear in the segments."""
    covered, back = [], []
    settled: dict = {}  # template end -> best segment that ends before the present one
    low = 0
    for i, (a, b, e) in enumerate(segments):
        while segments[low][1] <= a if max_gap is None else segments[low][1] < a - max_gap:
            end = segments[low][2]
            if max_gap is None and (end not in settled or covered[low] >= covered[settled[end]]):
                settled[end] = low
            low += 1
        best, last = b - a, -1
        for j in sorted((*settled.values(), *range(low, i))):
            if segments[j][2] < e and segments[j][1] < b:
                c = covered[j] + min(b - a, b - segments[j][1], e - segments[j][2])
                if c > best or (c == best and last >= 0):
                    best, last = c, j
        covered.append(best)
        back.append(last)
    return covered, back


@cache
def default_scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


def licences(docs: DataFrame, keep: list[str] | None = None, phrases: dict | None = None,
             templates: dict | None = None) -> DataFrame:
    """Word counts, base places, labels, score and covered spans of every document."""
    def make():
        s = default_scanner() if phrases is None and templates is None else Scanner(
            phrases if phrases is not None else PHRASES, templates if templates is not None else TEMPLATES)

        def f(block):
            got = [s.scan(words_of(t)) for t in block]
            return {c.name: [g[c.name] for g in got] for c in FIELDS}
        return f
    return map_text(docs, FIELDS, make, keep=keep)


def op2_licence_scan(spark, sf_dir) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"), keep=["doc_id"])
