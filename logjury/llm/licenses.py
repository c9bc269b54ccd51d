"""Operator 9: licence scan by matching statistics against a suffix automaton of licence tokens.

All licence templates form one generalised suffix automaton over words (between two templates lies a
token no text has, so no match crosses them). The words of a file are streamed through it: at every
word the state gives the longest run ending there that some template contains. Where such a run
cannot be extended and has at least ``MIN_MATCH`` words it is a match, at every place where its template holds it;
matches of one template with rising places and gaps of at most ``GAP`` words are chained to a span, several chains of a
template at a time, and the share of the
template's words that a span covers is its score. A span of at least ``COVER`` gives the label of the
template; of spans of a template that overlap the one that covers most stays. Stretches without licence words are
skipped: no run of a template lies in them.

The base phrases are rows of the automaton as well: a state knows the phrases that end in it, so every place where the
words of one stand one after the other is read off the same stream.

Scale: one narrow pass; the automaton is built from the templates, a fixed text, in every worker.

Defined cases: null and empty texts have no words and no labels; overlapping places all count;
repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.llm.shared import in_batches, table

MIN_MATCH = 3
GAP = 6
COVER = 0.6
# What a place of a base phrase is worth at least.
BASE_SCORE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases that are always reported, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Public licence notices.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
}


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


class Automaton:
    """Generalised suffix automaton of token rows.

    ``ends`` has for every state, by row, the smallest place at which its runs end there, ``places`` all of them.
    ``said`` has the rows of ``phrases``, by number, that end in a state, with their sizes.
    """

    def __init__(self, rows: list[list[int]], phrases: range = range(0)):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        self.places: list[dict[int, set[int]]] = []
        last = 0
        for template, row in enumerate(rows):
            for place, token in enumerate(row):
                last = self._extend(last, token, template, place)
            last = self._extend(last, -2 - template, -1, 0)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            above = self.ends[self.link[state]]
            for template, place in self.ends[state].items():
                above[template] = min(place, above.get(template, place))
        self._gather(rows, phrases)

    def _gather(self, rows: list[list[int]], phrases: range) -> None:
        """All places of every state, from those whose runs are longer, and the phrases, from those shorter."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        self.places = [{} for _ in self.step]
        for row, tokens in enumerate(rows):
            state = 0
            for place, token in enumerate(tokens):  # the state of a whole beginning is of its own length
                state = self.step[state][token]
                self.places[state].setdefault(row, set()).add(place)
        for state in reversed(order):
            for row, own in self.places[state].items():
                self.places[self.link[state]].setdefault(row, set()).update(own)
        self.said: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for row in phrases:
            state = 0
            for token in rows[row]:
                state = self.step[state][token]
            if state:
                self.said[state].append((row, len(rows[row])))
        for state in order:
            self.said[state] = self.said[self.link[state]] + self.said[state]

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _extend(self, last: int, token: int, template: int, place: int) -> int:
        new = self._state({}, 0, self.length[last] + 1)
        if template >= 0:
            self.ends[new][template] = place
        p = last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
                while p >= 0 and self.step[p].get(token) == q:
                    self.step[p][token] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
        return new

    def matches(
        self, tokens: list[int], shortest: int, spoken: list[tuple[int, int]] | None = None
    ) -> Iterator[tuple[int, int, int]]:
        """``(first word, length, state)`` of the runs that cannot be extended, in order.

        ``spoken`` collects ``(first word, row)`` of the phrases on the way.
        """
        state = size = 0
        for at, token in enumerate(tokens):
            grown = token in self.step[state]
            if not grown and size >= shortest:
                yield at - size, size, state
            while state and token not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.step[state]:
                state = self.step[state][token]
                size += 1
            if spoken is not None:
                spoken += [(at + 1 - n, row) for row, n in self.said[state] if n <= size]
        if size >= shortest:
            yield len(tokens) - size, size, state


class Scanner:
    """Templates, phrases, their words and the automaton."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.labels = [name for name, _ in templates]
        rows = [words(text) for _, text in templates]
        spoken = [words(text) for text, _ in phrases]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for row in rows + spoken for w in row))}
        self.sizes = [len(row) for row in rows]
        every = rows + spoken
        of_phrases = range(len(rows), len(every))
        self.automaton = Automaton([[self.ids[w] for w in row] for row in every], of_phrases)
        self.phrases = dict(zip(of_phrases, (label for _, label in phrases), strict=True))
        self.shortest = min([MIN_MATCH, *(len(row) for row in spoken if row)])

    def found(self, ids: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Places of base phrases, and label, first and last word and covered share of every chain that covers enough."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        base: list[tuple[int, str]] = []
        chains: dict[int, list[list[int]]] = {}  # those that may go on, by template
        done: list[tuple[int, list[int]]] = []
        for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - first < self.shortest:
                continue
            spoken: list[tuple[int, int]] = []
            for at, size, state in self.automaton.matches(ids[first:stop].tolist(), MIN_MATCH, spoken):
                for template, places in self.automaton.places[state].items():
                    if template not in self.phrases:
                        self._chain(chains.setdefault(template, []), done, template, first + at, size, sorted(places))
            base += [(first + at, self.phrases[row]) for at, row in spoken]
        done += [(template, chain) for template, own in chains.items() for chain in own]
        return sorted(base), self._covering(done)

    def _chain(
        self, chains: list[list[int]], done: list[tuple[int, list[int]]], template: int, start: int, size: int, places: list[int]
    ) -> None:
        """Go on with the chains that a match fits, at the nearest of its places; it begins chains at its other ones."""
        end = start + size - 1
        for chain in [c for c in chains if start - c[1] - 1 > GAP]:
            done.append((template, chain))
            chains.remove(chain)
        taken = set()
        # A chain: first word, last word, place in the template, words covered.
        for chain in chains:
            place = next((p for p in places if 0 < p - chain[2] <= size + GAP), None)
            if place is not None:
                chain[3] += min(size, place - chain[2], end - chain[1])
                chain[1:3] = [end, place]
                taken.add(place)
        chains += [[start, end, place, size] for place in places if place not in taken]

    def _covering(self, done: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """Chains that cover enough of their template; of those that overlap the one that covers most."""
        found = []
        kept: dict[int, list[tuple[int, int]]] = {}  # of a template, apart from each other and in order
        for template, (start, end, _, covered) in sorted(done, key=lambda d: (-d[1][3], d[1][0], d[1][1])):
            share = min(1.0, covered / self.sizes[template])
            own = kept.setdefault(template, [])
            at = bisect_left(own, (start, end))
            free = (at == 0 or own[at - 1][1] < start) and (at == len(own) or end < own[at][0])
            if share >= COVER and free:
                own.insert(at, (start, end))
                found.append((self.labels[template], start, end, share))
        return sorted(found, key=lambda span: (span[1], span[2], span[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        row = words(text)
        get = self.ids.get
        ids = np.array([get(w, -1) for w in row], dtype=np.int64)
        return len(row), *self.found(ids)


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, phrases)


RESULT = (
    "n_words long, base array<struct<word: long, label: string>>, "
    "spans array<struct<label: string, first_word: long, last_word: long, cover: double>>"
)
_BASE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])
)


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, base, spans)`` for every row."""
    parts = tuple((templates or TEMPLATES).items()), tuple((phrases or PHRASES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(*parts)
        for batch in batches:
            found = [own.scan(t) for t in batch.column(1).to_pylist()]
            base = [[{"word": at, "label": label} for at, label in row[1]] for row in found]
            spans = [
                [{"label": n, "first_word": a, "last_word": b, "cover": c} for n, a, b, c in row[2]] for row in found
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row[0] for row in found], pa.int64()), pa.array(base, _BASE), pa.array(spans, _SPANS)],
                names=["doc_id", "n_words", "base", "spans"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return in_batches(named, run, f"doc_id {kind}, {RESULT}")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    places = F.transform("base", lambda x: x["word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    own = F.transform("spans", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["cover"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
        "spans",
    )
