"""License scans by a generalised suffix automaton of license words.

The templates' words form one automaton. A text is streamed through it once, which gives
at every word the longest match that ends there (the matching statistics). Matches that
no next word extends, of ``MIN_MATCH`` words or more, are taken at every place that the
template has them, and chained in the order of both text and template. Of all chains the
one that covers the most words counts: a match that overlaps the one before it, in the text
or in the template, is trimmed by the overlap. A template is found where a chain covers
enough of its words. Templates are short notices and the full texts in ``license_texts``.

The scan of a text takes time in proportion to its words, times the matches that end within
``GAP`` words or a match's length.

Words are runs of ASCII digits and letters, A-Z in lower case, and of all characters
beyond ASCII. Defined cases: a null or empty text has no word, no label and score 0;
repeated rows are scanned each; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIN_MATCH, COVERAGE, GAP = 4, 0.7, 12

# The base phrases and their labels.
PHRASES = (
    (b"under the mit license", "mit"),
    (b"apache license version 2", "apache-2"),
    (b"cc by nc", "cc-by-nc"),
)

# Notices and texts of public licenses, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this"
        " permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
        " fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met: Redistributions of source code must retain the"
        " above copyright notice, this list of conditions and the following disclaimer. Redistributions in"
        " binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the"
        " License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
        " as published by the Free Software Foundation",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of"
        " the MPL was not distributed with this file, You can obtain one at",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


# Label of each full text, by the name of its file.
TEXT_LABELS = {
    "apache-2": "apache-2", "artistic": "artistic", "bsd": "bsd", "cc0": "cc0", "gpl-2": "gpl", "gpl-3": "gpl",
    "lgpl-2.1": "lgpl", "lgpl-3": "lgpl", "mpl-2": "mpl-2",
}


@lru_cache(maxsize=1)
def all_templates() -> tuple[tuple[str, str], ...]:
    """The notices and the full texts, which lie beside this file; read on the driver."""
    folder = Path(__file__).parent / "license_texts"
    return TEMPLATES + tuple((label, (folder / f"{name}.txt").read_text()) for name, label in TEXT_LABELS.items())


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``next[s]`` are the transitions of state s, ``link[s]`` its suffix link, ``length[s]``
    its longest match and ``ends[s]`` all (template, end) of its matches, if these may have
    ``MIN_MATCH`` words.
    """

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for end, word in enumerate(words, 1):
                last = self._extend(last, word)
                self.ends[last].append((number, end))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.length[above] >= MIN_MATCH:
                self.ends[above] += self.ends[state]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._fit(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last != -1:
            self.link[new] = self._fit(last, word, self.next[last][word])
        return new

    def _fit(self, state: int, word: bytes, target: int) -> int:
        """The state of exactly ``state``'s longest match and ``word``: ``target`` or its clone."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches of ``MIN_MATCH`` words or more that end where
        they can't be extended."""
        following, link, lengths = self.next, self.link, self.length
        state = length = 0
        for i, word in enumerate(words):
            to = following[state].get(word)
            if to is None:
                if length >= MIN_MATCH:
                    yield i, length, state
                while to is None and state:
                    state = link[state]
                    length = lengths[state]
                    to = following[state].get(word)
                if to is None:
                    continue
            state = to
            length += 1
        if length >= MIN_MATCH:
            yield len(words), length, state


def chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(covered words, start, end) of the best chain that ends with each of ``matches``.

    These are (end in the text, end in the template, length), in order, of one template. A
    match follows another that ends before it in both and at most ``GAP`` words before it in
    the text; it covers what the other has not.
    """
    best: list[tuple[int, int, int]] = []
    for i, (end, at, length) in enumerate(matches):
        start = end - length
        most, first = length, start
        for j in range(i - 1, -1, -1):
            before, place, _ = matches[j]
            if before < start - GAP:
                break
            left = length - max(0, before - start, place - (at - length))
            # No match that ends with this one's first words can follow by a gap.
            if left > 0 and start + length - left <= before + GAP and best[j][0] + left > most:
                most, first = best[j][0] + left, best[j][1]
        best.append((most, first, end))
    return best


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _ in templates]
        sequences = [words_of(text.encode()) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)

    def chained(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """The ``chains`` of each template that matches."""
        found = defaultdict(list)
        for end, length, state in self.automaton.matches(words):
            for number, at in self.automaton.ends[state]:
                found[number].append((end, at, length))
        return {number: chains(sorted(matches)) for number, matches in found.items()}

    def spans(self, chained: dict[int, list[tuple[int, int, int]]]) -> list[dict]:
        """Found templates: label, start and end in words, covered share; by start.

        Of chains of a template that overlap in the text the one that covers the most is taken.
        """
        found = []
        for number, ends in chained.items():
            size, taken = self.sizes[number], []
            enough = [x for x in ends if x[0] >= COVERAGE * size]
            for covered, start, end in sorted(enough, key=lambda x: (-x[0], x[1])):
                at = bisect_left(taken, (start, end))
                if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (start, end))
                found.append({"label": self.labels[number], "start": start, "end": end, "covered": covered / size})
        return sorted(found, key=lambda x: (x["start"], x["label"], x["end"]))

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in PHRASES:
            # Blanks are counted on from the place before.
            seen = word = 0
            at = joined.find(b" " + phrase + b" ")
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                places.append(word)
                labels.add(label)
                at = joined.find(b" " + phrase + b" ", at + 1)
        chained = self.chained(words)
        found = self.spans(chained)
        covered = [max(ends)[0] / self.sizes[number] for number, ends in chained.items()]
        return {
            "n_words": len(words),
            "places": sorted(places),
            "base_labels": sorted(labels),
            "labels": sorted(labels | {s["label"] for s in found}),
            "spans": found,
            "score": max(covered + [1.0 for _ in places[:1]], default=0.0),
        }


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One scanner for each worker, kept from task to task."""
    return Scanner(templates)


_SCAN = pa.struct(
    [
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.int64())),
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("start", pa.int64()),
                        ("end", pa.int64()),
                        ("covered", pa.float64()),
                    ]
                )
            ),
        ),
        ("score", pa.float64()),
    ]
)
SCAN = (
    "struct<n_words:bigint,places:array<bigint>,base_labels:array<string>,labels:array<string>,"
    "spans:array<struct<label:string,start:bigint,end:bigint,covered:double>>,score:double>"
)


def license_scan(text: Column, templates: tuple[tuple[str, str], ...] | None = None) -> Column:
    """What ``Scanner.scan`` gives for each text, by ``all_templates`` if none are given."""
    templates = all_templates() if templates is None else tuple(templates)

    @F.arrow_udf(SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner(templates)
        for texts in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            yield pa.array([scanner.scan(t) for t in raw], _SCAN)

    return scan(text)
