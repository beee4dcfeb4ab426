"""Licence scans: how much of which licence text stands in a document, and where.

All templates make one generalised suffix automaton of words.  A document's words walk through it, which
gives the matching statistics: at every word the longest run of words up to it that some template has too.
Runs that cannot be extended and are long enough are matches; matches that follow each other in a document
and in a template, with few words between, are chained to a span of that template.  A template stands
where a chain covers enough of its words.

The automaton grows with the templates alone, which are parameters; it is all that is broadcast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 3  # words of a match that is chained
GAP = 12  # words between two matches of a chain, at most
COVERED = 0.75  # least share of a template's words
PIECE = 1 << 20  # bytes of a text that are split at a time

# Phrases whose every place counts, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences by which licences are granted, and what they grant.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX License Identifier MIT"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation"""),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies."""),
    ("no-warranty", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT"""),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]

_WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, in order; a list has those that begin in one piece of the text."""
    start = 0
    while start < len(text):
        end = start + PIECE
        # A piece ends where a word does.
        while end < len(text) and _WORD_BYTES[text[end]] != 0x20:
            end += 1
        yield text[start:end].translate(_WORD_BYTES).split()
        start = end


class Template(NamedTuple):
    label: str
    size: int  # words
    phrase: bool  # every place of it counts


class Automaton(NamedTuple):
    """States are numbered; state 0 is the empty run."""

    ids: dict[bytes, int]  # of the templates' words, from 1
    steps: list[dict[int, int]]  # by word
    links: list[int]  # the longest suffix in another state
    lengths: list[int]  # of the longest run of a state
    ends: list[list[tuple[int, int]]]  # templates and places behind which a state's runs end
    phrases: list[list[tuple[int, int]]]  # phrases that are suffixes of the state's runs, and their lengths
    templates: list[Template]


def build(templates: Iterable[tuple[str, str]], phrases: dict[str, str]) -> Automaton:
    """The generalised suffix automaton of templates ``(label, text)`` and phrases ``text: label``.

    Templates without words are left out.
    """
    listed = [(label, text, False) for label, text in templates] + [(v, k, True) for k, v in phrases.items()]
    split = [(label, [w for part in words(text.encode()) for w in part], p) for label, text, p in listed]
    split = [s for s in split if s[1]]
    ids: dict[bytes, int] = {}
    steps, links, lengths = [{}], [-1], [0]

    def state(length: int, own: dict[int, int], link: int) -> int:
        steps.append(own)
        links.append(link)
        lengths.append(length)
        return len(steps) - 1

    def redirect(at: int, word: int, old: int, new: int) -> None:
        while at >= 0 and steps[at].get(word) == old:
            steps[at][word] = new
            at = links[at]

    def shorter(at: int, word: int) -> int:
        """The state of ``at``'s longest run and ``word``, which may have to be cut off a longer one."""
        to = steps[at][word]
        if lengths[to] == lengths[at] + 1:
            return to
        copy = state(lengths[at] + 1, dict(steps[to]), links[to])
        links[to] = copy
        redirect(at, word, to, copy)
        return copy

    def extended(last: int, word: int) -> int:
        if word in steps[last]:
            return shorter(last, word)
        new, at = state(lengths[last] + 1, {}, -1), last
        while at >= 0 and word not in steps[at]:
            steps[at][word] = new
            at = links[at]
        links[new] = 0 if at < 0 else shorter(at, word)
        return new

    for _, own, _ in split:
        last = 0
        for word in own:
            last = extended(last, ids.setdefault(word, len(ids) + 1))

    ends: list[list[tuple[int, int]]] = [[] for _ in steps]
    of_phrase: list[list[tuple[int, int]]] = [[] for _ in steps]
    for number, (_, own, phrase) in enumerate(split):
        at = 0
        for place, word in enumerate(own, 1):
            at = steps[at][ids[word]]
            if not phrase:
                ends[at].append((number, place))
        if phrase:
            of_phrase[at].append((number, len(own)))
    # Longer runs come later: what ends a run ends its suffixes too; a phrase that is a suffix is one of all longer runs.
    order = sorted(range(1, len(steps)), key=lengths.__getitem__)
    for at in reversed(order):
        ends[links[at]].extend(ends[at])
    for at in order:
        of_phrase[at] = of_phrase[at] + of_phrase[links[at]]
    ends[0] = []
    return Automaton(ids, steps, links, lengths, ends, of_phrase, [Template(lb, len(w), p) for lb, w, p in split])


class Match(NamedTuple):
    first: int  # word of the document
    last: int  # behind it
    state: int


class Scan(NamedTuple):
    n_words: int
    phrases: list[tuple[int, int]]  # place of the first word, template
    spans: list[tuple[int, int, int, int]]  # first word, last word, template, covered words


def statistics(automaton: Automaton, text: bytes) -> Iterator[tuple[int, int, int]]:
    """Matching statistics where they are not 0: the place of a word, the length of the longest run up to
    it that a template has, and its state."""
    ids, steps, links, lengths = automaton[:4]
    base, at, length = 0, 0, 0
    for part in words(text):
        for place, word in enumerate(map(ids.get, part, repeat(0)), base):
            if not word:
                at = length = 0
                continue
            while at and word not in steps[at]:
                at = links[at]
                length = lengths[at]
            if word in steps[at]:
                at = steps[at][word]
                length += 1
                yield place, length, at
        base += len(part)


def _matches(automaton: Automaton, found: Iterable[tuple[int, int, int]], phrases: list, least: int) -> Iterator[Match]:
    """Runs of ``least`` words or more that cannot be extended; places of phrases are noted on the way."""
    before = None
    for place, length, state in found:
        for number, size in automaton.phrases[state]:
            if size <= length:
                phrases.append((place - size + 1, number))
        if before and (place != before[0] + 1 or length != before[1] + 1) and before[1] >= least:
            yield Match(before[0] - before[1] + 1, before[0] + 1, before[2])
        before = place, length, state
    if before and before[1] >= least:
        yield Match(before[0] - before[1] + 1, before[0] + 1, before[2])


def chains(
    automaton: Automaton, matches: Iterable[Match], gap: int = GAP, covered: float = COVERED
) -> Iterator[tuple[int, int, int, int]]:
    """Spans ``first, last, template, covered words`` of chained matches that cover enough of a template.

    Of the chains that end with a match the one that covers most is kept.  A match can follow those that
    end within ``gap`` words of the document before it, so only these are held; where two overlap, in
    the document or the template, the words they share count once.
    """
    open_: dict[int, deque] = {}

    def closed(number: int, chain: tuple) -> Iterator[tuple[int, int, int, int]]:
        words_covered, first, last, _, followed = chain
        if not followed and words_covered >= covered * automaton.templates[number].size:
            yield first, last - 1, number, words_covered

    for match in matches:
        for number, place in automaton.ends[match.state]:
            begin = place - (match.last - match.first)
            own = open_.setdefault(number, deque())
            while own and own[0][2] + gap < match.first:
                yield from closed(number, own.popleft())
            best, follows = (match.last - match.first, match.first), None
            for chain in own:
                shared = max(chain[2] - match.first, chain[3] - begin, 0)
                gained = match.last - match.first - shared
                if gained > 0 and chain[3] < place and chain[2] < match.last and chain[0] + gained > best[0]:
                    best, follows = (chain[0] + gained, chain[1]), chain
            if follows:
                follows[4].append(True)
            own.append((best[0], best[1], match.last, place, []))
    for number, own in open_.items():
        for chain in own:
            yield from closed(number, chain)


def scan(automaton: Automaton, text: bytes, least: int = LEAST, gap: int = GAP, covered: float = COVERED) -> Scan:
    """All places of phrases and all spans of templates in a text; of equal or nested spans of a label the widest."""
    phrases: list[tuple[int, int]] = []
    n = sum(map(len, words(text)))
    found = chains(automaton, _matches(automaton, statistics(automaton, text), phrases, least), gap, covered)
    spans, seen = [], {}
    for span in sorted(found, key=lambda s: (s[0], -s[1], -s[3] / automaton.templates[s[2]].size)):
        label = automaton.templates[span[2]].label
        if span[1] > seen.get(label, -1):
            seen[label] = span[1]
            spans.append(span)
    return Scan(n, sorted(phrases), spans)


def licences(
    docs: DataFrame,
    templates: Iterable[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    least: int = LEAST,
    gap: int = GAP,
    covered: float = COVERED,
) -> DataFrame:
    """``doc_id, n_words, phrases, spans`` of every row of ``docs`` and its whole ``text``.

    ``phrases``: an array of ``first, label``, every place of a phrase in order.  ``spans``: an array of
    ``first, last, label, covered`` in order, the first and last word of each chain that covers the
    share ``covered`` of a template.  Words are numbered from 0; A-Z are lower case.

    A null text is empty and has nothing.  Rows come back each, also repeated ones and those without id;
    other columns are not read; an empty table gives no rows.  Long texts are split in pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(templates, phrases))
    place = pa.struct([("first", pa.int64()), ("label", pa.string())])
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])
    names = ["doc_id", "n_words", "phrases", "spans"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        of = automaton.templates
        for batch in batches:
            found = [scan(automaton, t.as_py() or b"", least, gap, covered) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([[{"first": a, "label": of[k].label} for a, k in f.phrases] for f in found], pa.list_(place)),
                pa.array(
                    [[{"first": a, "last": b, "label": of[k].label, "covered": n / of[k].size} for a, b, k, n in f.spans]
                     for f in found], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs["text"].cast("binary").alias("text")
    return docs.select("doc_id", text).mapInArrow(
        rows,
        f"doc_id {kind}, n_words long, phrases array<struct<first:long,label:string>>, "
        "spans array<struct<first:long,last:long,label:string,covered:double>>",
    )
