from __future__ import annotations

import random
import re

import pytest

from shelfmark.llm import licences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def places(text, phrases=licences.PHRASES):
    w = split(text)
    return sorted(
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    )


def is_part(run, templates):
    return any(run == t[i : i + len(run)] for t in templates for i in range(len(t) - len(run) + 1))


def test_matching_statistics_and_places():
    rnd = random.Random(4)
    for _ in range(60):
        letters = "abcd"[: rnd.randrange(1, 5)]
        made = lambda n: [rnd.choice(letters) for _ in range(n)]
        templates = [(str(k), " ".join(made(rnd.randrange(1, 12)))) for k in range(rnd.randrange(1, 6))]
        phrases = {" ".join(made(k + 1)): f"p{k}" for k in range(rnd.randrange(1, 4))}
        automaton = licences.build(templates, phrases)
        whole = [split(t) for _, t in templates] + [split(p) for p in phrases]
        text = made(60)
        if rnd.random() < 0.5:
            text[rnd.randrange(60)] = "zz"
        got = {i: (n, s) for i, n, s in licences.statistics(automaton, " ".join(text).encode())}
        for i in range(len(text)):
            want = max(n for n in range(i + 2) if n == 0 or is_part(text[i - n + 1 : i + 1], whole))
            assert got.get(i, (0, 0))[0] == want
            if want:
                run = text[i - want + 1 : i + 1]
                ends = {(k, e) for k, t in enumerate(whole[: len(templates)]) for e in range(want, len(t) + 1) if t[e - want : e] == run}
                assert set(automaton.ends[got[i][1]]) == ends
        found = licences.scan(automaton, " ".join(text).encode()).phrases
        assert [(i, automaton.templates[k].label) for i, k in found] == places(" ".join(text), phrases)


def labels(text, **options):
    automaton = licences.build(licences.TEMPLATES, licences.PHRASES)
    return {automaton.templates[k].label: (a, b, n) for a, b, k, n in licences.scan(automaton, text.encode(), **options).spans}


def test_spans_of_changed_licences():
    mit = licences.TEMPLATES[3][1]
    n = len(split(mit))
    before = "Some words. " * 20
    assert labels(before + mit + " And more.")["mit"] == (40, 39 + n, n)
    # A word changed every 15 words (one more is alone behind the last), a line put in between: chained over the gaps.
    changed = split(mit)
    for k in range(10, n, 15):
        changed[k] = "other"
    changed[50:50] = ["inserted"] * 8
    first, last, covered = labels(" ".join(changed))["mit"]
    assert first == 0 and last >= len(changed) - licences.LEAST and covered == n - 7
    # Half of it is not enough; nor are its halves in the wrong order.
    assert "mit" not in labels(" ".join(split(mit)[: n // 2]))
    assert "mit" not in labels(" ".join(split(mit)[n // 2 :] + split(mit)[: n // 2]))
    assert "mit" not in labels(" ".join(split(mit)[: n // 2] + ["x"] * (licences.GAP + 1) + split(mit)[n // 2 :]))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the MIT License.", {"mit"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("The public held a general license to walk; all rights were reserved for the king under the law.", set()),
        ("", set()),
    ],
)
def test_short_grants(text, want):
    assert set(labels(text)) == want


def test_chains_equal_the_best_of_all():
    """Against the best chain by trying all predecessors of every match."""
    rnd = random.Random(9)
    for _ in range(40):
        templates = [("t", " ".join(rnd.choice("abcdefgh") for _ in range(14))), ("u", " ".join(rnd.choice("abcdefgh") for _ in range(9)))]
        automaton = licences.build(templates, {})
        parts = [rnd.choice(templates)[1].split() for _ in range(4)]
        text = [w for p in parts for w in p[rnd.randrange(5) : rnd.randrange(5, len(p) + 1)] + ["z"] * rnd.randrange(4)]
        matches = list(licences._matches(automaton, licences.statistics(automaton, " ".join(text).encode()), [], 2))
        best = {}
        for number in range(2):
            ended = []
            for m in matches:
                for k, place in automaton.ends[m.state]:
                    if k == number:
                        size = m.last - m.first
                        top = size
                        for covered, last, at in ended:
                            gained = size - max(last - m.first, at - (place - size), 0)
                            if last + 5 >= m.first and gained > 0 and at < place and last < m.last:
                                top = max(top, covered + gained)
                        ended.append((top, m.last, place))
            best[number] = max((e[0] for e in ended), default=0)
        got = {}
        for _, _, number, n in licences.chains(automaton, matches, 5, 0.0):
            got[number] = max(got.get(number, 0), n)
        assert got == {k: v for k, v in best.items() if v}


def test_rows(spark, make_docs, monkeypatch):
    texts = [None, "", "CC BY\ncc-by  Cc_bY ccby", "all rights reserved. All  Rights\tReserved", "été CC BYé İ cc by", "x " * 50_000 + "general public license"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "cc by", "s"), (3, texts[3], "s"), (9, "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " cc by", None)]
    got = licences.licences(make_docs(rows)).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_words, [(p.first, p.label) for p in r.phrases]) for r in got])) == sorted(
        map(repr, [(i, len(split(t)), places(t)) for i, t, _ in rows])
    )
    assert licences.licences(make_docs([])).count() == 0
    whole = licences.scan(licences.build(licences.TEMPLATES, licences.PHRASES), texts[5].encode())
    monkeypatch.setattr(licences, "PIECE", 7)
    assert licences.scan(licences.build(licences.TEMPLATES, licences.PHRASES), texts[5].encode()) == whole
