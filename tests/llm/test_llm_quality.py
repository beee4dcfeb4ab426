from __future__ import annotations

import math
import re
from collections import Counter

from shelfmark.llm import quality
from tests_llm_words import WORDS

PROSE = "Words of a plain sentence follow each other here, and every one of them says something new again today."


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
    )


def test_measures(make_docs):
    eight = "a b c d e f g h"
    texts = [
        None, "", " \n\t\x0b", "one", PROSE, eight, f"{eight} {eight}", "x " * 30, f"{PROSE}\n{PROSE}\n\n \n{PROSE}",
        "a\x0bb\x0cc d e é퟿ 漢字 #*$%&|<> | |", "same line\nsame line \nsame line", "w " * 100_000,
        " ".join(str(i % 5000) for i in range(20_000)), "a b c d e f g h i a b c d e f g h j b c d e f g h i",
    ]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    for r in quality.judged(docs).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_the_votes(make_docs):
    words = PROSE.split()
    clean = [" ".join(words[k:] + words[:k]) + f" Number {k} ends." for k in range(18)] * 20
    marked = [" ".join(w + "***" for w in words * 2) + f" {k}" for k in range(40)]
    table = [" | ".join(words + [str(k)] + words[::-1]) for k in range(30)]
    shout = [" ".join(w.upper() + "!!" for w in words * 2) + f" {k}" for k in range(30)]
    texts = clean + marked + table + shout
    docs = make_docs([(i, t, None) for i, t in enumerate(texts)] + [(None, clean[0], None), (0, clean[0], None)])
    got = quality.judged(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id < len(clean)), (r.doc_id, r.quality)


def test_fit_is_expectation_maximisation(spark):
    rules = tuple(quality.Rule(n, "false", "false") for n in "ab")
    rows = [(1, 1)] * 50 + [(1, 0)] * 9 + [(-1, -1)] * 20 + [(-1, 1)] * 4 + [(0, -1)] * 3
    model = quality.fit(spark.createDataFrame(rows, "vote_a int, vote_b int"), rules)
    start = quality._start(rules)
    share, good, bad = start.share, start.good, start.bad
    for _ in range(quality.ROUNDS):
        post = []
        for v in rows:
            at = [3 * j + x + 1 for j, x in enumerate(v)]
            odds = math.log(share / (1 - share)) + sum(math.log(good[k] / bad[k]) for k in at)
            post.append((at, 1 / (1 + math.exp(-odds))))
        total = sum(p for _, p in post)
        good = [(sum(p for at, p in post if k in at) + 1) / (total + 3) for k in range(6)]
        bad = [(sum(1 - p for at, p in post if k in at) + 1) / (len(rows) - total + 3) for k in range(6)]
        share = (total + 1) / (len(rows) + 2)
    assert math.isclose(model.share, share, rel_tol=1e-9)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(model.good + model.bad, good + bad, strict=True))


def test_empty_table(make_docs):
    assert quality.judged(make_docs([])).count() == 0
