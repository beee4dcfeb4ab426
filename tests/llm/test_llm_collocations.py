from __future__ import annotations

import random
import re
from collections import Counter

from shelfmark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, phrase string, n string"


def brute(rows, longest=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [
            b for (other, more), b in candidates.items()
            if other == lang and len(more) > len(words) and 100 * b >= inside * a
            and any(more[i : i + len(words)] == words for i in range(len(more) - len(words) + 1))
        ]
        if not longer:
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, listed in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1)
    )


def docs(spark, rows, partitions=3):
    full = [(i, t, lang, "s", 0, "x", "y", "z") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def corpus(n=150):
    rnd = random.Random(3)
    names = ["New York", "état Élan", "in spite of", "a", "b", "The", "the", "of", "San Juan Bay", "x\tyz", "ÀB"]
    rows = []
    for i in range(n):
        parts = [rnd.choice(names) + rnd.choice([" ", " ", "  ", ". ", "\n", ",", "\r\n"]) for _ in range(rnd.randrange(40))]
        rows.append((i, "".join(parts), rnd.choice(["en", "en", "en", None, "und", "", "fr"])))
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, "...\n\n", "xx"), (None, "new york " * 30, "en"), (3, *rows[3][1:])]
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_counting_all_phrases(spark):
    rows = corpus()
    assert got(collocations.collocations(docs(spark, rows))) == brute(rows)
    few = dict(longest=4, least=5, inside=30, top=7)
    assert got(collocations.collocations(docs(spark, rows, 5), **few)) == brute(rows, **few)
    pairs = dict(longest=2, least=3)
    assert got(collocations.collocations(docs(spark, rows), **pairs)) == brute(rows, **pairs)


def test_a_filter_in_which_all_pairs_collide_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HASH_BITS", 3)
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    rows = corpus(60)
    assert got(collocations.collocations(docs(spark, rows), least=4)) == brute(rows, least=4)


def test_the_filter_drops_rare_pairs(spark):
    rows = [(i, f"alpha beta gamma{i} delta alpha beta", "en") for i in range(20)]
    windows = collocations._windows(docs(spark, rows), 3)
    pairs = collocations._frequent_pairs(windows, 10)
    padded = collocations._padded(windows, pairs, 3).distinct().collect()
    # Nothing but the first words is left of windows with a word that is there once.
    assert len(padded) == 1 + 1 + 1 + 20 and sum(r.w2 is not None for r in padded) == 2


def test_words_around_a_rare_pair_are_no_phrase(spark, monkeypatch):
    # Half of the filter is set by frequent pairs, so that every other hash of a word is found there.
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    often = [f"a{i} b{i}. " * 10 for i in range(25)] + [f"the of{i}. " * 10 for i in range(20)]
    around = [f"the x{i} of{i % 20}. " for i in range(800)]
    rows = [(i, text, "en") for i, text in enumerate(["".join(often), "".join(around)])]
    assert got(collocations.collocations(docs(spark, rows))) == brute(rows)


def test_rare_runs_of_frequent_pairs_lose_their_last_word(spark):
    rows = [(i, "one two. two three. one two four. " + ("one two three" if i < 5 else ""), "en") for i in range(12)]
    found = {(r.w1, r.w2, r.w3) for r in collocations._likely(docs(spark, rows), 3, 10).collect()}
    assert ("one", "two", "four") in found and ("one", "two", "three") not in found
    assert got(collocations.collocations(docs(spark, rows))) == brute(rows)


def test_a_long_text_counts_beyond_64_bits(spark):
    rows = [(0, "go on " * 200_000, "en")]
    assert got(collocations.collocations(docs(spark, rows))) == brute(rows)
    big = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12)],
                                "lang string, phrase string, words int, f long")
    assert [r.score for r in collocations._scored(big).collect()] == [10**6 * 10**24 // (3 * 10**24)]


def test_without_rows(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_words_are_split_without_a_regular_expression(spark):
    texts = ["A\tB  c\t \tD", " É X\tK. ÀB ZZ Q", "", None, "\t ; \t", "x Y Z"]
    docs = spark.createDataFrame([("de", text) for text in texts], "lang string, text string")
    pieces = [p for text in texts for p in re.split(collocations.CUTS, text or "")]
    words = [w for p in pieces for w in re.split(r"[\x20\x09]+", p.translate(LOWER)) if w]
    windows = collocations._windows(docs, 2)
    assert sorted(r.w1 for r in windows.collect()) == sorted(words)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert r"\x09]+" not in plan and ", \\x20" not in plan
