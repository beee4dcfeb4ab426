"""Quality rules as weak supervision.

Each rule looks at one measure of a text and votes good, votes bad or abstains.  How far a rule can
be believed is not set by hand: expectation-maximisation over the votes of all documents estimates,
for good and for bad documents, how often each rule casts each vote, and the share of good
documents.  The posterior probability of being good then replaces "every rule must pass".

Documents with equal votes are equal to the model, so it is fitted on the counted vote patterns, at
most ``3 ** rules`` rows however many documents there are.  Everything is DataFrame functions; a
text is measured within its own row, without exploding its words.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import NOT_SPACE, SPACE
from shelfmark.shared import written

WINDOW = 8  # words of a window whose repeats count
MIN_WORDS, MAX_REPEATED = 20, 30  # base rules: least words, most percent of repeated words
ROUNDS = 50  # of expectation-maximisation
KEPT = 0.5  # least posterior probability of a kept document

_MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_other", "n_clusters", "n_lone", "n_distinct", "n_stutters",
)


class Rule(NamedTuple):
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains.

    ``trust`` is where expectation-maximisation starts: how often a vote is right.
    """

    name: str
    bad: str
    good: str
    trust: float = 0.8


# Measures per word, line or character with a range between the votes where a rule abstains.  Where
# a good value says little, a rule only votes bad.  Every known kind of junk is seen by several rules.
RULES = (
    Rule("length", "n_words < 20", "false"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words", "false"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("other", "5 * n_other > 2 * n_words", "10 * n_other <= 3 * n_words"),
    Rule("clusters", "10 * n_clusters > n_words", "50 * n_clusters <= n_words"),
    Rule("lone", "10 * n_lone > n_words", "50 * n_lone <= n_words"),
    Rule("capitals", "2 * n_upper > word_chars - n_other", "false"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "false"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    Rule("stutter", "5 * n_stutters > n_words", "false"),
    Rule("variety", "n_words >= 50 AND 4 * n_distinct < n_words", "false"),
)


def _repeated(hashes: str) -> str:
    """SQL: words within windows whose hash is there twice or more, from the windows' hashes.

    Hashes and places are sorted together; neighbours with equal hashes give the places of repeated
    windows, and in the order of places each adds the words that the one before does not reach.
    """
    pairs = f"array_sort(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))"
    twice = (
        "filter(p, (x, j) -> (j > 0 AND p[j - 1].h = x.h) OR (j < size(p) - 1 AND p[j + 1].h = x.h))"
    )
    places = f"array_sort(transform(flatten(transform(array({pairs}), p -> {twice})), x -> x.i))"
    return (
        f"aggregate({places}, struct(0L AS n, CAST(-{WINDOW} AS INT) AS last), "
        f"(a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last), a -> a.n)"
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every whole ``text``; null is the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    space = r"\x20\x09-\x0D"
    left = lambda drop: F.char_length(F.regexp_replace(text, drop, "")).cast("long")
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left(r"\P{Lu}+").alias("n_upper"),
        left(rf"[\p{{L}}\p{{N}}{space}]+").alias("n_other"),
        F.regexp_count(text, F.lit(rf"[^\p{{L}}\p{{N}}{space}]{{2,}}")).cast("long").alias("n_clusters"),
        F.regexp_count(text, F.lit(rf"(?<![^{space}])[^\p{{L}}\p{{N}}{space}]+(?![^{space}])"))
        .cast("long").alias("n_lone"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_lines"),
        F.filter(F.split(text, SPACE), lambda x: x != "").alias("_text_words"),
    )
    # From here on one long stands for a word.
    hashed = base.select(
        "*",
        F.size("_text_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_text_words", "")).cast("long").alias("word_chars"),
        F.transform("_text_words", lambda w: F.xxhash64(w)).alias("_words"),
    )
    windows = f"transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW})))"
    wide = hashed.select(
        "*",
        F.when(F.col("n_words") >= WINDOW, F.expr(windows)).alias("_windows"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.size(F.expr("filter(_words, (x, i) -> i > 0 AND _words[i - 1] = x)")).cast("long").alias("n_stutters"),
    )
    any_twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    repeated = F.when(any_twice, F.expr(_repeated("_windows"))).otherwise(0).cast("long")
    return wide.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_upper", "n_other", "n_clusters", "n_lone", "n_distinct", "n_stutters",
    )


def votes(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add one column per rule: 1 good, -1 bad, 0 abstains."""
    return measures.select(
        "*",
        *[
            F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"vote_{r.name}")
            for r in rules
        ],
    )


class Model(NamedTuple):
    """``share`` of good documents; ``good`` and ``bad``: rate of each vote, three of every rule in turn.

    The votes of a rule are in the order bad, abstains, good.
    """

    share: float
    good: list[float]
    bad: list[float]


def _posterior(model: Model, rules: tuple[Rule, ...]) -> Column:
    """Probability of being good, from the votes, as odds in logarithms."""
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for j, r in enumerate(rules):
        ratio = [math.log(model.good[3 * j + v] / model.bad[3 * j + v]) for v in range(3)]
        vote = F.col(f"vote_{r.name}")
        odds = odds + F.when(vote == 1, ratio[2]).when(vote == -1, ratio[0]).otherwise(ratio[1])
    return 1 / (1 + F.exp(-odds))


def _start(rules: tuple[Rule, ...]) -> Model:
    """Half of all documents good, a quarter of votes not cast, the others right as often as trusted."""
    right = [(r.trust * 0.75, (1 - r.trust) * 0.75) for r in rules]
    good = [x for yes, no in right for x in (no, 0.25, yes)]
    return Model(0.5, good, [x for yes, no in right for x in (yes, 0.25, no)])


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Expectation-maximisation over the counted patterns of votes, as one SQL expression.

    The patterns, at most ``3 ** rules`` with their numbers of documents, become one array; each
    round folds over it.  One vote of each kind is added to every count, which keeps rates above 0.
    Only the fitted model, a row of numbers, comes to the driver.  Without documents the starting
    model is returned.
    """
    names = [f"vote_{r.name}" for r in rules]
    cast = F.array(*[F.col(n) + 1 + 3 * j for j, n in enumerate(names)])
    patterns = voted.groupBy(*names).agg(F.count("*").alias("docs")).select("docs", cast.alias("at"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("at", "docs"))).alias("patterns"))
    start = _start(rules)
    total = "(a, x) -> a + x"
    odds = "aggregate(p.at, ln(m.share / (1 - m.share)), (o, k) -> o + ln(m.good[k] / m.bad[k]))"
    expected = f"transform(patterns, p -> p.docs / (1 + exp(-{odds})))"
    said = "zip_with(patterns, w, (p, x) -> if(array_contains(p.at, k), {}, 0D))"
    rates = "transform(sequence(0, {} - 1), k -> (aggregate({}, 0D, {}) + 1) / ({} + 3))".format
    n = 3 * len(rules)
    good, docs = f"aggregate(w, 0D, {total})", "aggregate(patterns, 0D, (a, p) -> a + p.docs)"
    step = (
        f"transform(array({expected}), w -> named_struct('share', ({good} + 1) / ({docs} + 2), "
        f"'good', {rates(n, said.format('x'), total, good)}, "
        f"'bad', {rates(n, said.format('p.docs - x'), total, f'({docs} - {good})')}))[0]"
    )
    doubles = "array({})".format
    first = "named_struct('share', {}D, 'good', {}, 'bad', {})".format(
        start.share,
        *(doubles(", ".join(f"{x!r}D" for x in values)) for values in (start.good, start.bad)),
    )
    rounds = f"if(size(patterns) = 0, array(), sequence(1, {ROUNDS}))"
    model = one.select(F.expr(f"aggregate({rounds}, {first}, (m, r) -> {step}) AS m")).first()["m"]
    return Model(model["share"], model["good"], model["bad"])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measures, the votes, ``base_failed``, ``quality`` and ``kept`` per row.

    ``quality`` is the posterior probability of being good, ``kept`` false where a base rule fails.
    Null and empty texts have no words, so they fail; null ids stay null; repeated rows are judged
    each; other columns are not read; an empty table gives no rows.  Measures are written once,
    some numbers per document, for the fit and for the verdicts.
    """
    voted = written(votes(measured(docs), rules), "measures")
    model = fit(voted, rules)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    quality = F.round(_posterior(model, rules), 9)
    return voted.select(
        "*", failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= KEPT)).alias("kept")
    )
