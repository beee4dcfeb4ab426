"""Collocations: phrases whose words stand together more often than apart.

Counts of all orders come from the longest windows alone.  At every word a window has the word and
those that follow it in its piece, as columns led by one, two and more places and padded with nulls
beyond the piece's end.  Windows are counted once, which are the counts of the longest phrases; ROLLUP over
these counts then sums up ever shorter prefixes: the count of a phrase is the sum over all windows that
begin with it, and that of no word at all is the number of words.

A window of many words is rarely seen twice, so windows are padded earlier where that cannot change a
result: behind a pair of neighbours that stands too seldom for any phrase with it to be a candidate, and
then before the last word of a longer run of words that stands too seldom itself.  Pairs and runs are
counted by hash, and those seen often enough set bits of a filter of fixed size, so those that share a hash
or a bit only keep more than needed.  Hashes are a fraction of the words' bytes in a shuffle, and what is
left for the words themselves is little more than the phrases that are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import lower_ascii
from shelfmark.shared import written

# Fixed value: where a text is cut into pieces; words are separated by spaces and tabs.
CUTS = r"[.,;:!?\x0A-\x0D]"
LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences of a candidate
INSIDE = 50  # percent: a longer candidate with this share of a phrase's occurrences drops the phrase
TOP = 2000  # phrases of a language
UNKNOWN = "und"
HASH_BITS = 40  # of the hashes by which pairs are counted
FILTER_BITS = 26  # of the filter: at most 2**20 rows of 64 bits are broadcast, however many texts there are


def _windows(docs: DataFrame, longest: int) -> DataFrame:
    """``lang, w1, w2 ...``: every word with those that follow it in its piece, padded with nulls."""
    text = F.coalesce("text", F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    # Nearly all texts become lower case at once, others piece by piece, as few pieces need more than ASCII.
    lowered = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), plain.alias("plain"),
        F.when(plain, F.lower(text)).otherwise(text).alias("text"),
    )
    pieces = lowered.select("lang", "plain", F.explode(F.split("text", CUTS)).alias("piece"))
    piece = F.when(F.col("plain"), F.col("piece")).otherwise(lower_ascii(F.col("piece")))
    # A single character is found without a regular expression; empty words between spaces go.
    spaced = F.split(F.replace(piece, F.lit("\t"), F.lit(" ")), " ")
    split = pieces.select("lang", F.array_remove(spaced, "").alias("words"))
    # The words themselves and without the first, the first two ...: side by side they are windows.
    led = [F.slice("words", F.lit(k + 1), F.greatest(F.size("words"), F.lit(1))) for k in range(1, longest)]
    windows = split.select("lang", F.inline(F.arrays_zip("words", *led)))
    return windows.toDF("lang", *[f"w{k + 1}" for k in range(longest)])


def _hash(*words: str) -> Column:
    """The hash of neighbours, null where any of the words is."""
    there = reduce(Column.__and__, [F.col(w).isNotNull() for w in words])
    return F.when(there, F.xxhash64("lang", *words).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def _word(pair: Column) -> Column:
    """The row of the filter that holds a pair's bit."""
    return F.shiftright(pair.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6)


def _bit(pair: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), pair.bitwiseAND(F.lit(63)).cast("int"))


def _frequent(windows: DataFrame, words: int, least: int) -> DataFrame:
    """``word, bits``: the filter of runs of ``words`` words that are seen ``least`` times; ``2**FILTER_BITS`` bits at most."""
    hashed = windows.select(_hash(*[f"w{k + 1}" for k in range(words)]).alias("hash")).where("hash IS NOT NULL")
    often = hashed.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    bits = often.select(_word(F.col("hash")).alias("word"), _bit(F.col("hash")).alias("bit"))
    return bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _frequent_pairs(windows: DataFrame, least: int) -> DataFrame:
    return _frequent(windows, 2, least)


def _cut(windows: DataFrame, bits: DataFrame, *words: str) -> DataFrame:
    """Windows without the last of ``words`` where the filter does not have these words."""
    found = F.coalesce(F.col("_bits").bitwiseAND(_bit(_hash(*words))) != 0, F.lit(False))
    return (
        windows.join(F.broadcast(bits.toDF("_word", "_bits")), _word(_hash(*words)) == F.col("_word"), "left")
        .withColumn(words[-1], F.when(found, F.col(words[-1])))
        .drop("_word", "_bits")
    )


def _padded(windows: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """Windows that end before the first pair which the filter does not have."""
    for k in range(1, longest):
        windows = _cut(windows, pairs, f"w{k}", f"w{k + 1}")
    return windows


def _likely(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """Windows padded behind words that no candidate has; one pass over the texts per filter."""
    pairs = written(_frequent_pairs(_windows(docs, 2), least), "pairs")
    filters: list[DataFrame] = []

    def padded(words: int) -> DataFrame:
        windows = _padded(_windows(docs, words), pairs, words)
        for k, bits in enumerate(filters, 3):
            windows = _cut(windows, bits, *[f"w{i + 1}" for i in range(k)])
        return windows

    for k in range(3, longest + 1):
        filters.append(written(_frequent(padded(k), k, least), "runs"))
    return padded(longest)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to ``longest`` words that occur ``least`` times
    or more, and ``lang, n`` of all languages with words."""
    words = [f"w{k + 1}" for k in range(longest)]
    counted = _likely(docs, longest, least).groupBy("lang", *words).agg(F.count("*").alias("f"))
    # The longest prefixes are the windows themselves; their counts need no further sum, nor a shuffle.
    kept = F.when(F.col("f") >= least, F.col(words[-1])).isNotNull()
    whole = counted.where(kept).select("lang", "f", F.lit(longest).alias("words"), F.array(*words).alias("all"))
    shorter = words[:-1]
    sums = counted.rollup("lang", *shorter).agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    # A prefix of k words leaves out the columns behind it; padded ones are windows of fewer words.
    levels = {(1 << (longest - 1 - k)) - 1: k for k in range(longest)}
    length = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col("level").cast("int")]
    prefixes = sums.where(F.col("level") < (1 << (longest - 1))).select(
        "lang", "f", length.alias("words"), F.array(*shorter).alias("all")
    )
    filled = (F.col("f") >= least) & F.get("all", F.col("words") - 1).isNotNull()
    prefixes = prefixes.where(F.when(F.col("words") == 0, F.lit(True)).otherwise(filled))
    found = written(
        prefixes.union(whole).select(
            "lang", F.array_join(F.slice("all", F.lit(1), F.col("words")), " ").alias("phrase"), "words", "f"
        ),
        "phrases",
    )
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return found.where("words > 0"), totals


def _scored(phrases: DataFrame) -> DataFrame:
    """Candidates ``lang, phrase, words, a, l, r, score`` by their lowest-scoring cut."""
    candidates = phrases.where("words >= 2").withColumnRenamed("f", "a")
    part = lambda first, n: F.array_join(F.slice("_split", first, n), " ")
    cuts = (
        candidates.withColumn("_split", F.split("phrase", " "))
        .withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
        .select(
            "lang", "phrase", "words", "a", "k",
            part(F.lit(1), F.col("k")).alias("left"),
            part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
        )
    )
    known = phrases.select("lang", "phrase", "f")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    # Up to 10**6 * a * a: decimals, as the product may pass 64 bits.
    score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * whole("a") * whole("a"), whole("l") * whole("r"))
    both = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(
        known.toDF("lang", "right", "r"), ["lang", "right"]
    )
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return both.groupBy("lang", "phrase", "words", "a").agg(lowest).select(
        "lang", "phrase", "words", "a", "low.l", "low.r", "low.score"
    )


def _outside(candidates: DataFrame, longest: int, inside: int) -> DataFrame:
    """Candidates without those that mostly stand inside a longer one."""
    split = candidates.where("words > 2").select("lang", "a", "words", F.split("phrase", " ").alias("all"))
    inner = None
    for n in range(2, longest):
        longer = split.where(F.col("words") > n).select(
            "lang", "a", "all", F.explode(F.expr(f"sequence(1, words - {n} + 1)")).alias("at")
        )
        own = longer.select("lang", F.array_join(F.slice("all", F.col("at"), F.lit(n)), " ").alias("phrase"), "a")
        inner = own if inner is None else inner.union(own)
    if inner is None:
        return candidates
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    held = F.coalesce(100 * F.col("_most") >= inside * F.col("a"), F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").where(~held).drop("_most")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    Texts are cut into pieces and those into words; A-Z become lower case.  A phrase of 2 to
    ``longest`` words within a piece that occurs ``a >= least`` times is a candidate.  Of its cuts in
    two the one with the least ``floor(10**6 * a * a / (l * r))`` counts, ``l`` and ``r`` being the
    counts of the parts.  Candidates of which ``inside`` percent stand in one longer candidate go.

    A null text is empty, a null ``lang`` is ``und`` (and the same as that name); an empty ``lang`` is
    a language.  Repeated rows count each; phrases that tie in score and count are ordered by their
    UTF-8 bytes.  Other columns are not read; without candidates there are no rows.
    """
    phrases, totals = phrase_counts(docs, longest, least)
    kept = _outside(written(_scored(phrases), "scored"), longest, inside)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
