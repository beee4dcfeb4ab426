"""Benchmark decontamination with a distributed positional inverted index.

Every task writes the postings ``(term, doc, pos)`` of its training documents, sorted by term, for
all terms of the benchmark.  Of each benchmark window the two rarest terms, by the length of their
lists, are looked up; a list adjusted by the term's offset gives where the item would begin in a
document, and what both lists agree on (or, for proximity, nearly agree on) is a candidate.  For
candidates of phrases the lists of all terms of the item are intersected at their offsets; runs of
agreeing offsets as long as a window are the exact matches.  The texts are read once, for the index.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import broadcast_if_small, lower_ascii, told_apart
from shelfmark.shared import written

WINDOW = 10  # words
# Fixed value: words are runs of ASCII letters and digits and of all characters from U+0080.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Index(NamedTuple):
    """``terms``: term, number and length of its list.  ``items``: words of items by offset.
    ``postings``: term, doc_id, variant, pos.  ``docs``: doc_id, variant, n_words, one per row."""

    terms: DataFrame
    items: DataFrame
    postings: DataFrame
    docs: DataFrame


def _words(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """The index of ``docs`` (``doc_id``, ``text``) for the terms of ``benchmark`` (``item_id``, ``text``).

    Null texts have no words.  Rows of equal id are told apart by their text (``variant``); rows of
    equal id and text have their postings once.
    """
    # Items of equal id and different text stay apart; equal rows are one item.
    named = benchmark.select("item_id", "text").distinct()
    split = named.select(
        "item_id", F.xxhash64("text").alias("item"), F.posexplode(_words(F.col("text"))).alias("off", "word")
    )
    words = written(split.select("item_id", "item", "off", lower_ascii(F.col("word")).alias("word")), "items")
    terms = written(
        words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms"
    )
    small = broadcast_if_small(terms)

    rows, once = told_apart(docs)
    tokens = once.select("doc_id", "variant", F.posexplode(_words(F.col("text"))).alias("pos", "word"))
    found = tokens.select("doc_id", "variant", "pos", lower_ascii(F.col("word")).alias("word")).join(small, "word")
    postings = written(
        found.select("term", "doc_id", "variant", "pos").sortWithinPartitions("term", "doc_id", "variant", "pos"),
        "postings",
    )
    lengths = postings.groupBy("term").agg(F.count("*").alias("length"))
    terms = written(
        terms.join(lengths, "term", "left").select("word", "term", F.coalesce("length", F.lit(0)).alias("length")),
        "terms",
    )
    sizes = rows.select(
        "doc_id", "variant",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    return Index(terms, words, postings, sizes)


def _windows(index: Index) -> DataFrame:
    """``item_id, item, n, first, off1, term1, off2, term2``: the two rarest terms of every window.

    A window of one word has no second term.  Windows with a term that occurs nowhere are left out.
    """
    words = index.items.join(index.terms, "word").select("item_id", "item", "off", "term", "length")
    of_item = Window.partitionBy("item_id", "item")
    sized = words.withColumn("n", F.count("*").over(of_item))
    last = F.greatest(F.col("n") - WINDOW, F.lit(0))
    # A word is in the windows that begin up to WINDOW - 1 words before it.
    starts = F.sequence(F.greatest(F.col("off") - (WINDOW - 1), F.lit(0)).cast("long"), F.least(F.col("off").cast("long"), last))
    inside = sized.withColumn("first", F.explode(starts))
    rare = Window.partitionBy("item_id", "item", "first").orderBy("length", "term", "off")
    nth = inside.withColumn("nth", F.row_number().over(rare)).where("nth <= 2")
    pick = lambda k, c: F.max(F.when(F.col("nth") == k, F.col(c)))
    return (
        nth.groupBy("item_id", "item", "n", "first")
        .agg(
            F.min("length").alias("least"),
            *[pick(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("off", "term")],
        )
        .where("least > 0")
        .drop("least")
    )


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["variant"] == b["variant"])


def _rarest(index: Index, slop: int) -> DataFrame:
    """``doc_id, variant, item_id, item, n, at, apart``: where the two rarest lists of a window
    agree up to ``slop`` words; ``at`` is the place of the item's first word (it may be before the
    document), ``apart`` by how much they differ."""
    windows = _windows(index)
    # Windows of an item share their rarest terms: one entry per pair of places, not per window.
    pairs = written(windows.groupBy("item_id", "item", "n", "off1", "term1", "off2", "term2").agg(F.min("first")).drop("min(first)"), "pairs")
    first = pairs.select("item_id", "item", "n", "off1", "term1", "off2").distinct()
    second = pairs.where("term2 IS NOT NULL").select("item_id", "item", "off1", "off2", "term2").distinct()
    postings = index.postings
    one = postings.join(first, postings["term"] == first["term1"]).select(
        "doc_id", "variant", "item_id", "item", "n", "off1", "off2", (F.col("pos") - F.col("off1")).alias("at")
    )
    alone = one.where("off2 IS NULL").withColumn("apart", F.lit(0))
    two = postings.join(second, postings["term"] == second["term2"]).select(
        "doc_id", "variant", "item_id", "item", "off1", "off2", (F.col("pos") - F.col("off2")).alias("at2")
    )
    # Places that differ by at most slop share a cell of slop + 1 places or lie in the next one.
    cell = slop + 1
    one = one.where("off2 IS NOT NULL").withColumn("cell", F.floor(F.col("at") / cell))
    near = F.array(F.floor(F.col("at2") / cell) + 0, *([F.floor(F.col("at2") / cell) + d for d in (-1, 1)] if slop else []))
    two = two.withColumn("cell", F.explode(near))
    meet = (
        _same_doc(one, two)
        & one["item_id"].eqNullSafe(two["item_id"])
        & (one["item"] == two["item"])
        & (one["off1"] == two["off1"])
        & (one["off2"] == two["off2"])
        & (one["cell"] == two["cell"])
    )
    both = (
        one.join(two, meet)
        .withColumn("apart", F.abs(F.col("at") - F.col("at2")))
        .where(F.col("apart") <= slop)
        .select(one["doc_id"], one["variant"], one["item_id"], one["item"], "n", "at", "apart")
    )
    return alone.select(*both.columns).union(both)


def phrases(index: Index) -> DataFrame:
    """``doc_id, variant, item_id, from_word, to_word``: maximal runs of words (``to_word`` is
    behind the last) that consist of windows of the item."""
    places = written(_rarest(index, 0).select("doc_id", "variant", "item_id", "item", "n", "at").distinct(), "places")
    words = index.items.join(index.terms.select("word", "term"), "word").select(
        F.col("item_id").alias("i_id"), F.col("item").alias("i"), "off", F.col("term").alias("i_term")
    )
    same_item = places["item_id"].eqNullSafe(words["i_id"]) & (places["item"] == words["i"])
    # All offsets of the item, as places in the document that its words would have.
    wanted = places.join(words, same_item).where("at + off >= 0").select(
        "doc_id", "variant", "item_id", "item", "n", "at", "off", "i_term", (F.col("at") + F.col("off")).alias("pos")
    )
    # Lists are intersected for the candidates' documents; the postings of all others stay where they are.
    few = broadcast_if_small(places.select("doc_id", "variant").distinct())
    postings = index.postings.join(few, _same_doc(index.postings, few), "left_semi")
    hit = (
        _same_doc(wanted, postings)
        & (wanted["pos"] == postings["pos"])
        & (wanted["i_term"] == postings["term"])
    )
    agree = wanted.join(postings, hit).select(
        wanted["doc_id"], wanted["variant"], "item_id", "item", "n", "at", "off"
    )
    alignment = ["doc_id", "variant", "item_id", "item", "n", "at"]
    run = F.col("off") - F.row_number().over(Window.partitionBy(*alignment).orderBy("off"))
    return (
        agree.withColumn("run", run)
        .groupBy(*alignment, "run")
        .agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
        .where(F.expr(f"hi - lo + 1 >= least(n, {WINDOW})"))
        .select(
            "doc_id", "variant", "item_id",
            (F.col("at") + F.col("lo")).alias("from_word"),
            (F.col("at") + F.col("hi") + 1).alias("to_word"),
        )
    )


def proximity(index: Index, slop: int = 5) -> DataFrame:
    """``doc_id, variant, item_id, at, apart``: where the two rarest terms of a window stand within
    ``slop`` words of the distance they have in the item; phrases are among them, mostly with 0."""
    near = _rarest(index, slop)
    return near.groupBy("doc_id", "variant", "item_id", "at").agg(F.min("apart").alias("apart"))


def contamination(index: Index) -> DataFrame:
    """``doc_id, variant, n_words, n_hit, n_items, items_sha256, contaminated`` for every document row.

    ``n_hit`` counts words inside any occurring window, each once; the digest is of the occurring
    items' ids, sorted as strings and joined by commas.  Rows with equal id and text get the same
    result; null ids are ids like others.  Without benchmark items nothing is contaminated.
    """
    found = written(phrases(index), "phrases")
    doc = ["doc_id", "variant"]
    covered = (
        found.select(*doc, F.explode(F.expr("sequence(from_word, to_word - 1)")).alias("pos"))
        .distinct()
        .groupBy(*doc)
        .agg(F.count("*").alias("n_hit"))
    )
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    items = found.groupBy(*doc).agg(
        F.count_distinct("item_id").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256")
    )
    hits = covered.join(items, _same_doc(covered, items)).select(
        covered["doc_id"], covered["variant"], "n_hit", "n_items", "items_sha256"
    )
    docs = index.docs
    return docs.join(hits, _same_doc(docs, hits), "left").select(
        docs["doc_id"],
        docs["variant"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
