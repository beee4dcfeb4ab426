"""Line dedup by winnowing over line hashes.

From every line a window of consecutive lines runs forwards, and one backwards, until it holds
``min_words`` words.  Each window selects the least line hash in it as its fingerprint; equal
windows select equal lines, so a repeated run of ``min_words`` words or more is guaranteed to share
a fingerprint.  Windows whose fingerprint line is selected at one place only are dropped.  The
others are joined by content with the first place of that content, and windows that overlap or
touch extend the match both ways to the whole repeated run.  Every later run is deleted, the first
one stays.

A window has one partner, its content's first place: no pairs of positions are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import NOT_SPACE, SPACE, broadcast_if_small, told_apart
from shelfmark.shared import written

MIN_WORDS = 50

_DOC = ["doc_id", "variant"]


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, variant, first, last`` (numbers of lines with words), ``first_pos, last_pos``
    (their places in the text), ``words, content, least, least_at`` of all windows."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    line = docs.select(*_DOC, F.posexplode(split).alias("pos", "line")).where(F.col("line").rlike(NOT_SPACE))
    bare = F.regexp_replace("line", rf"^{SPACE}|{SPACE}$", "")
    lines = line.select(
        *_DOC,
        "pos",
        # Two hashes of other seeds: what is deleted is decided by both, 128 bits.
        F.xxhash64(bare).alias("h"),
        F.xxhash64(F.lit(1), bare).alias("h2"),
        F.regexp_count("line", F.lit(NOT_SPACE)).cast("long").alias("n"),
    )
    of_doc = Window.partitionBy(*_DOC)
    in_order = of_doc.orderBy("pos")
    summed = lines.select(
        "*",
        F.row_number().over(in_order).alias("line"),
        F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("after"),
    ).withColumn("before", F.col("after") - F.col("n"))
    # Lines that begin within min_words words of a line's begin; the same seen from its end.
    forward = of_doc.orderBy("before").rangeBetween(0, min_words - 1)
    backward = of_doc.orderBy("after").rangeBetween(-(min_words - 1), 0)

    def window(frame) -> Column:
        picked = F.min(F.struct("h", "pos")).over(frame)
        return F.struct(
            F.min("line").over(frame).alias("first"),
            F.max("line").over(frame).alias("last"),
            F.min("pos").over(frame).alias("first_pos"),
            F.max("pos").over(frame).alias("last_pos"),
            F.sum("n").over(frame).alias("words"),
            F.struct(
                F.xxhash64(F.collect_list("h").over(frame)), F.xxhash64(F.collect_list("h2").over(frame))
            ).alias("content"),
            picked["h"].alias("least"),
            picked["pos"].alias("least_at"),
        )

    both = summed.select(*_DOC, window(forward).alias("f"), window(backward).alias("b"))
    return (
        both.select(*_DOC, F.explode(F.array("f", "b")).alias("w"))
        .select(*_DOC, "w.*")
        .where(F.col("words") >= min_words)
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, variant, first_pos, last_pos, n_lines, source_doc_id`` of every later repeated run.

    Places are numbers of lines of the text, from 0; ``source_doc_id`` is the document where the
    run's first window stands first.  First is the least ``doc_id``, then the place in the text.
    Documents need ``doc_id``, ``variant`` and ``text``, and come once each.
    """
    windows = written(_windows(docs, min_words), "windows")
    place = F.struct(*_DOC, "least_at")
    repeated = (
        windows.groupBy("least").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
        .where("lo <> hi").select("least")
    )
    shared = windows.join(repeated, "least", "left_semi")
    at = F.struct(*_DOC, "first")
    first = (
        shared.groupBy("content").agg(F.min(at).alias("at"), F.max(at).alias("end"))
        .where("at <> end").select("content", "at")
    )
    later = (
        shared.join(first, "content")
        .where(at != F.col("at"))
        .select(*_DOC, "first", "last", "first_pos", "last_pos", F.col("at.doc_id").alias("source_doc_id"))
        .distinct()
    )
    order = Window.partitionBy(*_DOC).orderBy("first", "last", "source_doc_id")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") <= reached + 1, 0).otherwise(1)
    runs = later.withColumn("run", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*_DOC, "run").agg(
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
        (F.max("last") - F.min("first") + 1).alias("n_lines"),
        F.min(F.struct("first", "source_doc_id"))["source_doc_id"].alias("source_doc_id"),
    ).drop("run")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, n_runs`` per row: the text without later repeated runs.

    ``n_lines`` counts lines with words, ``n_removed`` those deleted; lines without words inside a
    run go with it.  Lines are compared without the ASCII white space around them.  A null text
    stays null.  Of rows with equal id and text all lose the same lines (they are one document);
    rows of equal id and other texts are documents of their own.  Other columns are not read; an
    empty table gives no rows.
    """
    rows, once = told_apart(docs)
    runs = written(
        repeated_runs(once, min_words).groupBy(*_DOC).agg(
            F.collect_list(F.struct("first_pos", "last_pos")).alias("runs"), F.sum("n_lines").alias("n_removed")
        ),
        "runs",
    )
    named = broadcast_if_small(runs.toDF("_doc_id", "_variant", "runs", "n_removed"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("variant").eqNullSafe(F.col("_variant"))
    joined = rows.join(named, same, "left")
    lines = F.split("text", "\n")
    left = F.filter(
        lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["first_pos"]) & (i <= r["last_pos"]))
    )
    counted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE)))
    return joined.select(
        "doc_id",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        counted.cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
    )
