"""Mixing sources to target weights by packed blocks.

Every source is a stream of words: its documents in a seeded order, cut into blocks of a fixed
number of words.  A source whose target is ``t`` words gives as many blocks as make ``t``.  Each of
these draws falls into a pseudorandom output shard, so that the counts of a source over the shards
are multinomial while its total stays on target; plain multinomial totals would miss targets and
the limit on repeats of small sources.  Draw ``k`` of a source takes, in its ``k div blocks``-th
pass, the block to which that pass's permutation maps ``k mod blocks``: every pass orders the blocks by a
hash of seed, source, pass and block.  Blocks and draws meet in an equi-join by source and block.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import n_words, seeded
from shelfmark.operators.ranks import ranked
from shelfmark.shared import written

BLOCK = 256  # words of a block
WEIGHTS = (5, 2, 1)  # repeated over the sources in order
MOST = 3  # no word is taken more often
CHUNK = 100_000  # places made by one row


class Mix(NamedTuple):
    """``sources``: size, target and number of draws.  ``docs``: place in the stream of their source.
    ``pieces``: which words of which document a block holds.
    ``draws``: output shard, source, pass and block of every slot."""

    block: int
    sources: DataFrame
    docs: DataFrame
    pieces: DataFrame
    draws: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to one row per ``source`` with its ``source_size``.

    Sources in order of code points, null last, take the weights in turn and share the sum of all
    sizes by weight.  No target is above ``most`` times its source; what is above is shared by
    weight among the others until none is.  That ends with all sources whose ``most * size /
    weight`` is below one level at their limit: sorted by that ratio, the level follows from sums
    over the sources before and after.
    """
    bare = sizes.select("source", "source_size").withColumn("_null", F.col("source").isNull())
    place = F.row_number().over(Window.orderBy("_null", F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    listed = bare.withColumn("_weight", weight).withColumn("_limit", most * F.col("source_size"))
    ratio = F.col("_limit") / F.col("_weight")
    up = Window.orderBy(ratio, "_null", F.col("source").cast("binary"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(
        F.sum("_limit").over(before), F.lit(0)
    )
    level = listed.select(
        "*",
        (left / F.sum("_weight").over(rest)).alias("_level"),
        ratio.alias("_ratio"),
        F.row_number().over(up).alias("_nth"),
    )
    # The first source whose ratio reaches the level of the rest sets the level of all.
    holds = F.when(F.col("_ratio") >= F.col("_level"), F.struct("_nth", "_level"))
    settled = F.min(holds).over(Window.partitionBy())["_level"]
    capped = F.least(F.col("_limit").cast("double"), F.col("_weight") * settled)
    return level.select("source", "source_size", F.coalesce(capped, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, block: int = BLOCK, n_shards: int = 64, seed: int = 9) -> Mix:
    """Mix all rows of ``docs`` (``doc_id``, ``text``, ``source``) to the weights.

    Null and empty texts have no words and are never taken.  A null source is a source of its own,
    the last one.  Rows that are equal throughout are documents of their own.  Extra columns are not
    read.  Empty tables give empty frames.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn(
        "_key", seeded(seed, "doc_id")
    )
    stream = written(
        ranked(rows, ["source"], ["_key", "doc_id", "size"], weight="size").select(
            "doc_id", "source", "size", F.col("rank").alias("place"), F.col("before").alias("start")
        ),
        "stream",
    )
    sizes = stream.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = (
        targets(sizes)
        .withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("n_draws", F.expr("if(source_size = 0, 0L, cast(round(target * blocks / source_size) as long))"))
    )
    sources = written(sources, "sources")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Whole passes: of the last one the draws take what its permutation puts first.
    passes = F.expr("(n_draws + blocks - 1) div blocks")
    chunks = sources.where("n_draws > 0").withColumn("n_places", passes * F.col("blocks")).select(
        "source", "blocks", "n_draws", "n_places",
        F.explode(F.expr(f"sequence(0L, n_places - 1, {CHUNK}L)")).alias("_from"),
    )
    # Few bytes become many rows here: an explicit number of partitions is not merged again.
    numbered = chunks.repartition(n, "source", "_from").select(
        "source", "blocks", "n_draws",
        F.explode(F.expr(f"sequence(_from, least(_from + {CHUNK}L, n_places) - 1)")).alias("at"),
    )
    of_pass = numbered.select(
        "source", "blocks", "n_draws", F.expr("at div blocks").alias("turn"), F.expr("at % blocks").alias("block")
    ).withColumn("_key", seeded(seed, "source", "turn", "block"))
    placed = ranked(of_pass, ["source", "turn"], ["_key", "block"])
    draws = (
        placed.withColumn("k", F.col("turn") * F.col("blocks") + F.col("rank") - 1)
        .where("k < n_draws")
        .select(
            F.pmod(F.xxhash64(F.lit(seed), "source", "k"), F.lit(n_shards)).cast("int").alias("shard"),
            "source",
            F.col("turn").cast("int").alias("turn"),
            "block",
        )
    )
    last = F.expr(f"(start + size - 1) div {block}")
    pieces = (
        stream.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), last)))
        .withColumn("from_word", F.greatest(F.lit(0), F.col("block") * block - F.col("start")))
        .withColumn("to_word", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")))
        .select("source", "block", "doc_id", "place", "from_word", "to_word")
    )
    return Mix(block, sources, stream, pieces, draws)


def uses(mixed: Mix) -> DataFrame:
    """``source, block, uses``: how often the mix takes each block that it takes."""
    return mixed.draws.groupBy("source", "block").agg(F.count("*").alias("uses"))


def _named_uses(mixed: Mix) -> DataFrame:
    # Draws are made from a few rows, whose size would be taken for theirs: never broadcast them.
    return uses(mixed).withColumnsRenamed({"source": "_source", "block": "_block"}).hint("merge")


def taken(mixed: Mix) -> DataFrame:
    """``doc_id, source, place, size, source_size, target, taken`` for every document."""
    used = _named_uses(mixed)
    here = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    words = (F.col("to_word") - F.col("from_word")) * F.col("uses")
    by_doc = (
        mixed.pieces.join(used, here)
        .groupBy(F.col("source").alias("_source"), F.col("place").alias("_place"))
        .agg(F.sum(words).alias("_taken"))
    )
    own = F.col("source").eqNullSafe(F.col("_source"))
    docs = mixed.docs.join(by_doc, own & (F.col("place") == F.col("_place")), "left").drop("_source")
    sums = mixed.sources.select(F.col("source").alias("_source"), "source_size", "target")
    return docs.join(sums, own).select(
        "doc_id", "source", "place", "size", "source_size", "target",
        F.coalesce("_taken", F.lit(0)).alias("taken"),
    )


def copies(mixed: Mix) -> DataFrame:
    """``doc_id, source, place, size, copies``: whole documents, for tables that cannot hold pieces.

    A document comes once for each time the mix takes the block in which it begins.
    """
    used = _named_uses(mixed)
    first = mixed.docs.withColumn("block", F.expr(f"start div {mixed.block}"))
    here = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    return first.join(used, here, "left").select(
        "doc_id", "source", "place", "size", F.coalesce("uses", F.lit(0)).alias("copies")
    )
