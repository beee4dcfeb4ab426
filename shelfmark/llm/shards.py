"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key and ranked within their source; the fractional rank
``(rank - 1/2) / rows of the source`` spreads every source evenly over the whole order.  Cut into
equal parts, that order gives shards whose row counts differ by one at most and whose mixture of
sources is that of the whole.  The law is ``rows``: neither sizes nor groups of equal texts decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import seeded
from shelfmark.operators.ranks import ranked

OVERHEAD = 8  # bytes a stored row takes beside its text


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 5) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``slot`` counts from 0 without gaps within a shard, in the interleaved order.  Needs ``doc_id``,
    ``text`` and ``source``; other columns are not read.  Null and empty texts: size 8, crc32 0.
    A null source is a source of its own, a null id is ordered like an empty one.  Rows that are
    equal throughout take places of their own.  An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("_key", seeded(seed, "doc_id"))
    tie = ["_key", "doc_id", "text_crc32", "size"]
    within = ranked(rows, ["source"], tie).select(
        *rows.columns, ((2 * F.col("rank") - 1) / (2 * F.col("rank_rows"))).alias("_fraction")
    )
    placed = ranked(within, [], ["_fraction", "source", *tie])
    at, of = F.col("rank") - 1, F.col("rank_rows")
    placed = placed.withColumn("shard", F.expr(f"(rank - 1) * {n_shards} div rank_rows"))
    first = F.expr(f"(shard * rank_rows + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (at - first).alias("slot"),
    ).where(of > 0)
