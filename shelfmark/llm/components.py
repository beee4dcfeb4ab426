"""Connected components of a large graph in DataFrames: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import written

SMALL = 200_000  # edges that one task handles in a round; more are shuffled by node


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``edges`` (``a``, ``b``: longs); the least id names it.

    Every round hangs each node's larger neighbours, then its smaller ones, on the least neighbour;
    a hub's neighbours are rows of a join, never a list.  Rounds are written, so a lost executor
    costs rereading; only a row count and a checksum come to the driver.  At most ``SMALL`` edges are
    kept in one partition, where groups and joins need no shuffle.  Repeated edges and loops do no
    harm; without edges there are no rows.
    """

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        df = written(df, name)
        seen = tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        return df.coalesce(1) if seen[0] <= SMALL else df, seen

    tidy = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    hung, seen = kept(tidy.distinct(), "edges")
    while True:
        both = hung.union(hung.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        least = least.select("a", F.least("a", "least").alias("least"))
        # Large-star: neighbours above a node hang on the least of its neighbours and itself.
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        ).distinct()
        # Small-star: the neighbours below a node, and the node, hang on the least of them.
        below, _ = kept(large.where("a <> b"), "large")
        lowest = below.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            below.join(lowest, "a")
            .where("b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(lowest.select("a", F.col("least").alias("b")))
        )
        before, (hung, seen) = seen, kept(small.distinct(), "edges")
        if before == seen:
            break
    roots = hung.select(F.col("b").alias("id")).distinct()
    return hung.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
