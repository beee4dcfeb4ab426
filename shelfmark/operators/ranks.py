"""Places of rows in an order, for keys of any size, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.shared import written


def ranked(
    df: DataFrame, keys: list[str], order: list[str], weight: str | None = None
) -> DataFrame:
    """Add ``rank`` (from 1 within equal ``keys``, by ``order``) and ``rank_rows`` (rows of the key).

    With ``weight`` also ``before`` (the weight of the earlier rows) and ``rank_weight`` (of all).
    Rows are range-partitioned by key and order, numbered within their partition and written; only
    counts per key and partition are then summed, so that a key with most of the rows spreads over
    many tasks.  Rows that tie in ``order`` get ranks in any order.
    """
    columns = df.columns
    placed = written(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")),
        "ranked",
    )
    weighed = F.sum(weight if weight else F.lit(0)).cast("long")
    counts = placed.groupBy(*keys, "_part").agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first"), weighed.alias("_weight")
    )
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("_part")
    offsets = counts.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_of"),
        "_first",
        (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_rows_before"),
        (F.sum("_weight").over(earlier) - F.col("_weight")).alias("_weight_before"),
        F.sum("_rows").over(of_key).alias("rank_rows"),
        F.sum("_weight").over(of_key).alias("rank_weight"),
    )
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    out = placed.join(offsets, same)
    extra = [
        (F.col("_rows_before") + F.col("_at") - F.col("_first") + 1).alias("rank"),
        "rank_rows",
    ]
    if weight:
        running = Window.partitionBy(*keys, "_part").orderBy("_at")
        before = F.col("_weight_before") + F.sum(weight).over(running) - F.col(weight)
        extra += [before.alias("before"), "rank_weight"]
    return out.select(*columns, *extra)
