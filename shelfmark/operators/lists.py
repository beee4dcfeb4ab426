"""Ordered lists per key that no single task has to hold whole.

Every list is cut into rows by ``part``: the place of an item in its list, from 0, divided by a
fixed number of items.  So the parts are a function of the data alone, most keys have part 0 only,
and a key with very many items spreads over parts and tasks; nothing is dropped.  A key of no more items
than a part has needs no places: its rows are gathered by one shuffle and sorted.  Only items of longer
keys get places, from a range shuffle by key and order with sums of counts per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranks import ranked
from shelfmark.shared import written

# Items of a part.
PART_ITEMS = 10_000


def with_part(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    per_part: int = PART_ITEMS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``part``: the place in the order of the key, from 0, div ``per_part``.

    ``counts``: ``keys, n`` with ``n`` at least the number of a key's rows, where that is known at less
    cost than by counting them.
    """
    if counts is None:
        df = written(df, "items")  # read twice
        counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    long = written(counts.where(F.col("n") > per_part).select(*[F.col(k).alias(f"_long{i}") for i, k in enumerate(keys)]), "long")
    if long.isEmpty():
        return df.withColumn("part", F.lit(0))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_long{i}"))
    placed = ranked(df.join(long, same, "left_semi"), keys, order)
    part = F.expr(f"CAST((rank - 1) DIV {per_part} AS INT)")
    return df.join(long, same, "left_anti").withColumn("part", F.lit(0)).union(
        placed.withColumn("part", part).select(*df.columns, "part")
    )


def in_order(*fields: str) -> Column:
    """Aggregate: the structs of ``fields`` of a group, sorted by them."""
    # No struct is null, so this is the order of array_sort, without a lambda for every comparison.
    return F.sort_array(F.collect_list(F.struct(*fields)))


def ordered_lists(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    name: str,
    per_part: int = PART_ITEMS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row ``keys, part, name`` per key and part; ``name`` is an array of ``item``.

    Items that tie in ``order`` are ordered by themselves.
    """
    items = df.select(*keys, *order, item.alias("_value"))
    rows = with_part(items, keys, [*order, "_value"], per_part, counts).groupBy(*keys, "part")
    return rows.agg(F.transform(in_order(*order, "_value"), lambda row: row["_value"]).alias(name))


def ordered_text(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    text: Column,
    name: str,
    separator: str = "",
    per_part: int = PART_ITEMS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row ``keys, part, name`` per key and part; ``name`` is the joined text of its rows.

    Between two parts of a text the separator is left out.
    """
    return ordered_lists(df, keys, order, text, name, per_part, counts).withColumn(
        name, F.array_join(name, separator)
    )
