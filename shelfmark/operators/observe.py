"""H. Facts measured from data files, which declare none.

Every row says ``evidence = 'observed'``: it holds for the data read, it is not a declaration.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value of ``evidence``.
OBSERVED = "observed"
LG_K = 14  # sketches have 2**LG_K registers of a byte at most
DEVIATIONS = 8  # standard errors that an estimate may be off
BATCH = 60  # references that are checked by one shuffle: a bit each


def observe_columns(df: DataFrame, name: str) -> DataFrame:
    """H1. One row per column: type and number of nulls; one pass over the data."""
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    entries = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            (F.col("rows") - F.col(f"`{field.name}`")).alias("nulls"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return counts.select("rows", F.inline(F.array(*entries))).select(
        F.lit(name).alias("table"),
        "position",
        "column_name",
        "data_type",
        "rows",
        "nulls",
        (F.col("nulls") > 0).alias("is_nullable"),
        F.lit(OBSERVED).alias("evidence"),
    )


def observe_rows(df: DataFrame, name: str) -> DataFrame:
    """H2. Number of rows."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table"), "row_count", F.lit(OBSERVED).alias("evidence")
    )


def check_key(df: DataFrame, columns: list[str], nulls: str = "forbid") -> DataFrame:
    """H3. Does a key hold?  ``rows, distinct_keys, null_rows, holds``.

    Copies of a key are counted before the shuffle, so a value that fills a third of the table
    moves as one row per task.  With ``nulls='allow'`` (a unique index) rows with a null in the key
    neither break it nor count as keys.
    """
    if nulls not in ("forbid", "allow"):
        raise ValueError("nulls is 'forbid' or 'allow'")
    has_null = F.lit(False)
    for c in columns:
        has_null = has_null | F.col(c).isNull()
    keys = df.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("has_null", has_null)
    counted = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(~F.col("has_null")).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("has_null"), F.col("n"))), F.lit(0)).alias("null_rows"),
    )
    unique = F.col("distinct_keys") == F.col("rows") - F.col("null_rows")
    holds = unique if nulls == "allow" else unique & (F.col("null_rows") == 0)
    return counted.select(
        F.lit(",".join(columns)).alias("key"), "rows", "distinct_keys", "null_rows",
        holds.alias("holds"), F.lit(OBSERVED).alias("evidence"),
    )


def check_reference(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]
) -> DataFrame:
    """H4. Does a reference hold?  ``matched_rows, orphan_rows, null_rows, holds``.

    Child rows are counted per value before they meet the parent, so a hot value is one row per
    task.  Rows with a null in the reference refer to nothing and do not break it.
    """
    values = child.groupBy(*columns).agg(F.count("*").alias("n"))
    present = parent.select(
        *[F.col(p).alias(c) for c, p in zip(columns, parent_columns)]
    ).distinct().withColumn("found", F.lit(True))
    has_null = F.lit(False)
    for c in columns:
        has_null = has_null | F.col(c).isNull()
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    counted = values.join(present, columns, "left").agg(
        total(F.col("found")).alias("matched_rows"),
        total(F.col("found").isNull() & ~has_null).alias("orphan_rows"),
        total(has_null).alias("null_rows"),
    )
    return counted.select(
        F.lit(",".join(columns)).alias("reference"), "matched_rows", "orphan_rows", "null_rows",
        (F.col("orphan_rows") == 0).alias("holds"), F.lit(OBSERVED).alias("evidence"),
    )


class Reference(NamedTuple):
    """Columns of a table, and those of another one that they refer to."""

    table: str
    columns: list[str]
    parent: str
    parent_columns: list[str]


def _comparable(column: str, kind: T.DataType) -> Column:
    """A value as a string that is equal where the values are, as an equi join compares them."""
    value = F.col(column).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)  # -0.0 equals 0.0
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)  # local times are not unique
    elif isinstance(kind, T.BinaryType):
        value = F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError(f"{column}: values of type {kind.simpleString()} are not compared")
    return value.cast("string")


def check_references(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """H4 for many references at once: ``table, reference, parent`` and the columns of ``check_reference``.

    Every table is read once and gives (value, columns that have it); all of them meet in one shuffle by
    value, where a bit per reference tells whether its parent has the value, and a count how many child rows
    have.  Both are combined before the shuffle, so a hot value is one row per task.  The sides of a
    reference need a common type; a null in any of its columns refers to nothing.
    """
    batches = [
        _check_batch(tables, references[i : i + BATCH]) for i in range(0, len(references), BATCH)
    ]
    if not batches:
        raise ValueError("no references are given")
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def _check_batch(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    # Columns with their types; a group that several references name is given once.
    groups: dict[tuple, dict] = {}
    for i, r in enumerate(references):
        sides = ((r.table, r.columns, "child"), (r.parent, r.parent_columns, "parent"))
        one, two = [tables[name].select(*columns) for name, columns, _ in sides]
        kinds = [f.dataType for f in one.limit(0).union(two.limit(0)).schema.fields]
        for name, columns, side in sides:
            group = groups.setdefault((name, tuple(columns), tuple(k.json() for k in kinds)), {"kinds": kinds, "child": [], "parent": []})
            group[side].append(i)
    values = None
    for table in dict.fromkeys(name for name, _, _ in groups):
        entries = []
        for (name, columns, _), group in groups.items():
            if name == table:
                parts = [_comparable(c, k) for c, k in zip(columns, group["kinds"], strict=True)]
                has_null = F.lit(False)
                for p in parts:
                    has_null = has_null | p.isNull()
                entries.append(
                    F.struct(
                        F.when(~has_null, F.array(*parts)).alias("value"),
                        F.lit(sum(1 << i for i in group["child"])).cast("long").alias("child"),
                        F.lit(sum(1 << i for i in group["parent"])).cast("long").alias("parent"),
                    )
                )
        own = tables[table].select(F.inline(F.array(*entries)))
        values = own if values is None else values.union(own)
    bit = lambda mask, i: F.getbit(mask, F.lit(i)) == 1
    numbered = range(len(references))
    met = values.groupBy("value").agg(
        F.bit_or("parent").alias("parents"), *[F.count_if(bit("child", i)).alias(f"n{i}") for i in numbered]
    )
    total = lambda i, when: F.coalesce(F.sum(F.when(when, F.col(f"n{i}"))), F.lit(0))
    given, is_null = F.col("value").isNotNull(), F.col("value").isNull()
    sums = met.agg(
        *[
            F.struct(
                F.lit(r.table).alias("table"),
                F.lit(",".join(r.columns)).alias("reference"),
                F.lit(r.parent).alias("parent"),
                total(i, given & bit("parents", i)).alias("matched_rows"),
                total(i, given & ~bit("parents", i)).alias("orphan_rows"),
                total(i, is_null).alias("null_rows"),
            ).alias(f"r{i}")
            for i, r in enumerate(references)
        ]
    )
    return sums.select(F.inline(F.array(*[f"r{i}" for i in numbered]))).select(
        "*", (F.col("orphan_rows") == 0).alias("holds"), F.lit(OBSERVED).alias("evidence")
    )


def key_sketches(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """H3. ``key, rows, null_rows, sketch`` of many column sets, by one scan and no shuffle of values.

    The sketches can be stored, and those of rows that came later added by union: ``likely_keys`` merges
    rows of equal ``key``.
    """
    entries = []
    for columns in keys:
        has_null = F.lit(False)
        for c in columns:
            has_null = has_null | F.col(c).isNull()
        # Rows are hashed with their places, so ('a', null) and (null, 'a') differ.
        value = F.when(~has_null, F.xxhash64(F.struct(*columns)))
        entries.append(
            F.struct(
                F.lit(",".join(columns)).alias("key"),
                F.count("*").alias("rows"),
                F.count_if(has_null).alias("null_rows"),
                F.hll_sketch_agg(value, F.lit(LG_K)).alias("sketch"),
            )
        )
    sums = df.agg(*[e.alias(f"k{i}") for i, e in enumerate(entries)])
    return sums.select(F.inline(F.array(*[f"k{i}" for i in range(len(keys))])))


def likely_keys(sketches: DataFrame, nulls: str = "forbid") -> DataFrame:
    """H3. ``key, rows, null_rows, estimate, likely``: the column sets that may be keys.

    A set whose distinct values are estimated far below its rows, by more than ``DEVIATIONS`` standard
    errors, is none; nor is one with nulls, unless these are allowed.  Whatever is likely has still to be
    checked.
    """
    if nulls not in ("forbid", "allow"):
        raise ValueError("nulls is 'forbid' or 'allow'")
    merged = sketches.groupBy("key").agg(
        F.sum("rows").alias("rows"),
        F.sum("null_rows").alias("null_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
    )
    least = (F.col("rows") - F.col("null_rows")) * (1 - DEVIATIONS * 1.04 / 2 ** (LG_K / 2))
    likely = F.col("estimate") >= F.floor(least)
    return merged.withColumn("likely", likely if nulls == "allow" else likely & (F.col("null_rows") == 0))


def find_keys(df: DataFrame, keys: list[list[str]], nulls: str = "forbid") -> DataFrame:
    """H3. The rows of ``check_key`` for those of many column sets that are keys.

    One scan sketches all of them; only the likely ones are counted exactly, by a shuffle each.  A set
    that holds is discarded with a chance below 1e-12.
    """
    likely = {r.key for r in likely_keys(key_sketches(df, keys), nulls).where("likely").select("key").collect()}
    found = [check_key(df, k, nulls) for k in keys if ",".join(k) in likely]
    out = found[0] if found else check_key(df.limit(0), keys[0], nulls).limit(0)
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("holds")


def observe_partitions(df: DataFrame, column: str | Column, name: str) -> DataFrame:
    """H6. Rows per partition value, and ``skew``: how many times the mean that is."""
    value = F.col(column) if isinstance(column, str) else column
    sizes = df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("rows"))
    mean = sizes.agg(F.avg("rows")).scalar()
    return sizes.select(
        F.lit(name).alias("table"), "value", "rows",
        F.round(F.col("rows") / mean, 6).alias("skew"), F.lit(OBSERVED).alias("evidence"),
    )
