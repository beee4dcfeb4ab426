"""D. The metadata store: merge with change detection, annotations, lookups, pages.

A store is two frames: ``tables`` (one row per table) and ``facts``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions.text import document_path, metadata_key
from shelfmark.operators.ranks import ranked
from shelfmark.shared import written


class Store(NamedTuple):
    """One row per table, and the facts of these tables (of no others)."""

    tables: DataFrame
    facts: DataFrame


class Snapshot(Store):
    """A store as it was read: it knows the number of the commit."""

    number: int

    def __new__(cls, tables: DataFrame, facts: DataFrame, number: int) -> Snapshot:
        self = super().__new__(cls, tables, facts)
        self.number = number
        return self

    def within(self, keys: DataFrame) -> Snapshot:
        """The part whose names are in ``keys``, which has one or more of the four."""
        return Snapshot(*[frame.join(keys, keys.columns, "left_semi") for frame in self], self.number)


class Merged(NamedTuple):
    """``tables`` and ``facts`` to store, and what the merge makes of the scanned tables.

    ``number`` is that of the store that was merged, if it was read; ``again`` merges the same scan
    with another store.
    """

    tables: DataFrame
    facts: DataFrame
    scanned: Store
    number: int | None = None
    again: Callable[[Store], Merged] | None = None


def with_metadata_key(df: DataFrame) -> DataFrame:
    """D1. Add ``metadata_key``."""
    return df.withColumn("metadata_key", metadata_key())


def sanitize_collisions(df: DataFrame) -> DataFrame:
    """D2b. Paths that more than one table would be written to, with the number of tables."""
    return (
        df.select(document_path().alias("path"), metadata_key().alias("key"))
        .groupBy("path")
        .agg(F.count_distinct("key").alias("tables"))
        .where(F.col("tables") > 1)
    )


def _in_sequence(facts: DataFrame) -> DataFrame:
    """Facts with their place in the order of an item instead of the position they came with."""
    order = ["position", *[c for c in m.FACT_FIELDS if c not in ("position", "item")]]
    ordered = ranked(facts, [*m.K4, "section", "item", "n"], order)
    return ordered.withColumn("position", F.col("rank")).drop("rank", "rank_rows")


def changed_tables(old: DataFrame, new: DataFrame, exact: bool = True) -> DataFrame:
    """D4. Tables whose facts differ in any field, order or number, as ``K4``.

    Positions count as an order only: a table whose columns come at 1 and 3, and are read back from
    a document at 1 and 2, is the same.  Old and new facts cancel out as a multiset, grouped by whole
    facts: exact, null-safe, without building a table's record, and a table with very many facts
    spreads over all tasks.  What is left is added up without positions, which decides nearly all tables:
    if facts remain, the table has changed.  Only where all of them differ in nothing but their positions
    are the facts of both sides numbered in order and compared again.

    With ``exact=False`` two 64-bit hashes of every fact, with its position and without, are summed per
    table instead.  That moves one row per table and task, where the exact form moves every fact; two
    different tables pass for equal with a chance of about 2**-128.
    """
    both = m.union(
        old.select(*m.FACT_COLUMNS, F.lit(-1).alias("n")),
        new.select(*m.FACT_COLUMNS, F.lit(1).alias("n")),
    )
    left = written(_remaining(both) if exact else _remaining_sums(both), "left")
    differ = left.where("changed").select(*m.K4)
    moved = left.where("NOT changed").select(*m.K4)
    if moved.isEmpty():
        return differ
    numbered = _in_sequence(both.join(moved, m.K4, "left_semi"))
    again = _remaining(numbered) if exact else _remaining_sums(numbered)
    return differ.union(again.select(*m.K4))


_BARE = [c for c in m.FACT_COLUMNS if c != "position"]


def _remaining(both: DataFrame) -> DataFrame:
    """``K4, changed``: tables whose facts, -1 for an old and 1 for a new one, do not cancel out, and
    whether they do not without positions either."""
    facts = both.groupBy(*m.FACT_COLUMNS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    bare = facts.groupBy(*_BARE).agg(F.sum("n").alias("n"))
    return bare.groupBy(*m.K4).agg(F.max(F.col("n") != 0).alias("changed"))


def _remaining_sums(both: DataFrame) -> DataFrame:
    """The same by sums of hashes."""
    fields = [c for c in _BARE if c not in m.K4]
    # A hash skips nulls, so the places of nulls are hashed as well.
    nulls = [F.col(c).isNull() for c in fields]
    hashed = lambda seed, *more: F.xxhash64(F.lit(seed), *fields, *nulls, *more).cast("decimal(20,0)")
    place = [F.col("position"), F.col("position").isNull()]
    total = lambda h: F.sum(F.col("n") * h)
    sums = both.groupBy(*m.K4).agg(
        F.sum("n").alias("n"),
        F.array(total(hashed(1)), total(hashed(2))).alias("bare"),
        F.array(total(hashed(3, *place)), total(hashed(4, *place))).alias("placed"),
    )
    is_left = lambda c: F.exists(c, lambda x: x != 0)
    changed = (F.col("n") != 0) | is_left("bare")
    return sums.where(changed | is_left("placed")).select(*m.K4, changed.alias("changed"))


def _own(custom: Column) -> Column:
    """Custom fields without those that the system owns; never null."""
    return F.map_filter(
        F.coalesce(custom, F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin(m.SYSTEM_KEYS),
    )


def merge_metadata(
    existing: Store,
    incoming: Store,
    now: Column,
    only_if_changed: bool = False,
    save: bool = True,
    exact: bool = True,
) -> Merged:
    """D3-D6, D14. Bring a scan into the store.

    ``tables`` gains ``action``: ``insert`` (new), ``update`` (facts replaced, ``updated_at`` set
    to ``now``), ``kept`` (not in this scan), and with ``only_if_changed`` also ``unchanged`` (same
    facts: the row stays as it is, even its documentation; new documentation is not taken over).
    Documentation is kept where the scan brings none, custom fields always.  Free-form fields go with
    what they belong to, and those of the description count as a change.

    With ``save=False`` the store stays as it is and only ``scanned`` carries the merge.  ``exact``
    is the way to compare, see ``changed_tables``.
    """
    again = partial(
        merge_metadata, incoming=incoming, now=now, only_if_changed=only_if_changed, save=save, exact=exact
    )
    number = getattr(existing, "number", None)
    scanned = incoming.tables.select(
        *m.K4,
        F.col("ai_documentation").alias("new_ai"),
        F.col("ai_extra").alias("new_ai_extra"),
        F.col("description_extra").alias("new_extra"),
        F.lit(True).alias("in_scan"),
    )
    if only_if_changed:
        # Tables outside the scan come out as changed too, but find no row here.  To leave them out
        # of the comparison, read only the scanned part of the store.
        changed = changed_tables(existing.facts, incoming.facts, exact).withColumn(
            "changed", F.lit(True)
        )
        scanned = scanned.join(changed, m.K4, "left")
    else:
        scanned = scanned.withColumn("changed", F.lit(True))
    stored = existing.tables.select(*m.TABLE_COLUMNS, F.lit(True).alias("in_store"))
    both = stored.join(scanned, m.K4, "full_outer")
    same_extra = F.to_json("description_extra").eqNullSafe(F.to_json("new_extra"))
    action = (
        F.when(F.col("in_scan").isNull(), "kept")
        .when(F.col("in_store").isNull(), "insert")
        .when(F.col("changed").isNull() & same_extra, "unchanged")
        .otherwise("update")
    )
    is_new = F.col("action").isin("insert", "update")
    # Written once: the facts to store, those of the scan and the tables all ask for the action.
    merged = both.withColumn("action", action).select(
        *m.K4,
        F.when(is_new, F.coalesce("new_ai", "ai_documentation"))
        .otherwise(F.col("ai_documentation"))
        .alias("ai_documentation"),
        F.when(is_new, _own(F.col("custom"))).otherwise(F.col("custom")).alias("custom"),
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(is_new & F.col("new_ai").isNotNull(), F.col("new_ai_extra"))
        .otherwise(F.col("ai_extra"))
        .alias("ai_extra"),
        F.when(is_new, F.col("new_extra")).otherwise(F.col("description_extra")).alias("description_extra"),
        "action",
    )
    merged = written(merged, "merged")
    replaced = merged.where(is_new).select(*m.K4)
    touched = merged.where(F.col("action") != "kept")
    old_facts, new_facts = existing.facts, incoming.facts
    fresh = new_facts.join(replaced, m.K4, "left_semi")
    facts = m.union(
        old_facts.join(replaced, m.K4, "left_anti").select(*m.FACT_COLUMNS),
        fresh.select(*m.FACT_COLUMNS),
    )
    if save:
        in_scan = facts.join(touched.select(*m.K4), m.K4, "left_semi")
        return Merged(merged, facts, Store(touched, in_scan), number, again)
    unchanged = old_facts.join(
        merged.where(F.col("action") == "unchanged").select(*m.K4), m.K4, "left_semi"
    )
    return Merged(
        existing.tables.withColumn("action", F.lit("kept")),
        old_facts,
        Store(touched, m.union(unchanged.select(*m.FACT_COLUMNS), fresh.select(*m.FACT_COLUMNS))),
        number,
        again,
    )


# ---- annotations -----------------------------------------------------------------------------

_NAMES = ["instance", "schema", "table"]


def rejected_patches(patches: DataFrame) -> DataFrame:
    """D7. Patches without any field."""
    return patches.where(F.coalesce(F.size("payload"), F.lit(0)) <= 0)


def _owner(tables: DataFrame) -> DataFrame:
    """D9. The one configuration, the smallest, that a name without configuration refers to."""
    return tables.groupBy(*_NAMES).agg(F.min("config").alias("config"))


def _fields(tables: DataFrame, patches: DataFrame) -> DataFrame:
    """Patched fields of existing tables ``K4, key, value``: the last patch of a field wins.

    Stale patches (made on an older ``based_on``) are left out.
    """
    basis = ["based_on"] if "based_on" in patches.columns else []
    last = F.max(F.struct("seq", "value")).alias("last")
    # The last value per field combines before the join, so many patches of one table are few rows.
    fields = (
        patches.where(F.size("payload") > 0)
        .select(*_NAMES, *basis, "seq", F.explode("payload").alias("key", "value"))
        .groupBy(*_NAMES, *basis, "key")
        .agg(last)
        .join(_owner(tables), _NAMES)
        .select(*m.K4, *basis, "key", "last.seq", "last.value")
    )
    if basis:
        current = tables.select(*m.K4, F.col("updated_at").alias("current"))
        fields = fields.join(current, m.K4).where(
            F.col("based_on").isNull() | (F.col("based_on") == F.col("current"))
        )
    return fields.groupBy(*m.K4, "key").agg(last).select(*m.K4, "key", "last.value")


def stale_patches(tables: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches made on a version of the row that is no longer the current one."""
    current = tables.join(_owner(tables), m.K4, "left_semi").select(
        *_NAMES, F.col("updated_at").alias("current")
    )
    return patches.join(current, _NAMES).where(F.col("based_on") != F.col("current"))


def annotate(tables: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """D7, D7b. Merge patches ``instance, schema, table, seq, payload[, based_on]`` into tables.

    Fields of the payload (JSON text each) become custom fields; the six protected ones are ignored
    but still restamp ``updated_at``; ``ai_documentation`` replaces the stored one.  A patch for an
    unknown table has no effect, an empty one neither.  ``schema_description`` replaces facts, see
    ``annotated_facts``.
    """
    from shelfmark.sources.documents import extra_of

    reserved = [*m.PROTECTED_KEYS, "schema_description", "ai_documentation"]
    # One entry per distinct field of a table, which bounds the collected list.
    patched = _fields(tables, patches).groupBy(*m.K4).agg(
        F.map_from_entries(
            F.collect_list(
                F.when(~F.col("key").isin(reserved), F.struct("key", "value"))
            )
        ).alias("patch"),
        F.max(F.when(F.col("key") == "ai_documentation", F.col("value"))).alias("patched_ai"),
        F.max(F.when(F.col("key") == "schema_description", F.col("value"))).alias("patched_description"),
        F.lit(True).alias("is_patched"),
    )
    custom = F.coalesce("custom", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(custom, lambda k, v: ~F.map_contains_key("patch", k))
    return tables.join(patched, m.K4, "left").select(
        *m.K4,
        F.coalesce(F.from_json("patched_ai", m.AI_TYPE), "ai_documentation").alias(
            "ai_documentation"
        ),
        F.when(F.col("is_patched"), F.map_concat(kept, F.col("patch")))
        .otherwise(F.col("custom"))
        .alias("custom"),
        F.when(F.col("is_patched"), now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(F.from_json("patched_ai", m.AI_TYPE).isNotNull(), extra_of(F.col("patched_ai"), "ai_documentation"))
        .otherwise(F.col("ai_extra"))
        .alias("ai_extra"),
        F.when(F.col("patched_description").isNotNull(), extra_of(F.col("patched_description"), "description"))
        .otherwise(F.col("description_extra"))
        .alias("description_extra"),
    )


def annotated_facts(store: Store, patches: DataFrame) -> DataFrame:
    """D7b. The store's facts after patches that carry a ``schema_description``."""
    from shelfmark.sources.documents import facts_of_descriptions

    given = _fields(store.tables, patches).where(F.col("key") == "schema_description")
    new = facts_of_descriptions(given.withColumnRenamed("value", "description"))
    return m.union(
        store.facts.join(given.select(*m.K4), m.K4, "left_anti").select(*m.FACT_COLUMNS), new
    )


# ---- lookups and pages -----------------------------------------------------------------------


def get_table(df: DataFrame, config: str, instance: str, schema: str, table: str) -> DataFrame:
    """D8. One table by its four names; equality filters, so a partitioned store is pruned."""
    wanted = dict(zip(m.K4, (config, instance, schema, table)))
    for name, value in wanted.items():
        df = df.where(F.col(name) == value)
    return df


def find_table(df: DataFrame, instance: str, schema: str, table: str) -> DataFrame:
    """D9. One table by three names; of several configurations the smallest."""
    found = df.where(
        (F.col("instance") == instance) & (F.col("schema") == schema) & (F.col("table") == table)
    )
    return found.orderBy("config").limit(1)


def find_tables(df: DataFrame) -> DataFrame:
    """D9 for every (instance, schema, table) at once."""
    return df.join(_owner(df), m.K4, "left_semi")


DEFAULT_PAGE, MAX_PAGE = 20, 200


def distinct_names(df: DataFrame, level: str, **within: str) -> DataFrame:
    """Distinct names of a level, across configurations, within the given parents."""
    for parent, name in within.items():
        df = df.where(F.col(parent) == name)
    return df.select(F.col(level).alias("name")).distinct()


def check_page_size(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page is at least 1 and page size 1 to {MAX_PAGE}")


def page(names: DataFrame, number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """D10-D12. One row ``items, total, page, page_size, pages`` of sorted names.

    Names get their places by a range sort and counts per partition, so a late page costs what the
    first one does, and only its names (at most 200) are gathered.  No names: an empty page, 0 pages.
    Names of a store on disk have an index, see ``sources.pages``.
    """
    check_page_size(number, size)
    placed = ranked(names.select("name"), [], ["name"])
    first = (number - 1) * size
    here = F.when((F.col("rank") > first) & (F.col("rank") <= first + size), F.col("name"))
    total = F.coalesce(F.max("rank_rows"), F.lit(0)).cast("bigint")
    return placed.agg(F.sort_array(F.collect_list(here)).alias("items"), total.alias("total")).select(
        "items",
        "total",
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / F.lit(size)).alias("pages"),
    )


def search(df: DataFrame, columns: list[str | Column], text: str) -> DataFrame:
    """D13. Rows where any of the columns contains the text, in any case."""
    hit = F.lit(False)
    for c in columns:
        value = F.col(c) if isinstance(c, str) else c
        hit = hit | F.coalesce(F.contains(F.lower(value), F.lower(F.lit(text))), F.lit(False))
    return df.where(hit)
