"""Stored metadata documents (one JSON object per table) to and from the store's frames.

Documents are free-form.  Fields that the store knows are typed columns; all others are kept beside them,
at every level, as variants (of a table) or as their JSON text (of a fact, since facts are compared), and
are written back where they stood.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions.text import iso, metadata_key
from shelfmark.shared import written

_LIST = "struct<name:string,data_type:string,is_nullable:boolean,default_value:string,comment:string,description:string>"
_DESCRIPTION = (
    f"struct<columns:array<{_LIST}>,primary_key:struct<column_names:array<string>>,"
    "sort_key:string,"
    "foreign_keys:array<struct<column_name:string,referenced_table:string,"
    "referenced_column:string,constraint_name:string>>,"
    "indexes:array<struct<name:string,column_names:array<string>,is_unique:boolean,"
    "is_primary:boolean,type:string>>,"
    "partitions:array<struct<column_name:string,data_type:string,comment:string>>>"
)


# The names that are known at each level of a document.
_KNOWN = {
    "columns": ["name", "data_type", "is_nullable", "default_value", "comment", "description"],
    "foreign_keys": ["column_name", "referenced_table", "referenced_column", "constraint_name"],
    "indexes": ["name", "column_names", "is_unique", "is_primary", "type"],
    "partitions": ["column_name", "data_type", "comment"],
    "primary_key": ["column_names"],
    "description": [
        "instance_name", "schema_name", "table_name", "columns", "primary_key", "sort_key",
        "foreign_keys", "indexes", "partitions",
    ],
    "ai_documentation": ["summary", "column_descriptions", "generated_at", "model"],
}
_OBJECT = "map<string,variant>"
_ENTRIES = ["columns", "foreign_keys", "indexes", "partitions"]
# The objects of a description whose entries may say more, with all that they say.
_OBJECTS = "struct<" + ",".join(f"{name}:array<{_OBJECT}>" for name in _ENTRIES) + f",primary_key:{_OBJECT}>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, which Spark does not see to around lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _others(fields: Column, known: list[str]) -> Column:
    """What an object says beyond the known names, as JSON text with sorted keys; null if nothing.

    ``fields`` is a column or a lambda's variable: it is asked for by every name.
    """

    def kept(names: Column) -> Column:
        values = F.transform(names, lambda k: F.element_at(fields, k))
        return F.when(F.size(names) > 0, F.to_json(F.map_from_arrays(names, values)))

    return _let(F.sort_array(F.filter(F.map_keys(fields), lambda k: ~k.isin(known))), kept)


def _others_of_lists(objects: str) -> Column:
    """The same for the entries of a description's lists (a column of ``_OBJECTS``), by list."""

    def of_list(name: str) -> Column:
        return F.transform(f"{objects}.{name}", lambda e: _others(e, _KNOWN[name])).alias(name)

    key = _others(F.col(f"{objects}.primary_key"), _KNOWN["primary_key"])
    return F.struct(*[of_list(name) for name in _ENTRIES], key.alias("primary_key"))


def extra_of(object_: Column, level: str) -> Column:
    """The fields of a JSON object (text) beyond those known at a level, as a variant."""
    return F.try_parse_json(_let(F.from_json(object_, _OBJECT), lambda fields: _others(fields, _KNOWN[level])))


def facts_of_descriptions(df: DataFrame) -> DataFrame:
    """Facts of ``K4, description``, the description being JSON text of one table's record."""
    objects = F.try_variant_get(F.try_parse_json("description"), "$", _OBJECTS)
    parsed = once(df, [*m.K4], d=F.from_json("description", _DESCRIPTION), objects=objects)
    return _facts(once(parsed, [*m.K4, "d"], others=_others_of_lists("objects")))


def once(df: DataFrame, kept: list[str], **values: Column) -> DataFrame:
    """``kept`` and new columns that are computed once per row, however often and by however many filters
    they are asked for: Spark copies an expression to where it is used, but not one that makes rows."""
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))


# Fixed value: what documents call an index without a name.
UNNAMED = "None"
# Facts of a later part of a long table come after those of the parts before it.
_PART = 1 << 32


def _fact(section: str, **fields: Column) -> Column:
    """A fact as a struct; fields not given are null, ``item`` is ''."""
    fields.setdefault("item", F.lit(""))
    values = [fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in m.FACT_FIELDS.items()]
    return F.struct(F.lit(section).alias("section"), *values)


def _facts(described: DataFrame) -> DataFrame:
    """Facts of all sections from one pass over ``K4, d, others[, part]``."""
    part = F.col("part") if "part" in described.columns else F.lit(0)
    before = part.cast("bigint") * _PART
    nothing = F.array().cast("array<" + _fact_type() + ">")

    def place(i: Column) -> Column:
        return before + i + 1

    def listed(name: str, fact) -> Column:
        facts = F.transform(f"d.{name}", lambda e, i: fact(e, i, F.get(f"others.{name}", i)))
        return F.coalesce(facts, nothing)

    def column(e: Column, i: Column, extra: Column) -> Column:
        own = ["data_type", "is_nullable", "default_value", "comment", "description"]
        return _fact(m.COLUMN, position=place(i), column_name=e["name"], extra=extra, **{f: e[f] for f in own})

    def reference(e: Column, i: Column, extra: Column) -> Column:
        own = ["column_name", "referenced_table", "referenced_column"]
        item = F.coalesce(e["constraint_name"], F.lit(""))
        return _fact(m.FOREIGN_KEY, item=item, position=place(i), extra=extra, **{f: e[f] for f in own})

    def partition(e: Column, i: Column, extra: Column) -> Column:
        own = ["column_name", "data_type", "comment"]
        return _fact(m.PARTITION, position=place(i), extra=extra, **{f: e[f] for f in own})

    def index(e: Column, i: Column, extra: Column) -> Column:
        def of(position: Column, name: Column) -> Column:
            return _fact(
                m.INDEX, item=F.coalesce(e["name"], F.lit(UNNAMED)), position=position, column_name=name,
                is_unique=e["is_unique"], is_primary=e["is_primary"], index_type=e["type"], extra=extra,
            )

        names = F.transform(e["column_names"], lambda name, k: of(place(k), name))
        # An index without columns is a fact as well.
        return F.when(F.size(e["column_names"]) > 0, names).otherwise(F.array(of(F.lit(None), F.lit(None))))

    # The primary key is one object: what it says beyond its columns stays with each of them.
    key = F.transform(
        "d.primary_key.column_names",
        lambda e, i: _fact(m.PRIMARY_KEY, position=place(i), column_name=e, extra=F.col("others.primary_key")),
    )
    sort_key = F.array(_fact(m.SORT_KEY, position=F.lit(1), column_name=F.col("d.sort_key")))
    indexes = F.transform("d.indexes", lambda e, i: index(e, i, F.get("others.indexes", i)))
    facts = F.concat(
        listed("columns", column),
        F.coalesce(key, nothing),
        F.when(F.col("d.sort_key").isNotNull(), sort_key).otherwise(nothing),
        listed("foreign_keys", reference),
        F.coalesce(F.flatten(indexes), nothing),
        listed("partitions", partition),
    )
    return described.select(*m.K4, F.inline(facts)).select(*m.FACT_COLUMNS)


def _fact_type() -> str:
    return "struct<section:string," + ",".join(f"{name}:{kind}" for name, kind in m.FACT_FIELDS.items()) + ">"


# What a table's row is made from; the lists of a description are passed over.
_HEAD = "struct<" + ",".join(f"{k}_name:string" for k in m.K4) + f",updated_at:string,ai_documentation:{m.AI_TYPE}>"
_READ = ["text", "updated_at", "ai_documentation"]


class Newest(NamedTuple):
    """``K4, part, at`` of the documents that count, and what is read of them, see ``newest``."""

    documents: DataFrame


def newest(texts: DataFrame, column: str = "document") -> Newest:
    """The documents that count, for ``tables_of_documents`` and ``facts_of_documents`` of the same
    texts; text that is no JSON object counts as absent.

    Of several documents of a table (and part) the one with the newest ``updated_at`` counts, then
    the greatest text; parts of older versions do not count.  Documents without all four names are absent.
    """
    part = F.col("part") if "part" in texts.columns else F.lit(0)
    given = once(texts, [], part=part, text=F.col(column))
    head = F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", _HEAD))
    at = F.coalesce(F.col("head.updated_at").try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    named = once(given, ["part", "text"], head=head).select(
        *[F.col(f"head.{k}_name").alias(k) for k in m.K4], "part", at.alias("at"),
        "text", "head.updated_at", "head.ai_documentation",
    ).dropna(subset=m.K4)
    named = _last(written(named, "documents"))
    if "part" not in texts.columns:
        return Newest(named)
    # Only tables of several parts can have some of an older version; times are read without the texts.
    ages = named.groupBy(*m.K4).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    mixed = written(ages.where("first < last").select(*m.K4, "last"), "mixed")
    if mixed.isEmpty():
        return Newest(named)
    return Newest(named.join(mixed, m.K4, "left").where("last IS NULL OR at = last").select(*named.columns))


def _last(named: DataFrame) -> DataFrame:
    """Of several texts of a table and part the last one.  Only such texts are moved; which tables have
    them is found without the texts."""
    keys = [*m.K4, "part"]
    counted = named.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    several = written(counted.select(*[F.col(k).alias(f"_{k}") for k in keys]), "several")
    if several.isEmpty():
        return named
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    order = F.struct("at", "text")
    last = named.join(several, same, "left_semi").groupBy(*keys).agg(F.max_by(F.struct("at", *_READ), order).alias("n"))
    alone = named.join(several, same, "left_anti")
    return written(alone.unionByName(last.select(*keys, "n.*")), "newest")


def _documents(texts: DataFrame | Newest, column: str) -> DataFrame:
    return (texts if isinstance(texts, Newest) else newest(texts, column)).documents


def tables_of_documents(texts: DataFrame | Newest, column: str = "document") -> DataFrame:
    """A3, D6. Header rows of JSON documents; custom fields, as JSON text each, are all that the
    system does not own.  Of a table that comes in several parts the first one counts."""
    first = _documents(texts, column).where("part = 0")
    of = lambda name: F.try_variant_get(F.try_element_at("fields", F.lit(name)), "$", _OBJECT)
    kept = [*m.K4, "updated_at", "ai_documentation"]
    parsed = once(
        once(first, kept, fields=F.from_json("text", _OBJECT)), [*kept, "fields"],
        ai=of("ai_documentation"), description=of("schema_description"),
    )
    custom = F.transform_values(
        F.map_filter("fields", lambda k, v: ~k.isin(m.SYSTEM_KEYS)), lambda k, v: F.to_json(v)
    )
    extra = lambda object_, level: F.try_parse_json(_others(F.col(object_), _KNOWN[level]))
    return m.tables(
        parsed,
        ai_documentation=F.col("ai_documentation"),
        custom=custom,
        updated_at=F.col("updated_at"),
        ai_extra=extra("ai", "ai_documentation"),
        description_extra=extra("description", "description"),
    )


def facts_of_documents(texts: DataFrame | Newest, column: str = "document") -> DataFrame:
    """A3. Facts of JSON documents, those of a table's parts (column ``part``) in their order."""
    kept = [*m.K4, "part"]
    described = lambda kind: F.from_json("text", f"struct<schema_description:{kind}>")["schema_description"]
    parsed = once(_documents(texts, column), kept, d=described(_DESCRIPTION), objects=described(_OBJECTS))
    return _facts(once(parsed, [*kept, "d"], others=_others_of_lists("objects")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A3. Document files (one JSON object each, in folders) as ``document`` texts."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .withColumnRenamed("value", "document")
    )


# Longer than any text: the rest of it, without asking for its length, which would build the text again.
_REST = (1 << 31) - 1
_NULLS = {"ignoreNullFields": "false"}


def _joined(own: Column, extra: Column) -> Column:
    """An object (JSON text) with what is known of it only as JSON text; which comes first is no matter to parsers."""
    lead = F.coalesce(F.concat(extra.substr(F.lit(1), F.length(extra) - 1), F.lit(",")), F.lit("{"))
    return F.concat(lead, own.substr(F.lit(2), F.lit(_REST)))


def _sorted(text: Column) -> Column:
    """JSON text with sorted keys; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def _text(entry: Column, kind) -> Column:
    """The known fields of an entry as JSON text with sorted keys."""
    return F.to_json(F.struct(*[entry[f].alias(f) for f in sorted(kind.names) if f != "extra"]), _NULLS)


def _entry(entry: Column, kind) -> Column:
    """An entry as JSON text with sorted keys.  Only one that says more is parsed, to sort its keys."""
    text = _text(entry, kind)
    if "extra" not in kind.names:
        return text
    more = F.coalesce(_sorted(_joined(text, entry["extra"])), F.lit("null"))
    return F.when(entry["extra"].isNull(), text).otherwise(more)


def _list(name: str, kind) -> Column:
    """A list of a row of ``describe.nest`` as JSON text; missing ones are empty."""
    bare = lambda e: F.struct(*[e[f].alias(f) for f in sorted(kind.names) if f != "extra"])
    plain = F.coalesce(F.to_json(F.transform(name, bare), _NULLS), F.lit("[]"))
    if "extra" not in kind.names:
        return plain

    def of(entry: Callable[[Column], Column]) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(name, entry), ","), F.lit("]"))

    # Entries that say more are parsed together; one by one only if some entry is no object that way.
    at_once = _sorted(of(lambda e: _joined(_text(e, kind), e["extra"])))
    one_by_one = of(lambda e: _entry(e, kind))
    says_more = F.exists(name, lambda e: e["extra"].isNotNull())
    return F.when(says_more, F.coalesce(at_once, one_by_one)).otherwise(plain)


def _value(c: Column) -> Column:
    """A value as JSON text."""
    text = F.to_json(F.array(c), _NULLS)
    return text.substr(F.lit(2), F.length(text) - 2)


def _description(nested: DataFrame) -> Column:
    """The description of a row of ``nested`` as JSON text with sorted keys, and all that is kept beside it."""
    key = F.col("primary_key")
    own = {name: _list(name, nested.schema[name].dataType.elementType) for name in _ENTRIES}
    own["primary_key"] = F.when(key.isNotNull(), _entry(key, nested.schema["primary_key"].dataType)).otherwise("null")
    own |= {f"{k}_name": _value(F.col(k)) for k in ("instance", "schema", "table")}
    own["sort_key"] = _value(F.col("sort_key"))
    names = sorted(own)
    piece = lambda place, at, text: F.struct(
        F.lit(place).alias("place"), F.lit(at).alias("at"), text.alias("text")
    )
    known = [piece(2 * i + 1, 0, F.concat(F.lit(f'"{k}":'), own[k])) for i, k in enumerate(names)]

    def other(e: Column, i: Column) -> Column:
        # Between the known names that it stands between; variants have their names in order.
        before = F.size(F.filter(F.lit(names), lambda k: k < e["key"]))
        return piece(2 * before, i, F.concat(_value(e["key"]), F.lit(":"), F.to_json(e["value"])))

    free = F.col("description_extra")
    entries = F.map_entries(F.try_variant_get(free, "$", _OBJECT))
    # Nothing at all, or a known name said again, makes no object.
    is_object = free.isNull() | ((F.size(entries) > 0) & ~F.exists(entries, lambda e: e["key"].isin(names)))
    none = F.array().cast("array<struct<place:int,at:int,text:string>>")
    more = F.when(free.isNull(), none).otherwise(F.transform(entries, other))
    texts = F.transform(F.sort_array(F.concat(F.array(*known), more)), lambda e: e["text"])
    return F.when(is_object, F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")))


def to_documents(tables: DataFrame, nested: DataFrame) -> DataFrame:
    """Stored form: ``K4, part, document`` with custom fields beside the system's own.

    ``nested`` comes from ``describe.nest``, with ``extra=True`` if what documents said beyond the known
    fields is to be written back; a very wide table gives several documents by ``part``, a table without
    facts one with empty lists.
    """
    ai = F.col("ai_documentation")
    documented = F.when(ai.isNotNull(), _sorted(_joined(F.to_json(ai, _NULLS), F.to_json("ai_extra"))))
    names = F.to_json(
        F.struct(
            metadata_key().alias("metadata_key"),
            *[F.col(k).alias(f"{k}_name") for k in m.K4],
            iso("updated_at").alias("updated_at"),
        ),
        _NULLS,
    )
    own = F.concat(
        names.substr(F.lit(2), F.length(names) - 2),
        F.lit(',"schema_description":'), F.coalesce(_description(nested), F.lit("null")),
        F.lit(',"ai_documentation":'), F.coalesce(documented, F.lit("null")), F.lit("}"),
    )
    # Custom values are JSON text already, so they are written as they are.
    entries = F.transform(
        F.map_entries(F.coalesce("custom", F.create_map().cast("map<string,string>"))),
        lambda e: F.concat(
            F.to_json(F.create_map(e["key"], F.lit(0))).substr(
                F.lit(2), F.length(F.to_json(F.create_map(e["key"], F.lit(0)))) - 3
            ),
            e["value"],
        ),
    )
    custom = F.array_join(F.transform(entries, lambda e: F.concat(e, F.lit(","))), "")
    return tables.join(nested, m.K4, "left").select(
        *m.K4,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.concat(F.lit("{"), custom, own).alias("document"),
    )
