"""B. Catalogue extracts to facts, and facts to one record per table.

Every function takes extracts of any number of tables at once.  Columns an extract carries besides
``config`` and ``instance`` are named as the source names them.  Results are facts
(:mod:`shelfmark.model`): B1-B13 are projections, explosions and joins, none of them groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions.text import code, non_empty, strip
from shelfmark.functions.types import BSON_TYPES, DYNAMO_TYPES, normalise_type
from shelfmark.operators.lists import PART_ITEMS, in_order, with_part

TABLE_SCHEMA = {"table_schema": "schema", "table_name": "table"}


def _is_yes(value: str) -> Column:
    return F.coalesce(F.col(value) == "YES", F.lit(False))


def _flag(value: str) -> Column:
    """0/1, boolean or null as a boolean."""
    return F.coalesce(F.col(value).cast("boolean"), F.lit(False))


# ---- columns ---------------------------------------------------------------------------------


def columns_mysql(raw: DataFrame) -> DataFrame:
    """B1. ``schema, table, ord, Field, Type, Null, Default``; comments are not listed there."""
    return m.facts(
        raw,
        m.COLUMN,
        position=F.col("ord"),
        column_name=F.col("Field"),
        data_type=F.col("Type"),
        is_nullable=_is_yes("Null"),
        default_value=F.col("Default"),
    )


def columns_postgres(cols: DataFrame, stats: DataFrame, descr: DataFrame) -> DataFrame:
    """B2. Columns with the comment that belongs to (table oid, ordinal), null if there is none.

    The oid of a table is unique in ``stats``, so descriptions are resolved to table names first;
    the join with the columns is then keyed by (table, ordinal) and a very wide table spreads out.
    """
    comments = (
        descr.join(
            stats,
            (descr.objoid == stats.relid)
            & (descr.config == stats.config)
            & (descr.instance == stats.instance),
        )
        .select(
            stats.config,
            stats.instance,
            stats.schemaname.alias("schema"),
            stats.relname.alias("table"),
            descr.objsubid.cast("bigint").alias("position"),
            descr.description,
        )
    )
    listed = cols.withColumnsRenamed(TABLE_SCHEMA).withColumn(
        "position", F.col("ordinal_position").cast("bigint")
    )
    return m.facts(
        listed.join(comments, [*m.K4, "position"], "left"),
        m.COLUMN,
        position=F.col("position"),
        column_name=F.col("column_name"),
        data_type=F.col("data_type"),
        is_nullable=_is_yes("is_nullable"),
        default_value=F.col("column_default"),
        comment=F.col("description"),
    )


def columns_sqlite(raw: DataFrame) -> DataFrame:
    """B3. A column is nullable if it is neither declared NOT NULL nor part of the primary key."""
    return m.facts(
        raw,
        m.COLUMN,
        position=F.col("cid") + 1,
        column_name=F.col("name"),
        data_type=F.col("type"),
        is_nullable=~_flag("notnull") & (F.col("pk") == 0),
        default_value=F.col("dflt_value"),
    )


def columns_duckdb(raw: DataFrame) -> DataFrame:
    """B4. A column is nullable if it is not declared NOT NULL, key or not."""
    return m.facts(
        raw,
        m.COLUMN,
        position=F.col("cid") + 1,
        column_name=F.col("name"),
        data_type=F.col("type"),
        is_nullable=~_flag("notnull"),
        default_value=F.col("dflt_value"),
    )


def columns_trino(raw: DataFrame) -> DataFrame:
    """B5. Columns; those marked as partition key become partition facts instead.

    Nullability that is not given counts as YES, an empty comment as none.
    """
    is_partition = F.coalesce(F.lower("extra_info") == "partition key", F.lit(False))
    nullable = F.upper(F.coalesce("is_nullable", F.lit("YES"))) == "YES"
    return m.facts(
        raw.withColumnsRenamed(TABLE_SCHEMA),
        F.when(is_partition, m.PARTITION).otherwise(m.COLUMN),
        position=F.col("ordinal_position"),
        column_name=F.col("column_name"),
        data_type=F.col("data_type"),
        is_nullable=F.when(~is_partition, nullable),
        default_value=F.when(~is_partition, F.col("column_default")),
        comment=non_empty("comment"),
    )


def _exploded(docs: DataFrame, *lists: Column) -> DataFrame:
    """One row per element of the given arrays of equal structs (a missing array is empty)."""
    return docs.select(*m.K4, F.inline(F.concat(*lists)))


def _part_list(array: Column, section: str, shape) -> Column:
    """Elements of ``array`` as structs (section, position, ...)."""
    return F.coalesce(
        F.transform(
            array,
            lambda e, i: F.struct(
                F.lit(section).alias("section"), (i + 1).alias("position"), *shape(e)
            ),
        ),
        F.array(),
    )


def columns_glue(docs: DataFrame) -> DataFrame:
    """B6. Storage columns (always nullable) and partition keys of nested table documents."""

    def shape(e: Column) -> list[Column]:
        return [
            e["Name"].alias("column_name"),
            e["Type"].alias("data_type"),
            F.nullif(e["Comment"], F.lit("")).alias("comment"),
        ]

    rows = _exploded(
        docs.withColumn("table", F.col("Name")),
        _part_list(F.col("StorageDescriptor.Columns"), m.COLUMN, shape),
        _part_list(F.col("PartitionKeys"), m.PARTITION, shape),
    )
    return m.facts(
        rows,
        F.col("section"),
        position=F.col("position"),
        column_name=F.col("column_name"),
        data_type=F.col("data_type"),
        is_nullable=F.when(F.col("section") == m.COLUMN, F.lit(True)),
        comment=F.col("comment"),
    )


def _key_of(kind: str) -> Column:
    """Attribute of the last key-schema entry of the given kind, else null."""
    found = F.filter(F.col("KeySchema"), lambda k: k["KeyType"] == kind)
    return F.try_element_at(found, F.lit(-1))["AttributeName"]


def columns_dynamo(docs: DataFrame) -> DataFrame:
    """B7. Attributes (never null); the HASH key is primary key and partition, RANGE is sort key.

    An attribute defined twice keeps its first place and its last type.
    """
    attributes = F.coalesce(F.col("AttributeDefinitions"), F.array())
    type_of = lambda name: normalise_type(
        F.try_element_at(
            F.filter(attributes, lambda a: a["AttributeName"] == name), F.lit(-1)
        )["AttributeType"],
        DYNAMO_TYPES,
    )
    names = F.array_distinct(F.transform(attributes, lambda a: a["AttributeName"]))
    present = lambda key: F.filter(F.array(key), lambda k: k.isNotNull())
    name_only = lambda e: [
        e.alias("column_name"), F.lit(None).cast("string").alias("data_type")
    ]
    hash_key = _key_of("HASH")
    rows = _exploded(
        docs.withColumn("table", F.col("TableName")),
        _part_list(names, m.COLUMN, lambda e: [e.alias("column_name"), type_of(e).alias("data_type")]),
        _part_list(present(hash_key), m.PRIMARY_KEY, name_only),
        _part_list(present(_key_of("RANGE")), m.SORT_KEY, name_only),
        _part_list(
            present(hash_key),
            m.PARTITION,
            lambda e: [
                e.alias("column_name"),
                F.coalesce(type_of(e), F.lit("Unknown")).alias("data_type"),
            ],
        ),
    )
    return m.facts(
        rows,
        F.col("section"),
        position=F.col("position"),
        column_name=F.col("column_name"),
        data_type=F.col("data_type"),
        is_nullable=F.when(F.col("section") == m.COLUMN, F.lit(False)),
    )


_MONGO_SCHEMA = (
    "struct<required:array<string>,"
    "properties:map<string,struct<bsonType:string,type:string,description:string,title:string>>>"
)


def _mongo_type(field: Column) -> Column:
    """``bsonType`` else ``type`` else 'unknown'; of several types the first that is not null."""
    given = F.coalesce(
        F.when(~field["bsonType"].isin("", "[]"), field["bsonType"]), field["type"], F.lit("unknown")
    )
    several = F.from_json(given, "array<string>")
    first = F.coalesce(
        F.try_element_at(F.filter(several, lambda t: t != "null"), F.lit(1)),
        F.try_element_at(several, F.lit(1)),
    )
    return normalise_type(F.when(given.startswith("["), first).otherwise(given), BSON_TYPES)


def columns_mongo(docs: DataFrame) -> DataFrame:
    """B8. Properties of a collection's declared JSON schema; nullable unless listed as required.

    Nothing is inferred: a collection without a schema has no columns (see ``undescribed``).
    """
    parsed = docs.select(
        "config",
        "instance",
        F.col("db").alias("schema"),
        F.col("name").alias("table"),
        F.from_json("json_schema", _MONGO_SCHEMA).alias("s"),
    )
    fields = parsed.select(
        *m.K4,
        F.coalesce(F.col("s.required"), F.array().cast("array<string>")).alias("required"),
        F.posexplode("s.properties").alias("position", "column_name", "field"),
    )
    field = F.col("field")
    return m.facts(
        fields,
        m.COLUMN,
        position=F.col("position") + 1,
        column_name=F.col("column_name"),
        data_type=_mongo_type(field),
        is_nullable=~F.array_contains("required", F.col("column_name")),
        comment=F.coalesce(
            F.nullif(field["description"], F.lit("")), F.nullif(field["title"], F.lit(""))
        ),
    )


# ---- keys and references ---------------------------------------------------------------------

_CONSTRAINT = ["config", "instance", "schema", "table", "constraint_name"]


def _of_type(constraints: DataFrame, kind: str) -> DataFrame:
    return constraints.where(F.col("constraint_type") == kind).select(
        "config",
        "instance",
        F.col("constraint_schema").alias("schema"),
        F.col("table_name").alias("table"),
        "constraint_name",
    )


def primary_keys(
    constraints: DataFrame, usage: DataFrame, constraint_type: str = "PRIMARY KEY"
) -> DataFrame:
    """B9. Key columns of constraints of one type, joined on name, schema and table."""
    used = usage.withColumnsRenamed(TABLE_SCHEMA)
    return m.facts(
        used.join(_of_type(constraints, constraint_type), _CONSTRAINT),
        m.PRIMARY_KEY,
        position=F.col("ordinal_position"),
        column_name=F.col("column_name"),
    )


def primary_keys_mysql(usage: DataFrame) -> DataFrame:
    """B9. There the primary key is the constraint named ``PRIMARY``."""
    return m.facts(
        usage.withColumnsRenamed(TABLE_SCHEMA).where(F.col("constraint_name") == "PRIMARY"),
        m.PRIMARY_KEY,
        position=F.col("ordinal_position"),
        column_name=F.col("column_name"),
    )


def primary_keys_sqlite(raw: DataFrame) -> DataFrame:
    """B9. There ``pk`` is the place of a column in the key, 0 outside it."""
    return m.facts(
        raw.where(F.col("pk") > 0),
        m.PRIMARY_KEY,
        position=F.col("pk"),
        column_name=F.col("name"),
    )


def primary_keys_duckdb(constraints: DataFrame) -> DataFrame:
    """B9. There a constraint row lists its columns: ``constraint_column_names``."""
    rows = constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(
        "config",
        "instance",
        F.col("schema_name").alias("schema"),
        F.col("table_name").alias("table"),
        F.posexplode("constraint_column_names").alias("i", "column_name"),
    )
    return m.facts(
        rows, m.PRIMARY_KEY, position=F.col("i") + 1, column_name=F.col("column_name")
    )


def foreign_keys_mysql(usage: DataFrame) -> DataFrame:
    """B10. Usage rows that name a referenced table."""
    return m.facts(
        usage.withColumnsRenamed(TABLE_SCHEMA).where(F.col("referenced_table").isNotNull()),
        m.FOREIGN_KEY,
        item=F.coalesce("constraint_name", F.lit("")),
        position=F.col("ordinal_position"),
        column_name=F.col("column_name"),
        referenced_table=F.col("referenced_table"),
        referenced_column=F.col("referenced_column"),
    )


def foreign_keys(
    constraints: DataFrame,
    usage: DataFrame,
    referenced: DataFrame,
    constraint_type: str = "FOREIGN KEY",
) -> DataFrame:
    """B10. Constraint, its columns, and the columns they refer to, paired by ordinal.

    ``referenced``: ``constraint_schema, constraint_name, table_name, column_name,
    ordinal_position``.  Matching by schema, name and ordinal gives n pairs for an n-column key;
    matching by name alone would give n*n and mix equal names of different schemas.  Copies of a
    referenced column are removed first, so every usage row finds one.
    """
    targets = referenced.select(
        "config",
        "instance",
        F.col("constraint_schema").alias("schema"),
        "constraint_name",
        "ordinal_position",
        F.col("table_name").alias("referenced_table"),
        F.col("column_name").alias("referenced_column"),
    ).distinct()
    used = usage.withColumnsRenamed(TABLE_SCHEMA).select(
        *_CONSTRAINT, "ordinal_position", "column_name"
    )
    return m.facts(
        used.join(_of_type(constraints, constraint_type), _CONSTRAINT).join(
            targets, ["config", "instance", "schema", "constraint_name", "ordinal_position"]
        ),
        m.FOREIGN_KEY,
        item=F.col("constraint_name"),
        position=F.col("ordinal_position"),
        column_name=F.col("column_name"),
        referenced_table=F.col("referenced_table"),
        referenced_column=F.col("referenced_column"),
    )


def foreign_keys_sqlite(raw: DataFrame) -> DataFrame:
    """B10. ``schema, table, id, seq, referenced, from, to``; constraints have no names there.

    References are ordered by their number, then by place; a key has fewer than 32768 columns.
    """
    return m.facts(
        raw,
        m.FOREIGN_KEY,
        position=F.col("id").cast("bigint") * 32768 + F.col("seq") + 1,
        column_name=F.col("from"),
        referenced_table=F.col("referenced"),
        referenced_column=F.col("to"),
    )


# ---- indexes and partitions ------------------------------------------------------------------


def indexes(raw: DataFrame) -> DataFrame:
    """B11. ``schema, table, index_name, column_name, seq, non_unique, is_primary, index_type``.

    Primary is what the source flags, or, where it has no flag, the index named ``PRIMARY``.
    """
    return m.facts(
        raw,
        m.INDEX,
        item=F.col("index_name"),
        position=F.col("seq"),
        column_name=F.col("column_name"),
        is_unique=~_flag("non_unique"),
        is_primary=F.coalesce(
            F.col("is_primary").cast("boolean"), F.col("index_name") == "PRIMARY"
        ),
        index_type=F.col("index_type"),
    )


def index_columns_from_ddl(sql: str | Column) -> Column:
    """B11b. Names in the first ``( ... )`` of index DDL; empty if there is none.

    The text ends at the first ``)``, so an expression index on ``lower(a)`` gives ``lower(a``.
    """
    sql = F.col(sql) if isinstance(sql, str) else sql
    inside = F.regexp_extract(sql, r"\(([^)]+)\)", 1)
    names = F.transform(F.split(inside, ","), strip)
    return F.when(inside != "", names).otherwise(F.array().cast("array<string>"))


def indexes_from_ddl(raw: DataFrame) -> DataFrame:
    """B11b. ``schema, table, index_name, is_unique, is_primary, sql``.

    An index whose columns cannot be read keeps one fact without a column.
    """
    rows = raw.select(
        *m.K4,
        "index_name",
        "is_unique",
        "is_primary",
        F.posexplode_outer(index_columns_from_ddl("sql")).alias("i", "column_name"),
    )
    return m.facts(
        rows,
        m.INDEX,
        item=F.col("index_name"),
        position=F.col("i") + 1,
        column_name=F.col("column_name"),
        is_unique=_flag("is_unique"),
        is_primary=_flag("is_primary"),
    )


def _numbered(raw: DataFrame, positions: str, attributes: DataFrame, *keep: str) -> DataFrame:
    """B11c. Attribute numbers with their place, joined to the attributes they name.

    Key parts that are expressions have no attribute and drop out; places keep the gap.
    """
    places = raw.select(
        "config",
        "instance",
        "schema",
        "table",
        "relid",
        *keep,
        F.posexplode(positions).alias("i", "attnum"),
    )
    named = attributes.select(
        "config", "instance", "relid", "attnum", "column_name", "data_type", "comment"
    )
    return places.join(named, ["config", "instance", "relid", "attnum"])


def indexes_postgres(raw: DataFrame, attributes: DataFrame) -> DataFrame:
    """B11c. ``schema, table, relid, index_name, is_unique, is_primary, index_type, indkey``."""
    kept = ["index_name", "is_unique", "is_primary", "index_type"]
    return m.facts(
        _numbered(raw, "indkey", attributes, *kept),
        m.INDEX,
        item=F.col("index_name"),
        position=F.col("i") + 1,
        column_name=F.col("column_name"),
        is_unique=_flag("is_unique"),
        is_primary=_flag("is_primary"),
        index_type=F.col("index_type"),
    )


def partitions_postgres(raw: DataFrame, attributes: DataFrame) -> DataFrame:
    """B12. ``schema, table, relid, partattrs``; the columns themselves stay columns too."""
    return m.facts(
        _numbered(raw, "partattrs", attributes),
        m.PARTITION,
        position=F.col("i") + 1,
        column_name=F.col("column_name"),
        data_type=F.col("data_type"),
        comment=F.col("comment"),
    )


def indexes_dynamo(docs: DataFrame) -> DataFrame:
    """B11d. Global and local secondary indexes with their key names, never unique."""

    def listed(source: str, kind: str) -> Column:
        return F.coalesce(
            F.transform(
                F.col(source),
                lambda x: F.struct(
                    x["IndexName"].alias("item"),
                    F.lit(kind).alias("index_type"),
                    F.transform(x["KeySchema"], lambda k: k["AttributeName"]).alias("names"),
                ),
            ),
            F.array(),
        )

    rows = docs.withColumn("table", F.col("TableName")).select(
        *m.K4,
        F.inline(
            F.concat(
                listed("GlobalSecondaryIndexes", "GSI"), listed("LocalSecondaryIndexes", "LSI")
            )
        ),
    )
    rows = rows.select(
        *m.K4, "item", "index_type", F.posexplode_outer("names").alias("i", "column_name")
    )
    return m.facts(
        rows,
        m.INDEX,
        item=F.col("item"),
        position=F.col("i") + 1,
        column_name=F.col("column_name"),
        is_unique=F.lit(False),
        is_primary=F.lit(False),
        index_type=F.col("index_type"),
    )


_MONGO_INDEXES = "map<string,struct<key:array<array<string>>,unique:boolean>>"


def indexes_mongo(docs: DataFrame) -> DataFrame:
    """B11e. ``indexes`` is JSON text name -> {key: [[column, direction]...], unique}.

    ``_id_`` is the primary index, and primary implies unique.
    """
    rows = docs.select(
        "config",
        "instance",
        F.col("db").alias("schema"),
        F.col("name").alias("table"),
        F.explode(F.from_json("indexes", _MONGO_INDEXES)).alias("item", "definition"),
    ).select(
        *m.K4,
        "item",
        F.coalesce(F.col("definition.unique"), F.lit(False)).alias("declared"),
        F.posexplode_outer("definition.key").alias("i", "pair"),
    )
    primary = F.col("item") == "_id_"
    return m.facts(
        rows,
        m.INDEX,
        item=F.col("item"),
        position=F.col("i") + 1,
        column_name=F.try_element_at("pair", F.lit(1)),
        is_unique=F.col("declared") | primary,
        is_primary=primary,
    )


def partitions_mongo(docs: DataFrame) -> DataFrame:
    """B12. Fields of the shard key (JSON text), typed 'unknown'; none if not sharded."""
    rows = docs.select(
        "config",
        "instance",
        F.col("db").alias("schema"),
        F.col("name").alias("table"),
        F.posexplode(F.map_keys(F.from_json("shard_key", "map<string,string>"))).alias(
            "i", "column_name"
        ),
    )
    return m.facts(
        rows,
        m.PARTITION,
        position=F.col("i") + 1,
        column_name=F.col("column_name"),
        data_type=F.lit("unknown"),
    )


# ---- whole tables ----------------------------------------------------------------------------


def _declares() -> Column:
    """The declared schema is there and is a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("json_schema"))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def mongo_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B8, B11e, B12, B15. Facts of the collections that declare a schema, and error rows of the
    others: a collection that is refused leaves no facts at all."""
    declared = docs.where(_declares())
    parts = (columns_mongo, indexes_mongo, partitions_mongo)
    return m.union(*[part(declared) for part in parts]), undescribed(docs)


def undescribed(docs: DataFrame) -> DataFrame:
    """B15. Collections whose schema is not declared, or cannot be read, as error rows ``K4, error``."""
    return docs.where(~_declares()).select(
        "config",
        "instance",
        F.col("db").alias("schema"),
        F.col("name").alias("table"),
        F.concat(
            F.lit("No readable JSON schema is declared for "), F.col("db"), F.lit("."), F.col("name"),
        ).alias("error"),
    )


def not_found(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """B15. Targets without any fact as error rows, so that they are not stored as empty tables."""
    return targets.select(*m.K4).join(facts.select(*m.K4), m.K4, "left_anti").select(
        *m.K4, F.concat(F.lit("Table "), code("table"), F.lit(" not found.")).alias("error")
    )


def describe_tables(*parts: DataFrame, per_part: int = PART_ITEMS) -> DataFrame:
    """B14. All facts of every table as nested records, see ``nest``; no joins of lists."""
    return nest(m.union(*parts), per_part)


def fact_counts(facts: DataFrame) -> DataFrame:
    """``K4, n``: the number of a table's facts, for ``nest`` where facts stand in a table already."""
    return facts.groupBy(*m.K4).agg(F.count("*").alias("n"))


def nest(
    facts: DataFrame, per_part: int = PART_ITEMS, extra: bool = False, counts: DataFrame | None = None
) -> DataFrame:
    """Facts as nested records ``K4, part, columns, primary_key, sort_key, foreign_keys, indexes,
    partitions``; with ``extra`` their entries also have the free-form fields, as JSON text.

    A record holds ``per_part`` consecutive facts of its table in the order ``FACT_ORDER``, so most
    tables have one, with part 0.  The facts are brought together in that order once, as one list
    per record, and split by section within the row.  A missing list is empty, a missing key null.
    ``counts``, see ``fact_counts``: facts are not written to be counted.
    """
    # Fields that tie are ordered by the rest of the fact.
    rest = [f for f in m.FACT_FIELDS if f not in m.FACT_ORDER]
    order = [*m.FACT_ORDER, *rest]
    placed = with_part(facts.select(*m.FACT_COLUMNS), m.K4, order, per_part, counts)
    # Rows are sorted by their group, which compares four names each time unless a number decides.
    number = F.xxhash64(*m.K4).alias("_number")
    listed = placed.groupBy(number, *m.K4, "part").agg(in_order(*order).alias("facts"))
    of = lambda section: F.filter("facts", lambda f: f["section"] == section)
    grouped = listed.select(
        *m.K4,
        "part",
        of(m.COLUMN).alias("columns"),
        of(m.PRIMARY_KEY).alias("key"),
        of(m.SORT_KEY).alias("sort"),
        of(m.FOREIGN_KEY).alias("references"),
        of(m.INDEX).alias("index_columns"),
        of(m.PARTITION).alias("partition_columns"),
    )
    key_names = F.transform("key", lambda k: k["column_name"])
    more = lambda fact: [fact["extra"].alias("extra")] if extra else []
    return grouped.select(
        *m.K4,
        "part",
        F.transform(
            "columns",
            lambda c: F.struct(
                c["column_name"].alias("name"),
                c["data_type"].alias("data_type"),
                c["is_nullable"].alias("is_nullable"),
                c["default_value"].alias("default_value"),
                c["comment"].alias("comment"),
                c["description"].alias("description"),
                *more(c),
            ),
        ).alias("columns"),
        F.when(
            F.size("key") > 0, F.struct(key_names.alias("column_names"), *more(F.get("key", F.lit(0))))
        ).alias("primary_key"),
        F.try_element_at("sort", F.lit(-1))["column_name"].alias("sort_key"),
        F.transform(
            "references",
            lambda r: F.struct(
                r["column_name"].alias("column_name"),
                r["referenced_table"].alias("referenced_table"),
                r["referenced_column"].alias("referenced_column"),
                F.nullif(r["item"], F.lit("")).alias("constraint_name"),
                *more(r),
            ),
        ).alias("foreign_keys"),
        _by_index(extra).alias("indexes"),
        F.transform(
            "partition_columns",
            lambda c: F.struct(
                c["column_name"].alias("column_name"),
                c["data_type"].alias("data_type"),
                c["comment"].alias("comment"),
                *more(c),
            ),
        ).alias("partitions"),
    )


def _by_index(extra: bool) -> Column:
    """Sorted index columns of one record gathered by index name.

    Columns of an index stand together, so an index is the stretch from where its name begins to
    where the next one does: one pass, however many indexes there are.
    """
    begins = (
        "filter(sequence(0, size(index_columns) - 1), i -> i = 0 OR "
        "NOT index_columns[i].item <=> index_columns[i - 1].item)"
    )
    starts = F.when(F.size("index_columns") > 0, F.expr(begins)).otherwise(
        F.array().cast("array<int>")
    )
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size("index_columns")))

    def one(start: Column, end: Column) -> Column:
        own = F.slice("index_columns", start + 1, end - start)
        return F.struct(
            own[0]["item"].alias("name"),
            F.filter(
                F.transform(own, lambda c: c["column_name"]), lambda c: c.isNotNull()
            ).alias("column_names"),
            own[0]["is_unique"].alias("is_unique"),
            own[0]["is_primary"].alias("is_primary"),
            own[0]["index_type"].alias("type"),
            *([own[0]["extra"].alias("extra")] if extra else []),
        )

    return F.filter(F.zip_with(starts, ends, lambda a, b: F.when(a.isNotNull(), one(a, b))), lambda x: x.isNotNull())
