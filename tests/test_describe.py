"""B. Extracts with a null, an empty list, a duplicate and a tie each."""

from pyspark.sql import functions as F

from helpers import column, extract, facts, rows
from shelfmark.functions.types import BSON_TYPES, normalise_type
from shelfmark.operators import describe


def test_columns_mysql(spark):
    raw = extract(
        spark, "columns_mysql",
        ("s", "t", 1, "id", "int", "NO", None), ("s", "t", 2, "name", "text", "YES", "x"),
        ("s", "t", 3, "odd", "text", None, None),
    )
    got = rows(
        describe.columns_mysql(raw),
        "column_name", "data_type", "is_nullable", "default_value", "comment",
    )
    assert got == [
        ("id", "int", False, None, None), ("name", "text", True, "x", None),
        ("odd", "text", False, None, None),
    ]


def test_columns_postgres_comment_belongs_to_table_and_ordinal(spark):
    cols = extract(
        spark, "columns_postgres",
        ("s", "t", "a", 1, "int", "NO", "0"), ("s", "t", "b", 2, "int", "YES", None),
        ("s", "u", "a", 1, "int", None, None),
    )
    stats = extract(spark, "stat_tables", ("s", "t", 10), ("s", "u", 11))
    descr = extract(
        spark, "descriptions", (10, 2, "second"), (10, 0, "the table"), (12, 1, "elsewhere")
    )
    got = rows(
        describe.columns_postgres(cols, stats, descr),
        "table", "column_name", "is_nullable", "default_value", "comment",
    )
    assert got == [
        ("t", "a", False, "0", None), ("t", "b", True, None, "second"), ("u", "a", False, None, None),
    ]


def test_columns_sqlite_and_duckdb_differ_on_keys(spark):
    given = [
        ("main", "users", 0, "id", "INTEGER", 0, None, 1),
        ("main", "users", 1, "name", "TEXT", 1, None, 0),
        ("main", "users", 2, "email", "TEXT", 0, None, 0),
    ]
    raw = extract(spark, "columns_sqlite", *given)
    nullable = lambda df: [r[1] for r in rows(df, "position", "is_nullable")]
    assert nullable(describe.columns_sqlite(raw)) == [False, False, True]
    assert nullable(describe.columns_duckdb(raw)) == [True, False, True]
    assert rows(describe.primary_keys_sqlite(raw), "column_name", "position") == [("id", 1)]


def test_columns_trino_split_partition_keys(spark):
    raw = extract(
        spark, "columns_trino",
        ("s", "t", "a", 1, "int", "no", None, "", None),
        ("s", "t", "b", 2, "int", None, "1", "note", "other"),
        ("s", "t", "d", 3, "date", "YES", None, "day", "Partition KEY"),
    )
    got = rows(
        describe.columns_trino(raw),
        "section", "column_name", "is_nullable", "default_value", "comment",
    )
    assert got == [
        ("column", "a", False, None, None), ("column", "b", True, "1", "note"),
        ("partition", "d", None, None, "day"),
    ]


def test_columns_glue(spark):
    docs = extract(
        spark, "glue",
        ("s", "t", ([("a", "int", ""), ("b", "string", "note")],), [("d", "date", None)]),
        ("s", "empty", ([],), None),
        ("s", "missing", None, None),
    )
    got = rows(
        describe.columns_glue(docs), "table", "section", "position", "column_name", "is_nullable",
        "comment",
    )
    assert got == [
        ("t", "column", 1, "a", True, None), ("t", "column", 2, "b", True, "note"),
        ("t", "partition", 1, "d", None, None),
    ]


DYNAMO = [
    (
        "default", "orders",
        [("id", "S"), ("at", "N"), ("id", "B"), ("blob", "Z")],
        [("x", "HASH"), ("id", "HASH"), ("at", "RANGE")],
        [("g", [("at", "HASH"), ("id", "RANGE")])],
        [("l", [("id", "HASH")])],
    ),
    ("default", "lost", [], [("gone", "HASH")], None, []),
    ("default", "bare", None, None, None, None),
]


def test_columns_dynamo_last_definition_wins(spark):
    docs = extract(spark, "dynamo", *DYNAMO)
    got = rows(
        describe.columns_dynamo(docs), "table", "section", "position", "column_name", "data_type"
    )
    assert got == [
        ("lost", "partition", 1, "gone", "Unknown"), ("lost", "primary_key", 1, "gone", None),
        ("orders", "column", 1, "id", "Binary"), ("orders", "column", 2, "at", "Number"),
        ("orders", "column", 3, "blob", "Z"), ("orders", "partition", 1, "id", "Binary"),
        ("orders", "primary_key", 1, "id", None), ("orders", "sort_key", 1, "at", None),
    ]


def test_indexes_dynamo(spark):
    got = rows(
        describe.indexes_dynamo(extract(spark, "dynamo", *DYNAMO)),
        "item", "position", "column_name", "is_unique", "index_type",
    )
    assert got == [
        ("g", 1, "at", False, "GSI"), ("g", 2, "id", False, "GSI"), ("l", 1, "id", False, "LSI"),
    ]


MONGO = [
    (
        "db", "people",
        '{"required":["name"],"properties":{"name":{"bsonType":"string","description":"who"},'
        '"age":{"bsonType":["null","int"],"title":"years"},"tag":{"type":"tag"},"x":{},'
        '"only":{"bsonType":["null"]},"e":{"bsonType":"","type":"bool","description":""}}}',
        '{"_id_":{"key":[["_id",1]]},"u":{"key":[["name",1],["age",-1]],"unique":true},"p":{"key":[]}}',
        '{"name":1,"age":"hashed"}',
    ),
    ("db", "free", None, None, None),
    ("db", "none", "{}", "{}", None),
]


def test_columns_mongo(spark):
    got = rows(
        describe.columns_mongo(extract(spark, "mongo", *MONGO)),
        "position", "column_name", "data_type", "is_nullable", "comment",
    )
    assert got == [
        (1, "name", "string", False, "who"), (2, "age", "int32", True, "years"),
        (3, "tag", "tag", True, None), (4, "x", "unknown", True, None),
        (5, "only", "null", True, None), (6, "e", "boolean", True, None),
    ]


def test_indexes_and_partitions_mongo(spark):
    docs = extract(spark, "mongo", *MONGO)
    got = rows(
        describe.indexes_mongo(docs), "item", "position", "column_name", "is_unique", "is_primary"
    )
    assert got == [
        ("_id_", 1, "_id", True, True), ("p", None, None, False, False),
        ("u", 1, "name", True, False), ("u", 2, "age", True, False),
    ]
    got = rows(describe.partitions_mongo(docs), "position", "column_name", "data_type")
    assert got == [(1, "name", "unknown"), (2, "age", "unknown")]


def test_undescribed_collection_is_an_error_row(spark):
    got = rows(describe.undescribed(extract(spark, "mongo", *MONGO)), "table", "error")
    assert got == [("free", "No readable JSON schema is declared for db.free")]


def test_primary_keys_join_on_name_schema_and_table(spark):
    constraints = extract(
        spark, "constraints",
        ("s", "t", "pk", "PRIMARY KEY"), ("s2", "t", "pk", "UNIQUE"), ("s", "t", "fk", "FOREIGN KEY"),
    )
    usage = extract(
        spark, "key_usage",
        ("s", "t", "pk", "b", 2, None, None), ("s", "t", "pk", "a", 1, None, None),
        ("s2", "t", "pk", "z", 1, None, None), ("s", "u", "pk", "y", 1, None, None),
    )
    got = rows(describe.primary_keys(constraints, usage), "schema", "position", "column_name")
    assert got == [("s", 1, "a"), ("s", 2, "b")]


def test_primary_keys_mysql_and_duckdb(spark):
    usage = extract(
        spark, "key_usage",
        ("s", "t", "PRIMARY", "a", 1, None, None), ("s", "t", "other", "b", 1, "r", "id"),
    )
    assert rows(describe.primary_keys_mysql(usage), "column_name") == [("a",)]
    assert rows(describe.foreign_keys_mysql(usage), "item", "column_name", "referenced_table") == [
        ("other", "b", "r")
    ]
    raw = extract(
        spark, "constraints_duckdb",
        ("s", "t", "PRIMARY KEY", ["b", "a"]), ("s", "t", "CHECK", ["z"]), ("s", "u", "PRIMARY KEY", []),
    )
    assert rows(describe.primary_keys_duckdb(raw), "position", "column_name") == [(1, "b"), (2, "a")]


def test_foreign_keys_pair_by_ordinal(spark):
    """A two-column key gives two pairs, and a key of the same name elsewhere does not mix in."""
    constraints = extract(
        spark, "constraints", ("s", "t", "fk", "FOREIGN KEY"), ("s2", "t", "fk", "FOREIGN KEY")
    )
    usage = extract(
        spark, "key_usage",
        ("s", "t", "fk", "a", 1, None, None), ("s", "t", "fk", "b", 2, None, None),
        ("s2", "t", "fk", "a", 1, None, None),
    )
    referenced = extract(
        spark, "referenced",
        ("s", "fk", "s", "r", "x", 1), ("s", "fk", "s", "r", "y", 2), ("s2", "fk", "s2", "q", "z", 1),
    )
    got = rows(
        describe.foreign_keys(constraints, usage, referenced),
        "schema", "column_name", "referenced_table", "referenced_column",
    )
    assert got == [("s", "a", "r", "x"), ("s", "b", "r", "y"), ("s2", "a", "q", "z")]


def test_foreign_keys_sqlite_have_no_name(spark):
    raw = extract(
        spark, "foreign_keys_sqlite",
        ("main", "t", 1, 0, "r", "a", "x"), ("main", "t", 0, 1, "q", "c", None),
        ("main", "t", 0, 0, "q", "b", "y"),
    )
    nested = describe.nest(describe.foreign_keys_sqlite(raw)).first()
    assert [tuple(k) for k in nested.foreign_keys] == [
        ("b", "q", "y", None), ("c", "q", None, None), ("a", "r", "x", None),
    ]


def test_indexes_flags(spark):
    raw = extract(
        spark, "index_columns",
        ("s", "t", "PRIMARY", "id", 1, False, None, None),
        ("s", "t", "ix", "b", 2, True, None, "BTREE"), ("s", "t", "ix", "a", 1, True, None, "BTREE"),
        ("s", "t", "flagged", "a", 1, False, True, None),
    )
    nested = describe.nest(describe.indexes(raw)).first()
    assert [tuple(i) for i in nested.indexes] == [
        ("PRIMARY", ["id"], True, True, None), ("flagged", ["a"], True, True, None),
        ("ix", ["a", "b"], False, False, "BTREE"),
    ]


def test_index_columns_from_ddl(spark):
    raw = extract(
        spark, "index_ddl",
        ("s", "t", "many", True, None, "CREATE INDEX many ON t( a ,b,\n c )"),
        ("s", "t", "expression", None, False, "CREATE INDEX e ON t(lower(a), b)"),
        ("s", "t", "none", False, False, None), ("s", "t", "odd", False, False, "no columns ()"),
    )
    nested = describe.nest(describe.indexes_from_ddl(raw)).first()
    assert [(i.name, i.column_names, i.is_unique) for i in nested.indexes] == [
        ("expression", ["lower(a"], False), ("many", ["a", "b", "c"], True),
        ("none", [], False), ("odd", [], False),
    ]


def test_postgres_positions_drop_expressions(spark):
    attributes = extract(
        spark, "attributes_postgres",
        (1, 1, "a", "int", None), (1, 2, "b", "text", "note"), (2, 1, "other", "int", None),
    )
    keys = extract(
        spark, "index_keys_postgres",
        ("s", "t", 1, "ix", True, False, "btree", [2, 0, 1]), ("s", "t", 1, "e", False, False, "gin", [0]),
    )
    got = rows(describe.indexes_postgres(keys, attributes), "item", "position", "column_name")
    assert got == [("ix", 1, "b"), ("ix", 3, "a")]
    parted = extract(spark, "partitioned_postgres", ("s", "t", 1, [2]), ("s", "u", 2, []))
    got = rows(describe.partitions_postgres(parted, attributes), "table", "column_name", "comment")
    assert got == [("t", "b", "note")]


def test_normalise_types_pass_unknown_codes(spark):
    df = spark.createDataFrame([("int",), ("geo",), (None,)], "code string")
    got = [r[0] for r in df.select(normalise_type("code", BSON_TYPES)).collect()]
    assert got == ["int32", "geo", None]


def test_describe_tables_fills_missing_parts(spark):
    only_columns = facts(spark, ("a", "column", column("y", 2)), ("a", "column", column("x", 1)))
    only_key = facts(spark, ("b", "primary_key", {"column_name": "k", "position": 1}))
    got = {r.table: r for r in describe.describe_tables(only_columns, only_key).collect()}
    assert [c.name for c in got["a"].columns] == ["x", "y"]
    assert got["a"].primary_key is None and got["a"].sort_key is None
    assert got["a"].foreign_keys == [] and got["a"].indexes == [] and got["a"].partitions == []
    assert got["b"].columns == [] and got["b"].primary_key.column_names == ["k"]


def test_not_found_targets(spark):
    known = facts(spark, ("a", "column", column("x")))
    targets = known.select("config", "instance", "schema", "table").union(
        known.select("config", "instance", "schema", F.lit("gone"))
    )
    assert rows(describe.not_found(targets, known), "table", "error") == [
        ("gone", "Table `gone` not found.")
    ]
