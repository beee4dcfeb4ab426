"""From a real database's catalogue to documents: extract, describe, merge, annotate, export."""

import sqlite3

from pyspark.sql import functions as F

from helpers import extract, rows
from shelfmark import model as m
from shelfmark.operators import describe, export, store
from shelfmark.operators.store import Store
from shelfmark.shared import new_folder, written
from shelfmark.sources.store import read_store, write_store

TABLES = """
CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE);
CREATE TABLE products (product_id INTEGER PRIMARY KEY, product_name TEXT NOT NULL, price REAL);
CREATE TABLE sales (user_id INTEGER REFERENCES users(id), product_id INTEGER, at TEXT DEFAULT 'now',
  PRIMARY KEY (product_id, user_id), FOREIGN KEY (product_id) REFERENCES products(product_id));
"""


def scan(spark, database):
    """Facts of a SQLite database from its PRAGMA rows."""
    run = lambda sql: database.execute(sql).fetchall()
    names = [r[0] for r in run("SELECT name FROM sqlite_master WHERE type = 'table'")]
    columns, references, index_columns = [], [], []
    for name in names:
        columns += [("main", name, *r) for r in run(f"PRAGMA table_info('{name}')")]
        references += [
            ("main", name, r[0], r[1], r[2], r[3], r[4])
            for r in run(f"PRAGMA foreign_key_list('{name}')")
        ]
        for _, index, unique, origin, _ in run(f"PRAGMA index_list('{name}')"):
            index_columns += [
                ("main", name, index, column, seq + 1, not unique, origin == "pk", None)
                for seq, _, column in run(f"PRAGMA index_info('{index}')")
            ]
    raw = extract(spark, "columns_sqlite", *columns)
    return m.union(
        describe.columns_sqlite(raw),
        describe.primary_keys_sqlite(raw),
        describe.foreign_keys_sqlite(extract(spark, "foreign_keys_sqlite", *references)),
        describe.indexes(extract(spark, "index_columns", *index_columns)),
    )


def headers(facts):
    return m.tables(facts.select(*m.K4).distinct())


def test_sqlite_to_documents(spark):
    database = sqlite3.connect(":memory:")
    database.executescript(TABLES)
    first = scan(spark, database)
    nested = {r.table: r for r in describe.nest(first).collect()}
    assert [(c.name, c.is_nullable) for c in nested["users"].columns] == [
        ("id", False), ("name", False), ("email", True),
    ]
    assert nested["sales"].primary_key.column_names == ["product_id", "user_id"]
    assert {(k.column_name, k.referenced_table, k.referenced_column) for k in nested["sales"].foreign_keys} == {
        ("user_id", "users", "id"), ("product_id", "products", "product_id"),
    }
    assert [(i.column_names, i.is_unique, i.is_primary) for i in nested["users"].indexes] == [
        (["email"], True, False)
    ]

    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    empty = Store(headers(first).limit(0), first.limit(0))
    merged = store.merge_metadata(empty, Store(headers(first), first), at(1))
    patches = spark.createDataFrame(
        [("i", "main", "users", 1, {"owner": '"crm"'})],
        "instance string, schema string, table string, seq int, payload map<string,string>",
    )
    path = new_folder(spark, "end-to-end")
    write_store(Store(merged.tables, merged.facts), path)
    stored = read_store(spark, path)
    write_store(Store(store.annotate(stored.tables, patches, at(2)), stored.facts), path)
    own = read_store(spark, path)

    database.execute("ALTER TABLE products ADD COLUMN note TEXT")
    second = scan(spark, database)
    again = store.merge_metadata(own, Store(headers(second), second), at(3), only_if_changed=True)
    assert rows(again.tables, "table", "action") == [
        ("products", "update"), ("sales", "unchanged"), ("users", "unchanged"),
    ]
    scanned = Store(*[written(frame, "scanned") for frame in again.scanned])
    documents = {}
    for r in sorted(export.export(scanned).collect(), key=lambda r: r.part):
        documents[r.format, r.path] = documents.get((r.format, r.path), "") + r.content
    assert len(documents) == 7
    users = documents[("okf", "c/i/main/users.md")]
    assert 'owner: "crm"' in users and "| email | TEXT | True |  |" in users
    assert "2024-01-02" in users
    assert "| note | TEXT | True |  |" in documents[("markdown", "c/i/main/products.md")]
    assert "- `user_id` -> `users.id`" in documents[("markdown", "c/i/main/sales.md")]
    assert "[main.sales](c/i/main/sales.md)" in documents[("okf", "index.md")]
