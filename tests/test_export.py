"""E, A5. Rendered documents."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import column, rows, store
from shelfmark.functions.text import front_matter, front_matter_value, md_escape, quoted, unquoted
from shelfmark.operators import export
from shelfmark.sources.store import publish_files

AT = datetime(2024, 1, 1)


def full(spark):
    return store(
        spark,
        [
            (
                "t",
                {
                    "ai_documentation": ("What it is.\nMore --- \"so\".", {"id": "the | key", "n": ""}, None, "m"),
                    "custom": {"owner": '"me"', "tags": '["x","y"]', "notes": '"n"', "status": '""'},
                    "updated_at": AT,
                },
            ),
            ("bare", {"updated_at": AT}),
            ("index", {"updated_at": AT}),
        ],
        [
            ("t", "column", column("id", 1, is_nullable=False, comment="unused")),
            ("t", "column", column("n", 2, is_nullable=True, comment="a\nb", default_value="7")),
            ("t", "column", column("x", 3)),
            ("t", "primary_key", {"column_name": "n", "position": 2}),
            ("t", "primary_key", {"column_name": "id", "position": 1}),
            ("t", "sort_key", {"column_name": "n", "position": 1}),
            ("t", "foreign_key", {"item": "fk", "column_name": "n", "position": 1, "referenced_table": "r", "referenced_column": "y"}),
            ("t", "index", {"item": "plain", "column_name": "n", "position": 1, "is_unique": False, "is_primary": False}),
            ("t", "index", {"item": "uq", "column_name": "n", "position": 2, "is_unique": True, "is_primary": False}),
            ("t", "index", {"item": "uq", "column_name": "id", "position": 1, "is_unique": True, "is_primary": False}),
            ("t", "index", {"item": "pk", "column_name": "id", "position": 1, "is_unique": True, "is_primary": True}),
            ("t", "partition", {"column_name": "x", "position": 1, "data_type": "date"}),
        ],
    )


BODY = """
{h} Description

What it is.
More --- "so".

{h} {columns}

| Name | Type | Nullable | Description |
| --- | --- | --- | --- |
| id | int | False | the \\| key |
| n | int | True | a b |
| x | int |  |  |

{h} Keys and Relationships

- Primary key: `id`, `n`
- Sort key: `n`
- `n` -> `r.y`

{h} Indexes

{indexes}

{h} Partitions

- `x` (date)
"""
ALL = "- `pk`: unique `id`\n- `plain`: `n`\n- `uq`: unique `id`, `n`"
SOURCE = """# s.{t}

## Source

- Configuration: `c`
- Instance: `i`
- Schema: `s`
- Table: `{t}`
- Metadata updated: `2024-01-01T00:00:00+00:00`
"""


def contents(df):
    return {r.path: r.content for r in df.collect()}


def test_markdown(spark):
    got = contents(export.render_markdown(full(spark)))
    body = BODY.format(h="##", columns="Columns", indexes=ALL)
    assert got["c/i/s/t.md"] == SOURCE.format(t="t") + body
    assert got["c/i/s/bare.md"] == SOURCE.format(t="bare")


def test_essential_markdown(spark):
    own = full(spark)
    got = contents(export.render_markdown(export.essential(own)))
    body = BODY.format(h="##", columns="Columns", indexes="- `uq`: unique `id`, `n`")
    assert got["c/i/s/t.md"] == SOURCE.format(t="t") + body
    tables = export.essential(own).tables
    assert rows(tables.where("table = 't'"), "custom") == [({"owner": '"me"', "tags": '["x","y"]'},)]
    assert tables.where("table = 't'").first().ai_documentation.column_descriptions is None
    assert rows(export.essential(own).facts, "default_value") == [(None,)] * 10


def test_okf_reads_as_yaml(spark):
    yaml = pytest.importorskip("yaml")
    got = contents(export.render_okf(full(spark)))
    _, front, body = got["c/i/s/t.md"].split("---\n", 2)
    assert yaml.safe_load(front) == {
        "type": "Database Table", "title": "s.t", "description": 'What it is.\nMore --- "so".',
        "tags": ["x", "y"],
        "generated": {"by": export.GENERATOR, "at": "2024-01-01T00:00:00+00:00"},
        "config": "c", "instance": "i", "schema": "s", "table": "t", "owner": "me",
    }
    assert body == BODY.format(h="#", columns="Schema", indexes=ALL)
    assert got["c/i/s/bare.md"].endswith('table: "bare"\n---\n\n\n')


def whole(index):
    """The lines of an index joined."""
    return "".join(r.content for r in sorted(index.collect(), key=lambda r: r.part))


def test_index(spark):
    own = full(spark)
    expected = {
        "c/i/s/bare.md": "* [s.bare](c/i/s/bare.md)",
        "c/i/s/t.md": '* [s.t](c/i/s/t.md) - What it is.\nMore --- "so".',
    }
    for entries in (
        export.entries_of_tables(own.tables), export.index_entries(export.render_okf(own))
    ):
        assert {r.path: r.line for r in entries.collect()} == expected
    text = whole(export.render_okf_index(export.entries_of_tables(own.tables)))
    assert text == '---\nokf_version: "0.2"\n---\n\n# Database Catalog\n\n' + "\n".join(
        expected[k] for k in sorted(expected)
    ) + "\n"
    empty = whole(export.render_okf_index(export.entries_of_tables(own.tables.limit(0))))
    assert empty.endswith("# Database Catalog\n\nNo concepts exported.\n")


def test_index_sorts_by_path_elements(spark):
    entries = spark.createDataFrame([("a-b/x.md", "2"), ("a/x.md", "1")], "path string, line string")
    assert whole(export.render_okf_index(entries)).endswith("\n1\n2\n")


@pytest.mark.parametrize(
    "value, cell",
    [(None, ""), ("a|b\nc", "a\\|b c"), ("", ""), ("\\|", "\\\\|"), ("\n\n", "  ")],
)
def test_md_escape(spark, value, cell):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(md_escape("v")).first()[0] == cell


def test_front_matter(spark):
    df = spark.createDataFrame(
        [
            ("---\na: 1\ntitle: \"x --- y\"\n---\nrest\n---\n",), ("---\na: 1",), ("x---\na: 1\n---\n",),
            ("--- \na: 1\n---\n",), ("---\na: 1\n---",), (None,),
        ],
        "t string",
    )
    block = front_matter("t")
    got = df.select(block, front_matter_value(block, "a"), unquoted(front_matter_value(block, "title")))
    assert [tuple(r) for r in got.collect()] == [
        ('a: 1\ntitle: "x --- y"', "1", "x --- y"), (None, None, None), (None, None, None),
        (None, None, None), ("a: 1", "1", None), (None, None, None),
    ]


def test_quoted_text_survives(spark):
    yaml = pytest.importorskip("yaml")
    text = 'a "b" \\ \n\t: # --- é  \u0085 {x}'
    df = spark.createDataFrame([(text,)], "v string").select(quoted("v").alias("q"))
    assert yaml.safe_load(df.first().q) == text
    assert df.select(unquoted("q")).first()[0] == text


def test_formats(spark):
    assert export.export_formats() == ["markdown", "okf"]
    assert export.export_formats(save_markdown=True) == ["markdown"]
    assert export.export_formats(save_markdown=False) == []
    assert export.export_formats([]) == []
    with pytest.raises(ValueError):
        export.export_formats(["pdf"])
    own = full(spark)
    assert export.export(own, []) is None
    got = sorted(set(rows(export.export(own), "format", "path")))
    assert got == [
        ("markdown", "c/i/s/bare.md"), ("markdown", "c/i/s/index.md"), ("markdown", "c/i/s/t.md"),
        ("okf", "c/i/s/bare.md"), ("okf", "c/i/s/index.md"), ("okf", "c/i/s/t.md"), ("okf", "index.md"),
    ]
    raw = export.export(own, ["markdown"], preformat=False).where("path = 'c/i/s/t.md'").first()
    assert "`plain`" in raw.content


def test_published_files_are_whole_and_replaced(spark):
    root = tempfile.mkdtemp(prefix="run-")
    docs = spark.createDataFrame(
        [("okf", "a/x.md", 2, "two"), ("okf", "a/x.md", 0, "one\n"), ("okf", "a/y.md", 0, "é")],
        "format string, path string, part int, content string",
    )
    publish_files(docs, root)
    publish_files(docs.withColumn("content", F.upper("content")), root)
    read = lambda p: open(f"{root}/okf/catalog/{p}", encoding="utf-8").read()
    assert read("a/x.md") == "ONE\nTWO" and read("a/y.md") == "É"
    assert os.stat(f"{root}/okf/catalog/a/x.md").st_mode & 0o777 == 0o644
    assert sorted(os.listdir(f"{root}/okf/catalog/a")) == ["x.md", "y.md"]
