"""D, A3, A4. The metadata store."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import column, facts, rows, store, tables
from shelfmark.functions.text import document_path, iso, metadata_key, sanitize
from shelfmark.operators import export
from shelfmark.operators import store as ops
from shelfmark.operators.store import Store
from shelfmark.shared import new_folder
from shelfmark.sources import documents
from shelfmark.sources.store import Conflict, read_store, update_store, version, write_store

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 2, 2, 3, 4, 5, 600)


def now():
    return F.lit(NEW)


def ai(summary):
    return (summary, {"id": "key"}, None, "m")


def existing(spark):
    return store(
        spark,
        [
            ("same", {"ai_documentation": ai("old same"), "custom": {"owner": '"x"'}, "updated_at": OLD}),
            ("changed", {"ai_documentation": ai("old changed"), "custom": {"tags": "[1]"}, "updated_at": OLD}),
            ("absent", {"updated_at": OLD}),
        ],
        [
            ("same", "column", column("id")), ("same", "column", column("b", 2)),
            ("changed", "column", column("id")), ("absent", "column", column("z")),
        ],
    )


def incoming(spark):
    return store(
        spark,
        [("same", {"ai_documentation": ai("new same")}), ("changed", {}), ("fresh", {"ai_documentation": ai("f")})],
        [
            ("same", "column", column("b", 2)), ("same", "column", column("id")),
            ("changed", "column", column("id", data_type="bigint")), ("fresh", "column", column("q")),
        ],
    )


def summary_rows(df):
    return rows(df, "table", "action", "ai_documentation.summary", "custom", "updated_at")


def test_merge_replaces_keeps_and_stamps(spark):
    merged = ops.merge_metadata(existing(spark), incoming(spark), now())
    assert summary_rows(merged.tables) == [
        ("absent", "kept", None, None, OLD), ("changed", "update", "old changed", {"tags": "[1]"}, NEW),
        ("fresh", "insert", "f", {}, NEW), ("same", "update", "new same", {"owner": '"x"'}, NEW),
    ]
    assert rows(merged.facts, "table", "column_name", "data_type") == [
        ("absent", "z", "int"), ("changed", "id", "bigint"), ("fresh", "q", "int"),
        ("same", "b", "int"), ("same", "id", "int"),
    ]
    assert {r[0] for r in rows(merged.scanned.facts, "table")} == {"changed", "fresh", "same"}


def test_unchanged_tables_stay_as_they_are(spark):
    merged = ops.merge_metadata(existing(spark), incoming(spark), now(), only_if_changed=True)
    got = {r[0]: r for r in summary_rows(merged.tables)}
    # Even new documentation of an unchanged table is not taken over.
    assert got["same"] == ("same", "unchanged", "old same", {"owner": '"x"'}, OLD)
    assert got["changed"][1] == "update" and got["fresh"][1] == "insert"


def test_merge_without_saving(spark):
    merged = ops.merge_metadata(existing(spark), incoming(spark), now(), True, save=False)
    assert {r[1] for r in rows(merged.tables, "table", "action")} == {"kept"}
    assert rows(merged.facts) == rows(existing(spark).facts)
    assert {r[0] for r in rows(merged.scanned.tables, "table")} == {"same", "changed", "fresh"}
    assert ("changed", "bigint") in rows(merged.scanned.facts, "table", "data_type")
    assert ("same", "int") in rows(merged.scanned.facts, "table", "data_type")


@pytest.mark.parametrize(
    "old, new, changed",
    [
        ([column("a")], [column("a")], False),
        ([column("a")], [column("a", comment="c")], True),
        ([column("a", default_value=None)], [column("a", default_value="")], True),
        ([column("a"), column("b", 2)], [column("b"), column("a", 2)], True),
        ([column("a")], [column("a"), column("a")], True),
        ([column("a"), column("b", 2)], [column("b", 2), column("a")], False),
        ([column("a", default_value="x")], [column("a", comment="x")], True),
        ([column("a")] * 2, [column("b")] * 2, True),
    ],
)
def test_change_detection(spark, old, new, changed):
    frame = lambda given: facts(spark, *[("t", "column", f) for f in given])
    for exact in (True, False):
        assert ops.changed_tables(frame(old), frame(new), exact).count() == int(changed)


def test_system_fields_are_not_custom(spark):
    old = store(spark, [("t", {"custom": {"table_name": '"x"', "owner": '"y"'}, "updated_at": OLD})], [])
    new = store(spark, [("t", {})], [])
    assert ops.merge_metadata(old, new, now()).tables.first().custom == {"owner": '"y"'}


PATCH = "instance string, schema string, table string, seq int, payload map<string,string>"


def test_annotate(spark):
    header = tables(
        spark,
        ("a", {"custom": {"owner": '"x"', "keep": "1"}, "updated_at": OLD}),
        ("b", {"updated_at": OLD}), ("c", {"custom": {}, "updated_at": OLD}), ("d", {"updated_at": OLD}),
    )
    patches = spark.createDataFrame(
        [
            ("i", "s", "a", 1, {"owner": '"y"', "notes": '"n"'}), ("i", "s", "a", 2, {"owner": '"z"'}),
            ("i", "s", "b", 1, {k: '"hack"' for k in ("metadata_key", "config_name", "instance_name",
                                                     "schema_name", "table_name", "updated_at")}),
            ("i", "s", "c", 1, {"ai_documentation": '{"summary":"s","model":"m"}'}),
            ("i", "s", "d", 1, {}), ("i", "s", "gone", 1, {"owner": '"q"'}),
        ],
        PATCH,
    )
    got = rows(
        ops.annotate(header, patches, now()), "table", "custom", "ai_documentation.summary", "updated_at"
    )
    assert got == [
        ("a", {"keep": "1", "owner": '"z"', "notes": '"n"'}, None, NEW), ("b", {}, None, NEW),
        ("c", {}, "s", NEW), ("d", None, None, OLD),
    ]
    assert rows(ops.rejected_patches(patches), "table") == [("d",)]


def test_patch_goes_to_smallest_config(spark):
    one = tables(spark, ("t", {"updated_at": OLD}))
    two = one.unionByName(one.withColumn("config", F.lit("b")))
    patches = spark.createDataFrame([("i", "s", "t", 1, {"owner": "1"})], PATCH)
    got = rows(ops.annotate(two, patches, now()), "config", "updated_at")
    assert got == [("b", NEW), ("c", OLD)]
    assert rows(ops.find_tables(two), "config") == [("b",)]
    assert rows(ops.find_table(two, "i", "s", "t"), "config") == [("b",)]
    assert rows(ops.get_table(two, "c", "i", "s", "t"), "config") == [("c",)]


def test_stale_patches_are_reported_not_merged(spark):
    header = tables(spark, ("a", {"updated_at": NEW}), ("b", {"updated_at": OLD}))
    patches = spark.createDataFrame(
        [("i", "s", "a", 1, {"owner": "1"}, OLD), ("i", "s", "b", 1, {"owner": "1"}, OLD)],
        PATCH + ", based_on timestamp",
    )
    got = rows(ops.annotate(header, patches, now()), "table", "custom")
    assert got == [("a", None), ("b", {"owner": "1"})]
    assert rows(ops.stale_patches(header, patches), "table") == [("a",)]


def test_patched_schema_replaces_facts(spark):
    own = existing(spark)
    text = '{"columns":[{"name":"n","data_type":"text","is_nullable":true}],"indexes":[{"name":"ix","column_names":["n"],"is_unique":true}]}'
    patches = spark.createDataFrame([("i", "s", "same", 1, {"schema_description": text})], PATCH)
    got = rows(ops.annotated_facts(own, patches), "table", "section", "column_name")
    assert got == [
        ("absent", "column", "z"), ("changed", "column", "id"), ("same", "column", "n"),
        ("same", "index", "n"),
    ]


@pytest.mark.parametrize(
    "name, safe",
    [
        ("cfg:1", "cfg_1"), ("host:3306", "host_3306"), ("db/schema", "db_schema"), ("tab*le", "tab_le"),
        ("né.Ω-9_", "né.Ω-9_"), ("a b\n", "a_b_"), ("٣½", "٣½"), ("", ""),
    ],
)
def test_sanitize(spark, name, safe):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(sanitize("n")).first()[0] == safe


def test_keys_paths_and_collisions(spark):
    df = spark.createDataFrame(
        [("c", "i", "a/b", "t"), ("c", "i", "a_b", "t"), ("c", "i", "a_b", "t"), ("c", "i", "x", "t")],
        "config string, instance string, schema string, table string",
    )
    assert df.select(metadata_key()).first()[0] == "c::i::a/b::t"
    assert df.select(document_path()).first()[0] == "c/i/a_b/t.md"
    assert rows(ops.sanitize_collisions(df)) == [("c/i/a_b/t.md", 2)]


def test_pages(spark):
    names = spark.createDataFrame([(f"host_{i}",) for i in range(5)] * 2, "name string").distinct()
    get = lambda *a: tuple(ops.page(names, *a).first())
    assert get(1, 3) == (["host_0", "host_1", "host_2"], 5, 1, 3, 2)
    assert get(2, 3) == (["host_3", "host_4"], 5, 2, 3, 2)
    assert get(3, 3) == ([], 5, 3, 3, 2)
    assert tuple(ops.page(names.limit(0)).first()) == ([], 0, 1, 20, 0)
    for bad in ((0, 3), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            ops.page(names, *bad)


def test_late_pages(spark):
    names = spark.range(1000).select(F.format_string("n%04d", F.col("id") * 7919 % 1000).alias("name")).repartition(9)
    got = ops.page(names, 13, 80).first()
    assert got["items"] == [f"n{i:04d}" for i in range(960, 1000)] and (got["total"], got["pages"]) == (1000, 13)
    assert ops.page(names, 99, 80).first()["items"] == []
    plan = ops.page(names, 13, 80)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_gaps_between_positions_are_no_change(spark):
    """Columns at 1 and 3, as a dropped column leaves them, equal those read back at 1 and 2."""
    one = lambda *places: facts(spark, *[("t", "column", column(c, p)) for c, p in zip("ab", places)])
    for exact in (True, False):
        assert rows(ops.changed_tables(one(1, 3), one(1, 2), exact)) == []
        assert len(rows(ops.changed_tables(one(3, 1), one(1, 2), exact))) == 1


def test_documents_of_all_kinds(spark):
    """A table without facts has a document, the newest document of a table counts, a column keeps
    its own description, an index without a name is listed."""
    from shelfmark.operators.describe import nest

    own = store(
        spark,
        [("bare", {"updated_at": OLD}), ("t", {"updated_at": OLD})],
        [("t", "column", column("a", description="by hand", comment="c"))],
    )
    texts = documents.to_documents(own.tables, nest(own.facts)).select("document")
    assert rows(documents.tables_of_documents(texts), "table") == [("bare",), ("t",)]
    assert rows(documents.facts_of_documents(texts)) == rows(own.facts)
    assert " | by hand |" in export.render_markdown(own).where("path like '%t.md'").first().content
    newer = texts.where("document like '%by hand%'").select(
        F.regexp_replace(F.regexp_replace("document", "by hand", "newer"), "2024-01-01T", "2024-05-01T").alias("document")
    )
    (fact,) = documents.facts_of_documents(texts.union(newer).repartition(3)).collect()
    assert fact.description == "newer"
    unnamed = '{"columns":[],"indexes":[{"column_names":["a","b"],"is_unique":true}]}'
    described = own.tables.where("`table` = 't'").select("config", "instance", "schema", "table", F.lit(unnamed).alias("description"))
    listed = Store(own.tables, documents.facts_of_descriptions(described))
    assert "- `None`: unique `a`, `b`" in export.render_markdown(listed).where("path like '%t.md'").first().content


def test_search_ignores_case_and_nulls(spark):
    df = spark.createDataFrame([("Orders", None), ("x", "ORDER desk"), (None, None)], "a string, b string")
    assert len(rows(ops.search(df, ["a", "b"], "order"))) == 2
    assert len(rows(ops.search(df, ["a"], "order"))) == 1


def test_iso(spark):
    df = spark.createDataFrame([(OLD,), (NEW,)], "t timestamp")
    assert [r[0] for r in df.select(iso("t")).collect()] == [
        "2024-01-01T00:00:00+00:00", "2024-02-02T03:04:05.000600+00:00",
    ]


def test_store_versions(spark):
    path = new_folder(spark, "test-store")
    own = existing(spark)
    assert version(spark, path) == 0 and rows(read_store(spark, path).tables) == []
    assert write_store(own, path) == 1
    merged = ops.merge_metadata(read_store(spark, path), incoming(spark), now())
    assert write_store(Store(merged.tables, merged.facts), path, base=1) == 2
    got = read_store(spark, path)
    assert {r[0] for r in rows(got.tables, "table")} == {"same", "changed", "absent", "fresh"}
    assert rows(got.facts) == rows(merged.facts)
    assert rows(ops.get_table(got.tables, "c", "i", "s", "fresh"), "updated_at") == [(NEW,)]
    assert rows(read_store(spark, path, number=1).facts) == rows(own.facts)


def test_only_one_of_two_writers_commits(spark):
    path = new_folder(spark, "test-store")
    own = existing(spark)
    write_store(own, path)
    merged = ops.merge_metadata(read_store(spark, path), incoming(spark), now())
    write_store(own, path, base=1)
    with pytest.raises(Conflict):
        update_store(merged, path, base=1)
    assert version(spark, path) == 2 and rows(read_store(spark, path).facts) == rows(own.facts)


def test_a_lost_writer_leaves_the_store_as_it_was(spark):
    path = new_folder(spark, "test-store")
    own = existing(spark)
    write_store(own, path)
    # Folders without a commit, as a writer leaves that is lost before it commits.
    own.facts.limit(1).write.partitionBy("config", "instance", "schema").parquet(f"{path}/facts/version=lost")
    assert rows(read_store(spark, path).facts) == rows(own.facts)
    assert write_store(own, path) == 2


def test_update_writes_only_changed_schemas(spark):
    path = new_folder(spark, "test-store")
    own = existing(spark)
    elsewhere = lambda df: df.unionByName(df.withColumn("schema", F.lit("s2")))
    write_store(Store(elsewhere(own.tables), elsewhere(own.facts)), path)
    files = lambda df: {f for f in df.inputFiles() if "/facts/" in f}
    before = read_store(spark, path)
    scoped = read_store(spark, path, "c", "i", "s")
    assert {r[0] for r in rows(scoped.facts, "schema")} == {"s"}
    merged = ops.merge_metadata(scoped, incoming(spark), now(), only_if_changed=True)
    expected = rows(merged.facts)
    update_store(merged, path)
    after = read_store(spark, path)
    assert rows(after.facts.where("schema = 's'")) == expected
    assert rows(after.tables.where("schema = 's'"), "table") == [(t,) for t in ("absent", "changed", "fresh", "same")]
    assert rows(after.facts.where("schema = 's2'")) == rows(before.facts.where("schema = 's2'"))
    new = files(after.facts) - files(before.facts)
    assert new and all("/schema=s/" in f for f in new)
    # What was read before the update is still there, and so is the merge.
    assert len(rows(before.facts)) == 2 * len(rows(own.facts))
    assert export.render_markdown(merged.scanned).count() > 0


def test_a_schema_that_loses_all_facts(spark):
    path = new_folder(spark, "test-store")
    own = existing(spark)
    write_store(own, path)
    stored = read_store(spark, path)
    nothing = Store(own.tables, own.facts.limit(0))
    update_store(ops.merge_metadata(stored, nothing, now()), path)
    after = read_store(spark, path)
    assert rows(after.facts) == [] and rows(after.tables, "table") == rows(own.tables, "table")


def test_documents_round_trip(spark):
    from shelfmark.operators.describe import nest

    own = store(
        spark,
        [("t", {"ai_documentation": ai('say "hi"'), "custom": {"owner": '"me"', 'odd"key': "[1,{}]"}, "updated_at": NEW})],
        [
            ("t", "column", column("a", is_nullable=True, default_value="1")),
            ("t", "column", column("b", 2, comment="c")),
            ("t", "primary_key", {"column_name": "a", "position": 1}),
            ("t", "sort_key", {"column_name": "b", "position": 1}),
            ("t", "foreign_key", {"item": "fk", "column_name": "b", "position": 1, "referenced_table": "r", "referenced_column": "x"}),
            ("t", "index", {"item": "ix", "column_name": "a", "position": 1, "is_unique": True, "is_primary": False, "index_type": "btree"}),
            ("t", "partition", {"column_name": "b", "position": 1, "data_type": "int"}),
        ],
    )
    texts = documents.to_documents(own.tables, nest(own.facts)).select("document")
    noise = spark.createDataFrame([("{broken",), ("[1]",), ("",), (None,)], "document string")
    assert rows(documents.facts_of_documents(texts.union(noise))) == rows(own.facts)
    back = documents.tables_of_documents(texts.union(noise)).collect()
    assert len(back) == 1
    assert back[0].custom == {"owner": '"me"', 'odd"key': "[1,{}]"}
    assert back[0].ai_documentation.summary == 'say "hi"' and back[0].updated_at == NEW
    path = new_folder(spark, "json")
    texts.write.text(path + "/c/i")
    import glob
    import os
    for i, name in enumerate(glob.glob(path + "/c/i/*.txt")):
        os.link(name, f"{path}/c/i/{i}.json")
    assert documents.read_documents(spark, path).where(F.length("document") > 1).count() == 1


def test_positions_are_compared_as_an_order(spark):
    """Gaps, swaps, repeated facts, other numbers of a fact, and items that have places of their own."""
    index = lambda name, *columns: [("t", "index", {"item": name, "column_name": c, "position": p}) for c, p in columns]
    cols = lambda *given: [("t", "column", column(c, p)) for c, p in given]
    cases = [
        (cols(("a", 1), ("b", 2)), cols(("a", 10), ("b", 70)), False),
        (cols(("a", 1), ("b", 2)), cols(("b", 1), ("a", 2)), True),
        (cols(("a", 1), ("a", 2), ("b", 3)), cols(("a", 1), ("b", 2), ("a", 3)), True),
        (cols(("a", 1), ("a", 2), ("b", 3)), cols(("a", 4), ("a", 5), ("b", 9)), False),
        (cols(("a", 1), ("a", 2)), cols(("a", 1)), True),
        (cols(("a", 1), ("a", 1)), cols(("a", 1), ("a", 2)), False),
        (cols(("a", None), ("b", 2)), cols(("a", None), ("b", 5)), False),
        (index("x", ("a", 1), ("b", 2)) + index("y", ("a", 1)), index("x", ("a", 3), ("b", 4)) + index("y", ("a", 9)), False),
        (index("x", ("a", 1), ("b", 2)) + index("y", ("a", 1)), index("x", ("a", 2), ("b", 1)) + index("y", ("a", 1)), True),
        (index("x", ("a", 1)) + index("y", ("b", 2)), index("x", ("b", 1)) + index("y", ("a", 2)), True),
        (cols(("a", 1)), [], True),
    ]
    named = lambda k, given: [(f"t{k}", *f[1:]) for f in given]
    old = facts(spark, *[f for k, (a, _, _) in enumerate(cases) for f in named(k, a)])
    new = facts(spark, *[f for k, (_, b, _) in enumerate(cases) for f in named(k, b)])
    want = [(f"t{k}",) for k, (_, _, changed) in enumerate(cases) if changed]
    for exact in (True, False):
        assert rows(ops.changed_tables(old, new, exact), "table") == sorted(want, key=repr)
        assert rows(ops.changed_tables(new, old, exact), "table") == sorted(want, key=repr)


def test_a_table_with_more_facts_is_decided_without_an_order(spark, monkeypatch):
    monkeypatch.setattr(ops, "_in_sequence", None)
    old = facts(spark, ("t", "column", column("a", 1)), ("u", "column", column("a", 1)))
    new = facts(spark, ("t", "column", column("a", 1)), ("t", "column", column("b", 2)), ("u", "column", column("a", 1)))
    for exact in (True, False):
        assert rows(ops.changed_tables(old, new, exact), "table") == [("t",)]
