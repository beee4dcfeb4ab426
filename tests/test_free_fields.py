"""Free-form fields of stored documents: kept at every level, compared, merged, patched, written back."""

import json

from helpers import column, facts, rows, tables
from pyspark.sql import functions as F

from shelfmark.operators import store as ops
from shelfmark.operators.describe import nest
from shelfmark.operators.store import Store
from shelfmark.shared import new_folder
from shelfmark.sources import documents
from shelfmark.sources.store import read_store, write_store

NAMES = {"config_name": "c", "instance_name": "i", "schema_name": "s", "table_name": "t"}
DOCUMENT = {
    **NAMES,
    "metadata_key": "c::i::s::t",
    "updated_at": "2024-01-01T00:00:00+00:00",
    "owner": {"team": "a", "since": 2001},
    "ai_documentation": {
        "summary": "S", "column_descriptions": {"a": "first"}, "generated_at": None, "model": "m",
        "confidence": 0.5, "sources": ["x", {"y": None}],
    },
    "schema_description": {
        "instance_name": "i", "schema_name": "s", "table_name": "t", "sort_key": "a", "engine": {"name": "E", "rows": 10},
        "columns": [
            {"name": "a", "data_type": "int", "is_nullable": False, "default_value": None, "comment": None,
             "description": None, "collation": "C", "z": {"b": 1, "a": [True, None]}},
            {"name": "b", "data_type": "text", "is_nullable": True, "default_value": "''", "comment": "é \"q\"", "description": None},
        ],
        "primary_key": {"column_names": ["a", "b"], "deferrable": False},
        "foreign_keys": [{"column_name": "b", "referenced_table": "u", "referenced_column": "id", "constraint_name": "fk", "on_delete": "CASCADE"}],
        "indexes": [
            {"name": "ix", "column_names": ["a", "b"], "is_unique": True, "is_primary": False, "type": "btree", "where": "a > 0"},
            {"name": "iy", "column_names": ["b"], "is_unique": False, "is_primary": False, "type": None},
        ],
        "partitions": [{"column_name": "a", "data_type": "int", "comment": None, "bounds": [1, 2]}],
    },
}


def texts(spark, *given):
    return spark.createDataFrame([(json.dumps(d),) for d in given], "document string")


def read(spark, *given):
    t = texts(spark, *given)
    return Store(documents.tables_of_documents(t), documents.facts_of_documents(t))


def back(own):
    return [json.loads(r.document) for r in documents.to_documents(own.tables, nest(own.facts, extra=True)).collect()]


def at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def test_unknown_fields_come_back_where_they_stood(spark):
    assert back(read(spark, DOCUMENT)) == [DOCUMENT]
    path = new_folder(spark, "test-free")
    write_store(read(spark, DOCUMENT), path)
    assert back(read_store(spark, path)) == [DOCUMENT]


def test_documents_without_them_have_none(spark):
    plain = json.loads(json.dumps(DOCUMENT))
    for key in ("confidence", "sources"):
        del plain["ai_documentation"][key]
    del plain["schema_description"]["engine"], plain["schema_description"]["columns"][0]["z"]
    own = read(spark, plain)
    (row,) = own.tables.collect()
    assert row.ai_extra is None and row.description_extra is None and back(own) == [plain]
    # Objects of other kinds than expected are no reason to fail.
    odd = {**NAMES, "ai_documentation": "text", "schema_description": {"columns": {"a": 1}, "note": 1, "indexes": [3]}}
    (row,) = read(spark, odd).tables.collect()
    assert row.ai_extra is None and row.description_extra.toPython() == {"note": 1}


def changed(spark, change):
    other = json.loads(json.dumps(DOCUMENT))
    change(other)
    old, new = read(spark, DOCUMENT), read(spark, other)
    merged = ops.merge_metadata(old, new, at(), only_if_changed=True)
    return merged, {r.action for r in merged.tables.collect()}


def test_they_count_as_changes(spark):
    same = lambda d: d["schema_description"]["columns"][0].update(z={"a": [True, None], "b": 1})
    assert changed(spark, same)[1] == {"unchanged"}
    for change in (
        lambda d: d["schema_description"].update(engine={"name": "E", "rows": 11}),
        lambda d: d["schema_description"]["columns"][0].pop("collation"),
        lambda d: d["schema_description"]["indexes"][0].update(where="a > 1"),
        lambda d: d["schema_description"]["primary_key"].update(deferrable=True),
    ):
        assert changed(spark, change)[1] == {"update"}


def test_a_scan_replaces_those_of_the_description_and_keeps_those_of_the_documentation(spark):
    scan = Store(tables(spark, ("t", {})), facts(spark, ("t", "column", column("a"))))
    merged = ops.merge_metadata(read(spark, DOCUMENT), scan, at())
    (row,) = merged.tables.collect()
    assert row.description_extra is None and row.ai_extra.toPython() == {"confidence": 0.5, "sources": ["x", {"y": None}]}
    assert row.ai_documentation.summary == "S" and rows(merged.facts, "extra") == [(None,)]


def test_patches_bring_their_own(spark):
    own = read(spark, DOCUMENT)
    payload = {"ai_documentation": '{"summary":"N","stars":3}', "schema_description": '{"columns":[{"name":"n","pii":true}],"v":2}'}
    patches = spark.createDataFrame([("i", "s", "t", 1, payload)], "instance string, schema string, table string, seq long, payload map<string,string>")
    (row,) = ops.annotate(own.tables, patches, at()).collect()
    assert row.ai_extra.toPython() == {"stars": 3} and row.description_extra.toPython() == {"v": 2}
    assert rows(ops.annotated_facts(own, patches), "column_name", "extra") == [("n", '{"pii":true}')]
    other = patches.withColumn("payload", F.create_map(F.lit("owner"), F.lit('"x"')))
    (row,) = ops.annotate(own.tables, other, at()).collect()
    assert row.ai_extra.toPython()["confidence"] == 0.5 and row.description_extra.toPython() == {"engine": {"name": "E", "rows": 10}}


def test_a_document_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(text):
        seen.add(1)
        return text

    given = texts(spark, DOCUMENT).union(texts(spark, {**DOCUMENT, "table_name": "u"})).repartition(1)
    for read_from in (documents.tables_of_documents, documents.facts_of_documents):
        before = seen.value
        computed = given.select(F.udf(passed, "string")("document").alias("document"), F.lit(0).alias("part"))
        assert {r.table for r in read_from(computed).collect()} == {"t", "u"}
        assert seen.value - before == 2


def test_lists_of_odd_entries_and_documents_without_names(spark):
    given = {**NAMES, "schema_description": {
        "columns": [None, {"name": "a"}], "indexes": [{"name": None}, {"name": "x", "column_names": [], "w": 1}, {"column_names": ["a", None]}],
        "primary_key": {"column_names": None, "x": 1}, "sort_key": "s",
    }}
    own = read(spark, given, {**given, "config_name": None}, {"table_name": "t"})
    assert len(own.tables.collect()) == 1
    assert rows(own.facts, "section", "item", "position", "column_name", "extra") == sorted([
        ("column", "", 1, None, None), ("column", "", 2, "a", None), ("sort_key", "", 1, "s", None),
        ("index", "None", None, None, None), ("index", "x", None, None, '{"w":1}'),
        ("index", "None", 1, "a", None), ("index", "None", 2, None, None),
    ], key=repr)


def test_documents_that_count_are_found_once_for_tables_and_facts(spark, monkeypatch):
    names, real = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df, name: names.append(name) or real(df, name))
    described = {**DOCUMENT["schema_description"], "table_name": "u"}
    other = {**DOCUMENT, "table_name": "u", "metadata_key": "c::i::s::u", "schema_description": described}
    older = {**DOCUMENT, "updated_at": "2023-01-01T00:00:00+00:00", "schema_description": {"columns": [{"name": "old"}]}}
    current = documents.newest(texts(spark, older, DOCUMENT, other, DOCUMENT))
    own = Store(documents.tables_of_documents(current), documents.facts_of_documents(current))
    assert sorted(back(own), key=lambda d: d["table_name"]) == [DOCUMENT, other]
    assert names == ["documents", "several", "newest"]
    # Where no document comes twice, none is moved.
    names.clear()
    assert documents.newest(texts(spark, DOCUMENT, other)).documents.count() == 2 and names == ["documents", "several"]


def test_only_entries_that_say_more_are_parsed_to_be_written(spark):
    given = [column(n, i, extra=extra) for i, (n, extra) in enumerate([("a", None), ("b", '{"name":"twice"}'), ("c", '{"k":[1,null],"b":"x"}')])]
    own = Store(tables(spark, ("t", {})), facts(spark, *[("t", "column", f) for f in given]))
    entry = lambda n, more="", last="": f'{{{more}"comment":null,"data_type":"int","default_value":null,"description":null,"is_nullable":null,{last}"name":"{n}"}}'
    documented = lambda described: documents.to_documents(own.tables, described).first().document
    rest = '"foreign_keys":[],"indexes":[],"instance_name":"i","partitions":[],"primary_key":null,"schema_name":"s","sort_key":null,"table_name":"t"}'
    want = ",".join([entry("a"), "null", entry("c", '"b":"x",', '"k":[1,null],')])
    assert f'"schema_description":{{"columns":[{want}],{rest}' in documented(nest(own.facts, extra=True))
    plain = documents.to_documents(own.tables, nest(own.facts))
    assert f'"schema_description":{{"columns":[{",".join(map(entry, "abc"))}],{rest}' in plain.first().document
    # Without free-form fields only the documentation is built from a variant.
    assert str(plain._jdf.queryExecution().optimizedPlan()).count("parseJson") <= 1


def test_free_fields_of_descriptions_stand_in_order(spark):
    free = '{"zz":1,"a":{"y":null,"x":"q\\""},"é":[2],"name":"n"}'
    for text, ends in ((free, ('{"a":{"x":"q\\"","y":null},"columns":[]', '"table_name":"t","zz":1,"é":[2]}')), ('{"columns":1}', None)):
        own = Store(tables(spark, ("t", {})).withColumn("description_extra", F.parse_json(F.lit(text))), facts(spark))
        (row,) = documents.to_documents(own.tables, nest(own.facts, extra=True)).collect()
        described = row.document.split('"schema_description":')[1].rsplit(',"ai_documentation":', 1)[0]
        assert described.startswith(ends[0]) and described.endswith(ends[1]) if ends else described == "null"
