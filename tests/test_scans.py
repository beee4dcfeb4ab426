"""G1. A scan does what its requests ask for."""

from datetime import datetime

from pyspark.sql import functions as F

from helpers import column, facts, rows
from shelfmark.operators.jobs import decode_messages
from shelfmark.shared import new_folder
from shelfmark.sources.scans import apply_requests
from shelfmark.sources.store import read_exports, read_store

FIELDS = "job_id string, save_metadata string, only_if_changed string, generate_ai_docs string, export_formats string"


def test_options_of_requests(spark):
    path = new_folder(spark, "scan")
    requests = decode_messages(
        spark.createDataFrame(
            [
                ("saves", "true", "", "true", '["okf"]'), ("shows", "false", "", "", '["markdown"]'),
                ("quiet", "true", "true", "", "[]"),
            ],
            FIELDS,
        )
    )
    found = facts(spark, *[(t, "column", column("id")) for t in ("a", "b", "c")])
    tables = {"saves": ["a"], "shows": ["b"], "quiet": ["c"]}
    results = spark.createDataFrame(
        [(j, "c", "i", "s", t) for j, ts in tables.items() for t in ts],
        "job_id string, config string, instance string, schema string, `table` string",
    )

    def call(system, prompt):
        return '{"summary": "about ' + prompt.split("Table: ")[1].split("\n")[0] + '"}'

    def run(day):
        at = F.lit(datetime(2024, 1, day))
        return apply_requests(requests, results, found, f"{path}/store", f"{path}/exports", at, call, pause=0.0)

    first = {r.table: (r.action, r.ai_generation_status) for r in run(1).collect()}
    assert first == {"a": ("insert", "generated"), "b": ("insert", None), "c": ("insert", None)}
    stored = read_store(spark, f"{path}/store")
    assert rows(stored.tables, "table") == [("a",), ("c",)]
    assert rows(stored.tables, "table", "ai_documentation.summary")[0] == ("a", "about a")
    assert rows(read_exports(spark, f"{path}/exports"), "format", "path") == [
        ("markdown", "c/i/s/b.md"), ("okf", "c/i/s/a.md"),
    ]
    second = {r.table: r.action for r in run(2).collect()}
    assert second == {"a": "update", "b": "insert", "c": "unchanged"}
    assert rows(read_store(spark, f"{path}/store").tables, "table", "updated_at") == [
        ("a", datetime(2024, 1, 2)), ("c", datetime(2024, 1, 1)),
    ]
