"""G. Scan jobs as event tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from shelfmark import model as m
from shelfmark.operators import jobs

NOW = datetime(2024, 1, 10, 12)


def at(**ago):
    return NOW - timedelta(**ago)


def now():
    return F.lit(NOW)


K4 = "config string, instance string, schema string, table string"


def test_scan_isolates_failures(spark):
    catalog = spark.createDataFrame(
        [("a", "h", "s", "good"), ("a", "h", "s", "bad"), ("a", "h", "s", "lost"), ("b", "h", "s", "good")], K4
    )
    scopes = spark.createDataFrame(
        [("j1", "a", None, None, None), ("j2", "b", None, None, None), ("j3", "z", None, None, None),
         ("j4", None, "h", "s", "bad")],
        "scope_id string, " + K4,
    )
    described = catalog.where("table = 'good'").withColumn("document", F.col("config"))
    errors = catalog.where("table = 'bad'").withColumn("error", F.lit("denied"))
    results, failed = jobs.scan(catalog, scopes, described, errors)
    assert rows(results, "job_id", "config", "table") == [("j1", "a", "good"), ("j2", "b", "good")]
    assert rows(failed, "job_id", "error") == [
        ("j1", "a/h/s/bad: denied"), ("j1", "a/h/s/lost: not found"), ("j3", "z/*/*/*: not found"),
        ("j4", "a/h/s/bad: denied"),
    ]
    counts = jobs.fold_counts(scopes.withColumnRenamed("scope_id", "job_id"), results, failed)
    assert rows(counts) == [
        ("j1", "partial", 1, 2), ("j2", "completed", 1, 0), ("j3", "failed", 0, 1), ("j4", "failed", 0, 1),
    ]


def test_fold_status(spark):
    ids = spark.createDataFrame([(j,) for j in ("ok", "some", "none", "idle", "crash")], "job_id string")
    results = spark.createDataFrame([("ok",), ("ok",), ("some",), ("crash",)], "job_id string")
    errors = spark.createDataFrame(
        [("some", 2, "b"), ("some", 1, "a"), ("none", 1, "x"), ("crash", 1, "y")],
        "job_id string, seq int, error string",
    )
    crashed = spark.createDataFrame([("crash", "boom")], "job_id string, error string")
    got = rows(jobs.fold_status(ids, results, errors, ["seq"], crashed))
    assert got == [
        ("crash", 0, "failed", None, "boom"), ("idle", 0, "completed", 0, None),
        ("none", 0, "failed", None, "x"), ("ok", 0, "completed", 2, None),
        ("some", 0, "partial", 1, "a; b"),
    ]


def test_state_takes_only_fields_an_update_carries(spark):
    events = spark.createDataFrame(
        [
            ("j", 1, "pending", None, None), ("j", 3, None, "late", None), ("j", 2, "running", "early", 5),
            ("k", 1, None, None, None),
        ],
        "job_id string, seq int, status string, error string, result_count int",
    )
    got = rows(jobs.job_state(events, ["seq"], ["status", "error", "result_count"]))
    assert got == [("j", "running", "late", 5), ("k", None, None, None)]


def job_index(spark):
    return spark.createDataFrame(
        [("a", at(days=1)), ("b", at(days=2)), ("c", at(days=2)), ("d", at(days=7)), ("e", at(days=8))],
        "job_id string, created_at timestamp",
    )


def test_recent_jobs_drop_expired_after_the_limit(spark):
    live = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "job_id string")
    assert rows(jobs.recent_jobs(job_index(spark), live, 3), "job_id") == [("a",), ("b",)]
    assert rows(jobs.recent_jobs(job_index(spark), live, 0), "job_id") == []


def test_retention_boundary_has_expired(spark):
    assert rows(jobs.prune(job_index(spark), now()), "job_id") == [("a",), ("b",), ("c",)]
    results = spark.createDataFrame(
        [("x", at(days=9)), ("x", at(days=6)), ("y", at(days=7)), ("z", at(days=8))],
        "job_id string, ts timestamp",
    )
    assert [r[0] for r in rows(jobs.live_results(results, now()))] == ["x", "x"]


def test_results_in_append_order(spark):
    results = spark.createDataFrame(
        [("j", 2, "b"), ("j", 1, "a"), ("k", 1, "z"), ("j", 3, "a")], "job_id string, seq int, document string"
    )
    assert [r.document for r in jobs.job_results(results, ["seq"], "j").collect()] == ["a", "b", "a"]
    ids = spark.createDataFrame([("j",), ("idle",)], "job_id string")
    got = jobs.job_with_results(ids, results, ["seq"])
    assert rows(got, "job_id", "results") == [("idle", []), ("j", ["a", "b", "a"])]
    assert jobs.job_with_results(ids, results, ["seq"], include=False).columns == ["job_id"]


def test_reclaim_looks_at_the_first_pending_only(spark):
    idle, fresh = at(seconds=30), at(seconds=29)
    deliveries = spark.createDataFrame(
        [
            ("1", "me", idle), ("2", "dead", at(hours=1)), ("2", "other", fresh), ("3", "dead", idle),
            ("4", "dead", idle), ("5", "dead", at(hours=2)), ("5", "dead2", idle),
        ],
        "message_id string, consumer string, delivered_at timestamp",
    )
    acks = spark.createDataFrame([("4",), ("4",)], "message_id string")
    got = rows(jobs.reclaim(deliveries, acks, "me", now()), "message_id", "consumer")
    assert got == [("3", "dead"), ("5", "dead2")]
    assert rows(jobs.reclaim(deliveries, acks, "me", now(), count=3), "message_id") == [("3",)]


def test_dedupe_keeps_the_first_result(spark):
    results = spark.createDataFrame(
        [("j", *"cist", 2, "second"), ("j", *"cist", 1, "first"), ("j", *"cisu", 3, None), ("k", *"cist", 4, "k")],
        f"job_id string, {K4}, seq int, document string",
    )
    got = rows(jobs.dedupe_results(results, ["seq"]), "job_id", "table", "seq", "document")
    assert got == [("j", "t", 1, "first"), ("j", "u", 3, None), ("k", "t", 4, "k")]


def test_decode_messages(spark):
    schema = (
        "job_id string, config_name string, instance_name string, no_cache string, save_metadata string,"
        " export_formats string, export_preformat string, save_markdown string"
    )
    messages = spark.createDataFrame(
        [
            ("1", "", "h", "true", None, '["okf"]', "false", "true"), ("2", "c", "", "True", "false", None, "false", "true"),
            ("3", None, None, None, "true", None, None, "no"), ("4", "c", "h", "false", "", "[]", None, None),
            ("5", "c", "h", "false", None, None, None, None), ("", "c", "h", "", "", None, None, None), (None,) * 8,
        ],
        schema,
    )
    got = rows(
        jobs.decode_messages(messages), "job_id", "config", "instance", "schema", "no_cache",
        "save_metadata", "export_formats", "export_preformat", "generate_ai_docs",
    )
    both = ["markdown", "okf"]
    assert got == [
        ("1", None, "h", None, True, True, ["okf"], False, False),
        ("2", "c", None, None, False, False, ["markdown"], True, False),
        ("3", None, None, None, False, True, [], True, False),
        ("4", "c", "h", None, False, False, [], True, False),
        ("5", "c", "h", None, False, True, both, True, False),
    ]


def test_enqueue_round_trip_keeps_null_scopes(spark):
    scopes = spark.createDataFrame(
        [(None, None, None, False, True, False, True, ["markdown"], True), ("c", "h", "s", True, False, True, False, [], False)],
        "config string, instance string, schema string, no_cache boolean, generate_ai_docs boolean,"
        " only_if_changed boolean, save_metadata boolean, export_formats array<string>, export_preformat boolean",
    )
    created = jobs.new_jobs(scopes, now(), F.coalesce("config", F.lit("all")))
    assert {r.status for r in created.collect()} == {m.PENDING}
    back = jobs.decode_messages(jobs.encode_messages(created)).select(*scopes.columns)
    assert rows(back) == rows(scopes)
    random = jobs.new_jobs(scopes, now()).select("job_id").collect()
    assert len({r.job_id for r in random}) == 2 and all(len(r.job_id) == 36 for r in random)


@pytest.mark.parametrize("no_cache, expected", [(False, ["empty", "never", "old"]), (True, ["empty", "fresh", "never", "old"])])
def test_freshness(spark, no_cache, expected):
    targets = spark.createDataFrame([(k,) for k in ("fresh", "old", "empty", "never")], "key string")
    snapshots = spark.createDataFrame(
        [("fresh", at(hours=23), ["1"]), ("fresh", at(hours=1), ["2"]), ("old", at(days=1), ["x"]), ("empty", at(hours=1), [])],
        "key string, ts timestamp, payload array<string>",
    )
    got = jobs.needs_rescan(targets, snapshots, ["key"], now(), no_cache=no_cache)
    assert [r[0] for r in rows(got)] == expected
    assert rows(jobs.fresh_answers(snapshots, ["key"], now())) == [("fresh", ["2"])]
