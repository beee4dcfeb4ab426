"""Levels of folded state: how many folders there are, what they hold, and what a lost writer leaves."""

import math
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.shared import new_folder
from shelfmark.streaming import scans, state

START = datetime(2024, 1, 1)
SCHEMA = "job_id string, ts timestamp, status string, error string"
FIELDS = ["status", "error"]


def folded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    latest = [scans._latest(f, ["ts"]) for f in FIELDS]
    return df.groupBy("job_id").agg(F.max("ts").alias("last_at"), *latest)


def add(spark, path, batch, rows, **options):
    state.add(folded(spark, rows), path, batch, lambda df: scans._folded(df, FIELDS), **options)


def read(spark, path, **options):
    return {r.job_id: (r.status, r.error) for r in scans.read_job_state(spark, path, FIELDS, **options).collect()}


def at(hours):
    return START + timedelta(hours=hours)


def folders(path):
    return sorted(n for n in os.listdir(path) if n.startswith("batch="))


def test_many_batches_leave_few_folders(spark):
    path, want = new_folder(spark, "test-state"), {}
    for k in range(50):
        rows = [("hot", at(k), f"s{k}", None), (f"j{k}", at(k), "new", "e" if k % 2 else None)]
        add(spark, path, k, rows)
        want |= {"hot": (f"s{k}", None), f"j{k}": ("new", "e" if k % 2 else None)}
    live = state.latest(spark, path).segments
    assert len(live) <= (state.FAN - 1) * math.ceil(math.log(51, state.FAN))
    assert len(folders(path)) <= len(live) + state.FAN and len(os.listdir(f"{path}/_manifests")) <= 2 * state.KEEP
    assert sorted(b for s in live for b in range(s.first, s.last + 1)) == list(range(50))
    assert read(spark, path) == want
    # A read opens the folders of the manifest only.
    files = scans.read_job_state(spark, path, FIELDS).inputFiles()
    assert {f.split("/")[-2] for f in files} <= {s.name for s in live}


def test_an_older_event_in_a_later_batch_changes_nothing(spark):
    path = new_folder(spark, "test-state")
    add(spark, path, 0, [("a", at(5), "done", None)], fan=2)
    add(spark, path, 1, [("a", at(1), "running", "late")], fan=2)
    assert read(spark, path) == {"a": ("done", "late")} and len(state.latest(spark, path).segments) == 1


def test_a_batch_that_runs_twice_and_a_lost_writer(spark, monkeypatch):
    path = new_folder(spark, "test-state")
    add(spark, path, 0, [("a", at(0), "x", None)], fan=2)
    before = read(spark, path)
    real = state._write

    def lost(*args):
        raise RuntimeError("lost")

    # Lost between writing folders, merged ones too, and naming them.
    monkeypatch.setattr(state, "_write", lost)
    with pytest.raises(RuntimeError):
        add(spark, path, 1, [("a", at(1), "y", None)], fan=2)
    assert read(spark, path) == before
    monkeypatch.setattr(state, "_write", real)
    add(spark, path, 1, [("a", at(1), "y", None)], fan=2)
    add(spark, path, 1, [("a", at(1), "never", None)], fan=2)
    assert read(spark, path) == {"a": ("y", None)}


def test_retention(spark):
    path, day = new_folder(spark, "test-state"), 24 * 3600
    add(spark, path, 0, [("old", at(0), "x", None), ("kept", at(0), "x", "first")], fan=2, ttl_seconds=day)
    add(spark, path, 1, [("other", at(2), "x", None)], fan=2, ttl_seconds=day)
    add(spark, path, 2, [("kept", at(20), "y", None)], fan=2, ttl_seconds=day)
    assert set(read(spark, path, ttl_seconds=day)) == {"old", "kept", "other"}
    add(spark, path, 3, [("new", at(25), "x", None)], fan=2, ttl_seconds=day)
    # The job that has a newer event in another folder keeps what the older one has of it.
    assert read(spark, path, ttl_seconds=day) == {"kept": ("y", "first"), "other": ("x", None), "new": ("x", None)}
    assert set(read(spark, path)) == {"kept", "other", "new"}
    # The boundary itself has expired; nothing of all is left where the newest is far later.
    add(spark, path, 4, [("last", at(26), "x", None)], fan=2, ttl_seconds=day)
    assert set(read(spark, path, ttl_seconds=day)) == {"kept", "new", "last"}


def test_empty_batches_and_none(spark):
    path = new_folder(spark, "test-state")
    with pytest.raises(LookupError):
        scans.read_job_state(spark, path, FIELDS)
    for k in range(3):
        add(spark, path, k, [], fan=2, ttl_seconds=10)
    assert read(spark, path, ttl_seconds=10) == {}
    add(spark, path, 3, [("a", at(0), None, "e")], fan=2, ttl_seconds=10)
    assert read(spark, path) == {"a": (None, "e")}
