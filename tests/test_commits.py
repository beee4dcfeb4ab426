"""Writers that meet, and what is removed from a store."""

import os
import threading

import pytest
from helpers import column, facts, rows, tables
from pyspark.sql import functions as F

from shelfmark.operators import store as ops
from shelfmark.operators.store import Store
from shelfmark.shared import new_folder
from shelfmark.sources import commits
from shelfmark.sources.store import Conflict, commit_merge, compact_store, read_store, update_store, version, write_store

def at():
    return F.lit("2024-05-05 00:00:00").cast("timestamp")


def scan(spark, *names, schema="s", kind="int"):
    own = Store(tables(spark, *[(n, {}) for n in names]), facts(spark, *[(n, "column", column("a", data_type=kind)) for n in names]))
    return Store(*[f.withColumn("schema", F.lit(schema)) for f in own])


def merged(spark, path, *names, **options):
    return ops.merge_metadata(read_store(spark, path), scan(spark, *names, **options), at())


def stored(spark, path, **options):
    return {(r.schema, r.table) for r in read_store(spark, path, **options).tables.collect()}


@pytest.fixture
def path(spark):
    place = new_folder(spark, "test-commits")
    write_store(scan(spark, "t1"), place)
    return place


def test_disjoint_tables_of_one_schema_survive(spark, path):
    first, second = merged(spark, path, "t2"), merged(spark, path, "t3")
    assert update_store(second, path) == 2
    final, number = commit_merge(first, path)
    assert number == 3 and stored(spark, path) == {("s", "t1"), ("s", "t2"), ("s", "t3")}
    # What was committed in the end is a merge with the newer store.
    assert {r[0] for r in rows(final.tables, "table")} == {"t1", "t2", "t3"} and final.number == 2
    assert len(rows(read_store(spark, path).facts)) == 3


def test_the_later_scan_of_one_table_counts(spark, path):
    first, second = merged(spark, path, "t1", kind="early"), merged(spark, path, "t1", kind="late")
    update_store(first, path)
    update_store(second, path)
    assert rows(read_store(spark, path).facts, "data_type") == [("late",)]


def test_other_schemas_are_carried_over_without_writing_again(spark, path):
    first, second = merged(spark, path, "x", schema="p"), merged(spark, path, "y", schema="q")
    update_store(second, path, base=1)
    written = {f for f in os.listdir(f"{path}/facts")}
    assert update_store(first, path, base=1) == 3
    assert len(os.listdir(f"{path}/facts")) == len(written) + 1
    assert stored(spark, path) == {("s", "t1"), ("p", "x"), ("q", "y")}


def test_a_base_refuses_the_same_schema_only(spark, path):
    first, second = merged(spark, path, "t2"), merged(spark, path, "t3")
    update_store(second, path)
    with pytest.raises(Conflict, match="c/i/s"):
        update_store(first, path, base=1)
    with pytest.raises(ValueError):
        update_store(ops.merge_metadata(scan(spark, "t1"), scan(spark, "t2"), at()), path)


def test_a_store_that_was_read_is_not_written_over_another(spark, path):
    before = read_store(spark, path)
    update_store(merged(spark, path, "t2"), path)
    with pytest.raises(Conflict):
        write_store(before, path)
    assert stored(spark, path) == {("s", "t1"), ("s", "t2")}


def test_many_writers_at_once(spark, path):
    problems = []

    def work(k):
        try:
            update_store(merged(spark, path, f"w{k}", schema=f"s{k % 2}"), path)
        except Exception as e:  # seen below
            problems.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert problems == [] and version(spark, path) == 5
    assert stored(spark, path) == {("s", "t1"), *[(f"s{k % 2}", f"w{k}") for k in range(4)]}


def test_vacuum_and_compaction(spark, path):
    for k in range(3):
        update_store(merged(spark, path, f"n{k}", schema=f"s{k}"), path)
    want = stored(spark, path)
    old = read_store(spark, path, number=3)
    # A writer that was lost: folders that no commit names.
    (lost := f"{path}/facts/version=lost") and os.makedirs(lost)
    assert commits.vacuum(spark, path) == []  # all are young
    assert compact_store(spark, path) == 5 and compact_store(spark, path) == 5
    assert stored(spark, path) == want and len(rows(read_store(spark, path).facts)) == 4
    gone = commits.vacuum(spark, path, keep=3, seconds=0)
    assert lost in gone and not os.path.exists(lost)
    # Kept numbers are read as before, also by who has read them already; older ones are gone.
    assert len(rows(old.facts)) == 3 and stored(spark, path, number=3) < want
    with pytest.raises(LookupError):
        read_store(spark, path, number=2)
    commits.vacuum(spark, path, keep=1, seconds=0)
    assert len(os.listdir(f"{path}/facts")) == 1 and stored(spark, path) == want
    assert update_store(merged(spark, path, "more"), path) == 6


def test_a_scan_during_compaction_wins(spark, path, monkeypatch):
    update_store(merged(spark, path, "n", schema="p"), path)
    late = merged(spark, path, "t2")
    real, calls = commits.commit_schemas, []

    def commit_schemas(*args):
        if not calls:
            calls.append(1)
            update_store(late, path, base=2)
        return real(*args)

    monkeypatch.setattr("shelfmark.sources.store.commit_schemas", commit_schemas)
    compact_store(spark, path)
    assert stored(spark, path) == {("s", "t1"), ("s", "t2"), ("p", "n")}


def test_a_writer_from_a_version_that_is_gone(spark, path):
    for k in range(2):
        update_store(merged(spark, path, f"n{k}", schema=f"s{k}"), path)
    commits.vacuum(spark, path, keep=1, seconds=0)
    schemas = spark.createDataFrame([("c", "i", "s")], "config string, instance string, schema string")
    with pytest.raises(Conflict, match="no longer kept"):
        commits.commit_schemas(spark, path, 1, "late", schemas)
    assert version(spark, path) == 3


def test_a_store_that_is_written_whole_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(text):
        seen.add(1)
        return text

    named = Store(*[frame.withColumn("config", F.udf(passed, "string")("config")) for frame in scan(spark, "t")])
    path = new_folder(spark, "test-store")
    write_store(named, path)
    assert seen.value == 2 and read_store(spark, path).facts.count() == 1
