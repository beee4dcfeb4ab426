"""The index of names: pages of any place, what a commit indexes again, and what is removed."""

import os

import pytest
from helpers import facts, tables
from pyspark.sql import functions as F

from shelfmark.operators import store as ops
from shelfmark.operators.store import Store
from shelfmark.shared import new_folder
from shelfmark.sources import pages
from shelfmark.sources.commits import LEVELS, vacuum
from shelfmark.sources.store import read_store, update_store, version, write_store


def scan(spark, rows):
    """Tables of (config, instance, schema, table)."""
    own = tables(spark, ("t", {})).drop(*LEVELS, "table")
    names = spark.createDataFrame(rows, "config string, instance string, schema string, `table` string")
    return Store(names.join(own).select(*tables(spark).columns), facts(spark))


def add(spark, path, rows):
    return update_store(ops.merge_metadata(read_store(spark, path), scan(spark, rows), F.current_timestamp()), path)


def page(spark, path, *args, **options):
    return tuple(pages.names_page(spark, path, *args, **options).first())


def entries(spark, path, number):
    return {
        (r.level, r.instance, r.schema): r.build for r in pages._directory(spark, path, number).collect()
    }


def test_late_pages_read_two_files_at_most(spark, monkeypatch):
    monkeypatch.setattr(pages, "FILE_NAMES", 300)
    path = new_folder(spark, "test-pages")
    hot = sorted({f"t{k * 7919 % 3000:04d}" for k in range(3000)})
    rows = [("c", "i", "hot", x) for x in hot] + [("d", "i", "hot", x) for x in hot[:50]]
    rows += [("c", "i", f"s{k:02d}", "only") for k in range(30)] + [("c", "j", "s", "A"), ("c", "j", "s", "a"), ("c", "j", "s", "ä")]
    write_store(scan(spark, rows), path)
    assert pages.index_names(spark, path) == 1 and pages.index_names(spark, path) == 1
    assert len([f for f in os.listdir(f"{path}/names/files/{os.listdir(f'{path}/names/files')[0]}") if f.startswith("part")]) >= 8
    within = {"instance": "i", "schema": "hot"}
    for number, size in ((1, 20), (15, 200), (14, 200), (7, 200), (150, 20), (151, 20)):
        total, files = pages.page_entries(spark, path, "table", number, size, 1, **within)
        want = hot[(number - 1) * size : number * size]
        assert total == 3000 and len(files) <= 2 and bool(files) == bool(want)
        assert page(spark, path, "table", number, size, **within) == (want, 3000, number, size, 3000 // size)
    assert page(spark, path, "table", instance="j", schema="s") == (["A", "a", "ä"], 3, 1, 20, 1)
    assert page(spark, path, "schema", 2, 10, instance="i") == ([f"s{k:02d}" for k in range(9, 19)], 31, 2, 10, 4)
    assert page(spark, path, "instance") == (["i", "j"], 2, 1, 20, 1)
    assert page(spark, path, "table", instance="j", schema="none") == ([], 0, 1, 20, 0)
    # The same as pages of sorted names.
    names = ops.distinct_names(read_store(spark, path).tables, "table", instance="i", schema="hot")
    assert page(spark, path, "table", 9, 77, **within) == tuple(ops.page(names, 9, 77).first())


def test_only_touched_lists_are_indexed_again(spark):
    path = new_folder(spark, "test-pages")
    write_store(scan(spark, [("c", "i", "s", "t1"), ("c", "i", "r", "t1"), ("c", "j", "s", "t1")]), path)
    pages.index_names(spark, path)
    add(spark, path, [("d", "i", "s", "t0"), ("c", "i", "s", "t1")])
    add(spark, path, [("c", "i", "s", "t2")])
    assert page(spark, path, "table", instance="i", schema="s") == (["t0", "t1", "t2"], 3, 1, 20, 1)
    old, new = entries(spark, path, 1), entries(spark, path, 3)
    same = {k for k in old if old[k] == new[k]}
    assert same == {("table", "i", "r"), ("table", "j", "s"), ("schema", "j", "")} and set(old) == set(new)
    # What was read before stays readable by its number.
    assert page(spark, path, "table", commit_number=1, instance="i", schema="s") == (["t1"], 1, 1, 20, 1)
    # A commit between two indexed ones may be indexed later.
    assert page(spark, path, "table", commit_number=2, instance="i", schema="s")[0] == ["t0", "t1"]
    gone = vacuum(spark, path, keep=1, seconds=0)
    assert any("/names/directories/" in g for g in gone) and any("/names/commits/" in g for g in gone)
    assert page(spark, path, "table", instance="i", schema="r") == (["t1"], 1, 1, 20, 1)
    assert page(spark, path, "table", instance="i", schema="s")[0] == ["t0", "t1", "t2"]
    with pytest.raises(LookupError):
        pages.names_page(spark, path, "table", commit_number=2, instance="i", schema="s")


def test_lists_that_are_gone_and_empty_stores(spark):
    path = new_folder(spark, "test-pages")
    assert version(spark, path) == 0 and page(spark, path, "instance") == ([], 0, 1, 20, 0)
    write_store(scan(spark, [("c", "i", "s", "t"), ("c", "j", "s", "t")]), path)
    pages.index_names(spark, path)
    write_store(scan(spark, [("c", "j", "s", "u")]), path)
    assert page(spark, path, "instance") == (["j"], 1, 1, 20, 1)
    assert page(spark, path, "table", instance="i", schema="s") == ([], 0, 1, 20, 0)
    assert page(spark, path, "table", instance="j", schema="s")[0] == ["u"]
    for bad in ({"number": 0}, {"size": 201}):
        with pytest.raises(ValueError):
            pages.names_page(spark, path, "instance", **bad)
    with pytest.raises(ValueError):
        pages.names_page(spark, path, "table", instance="j")
