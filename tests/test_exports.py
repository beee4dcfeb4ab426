from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.shared import new_folder
from shelfmark.sources import exports

KIND = "format string, path string, part int, content string"


def batch(spark, rows):
    return spark.createDataFrame(rows, KIND)


def current(spark, path, **how):
    return sorted(tuple(r) for r in exports.read_exports(spark, path, **how).collect())


def test_after_twenty_batches_no_file_of_replaced_documents_is_scanned(spark):
    path = new_folder(spark, "exports")
    want = {}
    for k in range(20):
        rows = [("markdown", f"d{i}.md", p, f"{k} {i} {p}") for i in range(k % 3, 12) for p in range(2)]
        if k == 0:
            rows.append(("okf", "a.md", 0, "stays"))
        exports.write_exports(batch(spark, rows), path)
        want.update({r[:3]: r[3] for r in rows})
    assert current(spark, path) == sorted((*key, text) for key, text in want.items())
    # The last batch and the one before hold what is current, the first one the other format.
    files = [f for f in exports.read_exports(spark, path).inputFiles() if "/documents/" in f]
    scanned = {f.split("batch=")[1].split("/")[0] for f in files}
    assert scanned == {r.batch for r in exports.pointers(spark, path).select("batch").distinct().collect()}
    assert len(scanned) <= 4 and len(files) < 40
    only = exports.read_exports(spark, path, ["okf"])
    assert [r.content for r in only.collect()] == ["stays"] and len(only.inputFiles()) == 1


def test_a_shorter_document_replaces_all_parts(spark):
    path = new_folder(spark, "exports")
    exports.write_exports(batch(spark, [("okf", "a", p, "old") for p in range(50)] + [("okf", "b", 0, "b")]), path)
    number = exports.write_exports(batch(spark, [("okf", "a", 0, "new"), ("okf", "index.md", 0, "no")]), path)
    assert current(spark, path) == [("okf", "a", 0, "new"), ("okf", "b", 0, "b")]
    assert len(current(spark, path, number=number - 1)) == 51


def test_small_batches_rewrite_the_buckets_they_touch(spark):
    path = new_folder(spark, "exports")
    exports.write_exports(batch(spark, [("okf", f"d{i}", 0, "x") for i in range(600)]), path)
    exports.write_exports(batch(spark, [("okf", "d7", 0, "y")]), path)
    builds = exports._directory(spark, path, 2).groupBy("build").count().collect()
    assert sorted(r["count"] for r in builds)[0] == 1 and len(builds) == 2
    assert len(current(spark, path)) == 600


def test_writers_at_once_keep_each_others_documents(spark, monkeypatch):
    path = new_folder(spark, "exports")
    exports.write_exports(batch(spark, [("okf", "a", 0, "first")]), path)
    plain, calls = exports.commit, []

    def late(session, place, base, name):
        if not calls:
            calls.append(base)
            exports.write_exports(batch(spark, [("okf", "b", 0, "other"), ("okf", "a", 0, "other")]), path)
        return plain(session, place, base, name)

    monkeypatch.setattr(exports, "commit", late)
    assert exports.write_exports(batch(spark, [("okf", "a", 0, "last")]), path) == 3
    assert current(spark, path) == [("okf", "a", 0, "last"), ("okf", "b", 0, "other")]


def test_without_documents(spark):
    path = new_folder(spark, "exports")
    assert current(spark, path) == []
    exports.write_exports(batch(spark, []), path)
    assert current(spark, path) == []
    assert exports.bundle_index(spark, path).count() >= 0


def test_documents_are_rendered_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(text):
        seen.add(1)
        return text

    path = new_folder(spark, "test-exports")
    given = batch(spark, [("okf", f"{k}.md", 0, str(k)) for k in range(5)])
    exports.write_exports(given.withColumn("content", F.udf(passed, "string")("content")), path)
    assert seen.value == 5 and len(current(spark, path)) == 5
