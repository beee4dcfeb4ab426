from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from check import compare, connect
from shelfmark.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name) == ""


def test_entry_has_all(spark):
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


def test_stages_keep_what_they_do_not_reject(spark):
    from shelfmark.llm import classifier, decontaminate, minmax

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    got = pipeline.good(spark, docs, SF_DIR)
    assert got.columns == pipeline.COLUMNS
    assert ids(got) == ids(classifier.scores(docs, classifier.learn(docs, labels)).where("predicted = 1"))
    got = pipeline.unlike(spark, docs, SF_DIR)
    assert ids(got) == ids(minmax.near_duplicates(docs).where("kept"))
    got = pipeline.clean(spark, docs, SF_DIR)
    index = decontaminate.build_index(docs, benchmark)
    assert got.columns == pipeline.COLUMNS
    assert ids(got) == ids(decontaminate.contamination(index).where("NOT contaminated"))
    mixed = pipeline.mixed(spark, docs, SF_DIR)
    assert mixed.columns == pipeline.COLUMNS
    counts = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    assert max(counts) <= 3
    placed = pipeline.sharded(spark, mixed, SF_DIR)
    assert placed.count() == mixed.count()


def test_repeated_and_null_ids(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, long, "a"), (1, long, "a"), (1, other, "a"), (2, long, None), (None, other, "b"), (None, None, None), (3, "", "b")]
    docs = make_docs(rows)
    texts = sorted(r.text or "" for r in pipeline.unlike(spark, docs, SF_DIR).collect())
    assert texts == ["", "", other, long]
    assert pipeline.clean(spark, docs, SF_DIR).count() == len(rows)
    assert pipeline.mixed(spark, docs, SF_DIR).select("doc_id").count() <= 3 * len(rows)
    for _, stage in pipeline.STAGES:
        assert stage(spark, make_docs([]), SF_DIR).count() == 0


def test_run(spark):
    got = pipeline.run(spark, SF_DIR).collect()
    assert got and {r.shard for r in got} == set(range(24))
