"""Every registered query against its SQL on the given tables (smallest scale)."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from shelfmark.plans import QUERIES, SQL

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert compare(spark, db, SF_DIR, name) == ""


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
