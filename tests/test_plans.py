"""Plans at scale: with broadcasting by estimate switched off, no query needs a cross join."""

import os
import re

import pytest

from shelfmark.operators import scope, store
from shelfmark.plans import QUERIES, roles

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def large(spark):
    """The session as if every table were too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


# Queries that write or stream while they are built are left to the SQL checks.
BUILT = [n for n in sorted(QUERIES) if not re.match(r"a\d|e|f1|.*stream|g1_scan_options|b14|described", n)]


@pytest.mark.parametrize("name", BUILT)
def test_no_cross_join_and_no_broadcast_by_hint(large, name):
    text = plan(QUERIES[name](large, SF_DIR))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "Broadcast" not in text


def test_page_is_limited_before_the_shuffle(large):
    text = plan(scope.list_tables(roles.catalog(large, SF_DIR), limit=5, offset=2))
    partial = text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1)
    assert text.index("Exchange") < partial


def test_lookup_filters_and_columns_reach_the_scan(large):
    df = store.get_table(
        roles.catalog(large, SF_DIR), "ASIA", "NATION_2", "BUILDING", "Customer#000000007"
    )
    text = plan(df.select("table"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "EqualTo(r_name,ASIA)" in text
    assert "c_acctbal" not in text


# Shuffles of the last step: places by key and part, then one grouping.
@pytest.mark.parametrize(
    "name, most", [("b14_describe_tables", 5), ("described_page", 20), ("e4_render_markdown", 5), ("e8_export", 20)]
)
def test_shuffles_of_nested_records_and_documents(large, name, most):
    text = plan(QUERIES[name](large, SF_DIR))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert len(re.findall(r"\bExchange ", text)) <= most


def test_a_hot_table_meets_no_single_window(large):
    """Places of facts come from a range shuffle, never from a window over a whole table's facts."""
    text = plan(QUERIES["b14_describe_tables"](large, SF_DIR))
    windows = [line for line in text.split("\n") if "Window " in line and "row_number" in line]
    assert windows == []
