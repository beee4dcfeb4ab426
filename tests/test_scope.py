"""C. Enumeration and scoping."""

import pytest

from helpers import rows
from shelfmark.operators import scope

K4 = "config string, instance string, schema string, table string"


def catalog(spark):
    return spark.createDataFrame(
        [
            ("a", "h1", "pub", "t1"), ("a", "h1", "pub", "t2"), ("a", "h1", "pub", "t3"),
            ("a", "h2", "pub", "t1"), ("b", "h1", "pub", "t1"), ("b", "h3", "x", "t9"),
        ],
        K4,
    )


def test_configs_and_hosts(spark):
    configs = spark.createDataFrame(
        [
            ("many", [("h1",), ("h2",)], "unused"), ("one", None, "h3"), ("empty", [], ""),
            ("none", None, None),
        ],
        "config string, hosts array<struct<host:string>>, host string",
    )
    assert rows(scope.config_hosts(configs)) == [("many", "h1"), ("many", "h2"), ("one", "h3")]
    assert rows(scope.list_configs(catalog(spark))) == [("a",), ("b",)]


def test_instances_are_not_deduplicated(spark):
    got = rows(scope.list_instances(catalog(spark), catalog(spark), configs=["b"]))
    assert got == [("b", "h1"), ("b", "h1"), ("b", "h3"), ("b", "h3")]


def test_versions_own_or_coordinator(spark):
    versions = spark.createDataFrame(
        [("a", "h1", "8"), ("b", None, "460"), ("b", None, "461")],
        "config string, instance string, version string",
    )
    some = catalog(spark).select("config", "instance").distinct()
    got = rows(scope.list_instances(some, versions=versions))
    assert got == [("a", "h1", "8"), ("a", "h2", None), ("b", "h1", "460"), ("b", "h3", "460")]


def test_system_schemas(spark):
    df = spark.createDataFrame(
        [
            ("p", "i", "pg_catalog", "t", "postgres"), ("p", "i", "pgdata", "t", "postgres"),
            ("p", "i", "pg", "t", "postgres"), ("p", "i", "public", "t", "postgres"),
            ("m", "i", "mysql", "t", "mysql"), ("m", "i", "pgdata", "t", "mysql"),
            ("g", "i", "admin", "t", "mongodb"), ("t", "i", "information_schema", "t", "trino"),
            ("t", "i", "information_schema", "u", None),
        ],
        K4 + ", dialect string",
    )
    got = rows(scope.list_schemas(df), "config", "schema")
    assert got == [("m", "pgdata"), ("p", "pg"), ("p", "public"), ("t", "information_schema")]


@pytest.mark.parametrize(
    "limit, offset, expected",
    [
        (None, None, 6), (0, None, 0), (2, None, 5), (2, 1, 2), (None, 1, 2), (None, 0, 6), (5, 5, 0),
    ],
)
def test_pages_count_per_schema(spark, limit, offset, expected):
    got = rows(scope.list_tables(catalog(spark), limit=limit, offset=offset))
    assert len(got) == expected
    if (limit, offset) == (2, 1):
        assert got == [("a", "h1", "pub", "t2"), ("a", "h1", "pub", "t3")]


@pytest.mark.parametrize("limit, offset", [(-1, None), (None, -1), ("5", None), (1.5, None)])
def test_bad_pages_are_refused(spark, limit, offset):
    with pytest.raises(ValueError):
        scope.list_tables(catalog(spark), limit=limit, offset=offset)


def test_kinds(spark):
    df = spark.createDataFrame(
        [
            ("c", "i", "s", "t1", "postgres", "BASE TABLE"), ("c", "i", "s", "t2", "postgres", "VIEW"),
            ("c", "i", "s", "t3", "mysql", "VIEW"), ("c", "i", "s", "t4", "sqlite", "view"),
            ("c", "i", "s", "t5", "sqlite", "table"),
        ],
        K4 + ", dialect string, kind string",
    )
    assert [r[3] for r in rows(scope.list_tables(df, by_dialect=True))] == ["t1", "t3", "t5"]
    assert [r[3] for r in rows(scope.list_tables(df, kinds=["VIEW"]))] == ["t2", "t3"]


def test_expand_scope_of_every_null_pattern(spark):
    """Against nested loops over the catalogue."""
    names = ["a", None], ["h1", None], ["pub", None], ["t1", None]
    scopes = [
        (f"{n}", c, i, s, t)
        for n, (c, i, s, t) in enumerate(
            [(c, i, s, t) for c in names[0] for i in names[1] for s in names[2] for t in names[3]]
            + [(None, None, None, None), (None, "nowhere", None, None), ("b", "h2", None, None)]
        )
    ]
    frame = spark.createDataFrame(scopes, "scope_id string, " + K4)
    tables = [tuple(r) for r in catalog(spark).collect()]
    expected = sorted(
        (s[0], *t) for s in scopes for t in tables if all(w in (None, g) for w, g in zip(s[1:], t))
    )
    expanded = scope.expand_scope(catalog(spark), frame)
    assert rows(expanded) == expected
    unmatched = rows(scope.unmatched_scopes(frame, expanded), "error")
    assert unmatched == [("*/nowhere/*/*: not found",), ("b/h2/*/*: not found",)]


def test_expand_scope_does_no_nested_loop(spark):
    frame = spark.createDataFrame([("1", "a", None, None, None)], "scope_id string, " + K4)
    plan = scope.expand_scope(catalog(spark), frame)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_owners(spark):
    requests = spark.createDataFrame(
        [("r1", "h2"), ("r2", "h1"), ("r3", "gone"), ("r4", None)], "request_id string, instance string"
    )
    got = rows(scope.resolve_owner(requests, catalog(spark)))
    assert got == [
        ("r1", "h2", 1, "a", None), ("r2", "h1", 2, None, None),
        ("r3", "gone", 0, None, "Instance 'gone' has no owner."), ("r4", None, 0, None, None),
    ]
