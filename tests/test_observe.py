"""H. Facts measured from data."""

import datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from shelfmark.operators import observe


def data(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", None), (2, "b", 3.0), (None, None, 4.0), (None, "c", 4.0)],
        "k int, v string, x double",
    )


def test_columns_and_rows(spark):
    assert rows(observe.observe_columns(data(spark), "d"), "position", "column_name", "data_type", "rows", "nulls", "is_nullable") == [
        (1, "k", "int", 5, 2, True), (2, "v", "string", 5, 1, True), (3, "x", "double", 5, 1, True),
    ]
    assert rows(observe.observe_rows(data(spark), "d")) == [("d", 5, "observed")]
    empty = observe.observe_columns(data(spark).limit(0), "d")
    assert {(r.rows, r.nulls, r.is_nullable) for r in empty.collect()} == {(0, 0, False)}


@pytest.mark.parametrize(
    "columns, nulls, expected",
    [
        (["k"], "forbid", (5, 2, 2, False)), (["k"], "allow", (5, 2, 2, False)),
        (["k", "v"], "forbid", (5, 3, 2, False)), (["k", "v"], "allow", (5, 3, 2, True)),
    ],
)
def test_keys(spark, columns, nulls, expected):
    got = observe.check_key(data(spark), columns, nulls).first()
    assert (got.rows, got.distinct_keys, got.null_rows, got.holds) == expected


def test_key_of_empty_data_holds(spark):
    got = observe.check_key(data(spark).limit(0), ["k"]).first()
    assert (got.rows, got.distinct_keys, got.null_rows, got.holds) == (0, 0, 0, True)
    with pytest.raises(ValueError):
        observe.check_key(data(spark), ["k"], "some")


def test_references(spark):
    parent = spark.createDataFrame([(2,), (2,), (7,)], "id int")
    got = observe.check_reference(data(spark), ["k"], parent, ["id"]).first()
    assert (got.matched_rows, got.orphan_rows, got.null_rows, got.holds) == (2, 1, 2, False)
    got = observe.check_reference(parent, ["id"], parent, ["id"]).first()
    assert (got.matched_rows, got.orphan_rows, got.holds) == (3, 0, True)


def test_partitions(spark):
    got = rows(observe.observe_partitions(data(spark), "v", "d"), "value", "rows", "skew")
    assert got == [("a", 2, 1.6), ("b", 1, 0.8), ("c", 1, 0.8), (None, 1, 0.8)]


def test_references_at_once_equal_each_alone(spark):
    at = datetime.datetime(2024, 1, 1)
    tables = {
        "a": spark.createDataFrame(
            [(1, "x", 0.0, at), (2, "y", -0.0, at), (2, None, None, None), (None, "1", float("nan"), at), (9, "z", 2.0, at)],
            "k int, v string, d double, at timestamp",
        ),
        "b": spark.createDataFrame(
            [(2, "y", 0, b"1"), (2, "x", 2, b"2"), (None, None, 7, None), (10**12, "1", 8, b"")], "id long, v string, d int, raw binary"
        ),
        "c": spark.createDataFrame([(at, b"1"), (None, b"2")], "at timestamp, raw binary"),
        "none": spark.createDataFrame([], "k int"),
    }
    given = [
        ("a", ["k"], "b", ["id"]), ("b", ["id"], "a", ["k"]), ("a", ["k", "v"], "b", ["id", "v"]), ("a", ["d"], "b", ["d"]),
        ("b", ["d"], "a", ["d"]), ("a", ["v"], "b", ["v"]), ("a", ["at"], "c", ["at"]), ("b", ["raw"], "c", ["raw"]),
        ("a", ["k"], "none", ["k"]), ("none", ["k"], "a", ["k"]), ("a", ["k"], "a", ["k"]),
    ]
    asked = [observe.Reference(*g) for g in given]
    checked = observe.check_references(tables, asked)
    names = ["matched_rows", "orphan_rows", "null_rows", "holds"]
    got = [(r.table, r.reference, r.parent, *[r[n] for n in names]) for r in checked.collect()]
    want = []
    for child, columns, parent, of in given:
        one = observe.check_reference(tables[child], columns, tables[parent].toDF(*[f"p_{c}" for c in tables[parent].columns]), [f"p_{c}" for c in of]).first()
        want.append((child, ",".join(columns), parent, *[one[n] for n in names]))
    assert got == want
    plan = checked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        observe.check_references(tables, [])
    with pytest.raises(ValueError):
        lists = tables["a"].select(F.array("k").alias("k"))
        observe.check_references({"l": lists}, [observe.Reference("l", ["k"], "l", ["k"])])


def test_references_beyond_a_batch(spark, monkeypatch):
    monkeypatch.setattr(observe, "BATCH", 2)
    tables = {"p": spark.range(3).toDF("k"), "c": spark.range(5).toDF("k")}
    got = observe.check_references(tables, [observe.Reference("c", ["k"], "p", ["k"])] * 5)
    assert [(r.matched_rows, r.orphan_rows) for r in got.collect()] == [(3, 2)] * 5


def test_a_hot_value_is_counted_before_the_shuffle(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") < 15_000, 7).otherwise(F.col("id")).alias("k"))
    tables = {"hot": hot, "p": spark.range(10).toDF("k")}
    checked = observe.check_references(tables, [observe.Reference("hot", ["k"], "p", ["k"])])
    got = checked.first()
    assert (got.matched_rows, got.orphan_rows) == (15_000, 5_000)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "partial_count_if" in plan or "partial_count" in plan


def test_sketches_discard_only_what_is_no_key(spark):
    df = spark.range(60_000).select(
        F.col("id").alias("key"), (F.col("id") % 20_000).alias("third"), F.when(F.col("id") > 5, F.col("id")).alias("gaps"),
        F.when(F.col("id") == 0, 1).otherwise(F.col("id")).alias("nearly"), (F.col("id") % 300).alias("a"), F.floor(F.col("id") / 300).alias("b"),
    )
    keys = [["key"], ["third"], ["gaps"], ["nearly"], ["a"], ["b"], ["a", "b"]]
    half = F.col("key") < 30_000
    parts = observe.key_sketches(df.where(half), keys).union(observe.key_sketches(df.where(~half), keys))
    for sketches in (observe.key_sketches(df, keys), parts):
        found = {r.key: r for r in observe.likely_keys(sketches).collect()}
        assert {k for k, r in found.items() if r.likely} == {"key", "nearly", "a,b"}
        assert all(r.rows == 60_000 for r in found.values()) and found["gaps"].null_rows == 6
        exact = {"key": 60_000, "third": 20_000, "gaps": 59_994, "nearly": 59_999, "a": 300, "b": 200, "a,b": 60_000}
        assert all(abs(found[k].estimate - n) <= observe.DEVIATIONS * 1.04 / 2**7 * n for k, n in exact.items())
    assert rows(observe.find_keys(df, keys), "key", "rows", "distinct_keys") == [("a,b", 60_000, 60_000), ("key", 60_000, 60_000)]
    assert rows(observe.find_keys(df, keys, "allow"), "key") == [("a,b",), ("gaps",), ("key",)]
    assert rows(observe.find_keys(df, [["third"]])) == []
    assert rows(observe.find_keys(df.limit(0), [["key"]]), "key", "rows") == [("key", 0)]
    with pytest.raises(ValueError):
        observe.find_keys(df, keys, "some")
