"""Small frames for the tests."""

from __future__ import annotations

from shelfmark import model as m
from shelfmark.operators.store import Store

FACT_SCHEMA = "config string, instance string, schema string, table string, section string, " + (
    ", ".join(f"{n} {t}" for n, t in m.FACT_FIELDS.items())
)
TABLE_SCHEMA = "config string, instance string, schema string, table string, " + ", ".join(
    f"{n} {t}" for n, t in m.TABLE_FIELDS.items()
)
K = ("c", "i", "s", "t")


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def facts(spark, *given):
    """Facts from (table, section, {field: value})."""
    data = []
    for table, section, fields in given:
        fields = {"item": "", **fields}
        data.append(("c", "i", "s", table, section, *[fields.get(n) for n in m.FACT_FIELDS]))
    return spark.createDataFrame(data, FACT_SCHEMA)


def tables(spark, *given):
    """Header rows from (table, {field: value})."""
    data = [("c", "i", "s", t, *[fields.get(n) for n in m.TABLE_FIELDS]) for t, fields in given]
    return spark.createDataFrame(data, TABLE_SCHEMA)


def store(spark, headers, listed):
    return Store(tables(spark, *headers), facts(spark, *listed))


def column(name, position=1, **fields):
    return {"column_name": name, "position": position, "data_type": "int", **fields}


def extract(spark, kind, *given):
    from shelfmark.sources.extracts import extract_schema

    return spark.createDataFrame([("c", "i", *r) for r in given], extract_schema(kind))
