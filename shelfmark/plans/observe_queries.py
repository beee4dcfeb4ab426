"""H, A1, A2. Facts measured from the given tables, and extracts read from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators import describe, observe
from shelfmark.plans import roles
from shelfmark.plans.registry import query
from shelfmark.plans.roles import K4_SQL, ORD, SCHEMAS, t
from shelfmark.sources.extracts import read_extract, read_json_extract
from shelfmark.shared import new_folder


def _columns(name: str) -> list[tuple[str, str]]:
    """Column names and Spark types of a given table."""
    pairs = [c.strip().split(" ", 1) for c in SCHEMAS[name].split(",")]
    return [(n, k.lower()) for n, k in pairs]


def _columns_sql() -> str:
    rows = []
    for name in SCHEMAS:
        for i, (column, kind) in enumerate(_columns(name)):
            rows.append(
                f"SELECT '{name}' AS \"table\", {i + 1} AS position, '{column}' AS column_name,"
                f" '{kind}' AS data_type, count(*) AS rows, count(*) - count({column}) AS nulls,"
                f" count(*) > count({column}) AS is_nullable, 'observed' AS evidence FROM {name}"
            )
    return " UNION ALL ".join(rows)


@query("h1_observe_columns", _columns_sql())
def observe_columns(spark, sf):
    return m.union(*[observe.observe_columns(t(spark, sf, name), name) for name in SCHEMAS])


@query(
    "h2_observe_rows",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS row_count, 'observed' AS evidence FROM {name}"
        for name in SCHEMAS
    ),
)
def observe_rows(spark, sf):
    return m.union(*[observe.observe_rows(t(spark, sf, name), name) for name in SCHEMAS])


KEYS = [
    ("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"),
    ("customer", "c_name"), ("supplier", "s_suppkey"), ("part", "p_partkey"),
    ("part", "p_name"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey,l_linenumber"),
    ("lineitem", "l_orderkey,l_linenumber,l_partkey,l_suppkey"), ("events", "event_id"),
    ("events", "user_id,ts"), ("documents", "doc_id"), ("documents", "text"),
    ("embeddings", "vec_id"), ("pages", "page_id"), ("benchmark", "item_id"),
    ("labels", "doc_id"), ("conversations", "conv_id,turn"),
]


@query(
    "h3_check_key",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", '{key}' AS key, CAST(sum(n) AS BIGINT) AS rows,
        count(*) AS distinct_keys, CAST(0 AS BIGINT) AS null_rows, sum(n) = count(*) AS holds,
        'observed' AS evidence FROM (SELECT count(*) AS n FROM {name} GROUP BY {key})"""
        for name, key in KEYS
    ),
)
def check_key(spark, sf):
    return m.union(
        *[
            observe.check_key(t(spark, sf, name), key.split(",")).withColumn("table", F.lit(name))
            for name, key in KEYS
        ]
    )


@query(
    "h3_find_keys",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", '{key}' AS key, CAST(sum(n) AS BIGINT) AS rows,
        count(*) AS distinct_keys, CAST(0 AS BIGINT) AS null_rows, true AS holds,
        'observed' AS evidence FROM (SELECT count(*) AS n FROM {name} GROUP BY {key}) HAVING sum(n) = count(*)"""
        for name, key in KEYS
    ),
)
def find_keys(spark, sf):
    return m.union(
        *[
            observe.find_keys(t(spark, sf, name), [k.split(",") for n, k in KEYS if n == name]).withColumn("table", F.lit(name))
            for name in dict(KEYS)
        ]
    )


@query(
    "h3_check_unique_index",
    """SELECT 'amount' AS key, count(*) AS rows, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END)
         AS distinct_keys, count(*) FILTER (o_orderstatus = 'P') AS null_rows,
         count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) =
           count(*) FILTER (o_orderstatus <> 'P') AS holds, 'observed' AS evidence FROM orders""",
)
def check_unique_index(spark, sf):
    amount = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return observe.check_key(
        t(spark, sf, "orders").select(amount.alias("amount")), ["amount"], nulls="allow"
    )


REFERENCES = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


@query(
    "h4_check_reference",
    " UNION ALL ".join(
        f"""SELECT '{child}' AS "table", '{c}' AS reference,
        count(*) FILTER ({c} IN (SELECT {p} FROM {parent})) AS matched_rows,
        count(*) FILTER ({c} NOT IN (SELECT {p} FROM {parent})) AS orphan_rows,
        CAST(0 AS BIGINT) AS null_rows, count(*) FILTER ({c} NOT IN (SELECT {p} FROM {parent})) = 0 AS holds,
        'observed' AS evidence FROM {child}"""
        for child, c, parent, p in REFERENCES
    ),
)
def check_reference(spark, sf):
    return m.union(
        *[
            observe.check_reference(
                t(spark, sf, child), [c], t(spark, sf, parent), [p]
            ).withColumn("table", F.lit(child))
            for child, c, parent, p in REFERENCES
        ]
    )


@query(
    "h4_check_references",
    " UNION ALL ".join(
        f"""SELECT '{child}' AS "table", '{c}' AS reference, '{parent}' AS parent,
        count(*) FILTER ({c} IN (SELECT {p} FROM {parent})) AS matched_rows,
        count(*) FILTER ({c} NOT IN (SELECT {p} FROM {parent})) AS orphan_rows,
        CAST(0 AS BIGINT) AS null_rows, count(*) FILTER ({c} NOT IN (SELECT {p} FROM {parent})) = 0 AS holds,
        'observed' AS evidence FROM {child}"""
        for child, c, parent, p in REFERENCES
    ),
)
def check_references(spark, sf):
    tables = {name: t(spark, sf, name) for r in REFERENCES for name in (r[0], r[2])}
    return observe.check_references(tables, [observe.Reference(a, [c], b, [p]) for a, c, b, p in REFERENCES])


LAYOUTS = [
    ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("events", "event_type"),
    ("documents", "source"), ("customer", "c_mktsegment"), ("conversations", "role"),
]


@query(
    "h6_observe_partitions",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", {column} AS value, count(*) AS rows, round(count(*) /
        (SELECT count(*) / count(DISTINCT {column}) FROM {name}), 6) AS skew, 'observed' AS evidence
        FROM {name} GROUP BY {column}"""
        for name, column in LAYOUTS
    ),
)
def observe_partitions(spark, sf):
    return m.union(
        *[observe.observe_partitions(t(spark, sf, name), column, name) for name, column in LAYOUTS]
    )


EXTRACT_SQL = f"""WITH {ORD} SELECT {K4_SQL}, o_orderkey AS position, column_name,
  o_orderpriority AS data_type, o_orderstatus = 'O' AS is_nullable FROM ord"""


def _landed(spark, sf, format: str):
    """Orders landed as a column extract in files of the given format, and read from there."""
    path = new_folder(spark, f"extract-{format}")
    raw = roles.raw_columns_mysql(spark, sf).withColumn("ord", F.col("ord").cast("int"))
    writer = raw.select("config", "instance", "schema", "table", "ord", "Field", "Type", "Null", "Default")
    if format == "csv":
        writer.write.option("header", True).csv(path)
    else:
        writer.write.format(format).save(path)
    columns = describe.columns_mysql(read_extract(spark, path, "columns_mysql", format))
    return columns.select(*m.K4, "position", "column_name", "data_type", "is_nullable")


@query("a1_read_extract_parquet", EXTRACT_SQL)
def read_extract_parquet(spark, sf):
    return _landed(spark, sf, "parquet")


@query("a1_read_extract_csv", EXTRACT_SQL)
def read_extract_csv(spark, sf):
    return _landed(spark, sf, "csv")


@query("a1_read_extract_json", EXTRACT_SQL)
def read_extract_json(spark, sf):
    return _landed(spark, sf, "json")


@query("a1_read_extract_orc", EXTRACT_SQL)
def read_extract_orc(spark, sf):
    return _landed(spark, sf, "orc")


@query(
    "a2_read_json_extract",
    """SELECT 'part_' || p_partkey AS "table", p_name AS column_name, p_type AS data_type,
       p_brand AS comment FROM part""",
)
def read_documents(spark, sf):
    path = new_folder(spark, "documents")
    column = F.struct(
        F.col("p_name").alias("Name"), F.col("p_type").alias("Type"), F.col("p_brand").alias("Comment")
    )
    t(spark, sf, "part").select(
        F.lit("lake").alias("config"),
        F.lit("main").alias("instance"),
        F.lit("parts").alias("schema"),
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("Name"),
        F.struct(F.array(column).alias("Columns")).alias("StorageDescriptor"),
    ).write.json(path)
    facts = describe.columns_glue(read_json_extract(spark, path, "glue"))
    return facts.select("table", "column_name", "data_type", "comment")
