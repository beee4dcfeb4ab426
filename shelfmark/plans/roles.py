"""Catalogue extracts derived from the given tables by plain projections and joins.

The given tables hold no catalogue, so each plays a part in one: customers are database tables
(region = configuration, nation = instance, market segment = schema), their orders are columns,
line items are key and index columns, events are scan-job events, documents are tables with long
descriptions.  ``CAT`` and the other SQL texts are the same derivations for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators.store import Store
from shelfmark.shared import written

NOW = "2024-06-01 12:00:00"
NOW_ISO = "2024-06-01T12:00:00+00:00"


def now() -> Column:
    return F.lit(f"{NOW}Z").cast("timestamp")


# Columns of the given tables; declared, so that opening a table reads no file.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
    " c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,"
    " value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


CAT = """cat AS (
  SELECT r_name AS config, n_name AS instance, c_mktsegment AS "schema", c_name AS "table",
         c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
K4_SQL = 'config, instance, "schema", "table"'


def _placed(df: DataFrame, spark: SparkSession, sf: str, nation_key: str) -> DataFrame:
    """Add the two upper levels; nation and region, the smaller sides, come last."""
    nation = t(spark, sf, "nation").withColumnRenamed("n_name", "instance")
    region = t(spark, sf, "region").withColumnRenamed("r_name", "config")
    return df.join(nation, F.col(nation_key) == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").withColumnsRenamed(
        {"c_mktsegment": "schema", "c_name": "table"}
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tables: K4, c_custkey, c_acctbal."""
    placed = _placed(_customers(spark, sf), spark, sf, "c_nationkey")
    return placed.select(*m.K4, "c_custkey", "c_acctbal")


ORD = f"""{CAT},
ord AS (SELECT {K4_SQL}, c_custkey, orders.*, 'c_' || o_orderkey AS column_name
        FROM orders JOIN cat ON o_custkey = c_custkey)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as columns of their customer's table."""
    owned = t(spark, sf, "orders").join(
        _customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")
    )
    return _placed(owned, spark, sf, "c_nationkey").select(
        *m.K4,
        "c_custkey",
        *[c.split()[0] for c in SCHEMAS["orders"].split(", ")],
        F.concat(F.lit("c_"), F.col("o_orderkey")).alias("column_name"),
    )


ITEM = f"""{ORD},
item AS (SELECT {K4_SQL}, o_orderpriority, o_orderstatus, lineitem.*, 'pk_' || l_orderkey AS constraint_name,
                'p_' || l_partkey AS column_name
         FROM lineitem JOIN ord ON l_orderkey = o_orderkey)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as key columns of their customer's table; the constraint is the order.

    Both sides are large, so this is a sort-merge join whatever the estimate.
    """
    named = orders(spark, sf).select(*m.K4, "o_orderkey", "o_orderpriority", "o_orderstatus")
    return (
        t(spark, sf, "lineitem")
        .join(named.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("constraint_name", F.concat(F.lit("pk_"), F.col("l_orderkey")))
        .withColumn("column_name", F.concat(F.lit("p_"), F.col("l_partkey")))
    )


SUP = """sup AS (
  SELECT r_name AS config, n_name AS instance, 'suppliers' AS "schema", s_name AS "table", s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as tables."""
    placed = _placed(t(spark, sf, "supplier"), spark, sf, "s_nationkey")
    return placed.select(
        "config",
        "instance",
        F.lit("suppliers").alias("schema"),
        F.col("s_name").alias("table"),
        "s_suppkey",
    )


def raw_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as constraints; the priority decides the type."""
    priority = F.col("o_orderpriority")
    return orders(spark, sf).select(
        "config",
        "instance",
        F.col("schema").alias("constraint_schema"),
        F.col("table").alias("table_name"),
        F.concat(F.lit("pk_"), F.col("o_orderkey")).alias("constraint_name"),
        F.when(priority == "1-URGENT", "PRIMARY KEY")
        .when(priority == "2-HIGH", "FOREIGN KEY")
        .otherwise("UNIQUE")
        .alias("constraint_type"),
    )


def raw_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as key column usage; returned items name a referenced table."""
    returned = F.col("l_returnflag") == "R"
    return items(spark, sf).select(
        "config",
        "instance",
        F.col("schema").alias("table_schema"),
        F.col("table").alias("table_name"),
        "constraint_name",
        "column_name",
        F.col("l_linenumber").alias("ordinal_position"),
        F.when(returned, "supplier").alias("referenced_table"),
        F.when(returned, F.concat(F.lit("s_"), F.col("l_suppkey"))).alias("referenced_column"),
    )


def raw_columns_mysql(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return orders(spark, sf).select(
        *m.K4,
        F.col("o_orderkey").alias("ord"),
        F.col("column_name").alias("Field"),
        F.col("o_orderpriority").alias("Type"),
        F.when(status == "O", "YES").when(status == "F", "NO").alias("Null"),
        status.alias("Default"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of customers' tables: orders as columns, pending ones also as partitions; line items
    as keys (urgent orders), references (high priority) and indexes (priority not specified)."""
    status, flag = F.col("o_orderstatus"), F.col("l_returnflag")
    sections = F.array_compact(
        F.array(F.lit(m.COLUMN), F.when(status == "P", F.lit(m.PARTITION)))
    )
    listed = orders(spark, sf).withColumn("section", F.explode(sections))
    is_column = F.col("section") == m.COLUMN
    of_orders = m.facts(
        listed,
        F.col("section"),
        position=F.col("o_orderkey"),
        column_name=F.col("column_name"),
        data_type=F.col("o_orderpriority"),
        is_nullable=F.when(is_column, F.coalesce(status == "O", F.lit(False))),
        default_value=F.when(is_column, status),
    )
    roles = {
        "1-URGENT": m.PRIMARY_KEY, "2-HIGH": m.FOREIGN_KEY, "4-NOT SPECIFIED": m.INDEX,
    }
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    used = items(spark, sf).where(F.col("o_orderpriority").isin(list(roles)))
    section = F.try_element_at(role, F.col("o_orderpriority"))
    is_reference, is_index = section == m.FOREIGN_KEY, section == m.INDEX
    of_items = m.facts(
        used,
        section,
        item=F.when(is_reference, F.col("constraint_name"))
        .when(is_index, F.concat(F.lit("idx_"), flag))
        .otherwise(F.lit("")),
        position=F.col("l_linenumber"),
        column_name=F.col("column_name"),
        referenced_table=F.when(is_reference, F.lit("supplier")),
        referenced_column=F.when(is_reference, F.concat(F.lit("s_"), F.col("l_suppkey"))),
        is_unique=F.when(is_index, flag != "R"),
        is_primary=F.when(is_index, flag == "N"),
    )
    return m.union(of_orders, of_items)


def json_text(value: Column) -> Column:
    """A custom field's JSON text from a plain name."""
    return F.concat(F.lit('"'), value, F.lit('"'))


def tables(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' tables with documentation and custom fields.

    Documentation names the customer's newest order as a column; one segment has none.
    """
    newest = (
        t(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"))
    )
    known = catalog(spark, sf).join(newest, F.col("c_custkey") == F.col("o_custkey"), "left")
    has_text = F.col("schema") != "MACHINERY"
    described = F.map_from_arrays(
        F.array(F.concat(F.lit("c_"), F.col("newest"))), F.array(F.lit("newest | order"))
    )
    ai = F.struct(
        F.concat(F.lit("Orders of "), F.col("table")).alias("summary"),
        F.when(F.col("newest").isNotNull(), described).alias("column_descriptions"),
        F.lit("2024-01-01 00:00:00Z").cast("timestamp").alias("generated_at"),
        F.lit("m").alias("model"),
    )
    custom = F.create_map(
        F.lit("owner"), json_text(F.col("instance")),
        F.lit("tags"), F.lit('["crm","orders"]'),
        F.lit("notes"), json_text(F.col("config")),
    )
    return m.tables(
        known,
        ai_documentation=F.when(has_text, ai),
        custom=custom,
        updated_at=F.lit("2024-01-01 00:00:00Z").cast("timestamp"),
    )


def store(spark: SparkSession, sf: str) -> Store:
    """Customers' tables with their facts, which are written first: rendering reads them by
    section and should not repeat the joins they come from."""
    return Store(tables(spark, sf), written(facts(spark, sf), "facts"))


DOC_K4 = """lang AS config, source AS instance, 'docs' AS "schema", 'doc_' || doc_id AS "table\""""


def document_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as tables whose summary is the whole text."""
    ai = F.struct(
        F.col("text").alias("summary"),
        F.lit(None).cast("map<string,string>").alias("column_descriptions"),
        F.lit(None).cast("timestamp").alias("generated_at"),
        F.lit("m").alias("model"),
    )
    named = t(spark, sf, "documents").select(
        F.col("lang").alias("config"),
        F.col("source").alias("instance"),
        F.lit("docs").alias("schema"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("table"),
        "doc_id",
        "text",
    )
    return m.tables(
        named,
        ai_documentation=ai,
        custom=F.create_map(F.lit("owner"), json_text(F.col("instance"))),
        updated_at=F.lit("2024-01-01 00:00:00Z").cast("timestamp"),
    )


EV = """ev AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id, event_id AS seq, ts, user_id,
         event_type, value, props FROM events)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scan-job events; a job is one user's day."""
    return t(spark, sf, "events").select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
    )


def text_time(c: str | Column) -> Column:
    """A time as text, to compare it with SQL."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
