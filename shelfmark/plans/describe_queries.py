"""B. Normalising extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions.types import DYNAMO_TYPES, normalise_type
from shelfmark.operators import describe
from shelfmark.operators.scope import list_tables
from shelfmark.plans import roles
from shelfmark.plans.registry import query
from shelfmark.plans.roles import CAT, ITEM, K4_SQL, ORD, SUP, t

def shown(facts: DataFrame) -> DataFrame:
    return facts.select(*m.K4, "section", *m.FACT_FIELDS)


def fact_sql(source: str, section: str, **fields: str) -> str:
    """SELECT of facts in SQL; fields not given are null, ``item`` is ''."""
    fields = {"item": "''", **fields}
    columns = []
    for name, kind in m.FACT_FIELDS.items():
        sql_type = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN"}[kind]
        columns.append(f"CAST({fields.get(name, 'NULL')} AS {sql_type}) AS {name}")
    return f"SELECT {K4_SQL}, {section} AS section, {', '.join(columns)} FROM {source}"


@query(
    "b1_columns_mysql",
    f"WITH {ORD} "
    + fact_sql(
        "ord", "'column'", position="o_orderkey", column_name="column_name",
        data_type="o_orderpriority", is_nullable="o_orderstatus = 'O'", default_value="o_orderstatus",
    ),
)
def columns_mysql(spark, sf):
    return shown(describe.columns_mysql(roles.raw_columns_mysql(spark, sf)))


@query(
    "b2_columns_postgres",
    f"""WITH {ORD},
    descr AS (SELECT config, instance, o_custkey AS objoid, o_orderkey AS objsubid,
                     o_orderstatus || ' ' || o_orderpriority AS description
              FROM ord WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
    joined AS (SELECT o.*, d.description FROM ord o
      LEFT JOIN cat st ON st.config = o.config AND st.instance = o.instance
        AND st."schema" = o."schema" AND st."table" = o."table"
      LEFT JOIN descr d ON d.config = st.config AND d.instance = st.instance
        AND d.objoid = st.c_custkey AND d.objsubid = o.o_orderkey) """
    + fact_sql(
        "joined", "'column'", position="o_orderkey", column_name="column_name",
        data_type="o_orderpriority", is_nullable="o_orderstatus = 'O'", comment="description",
    ),
)
def columns_postgres(spark, sf):
    ord_ = roles.orders(spark, sf)
    cols = ord_.select(
        "config",
        "instance",
        F.col("schema").alias("table_schema"),
        F.col("table").alias("table_name"),
        "column_name",
        F.col("o_orderkey").alias("ordinal_position"),
        F.col("o_orderpriority").alias("data_type"),
        F.when(F.col("o_orderstatus") == "O", "YES").otherwise("NO").alias("is_nullable"),
        F.lit(None).cast("string").alias("column_default"),
    )
    stats = roles.catalog(spark, sf).select(
        "config",
        "instance",
        F.col("schema").alias("schemaname"),
        F.col("table").alias("relname"),
        F.col("c_custkey").alias("relid"),
    )
    descr = ord_.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "config",
        "instance",
        F.col("o_custkey").alias("objoid"),
        F.col("o_orderkey").alias("objsubid"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("description"),
    )
    return shown(describe.columns_postgres(cols, stats, descr))


def _pragma(spark, sf) -> DataFrame:
    """Orders as table_info rows: finished orders are NOT NULL, urgent ones are in the key."""
    return roles.orders(spark, sf).select(
        *m.K4,
        F.col("o_orderkey").alias("cid"),
        F.col("column_name").alias("name"),
        F.col("o_orderpriority").alias("type"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("notnull"),
        F.col("o_orderstatus").alias("dflt_value"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") + 1)
        .otherwise(0)
        .alias("pk"),
    )


@query(
    "b3_columns_sqlite",
    f"WITH {ORD} "
    + fact_sql(
        "ord", "'column'", position="o_orderkey + 1", column_name="column_name",
        data_type="o_orderpriority",
        is_nullable="o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'",
        default_value="o_orderstatus",
    ),
)
def columns_sqlite(spark, sf):
    return shown(describe.columns_sqlite(_pragma(spark, sf)))


@query(
    "b4_columns_duckdb",
    f"WITH {ORD} "
    + fact_sql(
        "ord", "'column'", position="o_orderkey + 1", column_name="column_name",
        data_type="o_orderpriority", is_nullable="o_orderstatus <> 'F'",
        default_value="o_orderstatus",
    ),
)
def columns_duckdb(spark, sf):
    return shown(describe.columns_duckdb(_pragma(spark, sf)))


@query(
    "b5_columns_trino",
    f"WITH {ORD} "
    + fact_sql(
        "ord", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'partition' ELSE 'column' END",
        position="o_orderkey", column_name="column_name", data_type="o_orderpriority",
        is_nullable="CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderstatus <> 'F' END",
        default_value="CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderstatus END",
        comment="CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END",
    ),
)
def columns_trino(spark, sf):
    status = F.col("o_orderstatus")
    raw = roles.orders(spark, sf).select(
        "config",
        "instance",
        F.col("schema").alias("table_schema"),
        F.col("table").alias("table_name"),
        "column_name",
        F.col("o_orderkey").alias("ordinal_position"),
        F.col("o_orderpriority").alias("data_type"),
        F.when(status == "F", "no").when(status == "O", "yes").alias("is_nullable"),
        status.alias("column_default"),
        F.when(status == "O", "").otherwise(status).alias("comment"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Partition Key")
        .when(status == "P", "extra")
        .alias("extra_info"),
    )
    return shown(describe.columns_trino(raw))


NAMED_ORDERS = """named AS (
  SELECT o_orderstatus AS config, o_orderpriority AS instance, 'default' AS "schema",
         'order_' || o_orderkey AS "table", * FROM orders)"""


def _named_orders(spark, sf) -> DataFrame:
    """Orders as tables of a nested catalogue: one document each."""
    return t(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("config"),
        F.col("o_orderpriority").alias("instance"),
        F.lit("default").alias("schema"),
        F.concat(F.lit("order_"), F.col("o_orderkey")).alias("name"),
        "*",
    )


def _glue(name, kind, comment):
    return F.struct(name.alias("Name"), kind.alias("Type"), comment.alias("Comment"))


@query(
    "b6_columns_glue",
    f"WITH {NAMED_ORDERS} "
    + fact_sql(
        "named", "'column'", position="1", column_name="o_orderpriority",
        data_type="'string'", is_nullable="true",
    )
    + " UNION ALL "
    + fact_sql(
        "named", "'column'", position="2", column_name="'c_' || o_custkey", data_type="'char'",
        is_nullable="true", comment="o_orderpriority",
    )
    + " UNION ALL "
    + fact_sql(
        "named WHERE o_orderstatus <> 'P'", "'partition'", position="1",
        column_name="'o_orderdate'", data_type="'date'", comment="'by day'",
    ),
)
def columns_glue(spark, sf):
    docs = _named_orders(spark, sf).select(
        "config",
        "instance",
        "schema",
        F.col("name").alias("Name"),
        F.struct(
            F.array(
                _glue(F.col("o_orderpriority"), F.lit("string"), F.lit("")),
                _glue(
                    F.concat(F.lit("c_"), F.col("o_custkey")), F.lit("char"),
                    F.col("o_orderpriority"),
                ),
            ).alias("Columns")
        ).alias("StorageDescriptor"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.array(_glue(F.lit("o_orderdate"), F.lit("date"), F.lit("by day"))),
        ).alias("PartitionKeys"),
    )
    return shown(describe.columns_glue(docs))


def _attribute(name, kind):
    return F.struct(name.alias("AttributeName"), kind.alias("AttributeType"))


def _key(name, kind):
    return F.struct(name.alias("AttributeName"), F.lit(kind).alias("KeyType"))


def _dynamo(spark, sf) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    pending = status == "P"
    hash_key, range_key = _key(priority, "HASH"), _key(status, "RANGE")
    index = lambda prefix, name, *keys: F.struct(
        F.concat(F.lit(prefix), name).alias("IndexName"), F.array(*keys).alias("KeySchema")
    )
    return _named_orders(spark, sf).select(
        "config",
        "instance",
        "schema",
        F.col("name").alias("TableName"),
        F.array(
            _attribute(priority, F.lit("S")),
            _attribute(status, F.lit("N")),
            _attribute(F.concat(F.lit("c_"), F.col("o_custkey")), status),
        ).alias("AttributeDefinitions"),
        F.when(pending, F.array(hash_key))
        .otherwise(F.array(hash_key, range_key))
        .alias("KeySchema"),
        F.array(index("g_", status, _key(status, "HASH"), _key(priority, "RANGE"))).alias(
            "GlobalSecondaryIndexes"
        ),
        F.when(~pending, F.array(index("l_", priority, _key(priority, "HASH")))).alias(
            "LocalSecondaryIndexes"
        ),
    )


@query(
    "b7_columns_dynamo",
    f"WITH {NAMED_ORDERS} "
    + " UNION ALL ".join(
        [
            fact_sql(
                "named", "'column'", position="1", column_name="o_orderpriority",
                data_type="'String'", is_nullable="false",
            ),
            fact_sql(
                "named", "'column'", position="2", column_name="o_orderstatus",
                data_type="'Number'", is_nullable="false",
            ),
            fact_sql(
                "named", "'column'", position="3", column_name="'c_' || o_custkey",
                data_type="o_orderstatus", is_nullable="false",
            ),
            fact_sql("named", "'primary_key'", position="1", column_name="o_orderpriority"),
            fact_sql(
                "named WHERE o_orderstatus <> 'P'", "'sort_key'", position="1",
                column_name="o_orderstatus",
            ),
            fact_sql(
                "named", "'partition'", position="1", column_name="o_orderpriority",
                data_type="'String'",
            ),
        ]
    ),
)
def columns_dynamo(spark, sf):
    return shown(describe.columns_dynamo(_dynamo(spark, sf)))


NAMED_EVENTS = """named AS (
  SELECT 'users' AS config, 'user_' || user_id AS instance, event_type AS "schema",
         'event_' || event_id AS "table", props->>'k' AS k, * FROM events)"""


def _mongo(spark, sf) -> DataFrame:
    """Events as collections: properties ``k`` and one named by the user; errors have no schema."""
    kind = F.col("event_type")
    typed = (
        F.when(kind == "click", '"bsonType":"long"')
        .when(kind == "view", '"type":"objectId"')
        .when(kind == "signup", '"bsonType":"geo","description":"place"')
        .otherwise('"title":"untyped"')
    )
    user = F.concat(F.lit("u_"), F.col("user_id"))
    schema = F.concat(
        F.lit('{"bsonType":"object","required":["k"],"properties":{"k":'),
        F.lit('{"bsonType":["null","int"],"description":"","title":"'), F.col("props.k"),
        F.lit('"},"'), user, F.lit('":{'), typed, F.lit("}}}"),
    )
    unique = F.when(kind == "click", "true").otherwise("false")
    indexes = F.concat(
        F.lit('{"_id_":{"key":[["_id",1]]},"by_'), user, F.lit('":{"key":[["'), user,
        F.lit('",1],["k",-1]],"unique":'), unique, F.lit("}}"),
    )
    parsed = t(spark, sf, "events").withColumn("text", F.col("props")).withColumn(
        "props", F.from_json("props", "k string")
    )
    return parsed.select(
        F.lit("users").alias("config"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("instance"),
        kind.alias("db"),
        F.concat(F.lit("event_"), F.col("event_id")).alias("name"),
        F.when(kind != "error", schema).alias("json_schema"),
        indexes.alias("indexes"),
        F.when(kind != "view", F.col("text")).alias("shard_key"),
    )


@query(
    "b8_columns_mongo",
    f"WITH {NAMED_EVENTS} "
    + fact_sql(
        "named WHERE event_type <> 'error'", "'column'", position="1", column_name="'k'",
        data_type="'int32'", is_nullable="false", comment="k",
    )
    + " UNION ALL "
    + fact_sql(
        "named WHERE event_type <> 'error'", "'column'", position="2",
        column_name="'u_' || user_id",
        data_type="CASE event_type WHEN 'click' THEN 'int64' WHEN 'view' THEN 'ObjectId'"
        " WHEN 'signup' THEN 'geo' ELSE 'unknown' END",
        is_nullable="true",
        comment="CASE event_type WHEN 'signup' THEN 'place' WHEN 'purchase' THEN 'untyped' END",
    ),
)
def columns_mongo(spark, sf):
    return shown(describe.columns_mongo(_mongo(spark, sf)))


@query(
    "b9_primary_keys",
    f"WITH {ITEM} "
    + fact_sql(
        "item WHERE o_orderpriority = '1-URGENT'", "'primary_key'", position="l_linenumber",
        column_name="column_name",
    ),
)
def primary_keys(spark, sf):
    return shown(
        describe.primary_keys(roles.raw_constraints(spark, sf), roles.raw_usage(spark, sf))
    )


@query(
    "b9_primary_keys_mysql",
    f"WITH {ITEM} "
    + fact_sql(
        "item WHERE l_returnflag = 'A'", "'primary_key'", position="l_linenumber",
        column_name="column_name",
    ),
)
def primary_keys_mysql(spark, sf):
    usage = roles.items(spark, sf).select(
        "config",
        "instance",
        F.col("schema").alias("table_schema"),
        F.col("table").alias("table_name"),
        F.when(F.col("l_returnflag") == "A", "PRIMARY")
        .otherwise(F.col("constraint_name"))
        .alias("constraint_name"),
        "column_name",
        F.col("l_linenumber").alias("ordinal_position"),
    )
    return shown(describe.primary_keys_mysql(usage))


@query(
    "b9_primary_keys_sqlite",
    f"WITH {ORD} "
    + fact_sql(
        "ord WHERE o_orderpriority = '1-URGENT'", "'primary_key'", position="o_orderkey + 1",
        column_name="column_name",
    ),
)
def primary_keys_sqlite(spark, sf):
    return shown(describe.primary_keys_sqlite(_pragma(spark, sf)))


@query(
    "b9_primary_keys_duckdb",
    f"WITH {ORD} "
    + fact_sql(
        "ord WHERE o_orderpriority = '1-URGENT'", "'primary_key'", position="1",
        column_name="column_name",
    )
    + " UNION ALL "
    + fact_sql(
        "ord WHERE o_orderpriority = '1-URGENT'", "'primary_key'", position="2",
        column_name="o_orderstatus",
    ),
)
def primary_keys_duckdb(spark, sf):
    raw = roles.orders(spark, sf).select(
        "config",
        "instance",
        F.col("schema").alias("schema_name"),
        F.col("table").alias("table_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "PRIMARY KEY")
        .otherwise("CHECK")
        .alias("constraint_type"),
        F.array("column_name", "o_orderstatus").alias("constraint_column_names"),
    )
    return shown(describe.primary_keys_duckdb(raw))


@query(
    "b10_foreign_keys",
    f"""WITH {ITEM},
    named AS (SELECT constraint_name, l_linenumber, 's_' || min(l_suppkey) AS target FROM item GROUP BY ALL),
    joined AS (SELECT item.*, target FROM item JOIN named USING (constraint_name, l_linenumber)
     WHERE o_orderpriority = '2-HIGH') """
    + fact_sql(
        "joined", "'foreign_key'", item="constraint_name", position="l_linenumber",
        column_name="column_name", referenced_table="'supplier'", referenced_column="target",
    ),
)
def foreign_keys(spark, sf):
    named = roles.items(spark, sf).groupBy(
        "config", "instance", "schema", "constraint_name", "l_linenumber"
    )
    referenced = named.agg(F.min("l_suppkey").alias("target")).select(
        "config",
        "instance",
        F.col("schema").alias("constraint_schema"),
        "constraint_name",
        F.lit("supplier").alias("table_name"),
        F.concat(F.lit("s_"), F.col("target")).alias("column_name"),
        F.col("l_linenumber").alias("ordinal_position"),
    )
    return shown(
        describe.foreign_keys(
            roles.raw_constraints(spark, sf), roles.raw_usage(spark, sf), referenced
        )
    )


@query(
    "b10_foreign_keys_mysql",
    f"WITH {ITEM} "
    + fact_sql(
        "item WHERE l_returnflag = 'R'", "'foreign_key'", item="constraint_name",
        position="l_linenumber", column_name="column_name", referenced_table="'supplier'",
        referenced_column="'s_' || l_suppkey",
    ),
)
def foreign_keys_mysql(spark, sf):
    return shown(describe.foreign_keys_mysql(roles.raw_usage(spark, sf)))


@query(
    "b10_foreign_keys_sqlite",
    f"WITH {ITEM} "
    + fact_sql(
        "item", "'foreign_key'", position="l_orderkey * 32768 + l_linenumber + 1",
        column_name="column_name", referenced_table="'supplier'",
        referenced_column="'s_' || l_suppkey",
    ),
)
def foreign_keys_sqlite(spark, sf):
    raw = roles.items(spark, sf).select(
        *m.K4,
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("seq"),
        F.lit("supplier").alias("referenced"),
        F.col("column_name").alias("from"),
        F.concat(F.lit("s_"), F.col("l_suppkey")).alias("to"),
    )
    return shown(describe.foreign_keys_sqlite(raw))


@query(
    "b11_indexes",
    f"WITH {SUP}, ix AS (SELECT * FROM lineitem JOIN sup ON l_suppkey = s_suppkey) "
    + fact_sql(
        "ix", "'index'",
        item="CASE l_returnflag WHEN 'A' THEN 'PRIMARY' ELSE 'ix_' || l_returnflag END",
        position="l_linenumber", column_name="'p_' || l_partkey", is_unique="l_linestatus = 'F'",
        is_primary="l_returnflag IN ('A', 'N')", index_type="'BTREE'",
    ),
)
def indexes(spark, sf):
    flag = F.col("l_returnflag")
    raw = (
        t(spark, sf, "lineitem")
        .join(roles.suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            *m.K4,
            F.when(flag == "A", "PRIMARY")
            .otherwise(F.concat(F.lit("ix_"), flag))
            .alias("index_name"),
            F.concat(F.lit("p_"), F.col("l_partkey")).alias("column_name"),
            F.col("l_linenumber").alias("seq"),
            (F.col("l_linestatus") != "F").alias("non_unique"),
            F.when(flag == "N", F.lit(True)).alias("is_primary"),
            F.lit("BTREE").alias("index_type"),
        )
    )
    return shown(describe.indexes(raw))


@query(
    "b11b_index_columns_from_ddl",
    """SELECT p_partkey, p_type AS first_name, 'lower(' || p_name AS second_name,
              CAST(2 AS BIGINT) AS names
       FROM part""",
)
def index_columns_from_ddl(spark, sf):
    ddl = F.concat(
        F.lit("CREATE INDEX i_"), F.col("p_partkey"), F.lit(" ON "), F.col("p_brand"),
        F.lit(" ("), F.col("p_type"), F.lit(",  lower("), F.col("p_name"), F.lit("), p_size)"),
    )
    names = describe.index_columns_from_ddl(ddl)
    return t(spark, sf, "part").select(
        "p_partkey",
        names[0].alias("first_name"),
        names[1].alias("second_name"),
        F.size(names).cast("bigint").alias("names"),
    )


@query(
    "b11b_index_columns_in_texts",
    r"""WITH inner_text AS (SELECT page_id, regexp_extract(html, '\(([^)]+)\)', 1) AS inside FROM pages)
    SELECT page_id, CASE WHEN inside = '' THEN 0 ELSE len(string_split(inside, ',')) END AS names,
           CASE WHEN inside = '' THEN '' ELSE array_to_string(list_transform(string_split(inside, ','),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ';') END AS joined FROM inner_text""",
)
def index_columns_in_texts(spark, sf):
    names = describe.index_columns_from_ddl("html")
    return t(spark, sf, "pages").select(
        "page_id",
        F.size(names).cast("bigint").alias("names"),
        F.array_join(names, ";").alias("joined"),
    )


@query(
    "b11b_indexes_from_ddl",
    """WITH named AS (SELECT p_brand AS config, p_type AS instance, 'main' AS "schema",
         'part_' || p_partkey AS "table", * FROM part) """
    + fact_sql(
        "named WHERE p_size > 0", "'index'", item="'i_' || p_partkey", position="1",
        column_name="p_name", is_unique="p_size > 25", is_primary="false",
    )
    + " UNION ALL "
    + fact_sql(
        "named", "'index'", item="'i_' || p_partkey", position="2", column_name="'p_size'",
        is_unique="p_size > 25", is_primary="false",
    ),
)
def indexes_from_ddl(spark, sf):
    raw = t(spark, sf, "part").select(
        F.col("p_brand").alias("config"),
        F.col("p_type").alias("instance"),
        F.lit("main").alias("schema"),
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("table"),
        F.concat(F.lit("i_"), F.col("p_partkey")).alias("index_name"),
        (F.col("p_size") > 25).alias("is_unique"),
        F.lit(None).cast("boolean").alias("is_primary"),
        F.concat(F.lit("CREATE INDEX x ON t("), F.col("p_name"), F.lit(", p_size)")).alias("sql"),
    )
    return shown(describe.indexes_from_ddl(raw))


def _attributes(spark, sf) -> DataFrame:
    """Line items as attributes of their order's table."""
    return t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("relid"),
        F.col("l_linenumber").alias("attnum"),
        F.concat(F.lit("p_"), F.col("l_partkey")).alias("column_name"),
        F.col("l_returnflag").alias("data_type"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("comment"),
    ).join(
        _named_orders(spark, sf).select("config", "instance", F.col("o_orderkey").alias("relid")),
        "relid",
    )


KEYS_SQL = f"""{NAMED_ORDERS},
place AS (SELECT n.*, unnest([o_custkey % 7 + 1, 0, o_orderkey % 5 + 1]) AS attnum,
                 unnest([1, 2, 3]) AS position FROM named n),
found AS (SELECT p.*, 'p_' || l_partkey AS column_name, l_returnflag,
                 CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS note
          FROM place p JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = attnum)"""


def _key_places(spark, sf, name) -> DataFrame:
    return _named_orders(spark, sf).select(
        "config",
        "instance",
        "schema",
        F.col("name").alias("table"),
        F.col("o_orderkey").alias("relid"),
        F.lit("ix").alias("index_name"),
        (F.col("o_orderstatus") == "F").alias("is_unique"),
        F.lit(False).alias("is_primary"),
        F.lit("btree").alias("index_type"),
        F.array(F.col("o_custkey") % 7 + 1, F.lit(0), F.col("o_orderkey") % 5 + 1)
        .cast("array<int>")
        .alias(name),
    )


@query(
    "b11c_indexes_postgres",
    f"WITH {KEYS_SQL} "
    + fact_sql(
        "found", "'index'", item="'ix'", position="position", column_name="column_name",
        is_unique="o_orderstatus = 'F'", is_primary="false", index_type="'btree'",
    ),
)
def indexes_postgres(spark, sf):
    raw = _key_places(spark, sf, "indkey")
    return shown(describe.indexes_postgres(raw, _attributes(spark, sf)))


@query(
    "b11d_indexes_dynamo",
    f"WITH {NAMED_ORDERS} "
    + " UNION ALL ".join(
        [
            fact_sql(
                "named", "'index'", item="'g_' || o_orderstatus", position="1",
                column_name="o_orderstatus", is_unique="false", is_primary="false",
                index_type="'GSI'",
            ),
            fact_sql(
                "named", "'index'", item="'g_' || o_orderstatus", position="2",
                column_name="o_orderpriority", is_unique="false", is_primary="false",
                index_type="'GSI'",
            ),
            fact_sql(
                "named WHERE o_orderstatus <> 'P'", "'index'", item="'l_' || o_orderpriority",
                position="1", column_name="o_orderpriority", is_unique="false",
                is_primary="false", index_type="'LSI'",
            ),
        ]
    ),
)
def indexes_dynamo(spark, sf):
    return shown(describe.indexes_dynamo(_dynamo(spark, sf)))


@query(
    "b11e_indexes_mongo",
    f"WITH {NAMED_EVENTS} "
    + " UNION ALL ".join(
        [
            fact_sql(
                "named", "'index'", item="'_id_'", position="1", column_name="'_id'",
                is_unique="true", is_primary="true",
            ),
            fact_sql(
                "named", "'index'", item="'by_u_' || user_id", position="1",
                column_name="'u_' || user_id", is_unique="event_type = 'click'",
                is_primary="false",
            ),
            fact_sql(
                "named", "'index'", item="'by_u_' || user_id", position="2", column_name="'k'",
                is_unique="event_type = 'click'", is_primary="false",
            ),
        ]
    ),
)
def indexes_mongo(spark, sf):
    return shown(describe.indexes_mongo(_mongo(spark, sf)))


@query(
    "b12_partitions_postgres",
    f"WITH {KEYS_SQL} "
    + fact_sql(
        "found", "'partition'", position="position", column_name="column_name",
        data_type="l_returnflag", comment="note",
    ),
)
def partitions_postgres(spark, sf):
    raw = _key_places(spark, sf, "partattrs")
    return shown(describe.partitions_postgres(raw, _attributes(spark, sf)))


@query(
    "b12_partitions_mongo",
    f"WITH {NAMED_EVENTS} "
    + fact_sql(
        "named WHERE event_type <> 'view'", "'partition'", position="1", column_name="'k'",
        data_type="'unknown'",
    ),
)
def partitions_mongo(spark, sf):
    return shown(describe.partitions_mongo(_mongo(spark, sf)))


@query(
    "b13_normalise_types",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'String' WHEN 'F' THEN 'Number' ELSE 'P' END
       AS data_type FROM orders""",
)
def normalise_types(spark, sf):
    status = F.col("o_orderstatus")
    given = F.when(status == "O", "S").when(status == "F", "N").otherwise(status)
    return t(spark, sf, "orders").select(
        "o_orderkey", normalise_type(given, DYNAMO_TYPES).alias("data_type")
    )


FACTS_SQL = f"""{ITEM},
columns_of AS (SELECT {K4_SQL}, count(*) AS n_columns,
    string_agg(column_name || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS column_list
  FROM ord GROUP BY ALL),
keys_of AS (SELECT {K4_SQL}, string_agg(column_name, ',' ORDER BY l_linenumber, column_name) AS key_list
  FROM item WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
refs_of AS (SELECT {K4_SQL}, string_agg(column_name || '>supplier.s_' || l_suppkey, ','
    ORDER BY constraint_name, l_linenumber, column_name, 's_' || l_suppkey) AS reference_list
  FROM item WHERE o_orderpriority = '2-HIGH' GROUP BY ALL),
one_index AS (SELECT {K4_SQL}, l_returnflag,
    'idx_' || l_returnflag || '(' || string_agg(column_name, ',' ORDER BY l_linenumber, column_name) || ')' AS one
  FROM item WHERE o_orderpriority = '4-NOT SPECIFIED' GROUP BY {K4_SQL}, l_returnflag),
indexes_of AS (SELECT {K4_SQL}, string_agg(one, ',' ORDER BY l_returnflag) AS index_list
  FROM one_index GROUP BY ALL),
parts_of AS (SELECT {K4_SQL}, string_agg(column_name || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS partition_list
  FROM ord WHERE o_orderstatus = 'P' GROUP BY ALL)"""


def flat(nested: DataFrame) -> DataFrame:
    """Nested records with their lists as texts."""
    typed = lambda c: F.concat(c["name"], F.lit(":"), c["data_type"])
    join = lambda items: F.array_join(items, ",")
    return nested.select(
        *m.K4,
        "part",
        F.size("columns").cast("bigint").alias("n_columns"),
        join(F.transform("columns", typed)).alias("column_list"),
        F.coalesce(join("primary_key.column_names"), F.lit("")).alias("key_list"),
        join(
            F.transform(
                "foreign_keys",
                lambda k: F.concat(
                    k["column_name"], F.lit(">"), k["referenced_table"], F.lit("."),
                    k["referenced_column"],
                ),
            )
        ).alias("reference_list"),
        join(
            F.transform(
                "indexes",
                lambda i: F.concat(i["name"], F.lit("("), join(i["column_names"]), F.lit(")")),
            )
        ).alias("index_list"),
        join(
            F.transform(
                "partitions", lambda p: F.concat(p["column_name"], F.lit(":"), p["data_type"])
            )
        ).alias("partition_list"),
    )


@query(
    "b14_describe_tables",
    f"""WITH {FACTS_SQL}
    SELECT {K4_SQL}, 0 AS part, n_columns, column_list, coalesce(key_list, '') AS key_list,
           coalesce(reference_list, '') AS reference_list, coalesce(index_list, '') AS index_list,
           coalesce(partition_list, '') AS partition_list
    FROM columns_of LEFT JOIN keys_of USING ({K4_SQL}) LEFT JOIN refs_of USING ({K4_SQL})
      LEFT JOIN indexes_of USING ({K4_SQL}) LEFT JOIN parts_of USING ({K4_SQL})""",
)
def describe_tables(spark, sf):
    return flat(describe.describe_tables(roles.facts(spark, sf)))


@query(
    "b15_undescribed",
    f"""WITH {NAMED_EVENTS} SELECT {K4_SQL}, 'No readable JSON schema is declared for ' || "schema" || '.' || "table"
        AS error FROM named WHERE event_type = 'error'""",
)
def undescribed(spark, sf):
    return describe.undescribed(_mongo(spark, sf))


@query(
    "b15_mongo_tables",
    f"""WITH {NAMED_EVENTS}, kind AS (SELECT *, event_id % 4 AS cut FROM named)
        SELECT {K4_SQL}, CASE WHEN event_type = 'error' OR cut > 0
            THEN 'No readable JSON schema is declared for ' || "schema" || '.' || "table" END AS error,
          CASE WHEN event_type = 'error' OR cut > 0 THEN 0
            WHEN event_type = 'view' THEN 5 ELSE 6 END AS facts FROM kind""",
)
def mongo_tables(spark, sf):
    """Collections with a readable schema have facts; the others (none declared, cut off, no object)
    an error only."""
    cut = F.regexp_extract("name", r"(\d+)$", 1).cast("bigint") % 4
    schema = F.col("json_schema")
    docs = _mongo(spark, sf).withColumn(
        "json_schema",
        F.when(cut == 0, schema)
        .when(cut == 1, schema.substr(F.lit(1), F.length(schema) - 1))
        .when(cut == 2, F.lit("[1]")),
    )
    facts, errors = describe.mongo_tables(docs)
    counted = facts.select(*m.K4, F.lit(None).cast("string").alias("error"), F.lit(1).alias("n"))
    refused = errors.select(*m.K4, "error", F.lit(0).alias("n"))
    return m.union(counted, refused).groupBy(*m.K4).agg(
        F.max("error").alias("error"), F.sum("n").alias("facts")
    )


@query(
    "b15_not_found",
    f"""WITH {CAT} SELECT {K4_SQL}, 'Table `' || "table" || '` not found.' AS error FROM cat
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')""",
)
def not_found(spark, sf):
    recent = roles.orders(spark, sf).where(F.col("o_orderdate") >= F.lit("2001-01-01"))
    described = m.facts(recent, m.COLUMN, column_name=F.col("column_name"))
    return describe.not_found(roles.catalog(spark, sf), described)


FLAGSHIP_SQL = f"""WITH {FACTS_SQL},
page AS (SELECT {K4_SQL}, row_number() OVER (PARTITION BY config, instance, "schema" ORDER BY "table") AS rn
         FROM cat QUALIFY rn <= 5)
SELECT {K4_SQL}, 0 AS part, coalesce(n_columns, 0) AS n_columns, coalesce(column_list, '') AS column_list,
       coalesce(key_list, '') AS key_list
FROM page LEFT JOIN columns_of USING ({K4_SQL}) LEFT JOIN keys_of USING ({K4_SQL})"""


@query("described_page", FLAGSHIP_SQL)
def described_page(spark, sf):
    """First five tables of every schema with their columns and key: page first, so that only the
    facts of the paged tables are grouped."""
    page = list_tables(roles.catalog(spark, sf), limit=5)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    listed = m.union(
        describe.columns_mysql(roles.raw_columns_mysql(spark, sf)),
        m.facts(
            roles.items(spark, sf).where(urgent),
            m.PRIMARY_KEY,
            position=F.col("l_linenumber"),
            column_name=F.col("column_name"),
        ),
    ).join(page, m.K4, "left_semi")
    described = flat(describe.describe_tables(listed)).select(
        *m.K4, "part", "n_columns", "column_list", "key_list"
    )
    return page.join(described, m.K4, "left").select(
        *m.K4,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("n_columns", F.lit(0)).cast("bigint").alias("n_columns"),
        F.coalesce("column_list", F.lit("")).alias("column_list"),
        F.coalesce("key_list", F.lit("")).alias("key_list"),
    )
