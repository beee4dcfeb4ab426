"""C. Enumeration and scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators import scope
from shelfmark.plans import roles
from shelfmark.plans.registry import query
from shelfmark.plans.roles import CAT, K4_SQL, t


@query("c0_list_configs", f"WITH {CAT} SELECT DISTINCT config FROM cat")
def list_configs(spark, sf):
    return scope.list_configs(roles.catalog(spark, sf))


@query(
    "c0b_config_hosts",
    """SELECT o_orderpriority AS config, unnest(CASE o_orderstatus
         WHEN 'O' THEN ['a_' || o_orderkey, 'b_' || o_custkey] WHEN 'F' THEN ['h_' || o_custkey]
         ELSE CAST([] AS VARCHAR[]) END) AS instance FROM orders""",
)
def config_hosts(spark, sf):
    status = F.col("o_orderstatus")
    host = lambda prefix, key: F.struct(
        F.concat(F.lit(prefix), F.col(key)).alias("host")
    )
    configs = t(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("config"),
        F.when(status == "O", F.array(host("a_", "o_orderkey"), host("b_", "o_custkey"))).alias(
            "hosts"
        ),
        F.when(status == "F", F.concat(F.lit("h_"), F.col("o_custkey")))
        .when(status == "O", F.lit("unused"))
        .otherwise(F.lit(""))
        .alias("host"),
    )
    return scope.config_hosts(configs)


@query(
    "c1_list_instances",
    f"""WITH {CAT} SELECT config, instance FROM cat WHERE config IN ('ASIA', 'EUROPE')
        UNION ALL SELECT config, instance FROM cat WHERE config IN ('ASIA', 'EUROPE')""",
)
def list_instances(spark, sf):
    found = roles.catalog(spark, sf)
    return scope.list_instances(found, found, configs=["ASIA", "EUROPE"])


@query(
    "c1b_instance_versions",
    f"""WITH {CAT} SELECT config, instance, CASE
          WHEN instance IN (SELECT 'NATION_' || s_nationkey FROM supplier) THEN
            (SELECT 'v' || max(s_suppkey) FROM supplier WHERE 'NATION_' || s_nationkey = instance)
          ELSE 'c_' || config END AS version FROM cat""",
)
def instance_versions(spark, sf):
    own = (
        t(spark, sf, "supplier")
        .join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("config"), F.col("n_name").alias("instance"))
        .agg(F.concat(F.lit("v"), F.max("s_suppkey")).alias("version"))
    )
    coordinators = t(spark, sf, "region").select(
        F.col("r_name").alias("config"),
        F.lit(None).cast("string").alias("instance"),
        F.concat(F.lit("c_"), F.col("r_name")).alias("version"),
    )
    return scope.list_instances(
        roles.catalog(spark, sf), versions=own.unionByName(coordinators)
    )


# Orders' customers in schemas that are partly hidden, by dialect.
SCHEMAS_SQL = f"""{CAT},
named AS (SELECT config, instance, CASE WHEN config IN ('ASIA', 'EUROPE') THEN 'postgres'
                 WHEN config = 'AFRICA' THEN 'mysql' ELSE 'trino' END AS dialect,
          CASE "schema" WHEN 'BUILDING' THEN 'information_schema' WHEN 'MACHINERY' THEN 'pgdata'
               WHEN 'HOUSEHOLD' THEN 'sys' ELSE "schema" END AS "schema", "table" FROM cat)"""


def _named_schemas(spark, sf) -> DataFrame:
    schema, config = F.col("schema"), F.col("config")
    return (
        roles.catalog(spark, sf)
        .withColumn(
            "dialect",
            F.when(config.isin("ASIA", "EUROPE"), "postgres")
            .when(config == "AFRICA", "mysql")
            .otherwise("trino"),
        )
        .withColumn(
            "schema",
            F.when(schema == "BUILDING", "information_schema")
            .when(schema == "MACHINERY", "pgdata")
            .when(schema == "HOUSEHOLD", "sys")
            .otherwise(schema),
        )
    )


@query(
    "c2_list_schemas",
    f"""WITH {SCHEMAS_SQL} SELECT DISTINCT config, instance, "schema" FROM named
        WHERE NOT (dialect = 'postgres' AND ("schema" IN ('pg_catalog', 'information_schema', 'pg_toast')
                   OR "schema" LIKE 'pg_%'))
          AND NOT (dialect = 'mysql' AND "schema" IN
                   ('information_schema', 'mysql', 'performance_schema', 'sys'))""",
)
def list_schemas(spark, sf):
    return scope.list_schemas(_named_schemas(spark, sf))


def _page_sql(condition: str) -> str:
    return f"""WITH {CAT}, ranked AS (SELECT *, row_number() OVER
          (PARTITION BY config, instance, "schema" ORDER BY "table") AS rn FROM cat)
        SELECT {K4_SQL} FROM ranked WHERE {condition}"""


@query("c3_list_tables_page", _page_sql("rn > 2 AND rn <= 7"))
def list_tables_page(spark, sf):
    return scope.list_tables(roles.catalog(spark, sf), limit=5, offset=2)


@query("c3_list_tables_offset", _page_sql("rn > 3"))
def list_tables_offset(spark, sf):
    return scope.list_tables(roles.catalog(spark, sf), offset=3)


@query("c3_list_tables_in_schema", _page_sql("\"schema\" = 'BUILDING' AND config = 'ASIA' AND rn <= 4"))
def list_tables_in_schema(spark, sf):
    return scope.list_tables(
        roles.catalog(spark, sf), config="ASIA", schema="BUILDING", limit=4
    )


@query(
    "c3b_listed_kinds",
    f"""WITH {SCHEMAS_SQL} SELECT {K4_SQL} FROM named JOIN customer ON c_name = "table"
        WHERE dialect <> 'postgres' OR c_acctbal >= 0""",
)
def listed_kinds(spark, sf):
    kind = F.when(F.col("c_acctbal") >= 0, "BASE TABLE").otherwise("VIEW")
    return scope.list_tables(_named_schemas(spark, sf).withColumn("kind", kind), by_dialect=True)


def scopes(spark, sf) -> DataFrame:
    """Scopes of every kind: all, each region, each nation, each segment, pairs, each customer by
    name, and suppliers, which are no tables of the catalogue."""
    none = F.lit(None).cast("string")
    cat = roles.catalog(spark, sf)
    shape = lambda df, prefix, key, c=none, i=none, s=none, x=none: df.select(
        F.concat(F.lit(prefix), key).alias("scope_id"),
        c.alias("config"), i.alias("instance"), s.alias("schema"), x.alias("table"),
    )
    region, nation = t(spark, sf, "region"), t(spark, sf, "nation")
    segments = cat.select("schema").distinct()
    pairs = cat.select("config", "schema").distinct()
    return m.union(
        shape(region.where(F.col("r_name") == "ASIA"), "all_", F.col("r_name")),
        shape(region, "config_", F.col("r_name"), c=F.col("r_name")),
        shape(nation, "instance_", F.col("n_name"), i=F.col("n_name")),
        shape(segments, "schema_", F.col("schema"), s=F.col("schema")),
        shape(
            pairs, "pair_", F.concat("config", F.lit("_"), "schema"),
            c=F.col("config"), s=F.col("schema"),
        ),
        shape(
            cat, "table_", F.col("table"),
            c=F.col("config"), i=F.col("instance"), s=F.col("schema"), x=F.col("table"),
        ),
        shape(t(spark, sf, "supplier"), "named_", F.col("s_name"), x=F.col("s_name")),
    )


SCOPES_SQL = f"""{CAT},
scopes AS (
  SELECT 'all_' || r_name AS scope_id, CAST(NULL AS VARCHAR) AS config, CAST(NULL AS VARCHAR) AS instance,
         CAST(NULL AS VARCHAR) AS "schema", CAST(NULL AS VARCHAR) AS "table"
  FROM region WHERE r_name = 'ASIA'
  UNION ALL SELECT 'config_' || r_name, r_name, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'instance_' || n_name, NULL, n_name, NULL, NULL FROM nation
  UNION ALL SELECT DISTINCT 'schema_' || "schema", NULL, NULL, "schema", NULL FROM cat
  UNION ALL SELECT DISTINCT 'pair_' || config || '_' || "schema", config, NULL, "schema", NULL FROM cat
  UNION ALL SELECT 'table_' || "table", config, instance, "schema", "table" FROM cat
  UNION ALL SELECT 'named_' || s_name, NULL, NULL, NULL, s_name FROM supplier),
expanded AS (SELECT scope_id, cat.config, cat.instance, cat."schema", cat."table" FROM scopes s JOIN cat
  ON (s.config IS NULL OR s.config = cat.config) AND (s.instance IS NULL OR s.instance = cat.instance)
 AND (s."schema" IS NULL OR s."schema" = cat."schema") AND (s."table" IS NULL OR s."table" = cat."table"))"""


@query("c4_expand_scope", f"WITH {SCOPES_SQL} SELECT scope_id, {K4_SQL} FROM expanded")
def expand_scope(spark, sf):
    return scope.expand_scope(roles.catalog(spark, sf), scopes(spark, sf))


@query(
    "c4_unmatched_scopes",
    f"""WITH {SCOPES_SQL} SELECT scope_id, '*/*/*/' || "table" || ': not found' AS error
        FROM scopes WHERE scope_id NOT IN (SELECT scope_id FROM expanded)""",
)
def unmatched_scopes(spark, sf):
    given = scopes(spark, sf)
    return scope.unmatched_scopes(given, scope.expand_scope(roles.catalog(spark, sf), given))


@query(
    "c5_resolve_owner",
    """WITH owners AS (SELECT c_mktsegment || '_' || (c_custkey // 2) AS instance,
         CAST(count(DISTINCT c_nationkey) AS BIGINT) AS owners, min(CAST(c_nationkey AS VARCHAR)) AS owner
       FROM customer GROUP BY 1),
     requests AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN 'gone_' || o_orderkey
         ELSE c_mktsegment || '_' || (c_custkey // 2) END AS instance
       FROM orders JOIN customer ON o_custkey = c_custkey)
     SELECT request_id, instance, coalesce(owners, 0) AS owners,
            CASE WHEN owners = 1 THEN owner END AS config,
            CASE WHEN owners IS NULL THEN 'Instance ''' || instance || ''' has no owner.' END AS error
     FROM requests LEFT JOIN owners USING (instance)""",
)
def resolve_owner(spark, sf):
    customer = t(spark, sf, "customer")
    instance = F.concat_ws("_", "c_mktsegment", F.floor(F.col("c_custkey") / 2))
    instances = customer.select(
        F.col("c_nationkey").cast("string").alias("config"), instance.alias("instance")
    )
    gone = F.concat(F.lit("gone_"), F.col("o_orderkey"))
    requests = (
        t(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("request_id"),
            F.when(F.col("o_orderstatus") == "P", gone).otherwise(instance).alias("instance"),
        )
    )
    return scope.resolve_owner(requests, instances)
