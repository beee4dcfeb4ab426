"""C. Listing configurations, instances, schemas and tables, and expanding scopes.

A *catalogue* frame has ``K4`` (one row per table, plus ``kind`` where kinds are filtered and
``dialect`` where system schemas are hidden).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import model as m

# Schemas of the systems themselves, hidden from listings, per dialect.
SYSTEM_SCHEMAS = {
    "mysql": ["information_schema", "mysql", "performance_schema", "sys"],
    "postgres": ["pg_catalog", "information_schema", "pg_toast"],
    "mongodb": ["admin", "local", "config"],
}
# Fixed value: further hidden names there; '_' of a LIKE pattern matches any one character.
POSTGRES_HIDDEN = "^pg."

# Keys over which the tables below a coarse scope are dealt.
SALTS = 16

# Table kinds listed per dialect; dialects not named list every kind.
LISTED_KINDS = {"postgres": ["BASE TABLE"], "sqlite": ["table"]}


def list_configs(catalog: DataFrame) -> DataFrame:
    """C0. Distinct configuration names."""
    return catalog.select("config").distinct()


def config_hosts(configs: DataFrame) -> DataFrame:
    """C0b. ``config, hosts ARRAY<STRUCT<host>>, host`` to one row per host.

    The array wins over the single host; with neither there is no row and the instances have to
    be discovered.
    """
    many = F.transform("hosts", lambda h: h["host"])
    one = F.filter(F.array("host"), lambda h: h.isNotNull() & (h != ""))
    chosen = F.when(F.coalesce(F.size("hosts"), F.lit(0)) > 0, many).otherwise(one)
    return configs.select("config", F.explode(chosen).alias("instance"))


def list_instances(
    *sources: DataFrame, configs: list[str] | None = None, versions: DataFrame | None = None
) -> DataFrame:
    """C1, C1b. Instances of the chosen configurations, concatenated without removing duplicates.

    ``versions`` (``config, instance, version``) adds each server's version.  A row with a null
    instance holds the version of a coordinator and counts for every instance of its config.
    """
    listed = m.union(*[s.select("config", "instance") for s in sources])
    if configs:
        listed = listed.where(F.col("config").isin(configs))
    if versions is None:
        return listed
    own = versions.where(F.col("instance").isNotNull())
    coordinator = (
        versions.where(F.col("instance").isNull())
        .groupBy("config")
        .agg(F.min("version").alias("shared"))
    )
    return (
        listed.join(own, ["config", "instance"], "left")
        .join(coordinator, "config", "left")
        .select("config", "instance", F.coalesce("version", "shared").alias("version"))
    )


def is_system_schema(dialect: str = "dialect", schema: str = "schema") -> Column:
    """True for a schema name that its dialect hides.  A literal test, no join."""
    hidden = [
        (F.col(dialect) == name) & F.col(schema).isin(names)
        for name, names in SYSTEM_SCHEMAS.items()
    ]
    hidden.append((F.col(dialect) == "postgres") & F.col(schema).rlike(POSTGRES_HIDDEN))
    return F.coalesce(reduce(lambda a, b: a | b, hidden), F.lit(False))


def list_schemas(
    catalog: DataFrame, config: str | None = None, instance: str | None = None
) -> DataFrame:
    """C2. Distinct schemas in scope without those of the systems themselves."""
    return (
        _in_scope(catalog, config=config, instance=instance)
        .where(~is_system_schema())
        .select("config", "instance", "schema")
        .distinct()
    )


def _in_scope(catalog: DataFrame, **names: str | None) -> DataFrame:
    for level, name in names.items():
        if name is not None:
            catalog = catalog.where(F.col(level) == name)
    return catalog


def check_page(limit: int | None, offset: int | None) -> None:
    """Limit and offset are null or integers from 0."""
    for name, value in (("limit", limit), ("offset", offset)):
        if value is None:
            continue
        if not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} is an integer of at least 0 or None, not {value!r}")


def listed_kind(dialect: str = "dialect", kind: str = "kind") -> Column:
    """C3b. True for the kinds of table a dialect lists."""
    rules = [
        (F.col(dialect) != name) | F.col(kind).isin(kinds) for name, kinds in LISTED_KINDS.items()
    ]
    return reduce(and_, rules)


def list_tables(
    catalog: DataFrame,
    config: str | None = None,
    instance: str | None = None,
    schema: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
    kinds: list[str] | None = None,
    by_dialect: bool = False,
) -> DataFrame:
    """C3, C3b. Tables in scope; limit and offset count per schema, by table name.

    A bounded page is a rank filter, which Spark applies per task before the shuffle, so a schema
    with most of the tables moves only its first ``offset + limit`` names per task.  An offset
    without a limit ranks only the names to leave out and removes them by an anti join.
    """
    check_page(limit, offset)
    listed = _in_scope(catalog, config=config, instance=instance, schema=schema)
    if kinds:
        listed = listed.where(F.col("kind").isin(kinds))
    if by_dialect:
        listed = listed.where(listed_kind())
    listed = listed.select(*m.K4)
    if limit is not None:
        start = offset or 0
        return _first(listed, start + limit).where(F.col("rn") > start).drop("rn")
    if offset:
        return listed.join(_first(listed, offset).drop("rn"), m.K4, "left_anti")
    return listed


def _first(listed: DataFrame, n: int) -> DataFrame:
    per_schema = Window.partitionBy("config", "instance", "schema").orderBy("table")
    return listed.withColumn("rn", F.row_number().over(per_schema)).where(F.col("rn") <= n)


def expand_scope(catalog: DataFrame, scopes: DataFrame) -> DataFrame:
    """C4. Tables each scope covers: ``scope_id, K4``; a null level means all of that level.

    ``scopes``: ``scope_id`` and the four names.  A catalogue row stands for one candidate per
    pattern of null levels that occurs among the scopes (16 at most, asked for first), and one
    null-safe equi join on the four names finds the scopes: no condition with OR, no nested loop, one
    scan.  Where no table is named, very many rows share their names, so their candidates are dealt
    over ``SALTS`` keys, to each of which the scope goes.  A scope that covers nothing has no row
    (see ``unmatched_scopes``).
    """
    bits = {k: 1 << i for i, k in enumerate(m.K4)}
    pattern = sum(F.when(F.col(k).isNull(), 0).otherwise(bit) for k, bit in bits.items())
    present = sorted(r["pattern"] for r in scopes.select(pattern.alias("pattern")).distinct().collect())
    names_table = lambda given: given & bits["table"]

    def candidate(given: int) -> Column:
        names = [
            (F.col(k) if given & bit else F.lit(None)).cast("string").alias(f"s_{k}")
            for k, bit in bits.items()
        ]
        salt = F.lit(0) if names_table(given) else F.pmod(F.hash(*m.K4), F.lit(SALTS))
        return F.struct(*names, salt.alias("s_salt"))

    candidates = F.array(*[candidate(p) for p in present or [0]])
    rows = catalog.select(*m.K4, F.inline(candidates))
    salts = F.when(F.col("table").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    wanted = scopes.select(
        "scope_id", *[F.col(k).alias(f"w_{k}") for k in m.K4], F.explode(salts).alias("w_salt")
    )
    same = reduce(and_, [F.col(f"s_{k}").eqNullSafe(F.col(f"w_{k}")) for k in m.K4])
    return rows.join(wanted, same & (F.col("s_salt") == F.col("w_salt"))).select("scope_id", *m.K4)


def unmatched_scopes(scopes: DataFrame, expanded: DataFrame) -> DataFrame:
    """C4. Scopes that cover no table, as error rows: a name is not taken as given."""
    label = F.concat_ws("/", *[F.coalesce(F.col(k), F.lit("*")) for k in m.K4])
    return scopes.join(expanded, "scope_id", "left_anti").select(
        "scope_id", F.concat(label, F.lit(": not found")).alias("error")
    )


def resolve_owner(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """C5. Add to requests (with ``instance``) the configuration that owns the instance.

    Exactly one owner is bound as ``config``; with several the request stays unbound and covers
    all of them; with none it is an ``error``.
    """
    owners = catalog.groupBy("instance").agg(
        F.count_distinct("config").alias("owners"), F.min("config").alias("owner")
    )
    return requests.join(owners, "instance", "left").select(
        *requests.columns,
        F.coalesce("owners", F.lit(0)).alias("owners"),
        F.when(F.col("owners") == 1, F.col("owner")).alias("config"),
        F.when(
            F.col("owners").isNull() & F.col("instance").isNotNull(),
            F.concat(F.lit("Instance '"), F.col("instance"), F.lit("' has no owner.")),
        ).alias("error"),
    )
