"""D, A3, A4. The metadata store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions.text import iso, sanitize
from shelfmark.operators import describe, store
from shelfmark.operators.store import Store
from shelfmark.plans import roles
from shelfmark.plans.registry import query
from shelfmark.plans.roles import CAT, DOC_K4, K4_SQL, NOW_ISO, ORD, now, t
from shelfmark.shared import new_folder, written
from shelfmark.sources import documents
from shelfmark.sources.commits import vacuum
from shelfmark.sources.pages import index_names, names_page
from shelfmark.sources.store import compact_store, read_store, update_store, write_store


@query(
    "d1_metadata_key",
    f"""WITH {CAT} SELECT {K4_SQL}, config || '::' || instance || '::' || "schema" || '::' || "table"
        AS metadata_key FROM cat""",
)
def metadata_keys(spark, sf):
    return store.with_metadata_key(roles.catalog(spark, sf).select(*m.K4))


SAFE = r"'[^\p{L}\p{N}_.\-]', '_', 'g'"


@query(
    "d2_sanitize",
    f"""SELECT 'page' AS source, page_id AS id, regexp_replace(url, {SAFE}) AS safe FROM pages
        UNION ALL SELECT 'document', doc_id, regexp_replace(text, {SAFE}) FROM documents""",
)
def sanitized(spark, sf):
    pages = t(spark, sf, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), sanitize("url").alias("safe")
    )
    texts = t(spark, sf, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), sanitize("text").alias("safe")
    )
    return pages.union(texts)


# Two statuses of an order differ in a character that is not safe, so their paths collide.
@query(
    "d2b_sanitize_collisions",
    """WITH named AS (SELECT o_orderpriority AS a, 'c_' || o_custkey AS b,
         CASE o_orderstatus WHEN 'O' THEN 'a/b' WHEN 'F' THEN 'a_b' ELSE 'a.b' END AS c FROM orders),
       paths AS (SELECT regexp_replace(a, '[^\\p{L}\\p{N}_.\\-]', '_', 'g') || '/' || b || '/s/'
         || replace(c, '/', '_') || '.md' AS path, count(DISTINCT a || '|' || b || '|' || c) AS tables
         FROM named GROUP BY 1)
       SELECT path, tables FROM paths WHERE tables > 1""",
)
def sanitize_collisions(spark, sf):
    status = F.col("o_orderstatus")
    named = t(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("config"),
        F.concat(F.lit("c_"), F.col("o_custkey")).alias("instance"),
        F.lit("s").alias("schema"),
        F.when(status == "O", "a/b").when(status == "F", "a_b").otherwise("a.b").alias("table"),
    )
    return store.sanitize_collisions(named)


# The store holds the state before 2001: tables that had orders by then, with those orders.  The
# scan covers every segment but one and sees all orders.  So there are tables that are new, changed,
# unchanged, and not in the scan.
CUT = "2001-01-01"
SNAPSHOTS_SQL = f"""{ORD},
old_t AS (SELECT DISTINCT {K4_SQL}, c_custkey FROM ord WHERE o_orderdate < TIMESTAMP '{CUT}'),
new_t AS (SELECT DISTINCT {K4_SQL}, c_custkey FROM ord WHERE "schema" <> 'MACHINERY'),
touched AS (SELECT DISTINCT c_custkey FROM ord WHERE o_orderdate >= TIMESTAMP '{CUT}'),
merged AS (SELECT coalesce(o.config, n.config) AS config, coalesce(o.instance, n.instance) AS instance,
   coalesce(o."schema", n."schema") AS "schema", coalesce(o."table", n."table") AS "table",
   coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
   CASE WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.c_custkey IS NULL THEN 'insert'
        WHEN n.c_custkey NOT IN (SELECT c_custkey FROM touched) THEN 'unchanged' ELSE 'update' END AS action
  FROM old_t o FULL OUTER JOIN new_t n ON o.c_custkey = n.c_custkey)"""


def _columns(ord_: DataFrame) -> DataFrame:
    return m.facts(
        ord_,
        m.COLUMN,
        position=F.col("o_orderkey"),
        column_name=F.col("column_name"),
        data_type=F.col("o_orderpriority"),
    )


def snapshots(spark, sf) -> tuple[Store, Store]:
    """The store before 2001 and the scan."""
    ord_ = roles.orders(spark, sf)
    before = ord_.where(F.col("o_orderdate") < F.lit(CUT))
    scanned = ord_.where(F.col("schema") != "MACHINERY")
    ai = lambda text: F.struct(
        text.alias("summary"),
        F.lit(None).cast("map<string,string>").alias("column_descriptions"),
        F.lit(None).cast("timestamp").alias("generated_at"),
        F.lit("m").alias("model"),
    )
    old = m.tables(
        before.select(*m.K4).distinct(),
        ai_documentation=ai(F.concat(F.lit("old "), F.col("table"))),
        custom=F.create_map(
            F.lit("owner"), roles.json_text(F.col("instance")), F.lit("table_name"), F.lit('"x"')
        ),
        updated_at=F.lit("2001-01-01 00:00:00Z").cast("timestamp"),
    )
    new = m.tables(
        scanned.select(*m.K4).distinct(),
        ai_documentation=F.when(
            F.col("schema") == "BUILDING", ai(F.concat(F.lit("new "), F.col("table")))
        ),
    )
    return Store(old, _columns(before)), Store(new, _columns(scanned))


def shown_tables(tables: DataFrame) -> DataFrame:
    return tables.select(
        *m.K4,
        "action",
        F.col("ai_documentation.summary").alias("summary"),
        F.try_element_at("custom", F.lit("owner")).alias("owner"),
        F.try_element_at("custom", F.lit("table_name")).alias("stray"),
        iso("updated_at").alias("updated_at"),
    )


def _merge_sql(rows: str = "", unchanged: bool = True) -> str:
    action = "action" if unchanged else "CASE action WHEN 'unchanged' THEN 'update' ELSE action END"
    return f"""WITH {SNAPSHOTS_SQL}, acted AS (SELECT * REPLACE ({action} AS action) FROM merged)
    SELECT {K4_SQL}, action,
      CASE WHEN action IN ('insert', 'update') AND "schema" = 'BUILDING' THEN 'new ' || "table"
           WHEN action <> 'insert' THEN 'old ' || "table" END AS summary,
      CASE WHEN action <> 'insert' THEN '"' || instance || '"' END AS owner,
      CASE WHEN action IN ('kept', 'unchanged') THEN '"x"' END AS stray,
      CASE WHEN action IN ('insert', 'update') THEN '{NOW_ISO}'
           ELSE '2001-01-01T00:00:00+00:00' END AS updated_at
    FROM acted {rows}"""


@query("d3_merge_metadata", _merge_sql(unchanged=False))
def merge_metadata(spark, sf):
    old, new = snapshots(spark, sf)
    return shown_tables(store.merge_metadata(old, new, now()).tables)


@query("d4_merge_only_if_changed", _merge_sql())
def merge_only_if_changed(spark, sf):
    old, new = snapshots(spark, sf)
    return shown_tables(store.merge_metadata(old, new, now(), only_if_changed=True).tables)


CHANGED_SQL = f"""WITH {SNAPSHOTS_SQL} SELECT {K4_SQL} FROM merged WHERE action = 'update'
    UNION ALL SELECT DISTINCT {K4_SQL} FROM old_t WHERE c_custkey NOT IN (SELECT c_custkey FROM new_t)
    UNION ALL SELECT DISTINCT {K4_SQL} FROM new_t WHERE c_custkey NOT IN (SELECT c_custkey FROM old_t)"""


@query("d4_changed_tables", CHANGED_SQL)
def changed_tables(spark, sf):
    old, new = snapshots(spark, sf)
    return store.changed_tables(old.facts, new.facts)


@query("d4_changed_fingerprints", CHANGED_SQL)
def changed_fingerprints(spark, sf):
    old, new = snapshots(spark, sf)
    return store.changed_tables(old.facts, new.facts, exact=False)


MERGED_FACTS_SQL = f"""WITH {SNAPSHOTS_SQL} SELECT ord.config, ord.instance, ord."schema", ord."table",
      o_orderkey AS position, column_name, o_orderpriority AS data_type
    FROM ord JOIN merged ON ord.c_custkey = merged.c_custkey
    WHERE action <> 'kept' OR o_orderdate < TIMESTAMP '{CUT}'"""


@query("d3_merged_facts", MERGED_FACTS_SQL)
def merged_facts(spark, sf):
    old, new = snapshots(spark, sf)
    facts = store.merge_metadata(old, new, now(), only_if_changed=True).facts
    return facts.select(*m.K4, "position", "column_name", "data_type")


@query("d14_merge_without_saving", _merge_sql("WHERE action <> 'kept'"))
def merge_without_saving(spark, sf):
    old, new = snapshots(spark, sf)
    merged = store.merge_metadata(old, new, now(), only_if_changed=True, save=False)
    return shown_tables(merged.scanned.tables)


PATCHED_SQL = f"""docs AS (SELECT {DOC_K4}, doc_id FROM documents),
  owners AS (SELECT instance, "schema", "table", min(config) AS config FROM docs GROUP BY ALL),
  known AS (SELECT docs.* FROM docs JOIN owners USING (config, instance, "schema", "table"))"""


def patches(spark, sf) -> DataFrame:
    """Labels as patches of documents' tables, some of them with a field that is protected, some
    with documentation, and one more per label for a table that does not exist."""
    text = lambda c: F.col(c).cast("string")
    toxic = F.col("toxic") == 1
    payload = F.when(
        toxic,
        F.create_map(
            F.lit("toxic"), text("toxic"), F.lit("owner"), F.lit('"review"'),
            F.lit("table_name"), F.lit('"x"'),
            F.lit("ai_documentation"),
            F.concat(F.lit('{"summary":"reviewed '), text("doc_id"), F.lit('","model":"p"}')),
        ),
    ).otherwise(F.create_map(F.lit("quality"), text("quality"), F.lit("updated_at"), F.lit('"x"')))
    labelled = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id")
    shape = lambda prefix: labelled.select(
        F.col("source").alias("instance"),
        F.lit("docs").alias("schema"),
        F.concat(F.lit(prefix), F.col("doc_id")).alias("table"),
        F.col("doc_id").alias("seq"),
        payload.alias("payload"),
    )
    return shape("doc_").union(shape("none_"))


@query(
    "d7_annotate",
    f"""WITH {PATCHED_SQL} SELECT docs.config, docs.instance, docs."schema", docs."table",
      CASE WHEN toxic = 1 THEN '"review"' ELSE '"' || docs.instance || '"' END AS owner,
      CASE WHEN toxic = 0 THEN CAST(quality AS VARCHAR) END AS quality,
      CASE WHEN toxic = 1 THEN '1' END AS toxic,
      CASE WHEN toxic = 1 THEN 'reviewed ' || docs.doc_id ELSE text END AS summary,
      CASE WHEN l.doc_id IS NULL THEN '2024-01-01T00:00:00+00:00' ELSE '{NOW_ISO}' END AS updated_at,
      CASE WHEN toxic = 1 THEN 2 WHEN toxic = 0 THEN 2 ELSE 1 END AS fields
    FROM docs JOIN documents d ON d.doc_id = docs.doc_id
      LEFT JOIN labels l ON l.doc_id = docs.doc_id""",
)
def annotate(spark, sf):
    patched = store.annotate(roles.document_tables(spark, sf), patches(spark, sf), now())
    field = lambda name: F.try_element_at("custom", F.lit(name)).alias(name)
    return patched.select(
        *m.K4,
        field("owner"),
        field("quality"),
        field("toxic"),
        F.col("ai_documentation.summary").alias("summary"),
        iso("updated_at").alias("updated_at"),
        F.size("custom").alias("fields"),
    )


@query(
    "d7b_annotated_facts",
    f"""WITH {ORD} SELECT {K4_SQL}, 'patched' AS column_name, c_mktsegment AS data_type
        FROM cat JOIN customer USING (c_custkey) WHERE customer.c_acctbal < 0
        UNION ALL SELECT {K4_SQL}, column_name, o_orderpriority FROM ord
        WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def annotated_facts(spark, sf):
    ord_ = roles.orders(spark, sf)
    own = Store(roles.tables(spark, sf), _columns(ord_))
    text = F.concat(
        F.lit('{"columns":[{"name":"patched","data_type":"'), F.col("schema"), F.lit('"}]}')
    )
    given = (
        roles.catalog(spark, sf)
        .where(F.col("c_acctbal") < 0)
        .select(
            "instance", "schema", "table", F.col("c_custkey").alias("seq"),
            F.create_map(F.lit("schema_description"), text).alias("payload"),
        )
    )
    return store.annotated_facts(own, given).select(*m.K4, "column_name", "data_type")


@query(
    "d7_stale_patches",
    f"""WITH {PATCHED_SQL} SELECT instance, "schema", "table" FROM known
        JOIN labels USING (doc_id) WHERE toxic = 1""",
)
def stale_patches(spark, sf):
    based = patches(spark, sf).withColumn(
        "based_on",
        F.when(F.map_contains_key("payload", "toxic"), F.lit("2023-01-01 00:00:00Z"))
        .otherwise(F.lit("2024-01-01 00:00:00Z"))
        .cast("timestamp"),
    )
    return store.stale_patches(roles.document_tables(spark, sf), based).select(
        "instance", "schema", "table"
    )


@query(
    "d8_get_table",
    f"""WITH {CAT} SELECT {K4_SQL}, c_custkey FROM cat WHERE config = 'ASIA' AND instance = 'NATION_2'
        AND "schema" = 'BUILDING' AND "table" = (SELECT min("table") FROM cat WHERE config = 'ASIA'
        AND instance = 'NATION_2' AND "schema" = 'BUILDING')""",
)
def get_table(spark, sf):
    cat = roles.catalog(spark, sf)
    found = store.get_table
    first = (
        cat.where(
            (F.col("config") == "ASIA") & (F.col("instance") == "NATION_2")
            & (F.col("schema") == "BUILDING")
        )
        .agg(F.min("table"))
        .scalar()
    )
    return found(cat, "ASIA", "NATION_2", "BUILDING", first).select(*m.K4, "c_custkey")


@query(
    "d9_find_tables",
    """SELECT min(r_name) AS config, o_orderstatus AS instance, 's' AS "schema",
              'p_' || l_partkey AS "table"
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY o_orderstatus, l_partkey""",
)
def find_tables(spark, sf):
    named = (
        roles.items(spark, sf)
        .select(
            "config",
            F.col("o_orderstatus").alias("instance"),
            F.lit("s").alias("schema"),
            F.col("column_name").alias("table"),
        )
        .distinct()
    )
    return store.find_tables(named)


@query(
    "d9_find_table",
    f"""WITH {CAT}, twice AS (SELECT {K4_SQL} FROM cat UNION ALL SELECT 'ZZ', {K4_SQL[8:]} FROM cat),
        first AS (SELECT {K4_SQL} FROM cat ORDER BY "table" LIMIT 1)
        SELECT {K4_SQL} FROM twice SEMI JOIN first USING (instance, "schema", "table")
        ORDER BY config LIMIT 1""",
)
def find_table(spark, sf):
    cat = roles.catalog(spark, sf).select(*m.K4)
    twice = cat.union(cat.withColumn("config", F.lit("ZZ")))
    first = cat.agg(F.min_by(F.struct(*m.K4), "table").alias("t"))
    of = lambda k: first.select(f"t.{k}").scalar()
    return store.find_table(twice, of("instance"), of("schema"), of("table"))


def _names_sql(level: str, where: str, number: int, size: int) -> str:
    return f"""WITH {CAT}, names AS (SELECT DISTINCT {level} AS name FROM cat {where}),
      shown AS (SELECT name FROM names ORDER BY name LIMIT {size} OFFSET {(number - 1) * size})
      SELECT coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM shown), '') AS items,
        (SELECT count(*) FROM names) AS total, {number} AS page, {size} AS page_size,
        CAST(ceil((SELECT count(*) FROM names) / {size}) AS BIGINT) AS pages"""


def _shown_page(page: DataFrame) -> DataFrame:
    return page.withColumn("items", F.array_join("items", ","))


@query("d10_instances_page", _names_sql("instance", "", 2, 10))
def instances_page(spark, sf):
    names = store.distinct_names(roles.catalog(spark, sf), "instance")
    return _shown_page(store.page(names, 2, 10))


@query("d11_databases_page", _names_sql('"schema"', "WHERE instance = 'NATION_3'", 1, 3))
def databases_page(spark, sf):
    names = store.distinct_names(roles.catalog(spark, sf), "schema", instance="NATION_3")
    return _shown_page(store.page(names, 1, 3))


@query(
    "d12_tables_page",
    _names_sql('"table"', "WHERE instance = 'NATION_3' AND \"schema\" = 'BUILDING'", 1, 200),
)
def tables_page(spark, sf):
    names = store.distinct_names(
        roles.catalog(spark, sf), "table", instance="NATION_3", schema="BUILDING"
    )
    return _shown_page(store.page(names, 1, 200))


@query("d12_no_tables_page", _names_sql('"table"', "WHERE instance = 'nowhere'", 1, 20))
def no_tables_page(spark, sf):
    names = store.distinct_names(roles.catalog(spark, sf), "table", instance="nowhere")
    return _shown_page(store.page(names))


INDEXED_PAGES = [
    ("instance", "", 2, 10, {}),
    ("schema", "WHERE instance = 'NATION_3'", 1, 3, {"instance": "NATION_3"}),
    ("table", "WHERE instance = 'NATION_3' AND \"schema\" = 'BUILDING'", 2, 4,
     {"instance": "NATION_3", "schema": "BUILDING"}),
]


# Half of the tables are scanned after the other half was indexed; the pages are of all.
@query(
    "d10_indexed_pages",
    " UNION ALL ".join(
        f"""SELECT '{level}' AS level, * FROM ({_names_sql(f'"{level}"', where, number, size)})"""
        for level, where, number, size, _ in INDEXED_PAGES
    ),
)
def indexed_pages(spark, sf):
    path = new_folder(spark, "store")
    first, second = _parts(roles.store(spark, sf), F.crc32("table") % 2, 2)
    write_store(first, path)
    index_names(spark, path)
    update_store(store.merge_metadata(read_store(spark, path), second, now()), path)
    index_names(spark, path)
    return m.union(
        *[
            _shown_page(names_page(spark, path, level, number, size, **within)).withColumn("level", F.lit(level))
            for level, _, number, size, within in INDEXED_PAGES
        ]
    )


@query(
    "d13_search",
    """SELECT doc_id FROM documents WHERE contains(lower(text), 'thand')
       OR contains(lower(source), 'thand') OR contains(lower(lang), 'thand')""",
)
def search(spark, sf):
    hits = store.search(t(spark, sf, "documents"), ["text", "source", "lang"], "ThAnd")
    return hits.select("doc_id")


FACT_ROWS_SQL = f"""WITH {ORD} SELECT {K4_SQL}, o_orderkey AS position, column_name,
    o_orderpriority AS data_type, o_orderstatus = 'O' AS is_nullable FROM ord"""


@query("a4_store_round_trip", FACT_ROWS_SQL)
def store_round_trip(spark, sf):
    """Write two versions and read the latest."""
    path = new_folder(spark, "store")
    facts = describe.columns_mysql(roles.raw_columns_mysql(spark, sf))
    tables = roles.tables(spark, sf)
    write_store(Store(tables.limit(0), facts.limit(0)), path)
    write_store(Store(tables, facts), path)
    return read_store(spark, path).facts.select(
        *m.K4, "position", "column_name", "data_type", "is_nullable"
    )


# The store after a scan of one instance: only the schemas that changed are written again.
@query(
    "a4_store_update",
    f"""WITH {SNAPSHOTS_SQL} SELECT ord.config, ord.instance, ord."schema", ord."table",
          o_orderkey AS position, column_name, o_orderpriority AS data_type
        FROM ord JOIN merged ON ord.c_custkey = merged.c_custkey
        WHERE (merged.instance = 'NATION_3' AND action <> 'kept') OR o_orderdate < TIMESTAMP '{CUT}'""",
)
def store_update(spark, sf):
    path = new_folder(spark, "store")
    old, new = snapshots(spark, sf)
    write_store(old, path)
    one = F.col("instance") == "NATION_3"
    part = read_store(spark, path, config=None, instance="NATION_3")
    scan = Store(new.tables.where(one), new.facts.where(one))
    update_store(store.merge_metadata(part, scan, now(), only_if_changed=True), path)
    return read_store(spark, path).facts.select(*m.K4, "position", "column_name", "data_type")


def _parts(scan: Store, share: Column, n: int) -> list[Store]:
    """A scan in ``n`` scans of disjoint tables."""
    return [Store(scan.tables.where(share == k), scan.facts.where(share == k)) for k in range(n)]


# Both scans are merged with the same version, and have tables of every schema; the first one to commit is
# not undone by the second, which merges again.
@query("a4_interleaved_scans", MERGED_FACTS_SQL)
def interleaved_scans(spark, sf):
    path = new_folder(spark, "store")
    old, new = snapshots(spark, sf)
    write_store(old, path)
    read = read_store(spark, path)
    first, second = [
        store.merge_metadata(read, part, now(), only_if_changed=True)
        for part in _parts(new, F.crc32("table") % 2, 2)
    ]
    update_store(second, path)
    update_store(first, path)
    return read_store(spark, path).facts.select(*m.K4, "position", "column_name", "data_type")


# A store after three scans, its small versions put together, and all older ones removed.
@query("a4_compacted_store", MERGED_FACTS_SQL)
def compacted_store(spark, sf):
    path = new_folder(spark, "store")
    old, new = snapshots(spark, sf)
    write_store(old, path)
    for part in _parts(new, F.crc32("instance") % 3, 3):
        update_store(store.merge_metadata(read_store(spark, path), part, now(), only_if_changed=True), path)
    compact_store(spark, path)
    vacuum(spark, path, keep=1, seconds=0)
    return read_store(spark, path).facts.select(*m.K4, "position", "column_name", "data_type")


def json_documents(spark, sf) -> DataFrame:
    """Customers' tables as JSON documents."""
    own = roles.store(spark, sf)
    nested = describe.nest(own.facts, counts=describe.fact_counts(own.facts))
    return documents.to_documents(own.tables, nested).select("part", "document")


# Positions of a document's columns are their places in its list.
@query(
    "a3_facts_of_documents",
    f"""WITH {ORD} SELECT {K4_SQL}, row_number() OVER (PARTITION BY {K4_SQL} ORDER BY o_orderkey) AS position,
        column_name, o_orderpriority AS data_type, o_orderstatus = 'O' AS is_nullable FROM ord""",
)
def facts_of_documents(spark, sf):
    found = documents.facts_of_documents(json_documents(spark, sf))
    return found.where(F.col("section") == m.COLUMN).select(
        *m.K4, "position", "column_name", "data_type", "is_nullable"
    )


@query(
    "a3_tables_of_documents",
    f"""WITH {CAT} SELECT {K4_SQL}, CASE WHEN "schema" <> 'MACHINERY' THEN 'Orders of ' || "table" END
          AS summary, '"' || instance || '"' AS owner, '["crm","orders"]' AS tags, 3 AS fields,
          '2024-01-01T00:00:00+00:00' AS updated_at FROM cat""",
)
def tables_of_documents(spark, sf):
    broken = t(spark, sf, "documents").select(F.lit(0).alias("part"), F.col("text").alias("document"))
    texts = json_documents(spark, sf).union(broken)
    found = documents.tables_of_documents(texts)
    field = lambda name: F.try_element_at("custom", F.lit(name)).alias(name)
    return found.select(
        *m.K4, F.col("ai_documentation.summary").alias("summary"), field("owner"), field("tags"),
        F.size("custom").alias("fields"), iso("updated_at").alias("updated_at"),
    )




# Documents with fields that nobody declared, beside the table's own, in its documentation, in its description
# and in every column; through the store and back.
@query(
    "a3_round_trip_unchanged",
    f"""WITH {ORD}, cols AS (SELECT {K4_SQL}, count(*) AS n FROM ord GROUP BY ALL)
        SELECT cat.config, cat.instance, cat."schema", cat."table", true AS unchanged, coalesce(n, 0) AS columns_with_pii,
          cat."schema" AS reviewed_by, CASE WHEN cat."schema" <> 'MACHINERY' THEN 0.75::DOUBLE END AS confidence
        FROM cat LEFT JOIN cols ON cols.config = cat.config AND cols.instance = cat.instance
          AND cols."schema" = cat."schema" AND cols."table" = cat."table" """,
)
def round_trip_unchanged(spark, sf):
    path = new_folder(spark, "store")
    plain = F.regexp_replace("document", r'"ai_documentation":\{', '"ai_documentation":{"confidence":0.75,')
    plain = F.regexp_replace(plain, r'\{"comment":', '{"pii":{"kind":"mail"},"comment":')
    given = F.concat(
        F.substring_index(plain, '"schema_description":{', 1),
        F.lit('"schema_description":{"reviewed":{"by":'), roles.json_text(F.col("schema")),
        F.lit(',"notes":[1,{"x":null}]},'),
        F.substring_index(plain, '"schema_description":{', -1),
    )
    own = roles.store(spark, sf)
    nested = describe.nest(own.facts, counts=describe.fact_counts(own.facts))
    texts = written(documents.to_documents(own.tables, nested).select(*m.K4, given.alias("document")), "texts")
    current = documents.newest(texts)
    write_store(Store(documents.tables_of_documents(current), documents.facts_of_documents(current)), path)
    stored = read_store(spark, path)
    nested = describe.nest(stored.facts, extra=True, counts=describe.fact_counts(stored.facts))
    back = documents.to_documents(stored.tables, nested)
    both = texts.join(back.select(*m.K4, F.col("document").alias("back")), m.K4, "left")
    parsed = documents.once(both, [*m.K4], given=F.parse_json("document"), doc=F.parse_json("back"))
    doc = F.col("doc")
    columns = F.try_variant_get(doc, "$.schema_description.columns", "array<struct<pii:struct<kind:string>>>")
    return parsed.select(
        *m.K4,
        (F.to_json("given") == F.to_json("doc")).alias("unchanged"),
        F.size(F.filter(columns, lambda c: c["pii"]["kind"] == "mail")).cast("bigint").alias("columns_with_pii"),
        F.try_variant_get(doc, "$.schema_description.reviewed.by", "string").alias("reviewed_by"),
        F.try_variant_get(doc, "$.ai_documentation.confidence", "double").alias("confidence"),
    )
