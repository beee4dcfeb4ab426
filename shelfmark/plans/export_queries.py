"""E, A5, F. Rendered documents and generated documentation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from shelfmark import __version__
from shelfmark import model as m
from shelfmark.functions.text import front_matter, front_matter_value, md_escape
from shelfmark.operators import describe, docgen, export
from shelfmark.operators.store import Store
from shelfmark.plans import roles
from shelfmark.plans.registry import query
from shelfmark.plans.roles import DOC_K4, ITEM, K4_SQL, now, t
from shelfmark.shared import new_folder
from shelfmark.sources.store import bundle_index, read_exports, write_exports


@query(
    "e2_md_escape",
    """SELECT 'document' AS source, doc_id AS id, replace(replace(text, '|', '\\|'), chr(10), ' ') AS cell
       FROM documents UNION ALL
       SELECT 'page', page_id, replace(replace(html, '|', '\\|'), chr(10), ' ') FROM pages""",
)
def escaped(spark, sf):
    texts = t(spark, sf, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), md_escape("text").alias("cell")
    )
    pages = t(spark, sf, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), md_escape("html").alias("cell")
    )
    return texts.union(pages)


# Parts of a customer's document in SQL.  No customer has as many facts as a part holds, so ``part``
# is 0; ``tests/test_skew.py`` compares longer ones with SQL.  ``u`` is the newest order, which documentation describes.
DOC_SQL = f"""{ITEM},
u AS (SELECT o_custkey, max(o_orderkey) AS newest FROM orders GROUP BY ALL),
head AS (SELECT cat.*, newest FROM cat LEFT JOIN u ON c_custkey = o_custkey),
cols AS (SELECT {K4_SQL}, string_agg('| ' || column_name || ' | ' || o_orderpriority || ' | ' ||
    CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END || ' | ' ||
    CASE WHEN o_orderkey = newest AND "schema" <> 'MACHINERY' THEN 'newest \\| order' ELSE '' END || ' |',
    chr(10) ORDER BY o_orderkey) AS rows
  FROM ord JOIN u USING (o_custkey) GROUP BY ALL),
pk AS (SELECT {K4_SQL}, '- Primary key: ' || string_agg('`' || column_name || '`', ', '
    ORDER BY l_linenumber, column_name) AS line FROM item WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
fk AS (SELECT {K4_SQL}, string_agg('- `' || column_name || '` -> `supplier.s_' || l_suppkey || '`', chr(10)
    ORDER BY constraint_name, l_linenumber, column_name, 's_' || l_suppkey) AS lines
  FROM item WHERE o_orderpriority = '2-HIGH' GROUP BY ALL),
keys AS (SELECT {K4_SQL}, concat_ws(chr(10), line, lines) AS rows
  FROM pk FULL OUTER JOIN fk USING ({K4_SQL})),
one AS (SELECT {K4_SQL}, l_returnflag, '- `idx_' || l_returnflag || '`:' ||
    CASE WHEN l_returnflag <> 'R' THEN ' unique' ELSE '' END || ' ' ||
    string_agg('`' || column_name || '`', ', ' ORDER BY l_linenumber, column_name) AS line
  FROM item WHERE o_orderpriority = '4-NOT SPECIFIED' GROUP BY {K4_SQL}, l_returnflag),
ix AS (SELECT {K4_SQL}, string_agg(line, chr(10) ORDER BY l_returnflag) AS rows,
    string_agg(line, chr(10) ORDER BY l_returnflag) FILTER (l_returnflag = 'A') AS essential_rows
  FROM one GROUP BY ALL),
pt AS (SELECT {K4_SQL}, string_agg('- `' || column_name || '` (' || o_orderpriority || ')', chr(10)
    ORDER BY o_orderkey) AS rows FROM ord WHERE o_orderstatus = 'P' GROUP BY ALL)"""

COLUMN_HEAD = "'| Name | Type | Nullable | Description |' || chr(10) || '| --- | --- | --- | --- |'"
PATH_SQL = (
    "concat_ws('/', regexp_replace(config, '[^\\p{L}\\p{N}_.\\-]', '_', 'g'), instance, \"schema\","
    " regexp_replace(\"table\", '[^\\p{L}\\p{N}_.\\-]', '_', 'g')) || '.md'"
)
JOINED = " ".join(
    f'LEFT JOIN {x} ON {x}."table" = head."table" AND {x}."schema" = head."schema"'
    f" AND {x}.instance = head.instance AND {x}.config = head.config"
    for x in ("cols", "keys", "ix", "pt")
)


def _body_sql(mark: str, columns: str, indexes: str = "ix.rows") -> str:
    section = lambda title, rows: (
        f"CASE WHEN {rows} IS NOT NULL THEN chr(10) || chr(10) || '{mark} {title}' || chr(10)"
        f" || chr(10) || {rows} ELSE '' END"
    )
    return " || ".join(
        [
            f"CASE WHEN head.\"schema\" <> 'MACHINERY' THEN chr(10) || chr(10) || '{mark} Description'"
            " || chr(10) || chr(10) || 'Orders of ' || head.\"table\" ELSE '' END",
            section(columns, f"({COLUMN_HEAD} || chr(10) || cols.rows)"),
            section("Keys and Relationships", "keys.rows"),
            section("Indexes", indexes),
            section("Partitions", "pt.rows"),
        ]
    )


HEAD_SQL = (
    "'# ' || head.\"schema\" || '.' || head.\"table\" || chr(10) || chr(10) || '## Source' || chr(10) || chr(10)"
    " || '- Configuration: `' || head.config || '`' || chr(10) || '- Instance: `' || head.instance || '`'"
    " || chr(10) || '- Schema: `' || head.\"schema\" || '`' || chr(10) || '- Table: `' || head.\"table\" || '`'"
    " || chr(10) || '- Metadata updated: `2024-01-01T00:00:00+00:00`'"
)
PATH_OF_HEAD = PATH_SQL.replace("config,", "head.config,").replace(
    ' instance, "schema",', ' head.instance, head."schema",'
).replace('regexp_replace("table"', 'regexp_replace(head."table"')


def _markdown_sql(indexes: str) -> str:
    return (
        f"SELECT {PATH_OF_HEAD} AS path, 0 AS part, {HEAD_SQL} || {_body_sql('##', 'Columns', indexes)}"
        f" || chr(10) AS content FROM head {JOINED}"
    )


FRONT_SQL = (
    "'---' || chr(10) || 'type: \"Database Table\"' || chr(10) || 'title: \"' || head.\"schema\" || '.'"
    " || head.\"table\" || '\"' || chr(10) || CASE WHEN head.\"schema\" <> 'MACHINERY' THEN"
    " 'description: \"Orders of ' || head.\"table\" || '\"' || chr(10) ELSE '' END"
    " || 'tags: [\"crm\",\"orders\"]' || chr(10) || 'generated:' || chr(10)"
    f" || '  by: \"shelfmark/{__version__}\"' || chr(10)"
    " || '  at: \"2024-01-01T00:00:00+00:00\"' || chr(10)"
    " || 'config: \"' || head.config || '\"' || chr(10) || 'instance: \"' || head.instance || '\"' || chr(10)"
    " || 'schema: \"' || head.\"schema\" || '\"' || chr(10) || 'table: \"' || head.\"table\" || '\"' || chr(10)"
    " || 'owner: \"' || head.instance || '\"' || chr(10) || '---'"
)


def _okf_sql(indexes: str) -> str:
    # A document without anything below its front matter ends with an empty body.
    body = _body_sql("#", "Schema", indexes)
    return (
        f"SELECT {PATH_OF_HEAD} AS path, 0 AS part, {FRONT_SQL} || CASE WHEN ({body}) = '' THEN chr(10) || chr(10)"
        f" ELSE {body} END || chr(10) AS content FROM head {JOINED}"
    )


@query(
    "e1_essential",
    f"""WITH {DOC_SQL}, kept AS (
      SELECT {K4_SQL}, 'column' AS section, column_name,
        CASE WHEN o_orderkey = newest AND "schema" <> 'MACHINERY' THEN 'newest | order' END AS description
      FROM ord JOIN u USING (o_custkey)
      UNION ALL SELECT {K4_SQL}, 'partition', column_name, NULL FROM ord WHERE o_orderstatus = 'P'
      UNION ALL SELECT {K4_SQL}, 'primary_key', column_name, NULL FROM item WHERE o_orderpriority = '1-URGENT'
      UNION ALL SELECT {K4_SQL}, 'foreign_key', column_name, NULL FROM item WHERE o_orderpriority = '2-HIGH'
      UNION ALL SELECT {K4_SQL}, 'index', column_name, NULL FROM item
        WHERE o_orderpriority = '4-NOT SPECIFIED' AND l_returnflag = 'A')
    SELECT *, true AS no_default FROM kept""",
)
def essential(spark, sf):
    facts = export.essential(roles.store(spark, sf)).facts
    return facts.select(
        *m.K4, "section", "column_name", F.col("comment").alias("description"),
        F.col("default_value").isNull().alias("no_default"),
    )


@query(
    "e1_essential_tables",
    f"""WITH {DOC_SQL} SELECT {K4_SQL}, CASE WHEN "schema" <> 'MACHINERY' THEN 'Orders of ' || "table" END
        AS summary, '"' || instance || '"' AS owner, '["crm","orders"]' AS tags, 2 AS fields FROM cat""",
)
def essential_tables(spark, sf):
    tables = export.essential(roles.store(spark, sf)).tables
    field = lambda name: F.try_element_at("custom", F.lit(name)).alias(name)
    return tables.select(
        *m.K4, F.col("ai_documentation.summary").alias("summary"), field("owner"), field("tags"),
        F.size("custom").alias("fields"),
    )


@query("e4_render_markdown", f"WITH {DOC_SQL} {_markdown_sql('ix.rows')}")
def render_markdown(spark, sf):
    return export.render_markdown(roles.store(spark, sf)).select("path", "part", "content")


@query("e5_render_okf", f"WITH {DOC_SQL} {_okf_sql('ix.rows')}")
def render_okf(spark, sf):
    return export.render_okf(roles.store(spark, sf)).select("path", "part", "content")


@query(
    "e4_render_texts",
    f"""WITH docs AS (SELECT {DOC_K4}, text FROM documents)
      SELECT {PATH_SQL} AS path, 0 AS part, '# docs.' || "table" || chr(10) || chr(10) || '## Source' || chr(10) || chr(10)
       || '- Configuration: `' || config || '`' || chr(10) || '- Instance: `' || instance || '`' || chr(10)
       || '- Schema: `docs`' || chr(10) || '- Table: `' || "table" || '`' || chr(10)
       || '- Metadata updated: `2024-01-01T00:00:00+00:00`'
       || CASE WHEN text <> '' THEN chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || text ELSE '' END
       || CASE WHEN quality IS NOT NULL THEN chr(10) || chr(10) || '## Columns' || chr(10) || chr(10)
            || {COLUMN_HEAD} || chr(10) || '| label\\|' || quality || ' | ' || replace(replace(text, '|', '\\|'), chr(10), ' ')
            || ' |  |  |' ELSE '' END
       || chr(10) AS content
      FROM docs LEFT JOIN labels ON "table" = 'doc_' || doc_id""",
)
def render_texts(spark, sf):
    """Documents as summaries, and, where labelled, as a column's type text."""
    labelled = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id")
    facts = m.facts(
        labelled.select(
            F.col("lang").alias("config"), F.col("source").alias("instance"),
            F.lit("docs").alias("schema"),
            F.concat(F.lit("doc_"), F.col("doc_id")).alias("table"), "text", "quality",
        ),
        m.COLUMN,
        position=F.lit(1),
        column_name=F.concat(F.lit("label|"), F.col("quality")),
        data_type=F.col("text"),
    )
    own = Store(roles.document_tables(spark, sf), facts)
    return export.render_markdown(own).select("path", "part", "content")


def _index_sql(bullets: str) -> str:
    """Part 0 opens the index, every further part is one bullet."""
    return (
        """SELECT 'index.md' AS path, 0 AS part, '---' || chr(10) || 'okf_version: "0.2"' || chr(10)"""
        " || '---' || chr(10) || chr(10) || '# Database Catalog' || chr(10) || chr(10) AS content UNION ALL"
        " SELECT 'index.md', row_number() OVER (ORDER BY string_split(path, '/')), line || chr(10)"
        f" FROM {bullets}"
    )


BULLETS_SQL = f"""docs AS (SELECT {DOC_K4}, text FROM documents),
bullet AS (SELECT {PATH_SQL} AS path, '* [docs.' || "table" || '](' || {PATH_SQL} || ')' ||
  CASE WHEN text <> '' THEN ' - ' || text ELSE '' END AS line FROM docs)"""


@query("e6_index_entries", f"WITH {BULLETS_SQL} SELECT path, line FROM bullet")
def index_entries(spark, sf):
    """Bullets read back from the front matter of rendered documents."""
    tables = roles.document_tables(spark, sf)
    own = m.facts(
        tables, m.COLUMN, position=F.lit(1), column_name=F.lit("text"), data_type=F.col("config")
    )
    documents = export.render_okf(Store(tables, own))
    return export.index_entries(documents.where("part = 0"))


@query(
    "e6_render_okf_index",
    f"WITH {BULLETS_SQL} {_index_sql('bullet')}",
)
def render_okf_index(spark, sf):
    entries = export.entries_of_tables(roles.document_tables(spark, sf))
    return export.render_okf_index(entries).select("path", "part", "content")


@query(
    "e7_parse_front_matter",
    """SELECT doc_id, lang, '"' || source || ' --- x"' AS title, 'lang: ' || lang || chr(10) || 'title: "'
         || source || ' --- x"' AS block FROM documents
       UNION ALL SELECT -1 - doc_id, NULL, NULL, NULL FROM documents""",
)
def parse_front_matter(spark, sf):
    texts = t(spark, sf, "documents")
    with_front = texts.select(
        "doc_id",
        F.concat(
            F.lit("---\nlang: "), "lang", F.lit('\ntitle: "'), "source", F.lit(' --- x"\n---\n'), "text"
        ).alias("content"),
    )
    without = texts.select((-1 - F.col("doc_id")).alias("doc_id"), F.col("text").alias("content"))
    block = front_matter("content")
    return with_front.union(without).select(
        "doc_id",
        front_matter_value(block, "lang").alias("lang"),
        front_matter_value(block, "title").alias("title"),
        block.alias("block"),
    )


EXPORT_SQL = f"""WITH {DOC_SQL},
  entry AS (SELECT {PATH_SQL} AS path, '* [' || "schema" || '.' || "table" || '](' || {PATH_SQL} || ')' ||
    CASE WHEN "schema" <> 'MACHINERY' THEN ' - Orders of ' || "table" ELSE '' END AS line FROM cat)
  SELECT 'markdown' AS format, path, part, content FROM ({_markdown_sql('ix.essential_rows')})
  UNION ALL SELECT 'okf', path, part, content FROM ({_okf_sql('ix.essential_rows')})
  UNION ALL SELECT 'okf', * FROM ({_index_sql('entry')})"""


@query("e8_export", EXPORT_SQL)
def export_all(spark, sf):
    return export.export(roles.store(spark, sf)).select("format", "path", "part", "content")


@query("a5_written_exports", f"WITH {DOC_SQL} SELECT 'markdown' AS format, * FROM ({_markdown_sql('ix.essential_rows')})")
def written_exports(spark, sf):
    path = new_folder(spark, "exports")
    write_exports(export.export(roles.store(spark, sf), ["markdown"]), path)
    return read_exports(spark, path)


@query("a5_export_batches", EXPORT_SQL)
def export_batches(spark, sf):
    """Three batches, of other schemas and formats each: later ones leave the earlier documents, and
    the index lists the whole bundle."""
    path = new_folder(spark, "exports")
    whole = roles.store(spark, sf)
    batches = [("schema <> 'MACHINERY'", None), ("schema >= 'FURNITURE'", ["okf"]), ("schema >= 'MACHINERY'", ["markdown"])]
    for condition, formats in batches:
        part = Store(whole.tables.where(condition), whole.facts.where(condition))
        write_exports(export.export(part, formats), path)
    index = bundle_index(spark, path).select(F.lit("okf").alias("format"), "path", "part", "content")
    return read_exports(spark, path).union(index)


PROMPT_SQL = f"""WITH {ITEM},
  c AS (SELECT {K4_SQL}, string_agg('{{"name":"' || column_name || '","data_type":"' || o_orderpriority
      || '","is_nullable":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END
      || ',"default_value":"' || o_orderstatus || '","comment":null}}', ',' ORDER BY o_orderkey) AS columns
    FROM ord GROUP BY ALL),
  k AS (SELECT {K4_SQL}, string_agg('"' || column_name || '"', ',' ORDER BY l_linenumber, column_name) AS keys
    FROM item WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
  f AS (SELECT {K4_SQL}, string_agg('{{"column_name":"' || column_name || '","referenced_table":"supplier",'
      || '"referenced_column":"s_' || l_suppkey || '","constraint_name":"' || constraint_name || '"}}', ','
      ORDER BY constraint_name, l_linenumber, column_name, 's_' || l_suppkey) AS refs
    FROM item WHERE o_orderpriority = '2-HIGH' GROUP BY ALL)
  SELECT {K4_SQL}, 0 AS part, 'Describe what this database table is for.' || chr(10) || 'Instance: ' || instance
    || chr(10) || 'Schema: ' || "schema" || chr(10) || 'Table: ' || "table" || chr(10)
    || 'Columns: [' || columns || ']' || chr(10) || 'Primary key: [' || coalesce(keys, '') || ']' || chr(10)
    || 'References: [' || coalesce(refs, '') || ']' || chr(10)
    || 'Reply with one JSON object: ''summary'', one sentence on the table, and ''column_descriptions'','
    || ' an object from column name to a short text.' AS prompt
  FROM c LEFT JOIN k USING ({K4_SQL}) LEFT JOIN f USING ({K4_SQL})"""


@query("f1_build_prompts", PROMPT_SQL)
def build_prompts(spark, sf):
    return docgen.build_prompts(describe.nest(roles.store(spark, sf).facts)).select(*m.K4, "part", "prompt")


@query(
    "f2_parse_replies",
    """SELECT doc_id, text AS summary, source AS text_of_lang, 'generated' AS status, NULL AS error FROM documents
       UNION ALL SELECT -1 - doc_id, NULL, NULL, 'failed', 'Model ''m'' sent no JSON object' FROM documents
         WHERE text <> ''
       UNION ALL SELECT 1000000000 + page_id, NULL, NULL, 'failed', 'Model ''m'' sent an empty reply'
         FROM pages""",
)
def parse_replies(spark, sf):
    texts = t(spark, sf, "documents")
    answer = F.to_json(
        F.struct(
            F.col("text").alias("summary"),
            F.create_map(F.col("lang"), F.col("source")).alias("column_descriptions"),
        )
    )
    fenced = F.concat(F.lit(" ```json\n"), answer, F.lit("\n```\n"))
    replies = m.union(
        texts.select(
            "doc_id", "lang",
            F.when(F.col("lang") == "en", fenced).otherwise(answer).alias("reply"),
        ),
        texts.where(F.col("text") != "").select(
            (-1 - F.col("doc_id")).alias("doc_id"), "lang", F.col("text").alias("reply")
        ),
        t(spark, sf, "pages").select(
            (1000000000 + F.col("page_id")).alias("doc_id"), F.lit("").alias("lang"),
            F.lit("").alias("reply"),
        ),
    )
    parsed = docgen.parse_replies(replies, "m", now())
    return parsed.select(
        "doc_id",
        F.col("ai_documentation.summary").alias("summary"),
        F.try_element_at("ai_documentation.column_descriptions", F.col("lang")).alias("text_of_lang"),
        F.col("ai_generation_status").alias("status"),
        F.col("ai_generation_error").alias("error"),
    )


def measure(system: str, prompt: str) -> str:
    """Stands in for a model: fails on some texts, else measures the prompt."""
    if "?" in prompt:
        raise RuntimeError("question")
    return json.dumps({"summary": f"{len(prompt)} characters"})


@query(
    "f4_generate",
    """SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN NULL ELSE length(text) || ' characters' END
         AS summary, CASE WHEN contains(text, '?') THEN 'failed' ELSE 'generated' END AS status,
         CASE WHEN contains(text, '?') THEN 'question' END AS error FROM conversations""",
)
def generate(spark, sf):
    prompts = t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    replies = docgen.generate(prompts, measure, pause=0.0)
    return docgen.parse_replies(replies, "m", now()).select(
        "conv_id",
        "turn",
        F.col("ai_documentation.summary").alias("summary"),
        F.col("ai_generation_status").alias("status"),
        F.col("ai_generation_error").alias("error"),
    )
