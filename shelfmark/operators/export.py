"""E. Rendered documents.

A document is rendered as *pieces*: rows of text with a sort key.  Every fact gives a piece of its
own, so rendering collects nothing; only the last step joins the pieces of a document in order, and
cuts a very long document into several rows by ``part`` (the document is their concatenation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import __version__
from shelfmark import model as m
from shelfmark.functions.text import (
    code,
    document_path,
    front_matter,
    front_matter_value,
    iso,
    md_bool,
    md_escape,
    non_empty,
    quoted,
    unquoted,
)
from shelfmark.operators.lists import PART_ITEMS, ordered_lists
from shelfmark.operators.ranks import ranked
from shelfmark.operators.store import Store
from shelfmark.shared import written

# Words and layout of the documents.
SOURCE_LABELS = {
    "config": "Configuration", "instance": "Instance", "schema": "Schema", "table": "Table",
}
UPDATED_LABEL = "Metadata updated"
DESCRIPTION, COLUMNS, OKF_COLUMNS = "Description", "Columns", "Schema"
KEYS, INDEXES, PARTITIONS = "Keys and Relationships", "Indexes", "Partitions"
COLUMN_HEADER = "| Name | Type | Nullable | Description |\n| --- | --- | --- | --- |"
OKF_TYPE = "Database Table"
OKF_VERSION = "0.2"
INDEX_TITLE, INDEX_EMPTY = "Database Catalog", "No concepts exported."
RESERVED_NAMES = ["index", "log"]
ESSENTIAL_FIELDS = ["owner", "tags", "status"]

GENERATOR = f"shelfmark/{__version__}"

# Order of the pieces of a document; the facts of three sections share one heading.
_FRONT, _SUMMARY, _COLUMNS, _KEYS, _INDEXES, _PARTITIONS, _END = range(7)
_PLACE = {
    m.COLUMN: (_COLUMNS, 1),
    m.PRIMARY_KEY: (_KEYS, 1),
    m.SORT_KEY: (_KEYS, 2),
    m.FOREIGN_KEY: (_KEYS, 3),
    m.INDEX: (_INDEXES, 1),
    m.PARTITION: (_PARTITIONS, 1),
}
_ORDER = ["block", "kind", "item", "position", "column_name", "referenced_column"]


def _summary() -> Column:
    return non_empty(F.col("ai_documentation.summary"))


def _place(index: int) -> Column:
    chosen = F.when(F.lit(False), F.lit(0))
    for section, place in _PLACE.items():
        chosen = chosen.when(F.col("section") == section, place[index])
    return chosen


def essential(store: Store) -> Store:
    """E1. The compact view: no defaults, of the indexes only unique ones that are not primary, of
    the custom fields only owner, tags and status, of the documentation only the summary; a column
    keeps one description, the documentation's text before the comment."""
    kept = (F.col("section") != m.COLUMN) & (
        (F.col("section") != m.INDEX)
        | (F.coalesce("is_unique", F.lit(False)) & ~F.coalesce("is_primary", F.lit(False)))
    )
    nothing = F.lit(None).cast("string")
    compact = {"default_value": nothing, "comment": non_empty("shown"), "description": nothing}
    columns = described_columns(store).select(
        *[compact.get(name, F.col(name)).alias(name) for name in m.FACT_COLUMNS]
    )
    facts = m.union(columns, store.facts.where(kept).select(*m.FACT_COLUMNS))
    empty = ["null", '""', "[]", "{}", ""]
    tables = store.tables.select(
        *m.K4,
        F.when(
            _summary().isNotNull(),
            F.struct(
                _summary().alias("summary"),
                F.lit(None).cast("map<string,string>").alias("column_descriptions"),
                F.lit(None).cast("timestamp").alias("generated_at"),
                F.lit(None).cast("string").alias("model"),
            ),
        ).alias("ai_documentation"),
        F.map_filter(
            "custom", lambda k, v: k.isin(ESSENTIAL_FIELDS) & v.isNotNull() & ~v.isin(empty)
        ).alias("custom"),
        "updated_at",
    )
    return Store(tables, facts)


def described_columns(store: Store) -> DataFrame:
    """Column facts with ``shown``: the column's own description, else the documentation's text,
    else the comment.

    The join is keyed by (table, column), so a wide table spreads over tasks.
    """
    texts = store.tables.select(
        *m.K4, F.explode("ai_documentation.column_descriptions").alias("column_name", "ai_text")
    )
    columns = store.facts.where(F.col("section") == m.COLUMN)
    return columns.join(texts, [*m.K4, "column_name"], "left").select(
        *m.FACT_COLUMNS,
        F.coalesce(non_empty("description"), non_empty("ai_text"), "comment").alias("shown"),
    )


def _listed_name(lead: Column, facts: DataFrame) -> DataFrame:
    """Pieces of facts that share one line: the first carries ``lead``, the others a comma.

    The first fact per line comes from a pre-aggregated minimum, copies of a fact are counted
    before anything else, and no line is collected.
    """
    # A fact without an item has a line like others; joins and groups take it as the empty name.
    facts = facts.withColumn("item", F.coalesce("item", F.lit("")))
    line = [*m.K4, "section", "item"]
    place = F.struct(F.coalesce("position", F.lit(-1)).alias("p"), F.col("column_name").alias("c"))
    copies = facts.groupBy(*line, "position", "column_name", "is_unique").agg(
        F.count("*").alias("copies")
    )
    first = copies.groupBy(*line).agg(F.min(place).alias("first"))
    name = F.when(F.col("column_name").isNotNull(), code("column_name")).otherwise(F.lit(""))
    more = F.concat(F.lit(", "), name)
    text = F.when(
        place.eqNullSafe(F.col("first")),
        F.concat(lead, name, F.repeat(more, (F.col("copies") - 1).cast("int"))),
    ).otherwise(F.repeat(more, F.col("copies").cast("int")))
    return copies.join(first, line).select(
        *m.K4, "section", "item", "position", "column_name",
        F.lit(None).cast("string").alias("referenced_column"), text.alias("text"),
    )


def _pieces_of_facts(store: Store, compact: bool) -> DataFrame:
    facts, section = store.facts, F.col("section")
    cells = [
        md_escape("column_name"), md_escape("data_type"), md_bool("is_nullable"),
        md_escape("shown"),
    ]
    row = F.concat(F.lit("\n| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    sort_key = F.concat(F.lit("\n- Sort key: "), code("column_name"))
    reference = F.concat(
        F.lit("\n- "), code("column_name"), F.lit(" -> `"),
        F.coalesce("referenced_table", F.lit("None")), F.lit("."),
        F.coalesce("referenced_column", F.lit("None")), F.lit("`"),
    )
    partition = F.concat(
        F.lit("\n- "), code("column_name"), F.lit(" ("),
        F.coalesce("data_type", F.lit("None")), F.lit(")"),
    )
    place = [*m.K4, "section", "item", "position", "column_name", "referenced_column"]
    if compact:
        described = facts.where(section == m.COLUMN).withColumn("shown", F.col("comment"))
    else:
        described = described_columns(store)
    columns = described.select(*place, row.alias("text"))
    own_line = facts.where(section.isin(m.SORT_KEY, m.FOREIGN_KEY, m.PARTITION)).select(
        *place,
        F.when(section == m.SORT_KEY, sort_key)
        .when(section == m.FOREIGN_KEY, reference)
        .otherwise(partition)
        .alias("text"),
    )
    lead = F.when(section == m.PRIMARY_KEY, F.lit("\n- Primary key: ")).otherwise(
        F.concat(
            F.lit("\n- "), code("item"), F.lit(":"),
            F.when(F.col("is_unique"), F.lit(" unique")).otherwise(F.lit("")), F.lit(" "),
        )
    )
    shared_line = _listed_name(lead, facts.where(section.isin(m.PRIMARY_KEY, m.INDEX)))
    return m.union(columns, own_line, shared_line).select(
        *m.K4, _place(0).alias("block"), _place(1).alias("kind"), *place[5:], "text"
    )


def _piece(df: DataFrame, block: Column, text: Column, okf: Column) -> DataFrame:
    """Pieces that stand before the facts of their block."""
    nothing = F.lit(None).cast("string")
    return df.select(
        *m.K4, block.cast("int").alias("block"), F.lit(0).alias("kind"), F.lit("").alias("item"),
        F.lit(0).cast("bigint").alias("position"), nothing.alias("column_name"),
        nothing.alias("referenced_column"), text.alias("text"), okf.alias("okf"),
    )


def _title_and_source() -> Column:
    lines = [
        F.concat(F.lit("# "), F.col("schema"), F.lit("."), F.col("table")),
        F.lit(""),
        F.lit("## Source"),
        F.lit(""),
        *[F.concat(F.lit(f"- {label}: "), code(k)) for k, label in SOURCE_LABELS.items()],
        F.concat(F.lit(f"- {UPDATED_LABEL}: "), code(iso("updated_at"))),
    ]
    return F.concat_ws("\n", *lines)


def _custom(key: str) -> Column:
    """A custom field as JSON text, null if it is empty."""
    value = F.try_element_at("custom", F.lit(key))
    return F.when(~value.isin("null", '""', "[]", "{}", "false", "0", ""), value)


def _front_lines() -> Column:
    """Front matter of a knowledge-bundle document; scalars are JSON literals, which YAML reads."""

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value)

    return F.concat_ws(
        "\n",
        F.lit("---"),
        line("type", quoted(F.lit(OKF_TYPE))),
        line("title", quoted(F.concat_ws(".", "schema", "table"))),
        F.when(_summary().isNotNull(), line("description", quoted(_summary()))),
        line("tags", _custom("tags")),
        F.lit("generated:"),
        line("  by", quoted(F.lit(GENERATOR))),
        line("  at", quoted(iso("updated_at"))),
        line("status", _custom("status")),
        *[line(k, quoted(F.col(k))) for k in m.K4],
        line("owner", _custom("owner")),
        F.lit("---"),
    )


def pieces(store: Store, compact: bool = False) -> DataFrame:
    """E4, E5. All pieces of all documents: K4, the sort key ``_ORDER``, ``text`` and ``okf``.

    ``text`` is a piece as it stands in Markdown, ``okf`` what stands in its place in the knowledge bundle,
    null if it is the same: facts are rendered once for both.  A ``compact`` store is one from
    ``essential``, whose comments are the descriptions already, so they are not joined again.
    """
    of_facts = _pieces_of_facts(store, compact).withColumn("okf", F.lit(None).cast("string"))
    # At most four headings per table, pre-aggregated.
    heads = store.facts.select(*m.K4, _place(0).alias("block")).distinct()

    def heading(mark: str, columns: str) -> Column:
        titles = {
            _COLUMNS: f"{columns}\n\n{COLUMN_HEADER}",
            _KEYS: f"{KEYS}\n",
            _INDEXES: f"{INDEXES}\n",
            _PARTITIONS: f"{PARTITIONS}\n",
        }
        title = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
        return F.concat(F.lit(f"\n\n{mark} "), F.try_element_at(title, F.col("block")))

    with_facts = heads.select(*m.K4).distinct().withColumn("has_facts", F.lit(True))
    no_body = F.col("has_facts").isNull() & _summary().isNull()
    okf_front = F.concat(_front_lines(), F.when(no_body, F.lit("\n\n")).otherwise(F.lit("")))
    summary = lambda mark: F.concat(F.lit(f"\n\n{mark} {DESCRIPTION}\n\n"), _summary())
    piece = lambda block, text, okf: F.struct(F.lit(block).alias("block"), text.alias("text"), okf.alias("okf"))
    of_table = F.array(
        piece(_FRONT, _title_and_source(), okf_front),
        piece(_SUMMARY, summary("##"), summary("#")),
        piece(_END, F.lit("\n"), F.lit("\n")),
    )
    own = store.tables.join(with_facts, m.K4, "left").select(*m.K4, F.inline(of_table)).where(F.col("text").isNotNull())
    return m.union(
        _piece(own, F.col("block"), F.col("text"), F.col("okf")),
        _piece(heads, F.col("block"), heading("##", COLUMNS), heading("#", OKF_COLUMNS)),
        of_facts,
    )


def _documents(store: Store, formats: list[str], per_part: int, compact: bool = False) -> DataFrame:
    """``K4, path, part, format, content``: documents of all formats from one pass over the pieces."""
    # Facts are read by section, several times.
    store = Store(store.tables, written(store.facts.select(*m.FACT_COLUMNS), "facts"))
    rows = written(pieces(store, compact), "pieces")
    # Every fact gives one piece, a table at most three and four headings more.
    most = m.union(store.tables.select(*m.K4, F.lit(7).alias("n")), store.facts.select(*m.K4, F.lit(1).alias("n")))
    counts = most.groupBy(*m.K4).agg(F.sum("n").alias("n"))
    listed = ordered_lists(rows, m.K4, _ORDER, F.struct("text", "okf"), "pieces", per_part, counts)
    said = {m.MARKDOWN: lambda p: p["text"], m.OKF: lambda p: F.coalesce(p["okf"], p["text"])}
    contents = [
        F.struct(F.lit(f).alias("format"), F.array_join(F.transform("pieces", said[f]), "").alias("content"))
        for f in formats
    ]
    return listed.select(*m.K4, document_path().alias("path"), "part", F.inline(F.array(*contents)))


def render_markdown(store: Store, per_part: int = PART_ITEMS) -> DataFrame:
    """E4. Markdown documents ``K4, path, part, content``; empty sections are left out.

    A row has ``per_part`` pieces, about one per fact; a document is its rows one after the other.
    """
    return _documents(store, [m.MARKDOWN], per_part).drop("format")


def render_okf(store: Store, per_part: int = PART_ITEMS) -> DataFrame:
    """E5. Knowledge-bundle documents: front matter, then the body one heading level higher."""
    return _documents(store, [m.OKF], per_part).drop("format")


def index_entries(documents: DataFrame) -> DataFrame:
    """E6, E7. One bullet per bundle document ``path, line``, read from its front matter.

    Documents named like the reserved files, and texts without front matter, have no bullet.
    """
    block = front_matter("content")
    parsed = documents.select("path", block.alias("block")).where(F.col("block").isNotNull())
    return _bullets(
        parsed,
        unquoted(front_matter_value("block", "title")),
        unquoted(front_matter_value("block", "description")),
    )


def entries_of_tables(tables: DataFrame) -> DataFrame:
    """E6. The same bullets straight from the tables, without rendering documents for them."""
    return _bullets(
        tables.withColumn("path", document_path()), F.concat_ws(".", "schema", "table"), _summary()
    )


def _bullets(df: DataFrame, title: Column, description: Column) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    suffix = F.coalesce(F.concat(F.lit(" - "), non_empty(description)), F.lit(""))
    line = F.concat(
        F.lit("* ["), F.coalesce(non_empty(title), name), F.lit("]("), F.col("path"), F.lit(")"),
        suffix,
    )
    return df.where(~name.isin(RESERVED_NAMES)).select("path", line.alias("line"))


def render_okf_index(entries: DataFrame) -> DataFrame:
    """E6. The bundle's index as ordered lines ``path, part, content``: part 0 opens the file, every
    further part is one bullet, sorted by the parts of its path.

    The index is one text with a line per document of the bundle, so it is never joined to a string;
    lines are numbered by a range shuffle.
    """
    head = f'---\nokf_version: "{OKF_VERSION}"\n---\n\n# {INDEX_TITLE}\n\n'
    bullets = entries.select(F.split("path", "/").alias("place"), F.concat("line", F.lit("\n")).alias("content"))
    lines = ranked(bullets, [], ["place", "content"]).select(F.col("rank").alias("part"), "content")
    # A bundle without documents says so.
    nothing = (
        entries.agg(F.count("*").alias("n"))
        .where(F.col("n") == 0)
        .select(F.lit(1).cast("bigint").alias("part"), F.lit(f"{INDEX_EMPTY}\n").alias("content"))
    )
    opening = entries.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("part"), F.lit(head).alias("content")
    )
    return m.union(opening, nothing, lines).select(F.lit("index.md").alias("path"), "part", "content")


def export_formats(formats: list[str] | None = None, save_markdown: bool | None = None) -> list[str]:
    """E8. The formats to write: as given, else by the older switch for Markdown, else all."""
    if formats is not None:
        unknown = set(formats) - set(m.FORMATS)
        if unknown:
            raise ValueError(f"unknown export formats: {sorted(unknown)}")
        return list(formats)
    if save_markdown is not None:
        return [m.MARKDOWN] if save_markdown else []
    return list(m.FORMATS)


def export(
    store: Store,
    formats: list[str] | None = None,
    preformat: bool = True,
    per_part: int = PART_ITEMS,
) -> DataFrame | None:
    """E8. Documents of the chosen formats ``format, path, part, content``; None without formats.

    With ``okf`` the bundle's index is among them, built once per batch.
    """
    chosen = export_formats(formats)
    if not chosen:
        return None
    source = essential(store) if preformat else store
    frames = [_documents(source, sorted(set(chosen)), per_part, preformat)]
    if m.OKF in chosen:
        index = render_okf_index(entries_of_tables(source.tables))
        frames.append(index.withColumn("format", F.lit(m.OKF)))
    part = F.col("part").cast("bigint").alias("part")
    return m.union(*[f.select("format", "path", part, "content") for f in frames])
