"""Data model.

A table is identified by four names, ``K4``.  What a catalogue declares about it is kept as
*facts*: one row per column, key column, reference, index column or partition column.  Rows, not
nested lists, because rows can be split over tasks however wide one table is, compared without
building documents, and rendered without collecting a table anywhere.  ``describe.nest`` turns
facts into one nested record per table where a caller wants that.

What people and models add to a table (``tables`` frames) is one row per table:
``K4, ai_documentation, custom, updated_at`` and the free-form fields of stored documents as variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K4 = ["config", "instance", "schema", "table"]

# Sections a fact may belong to.
COLUMN, PRIMARY_KEY, SORT_KEY = "column", "primary_key", "sort_key"
FOREIGN_KEY, INDEX, PARTITION = "foreign_key", "index", "partition"
SECTIONS = [COLUMN, PRIMARY_KEY, SORT_KEY, FOREIGN_KEY, INDEX, PARTITION]

# Fields of a fact after K4 and ``section``; ``item`` is the constraint or index name ('' if none),
# ``position`` orders the facts of an item.
FACT_FIELDS = {
    "item": "string",
    "position": "bigint",
    "column_name": "string",
    "data_type": "string",
    "is_nullable": "boolean",
    "default_value": "string",
    "comment": "string",
    "referenced_table": "string",
    "referenced_column": "string",
    "is_unique": "boolean",
    "is_primary": "boolean",
    "index_type": "string",
    "description": "string",  # of a column, written by people
    "extra": "string",  # JSON of what a document says of it beyond these fields, keys sorted
}
FACT_COLUMNS = [*K4, "section", *FACT_FIELDS]
# A total order of the facts of one table.
FACT_ORDER = ["section", "item", "position", "column_name", "referenced_column"]

AI_TYPE = (
    "struct<summary:string,column_descriptions:map<string,string>,"
    "generated_at:timestamp,model:string>"
)
TABLE_FIELDS = {
    "ai_documentation": AI_TYPE,
    "custom": "map<string,string>",
    "updated_at": "timestamp",
    "ai_extra": "variant",  # fields of the documentation beyond those of its type
    "description_extra": "variant",  # fields of the description beyond facts
}
TABLE_COLUMNS = [*K4, *TABLE_FIELDS]

# Names of a stored document that the system owns, and those a patch may not touch.
SYSTEM_KEYS = [
    "metadata_key", "config_name", "instance_name", "schema_name",
    "table_name", "updated_at", "schema_description", "ai_documentation",
]
PROTECTED_KEYS = [
    "metadata_key", "config_name", "instance_name", "schema_name", "table_name", "updated_at",
]

# Job states.
PENDING, RUNNING, COMPLETED, PARTIAL, FAILED = (
    "pending", "running", "completed", "partial", "failed",
)

# Export formats.
MARKDOWN, OKF = "markdown", "okf"
FORMATS = [MARKDOWN, OKF]
# Folder of each format's files; the knowledge bundle is a folder of its own.
FORMAT_FOLDERS = {MARKDOWN: "markdown", OKF: "okf/catalog"}

NAME_TYPES = T.StructType([T.StructField(name, T.StringType(), False) for name in K4])


def facts(df: DataFrame, section: str | Column, **fields: Column) -> DataFrame:
    """Shape ``df`` (which carries K4) as facts; fields not given are null, ``item`` is ''."""
    fields.setdefault("item", F.lit(""))
    section = F.lit(section) if isinstance(section, str) else section
    return df.select(
        *K4,
        section.alias("section"),
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in FACT_FIELDS.items()
        ],
    )


def tables(df: DataFrame, **fields: Column) -> DataFrame:
    """Shape ``df`` (which carries K4) as a ``tables`` frame; fields not given are null."""
    return df.select(
        *K4,
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in TABLE_FIELDS.items()
        ],
    )


def union(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
