"""Text expressions: keys, safe names, escaping, front matter, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.model import K4


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metadata_key(*names: str | Column) -> Column:
    """D1. The four names joined by '::'.  Names are never null, so nothing is skipped."""
    return F.concat_ws("::", *[col(n) for n in (names or K4)])


def sanitize(name: str | Column) -> Column:
    """D2. Replace everything but letters, digits, '_', '.' and '-' of any script by '_'."""
    return F.regexp_replace(col(name), r"[^\p{L}\p{N}_.\-]", "_")


def document_path(*names: str | Column) -> Column:
    """Path of a rendered document below its format's folder."""
    return F.concat(F.concat_ws("/", *[sanitize(n) for n in (names or K4)]), F.lit(".md"))


def md_escape(value: str | Column) -> Column:
    """E2. Text safe inside a Markdown table cell; null becomes ''."""
    value = F.coalesce(col(value), F.lit(""))
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def md_bool(value: str | Column) -> Column:
    """A boolean spelled ``True``, ``False`` or ''."""
    return F.coalesce(F.initcap(col(value).cast("string")), F.lit(""))


def non_empty(value: str | Column) -> Column:
    """Null for the empty string."""
    return F.nullif(col(value), F.lit(""))


def code(value: str | Column) -> Column:
    """Text in Markdown code marks; a missing value is spelled ``None``."""
    return F.concat(F.lit("`"), F.coalesce(col(value), F.lit("None")), F.lit("`"))


def strip(value: str | Column) -> Column:
    """Remove white space on both ends."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def iso(ts: str | Column) -> Column:
    """ISO-8601 text of a timestamp in UTC; a fraction is written only if there is one."""
    ts = F.to_utc_timestamp(col(ts), F.current_timezone())
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(
        whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00")
    )


def quoted(value: str | Column) -> Column:
    """A JSON string literal, which is also a YAML scalar."""
    body = F.to_json(F.struct(col(value).alias("v")))
    literal = body.substr(F.lit(6), F.length(body) - 6)
    # YAML, unlike JSON, folds these three line breaks inside quotes.
    for raw, escaped in (("\u0085", "\\u0085"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        literal = F.replace(literal, F.lit(raw), F.lit(escaped))
    return literal


def unquoted(value: str | Column) -> Column:
    """The text of a JSON string literal, null if it is none."""
    return F.get_json_object(F.concat(F.lit('{"v":'), col(value), F.lit("}")), "$.v")


def front_matter(content: str | Column) -> Column:
    """E7. Text between the opening line '---' and the next such line, else null.

    The end is a whole line, so a title that contains '---' does not cut the block short.
    """
    found = F.regexp_extract(col(content), r"\A---\n((?s:.*?))\n---(?:\n|\z)", 1)
    return F.when(found != "", found)


def front_matter_value(block: str | Column, key: str) -> Column:
    """The raw scalar after ``key:`` in a front-matter block, null if the key is absent."""
    found = F.regexp_extract(col(block), rf"(?m)^{key}: (.*)$", 1)
    return F.when(found != "", found)
