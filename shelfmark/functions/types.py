"""B13. Source type codes to readable names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import col

# Key-value store attribute codes.
DYNAMO_TYPES = {"S": "String", "N": "Number", "B": "Binary"}

# BSON aliases.
BSON_TYPES = {
    "string": "string",
    "int": "int32",
    "long": "int64",
    "double": "double",
    "decimal": "decimal128",
    "bool": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "objectId": "ObjectId",
    "array": "array",
    "object": "object",
    "binData": "binary",
    "null": "null",
}


def normalise_type(code: str | Column, mapping: dict[str, str]) -> Column:
    """The mapped name of a type code; a code that is not in the mapping passes through.

    The mapping is a literal of the expression, so no join is needed.
    """
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    code = col(code)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)
