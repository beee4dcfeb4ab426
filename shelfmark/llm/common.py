"""What several operators share: texts as words, row identity, seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, and what separates words for the two kinds of word.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 16 << 20  # of frames whose size is measured; larger ones are joined by shuffle


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(word) == F.char_length(word)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are measured to hold few bytes, else as it is.

    What is measured is the rows as JSON, with names and lists of any length.  ``df`` is read twice,
    so it should be a written one.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def variant(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows of equal ``row_id`` apart: 0 if every id is there once, else a hash of the text.

    Rows that are equal in both are the same document for joins; they get the same results.
    """
    repeated = docs.groupBy(row_id).count().where(F.col("count") > 1)
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64(F.col(text))


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text, variant`` of every row, and of every document once.

    Rows of equal id and text are one document; where every id is there once, nothing is moved.
    """
    plain = docs.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty()
    told = F.lit(0).cast("long") if plain else F.xxhash64("text")
    rows = docs.select("doc_id", "text").withColumn("variant", told)
    return rows, rows if plain else rows.distinct()


def seeded(seed: int | str, *columns: str) -> Column:
    """A pseudorandom key of the given columns, the same wherever and however often it is made."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
