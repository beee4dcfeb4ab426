from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the input.
CLASHING = (
    "size rank before variant key id node item score label words lines runs pos off first last block uses "
    "copies draws kind value head component _part _at _key _doc_id _text n_words vote_length row turn2"
).split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """A function of rows ``(doc_id, text, source)``: documents with many clashing columns."""

    def make(rows, clashing=True, partitions=3):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(partitions)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])
        return df

    return make
