"""F. Documentation of tables by a language model that the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import model as m
from shelfmark.functions.text import strip

SYSTEM_MESSAGE = (
    "You document database tables for colleagues who have never seen them. Answer with JSON only."
)


def build_prompts(nested: DataFrame) -> DataFrame:
    """F1. One prompt per record ``K4, part, prompt`` from ``describe.nest``.

    A very wide table, which has several records, gives one prompt per part; ``joined`` brings the
    replies together again.
    """
    as_json = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    columns = F.transform("columns", lambda c: c.dropFields("description"))
    prompt = F.concat_ws(
        "\n",
        F.lit("Describe what this database table is for."),
        F.concat(F.lit("Instance: "), F.col("instance")),
        F.concat(F.lit("Schema: "), F.col("schema")),
        F.concat(F.lit("Table: "), F.col("table")),
        F.concat(F.lit("Columns: "), F.to_json(columns, {"ignoreNullFields": "false"})),
        F.concat(F.lit("Primary key: "), F.coalesce(F.to_json("primary_key.column_names"), F.lit("[]"))),
        F.concat(F.lit("References: "), as_json("foreign_keys")),
        F.lit(
            "Reply with one JSON object: 'summary', one sentence on the table, and "
            "'column_descriptions', an object from column name to a short text."
        ),
    )
    return nested.select(*m.K4, "part", prompt.alias("prompt"))


def joined(replies: DataFrame) -> DataFrame:
    """Parsed replies of a table's parts as one row per table ``K4, ai_documentation,
    ai_generation_status, ai_generation_error``.

    The summary is that of the first part that has one; descriptions of columns are those of all
    parts, as each describes its own columns; failed if all parts are.  There is a part per
    ``PART_ITEMS`` facts, so what is brought together is small.
    """
    ai, status = F.col("ai_documentation"), F.col("ai_generation_status")
    descriptions = F.flatten(
        F.collect_list(F.struct("part", F.map_entries(ai["column_descriptions"]).alias("e")))["e"]
    )
    named = F.aggregate(
        descriptions,
        F.create_map().cast("map<string,string>"),
        lambda all_, e: F.map_concat(
            all_, F.map_filter(F.map_from_entries(F.array(e)), lambda k, v: ~F.map_contains_key(all_, k))
        ),
    )
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("part")))
    grouped = replies.groupBy(*m.K4).agg(
        first(ai["summary"]).alias("summary"), named.alias("column_descriptions"),
        F.max(ai["generated_at"]).alias("generated_at"), F.max(ai["model"]).alias("model"),
        F.max(ai.isNotNull()).alias("any"),
        F.max(F.when(status == "generated", status)).alias("generated"),
        first(F.col("ai_generation_error")).alias("error"),
    )
    parts = ["summary", "column_descriptions", "generated_at", "model"]
    return grouped.select(
        *m.K4,
        F.when(F.col("any"), F.struct(*parts)).cast(m.AI_TYPE).alias("ai_documentation"),
        F.coalesce("generated", F.lit("failed")).alias("ai_generation_status"),
        F.when(F.col("generated").isNull(), F.col("error")).alias("ai_generation_error"),
    )


def generate(
    prompts: DataFrame,
    call: Callable[[str, str], str],
    attempts: int = 2,
    pause: float = 2.0,
) -> DataFrame:
    """F4. Add ``reply`` and ``call_error``: ``call(system, prompt)`` per row, tried again once.

    Runs in Arrow batches on the executors; a row that fails carries its error and stops nothing.
    """
    answers = [T.StructField(name, T.StringType()) for name in ("reply", "call_error")]
    schema = T.StructType([*prompts.schema.fields, *answers])

    def ask(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(attempts):
            if attempt:
                time.sleep(pause)
            try:
                return call(SYSTEM_MESSAGE, prompt), None
            except Exception as e:
                error = str(e) or type(e).__name__
        return None, error

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = [ask(prompt) for prompt in frame["prompt"]]
            yield frame.assign(reply=[a[0] for a in asked], call_error=[a[1] for a in asked])

    return prompts.mapInPandas(batches, schema)


def without_fence(reply: str | Column) -> Column:
    """F2. A reply without the code fence around it (with or without a language)."""
    text = strip(reply)
    rest = F.when(
        F.contains(text, F.lit("\n")), F.regexp_replace(text, r"\A[^\n]*\n", "")
    ).otherwise(F.regexp_replace(text, r"\A```", ""))
    closed = F.when(rest.endswith("```"), strip(F.regexp_replace(rest, r"```\z", ""))).otherwise(rest)
    return F.when(text.startswith("```"), closed).otherwise(text)


def parse_replies(replies: DataFrame, model: str, now: Column) -> DataFrame:
    """F2, F3. Add ``ai_documentation``, ``ai_generation_status``, ``ai_generation_error``.

    A reply that is no JSON object gives the status ``failed`` and no documentation.
    """
    text = without_fence("reply")
    is_object = F.coalesce(
        F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)
    )
    parsed = F.from_json(text, "summary string, column_descriptions map<string,string>")
    document = F.struct(
        F.coalesce(parsed["summary"], F.lit("")).alias("summary"),
        F.coalesce(
            parsed["column_descriptions"], F.create_map().cast("map<string,string>")
        ).alias("column_descriptions"),
        now.cast("timestamp").alias("generated_at"),
        F.lit(model).alias("model"),
    )
    failed = F.col("call_error") if "call_error" in replies.columns else F.lit(None).cast("string")
    empty = F.coalesce(F.col("reply") == "", F.lit(True))
    error = (
        F.when(failed.isNotNull(), failed)
        .when(empty, F.lit(f"Model '{model}' sent an empty reply"))
        .when(~is_object, F.lit(f"Model '{model}' sent no JSON object"))
    )
    return (
        replies.withColumn("ai_generation_error", error)
        .withColumn(
            "ai_generation_status",
            F.when(F.col("ai_generation_error").isNull(), "generated").otherwise("failed"),
        )
        .withColumn(
            "ai_documentation", F.when(F.col("ai_generation_error").isNull(), document)
        )
    )
