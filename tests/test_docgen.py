"""F. Generated documentation."""

import json

from pyspark.sql import functions as F

from helpers import column, facts, rows
from shelfmark.operators import describe, docgen


def test_prompt_names_everything(spark):
    listed = facts(
        spark, ("t", "column", column("id")), ("t", "column", column("name", 2, comment="who")),
        ("t", "primary_key", {"column_name": "id", "position": 1}),
    )
    prompt = docgen.build_prompts(describe.nest(listed)).first().prompt
    assert "Table: t" in prompt and 'Primary key: ["id"]' in prompt and '"comment":"who"' in prompt
    assert json.loads(prompt.split("Columns: ")[1].split("\n")[0])[1]["name"] == "name"


def replies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, reply string")


def test_replies(spark):
    good = '{"summary":"s","column_descriptions":{"id":"key"}}'
    df = replies(
        spark, good, f"```json\n{good}\n```", f"  ```\n{good}```  ", f"```{good}```", "{}", "not json",
        "[1]", "", None, f"```json\n{good}", "```", '{"summary":null}',
    )
    got = docgen.parse_replies(df, "m", F.lit("2024-01-01")).orderBy("n").collect()
    summaries = [r.ai_documentation.summary if r.ai_documentation else None for r in got]
    assert summaries == ["s", "s", "s", "s", "", None, None, None, None, "s", None, ""]
    assert got[0].ai_documentation.column_descriptions == {"id": "key"}
    assert got[4].ai_documentation.column_descriptions == {}
    assert [r.ai_generation_status for r in got].count("failed") == 5
    assert got[5].ai_generation_error == "Model 'm' sent no JSON object"
    assert got[7].ai_generation_error == got[8].ai_generation_error == "Model 'm' sent an empty reply"


def test_generate_tries_twice_and_isolates_failures(spark):
    calls = {}

    def call(system, prompt):
        calls[prompt] = calls.get(prompt, 0) + 1
        if prompt == "never" or (prompt == "once" and calls[prompt] == 1):
            raise RuntimeError("down")
        return json.dumps({"summary": f"{prompt} {calls[prompt]}"})

    prompts = spark.createDataFrame([("fine",), ("once",), ("never",)], "prompt string").coalesce(1)
    answered = docgen.generate(prompts, call, pause=0.0)
    assert prompts.columns == ["prompt"]
    got = docgen.parse_replies(answered, "m", F.lit("2024-01-01"))
    assert rows(got, "prompt", "ai_documentation.summary", "ai_generation_status", "ai_generation_error") == [
        ("fine", "fine 1", "generated", None), ("never", None, "failed", "down"),
        ("once", "once 2", "generated", None),
    ]
