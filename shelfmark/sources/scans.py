"""G1. What a scan's requests ask to do with its results: save, compare, document, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators import docgen, export
from shelfmark.operators.describe import nest
from shelfmark.operators.store import Store, merge_metadata
from shelfmark.shared import written
from shelfmark.sources.store import commit_merge, read_store, write_exports

_LEVELS = m.K4[:3]


def _documented(
    facts: DataFrame, call: Callable[[str, str], str], model: str, now: Column, **options
) -> DataFrame:
    """``K4, ai_documentation, ai_generation_status, ai_generation_error`` of the described tables."""
    replies = docgen.generate(docgen.build_prompts(nest(facts)), call, **options)
    return written(docgen.joined(docgen.parse_replies(replies, model, now)), "documented")


def apply_requests(
    requests: DataFrame,
    results: DataFrame,
    facts: DataFrame,
    store: str,
    exports: str,
    now: Column,
    call: Callable[[str, str], str] | None = None,
    model: str = "model",
    **options,
) -> DataFrame:
    """Do with the scanned tables what their requests say; ``K4, action, ai_generation_status,
    ai_generation_error`` per table.

    ``requests``: decoded ones (``jobs.decode_messages``); ``results``: ``job_id, K4`` of the tables
    found; ``facts``: what was found of them.  A table is saved if any of its requests saves, and
    only if it changed if all of these say so; it is documented by ``call`` if any asks for that; it
    is exported in every form that any asks for, saved or not.  Only the schemas of the scan are read
    and, where something changed, written.  Nothing is cached, so ``no_cache`` has nothing to do.
    """
    spark = requests.sparkSession
    save, if_changed = F.col("save_metadata"), F.col("only_if_changed")
    wanted = results.select("job_id", *m.K4).join(requests.drop(*m.K4), "job_id")
    targets = written(
        wanted.select(
            *m.K4, save.alias("save"), (save & ~if_changed).alias("always"), "generate_ai_docs",
            F.array_sort(F.array_distinct("export_formats")).alias("formats"), "export_preformat",
        ),
        "targets",
    )
    per_table = written(
        targets.groupBy(*m.K4).agg(
            F.max("save").alias("save"), F.max("always").alias("always"), F.max("generate_ai_docs").alias("ai")
        ),
        "scanned",
    )
    found = written(facts.join(per_table, m.K4, "left_semi").select(*m.FACT_COLUMNS), "found")
    nothing = "ai_documentation " + m.AI_TYPE + ", ai_generation_status string, ai_generation_error string"
    names = ", ".join(f"`{k}` string" for k in m.K4)
    documented = spark.createDataFrame([], f"{names}, {nothing}")
    if call is not None:
        asked = found.join(per_table.where("ai"), m.K4, "left_semi")
        documented = _documented(asked, call, model, now, **options)
    incoming = per_table.join(documented, m.K4, "left")

    schemas = written(per_table.select(*_LEVELS).distinct(), "schemas")
    scanned = []
    groups = [("save AND always", False, True), ("save AND NOT always", True, True), ("NOT save", False, False)]
    for condition, only_if_changed, saved in groups:
        own = incoming.where(condition)
        if own.isEmpty():
            continue
        stored = read_store(spark, store).within(schemas)
        tables = m.tables(own, ai_documentation=F.col("ai_documentation"))
        new = Store(tables, found.join(own.select(*m.K4), m.K4, "left_semi"))
        merged = merge_metadata(stored, new, now, only_if_changed=only_if_changed, save=saved)
        if saved:
            # Another worker may have saved the same schemas meanwhile: then this is a newer merge.
            merged, _ = commit_merge(merged, store)
        scanned.append(Store(*[written(frame, "merged") for frame in merged.scanned]))

    if scanned:
        whole = Store(m.union(*[s.tables for s in scanned]), m.union(*[s.facts for s in scanned]))
        # At most every choice of formats, compact or not.
        forms = targets.select("formats", "export_preformat").distinct().collect()
        for form in forms:
            same = F.col("formats") == F.array(*map(F.lit, form["formats"])).cast("array<string>")
            chosen = targets.where(same & (F.col("export_preformat") == form["export_preformat"]))
            keys = chosen.select(*m.K4).distinct()
            part = Store(*[f.join(keys, m.K4, "left_semi") for f in whole])
            documents = export.export(part, form["formats"], form["export_preformat"])
            if documents is not None:
                write_exports(documents, exports)
        actions = whole.tables.select(*m.K4, "action")
    else:
        actions = per_table.select(*m.K4, F.lit(None).cast("string").alias("action"))
    status = documented.select(*m.K4, "ai_generation_status", "ai_generation_error")
    return actions.join(status, m.K4, "left")
