"""G. Scan jobs as event tables.

``scan_event``: ``job_id, seq, ts`` and the fields an event carries, null where it carries none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators.lists import PART_ITEMS, ordered_lists, ordered_text
from shelfmark.operators.scope import expand_scope, unmatched_scopes

RETENTION = "interval 7 days"
FRESHNESS = "interval 1 day"
STATE_FIELDS = ["status", "started_at", "completed_at", "error", "result_count"]


def scan(
    catalog: DataFrame, scopes: DataFrame, described: DataFrame, errors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """G1. Fan scopes (``scope_id`` = job) out to tables: ``(results, errors)``.

    ``described``: one row per described table (K4 and whatever a result carries); ``errors``:
    ``K4, error``.  A table of the scope that is neither becomes an error as well.  Failures are
    rows, so none stops another table, and a job's count is the number of its results.
    """
    targets = expand_scope(catalog, scopes).withColumnRenamed("scope_id", "job_id")
    failed = errors.select(*m.K4, "error")
    results = targets.join(failed.select(*m.K4), m.K4, "left_anti").join(described, m.K4)
    missing = (
        targets.join(described.select(*m.K4), m.K4, "left_anti")
        .join(failed, m.K4, "left")
        .select(
            "job_id",
            *m.K4,
            F.concat(
                F.concat_ws("/", *m.K4), F.lit(": "), F.coalesce("error", F.lit("not found"))
            ).alias("error"),
        )
    )
    uncovered = unmatched_scopes(
        scopes, targets.select(F.col("job_id").alias("scope_id"))
    ).select(
        F.col("scope_id").alias("job_id"),
        *[F.lit(None).cast("string").alias(k) for k in m.K4],
        "error",
    )
    return results, missing.unionByName(uncovered)


def fold_counts(
    jobs: DataFrame, results: DataFrame, errors: DataFrame, crashed: DataFrame | None = None
) -> DataFrame:
    """G2. ``job_id, status, result_count, errors`` by one pre-aggregated count.

    Errors and results: partial; errors alone: failed; no errors: completed; a run that broke off
    itself (``crashed``: ``job_id, error``): failed.
    """

    def marked(df: DataFrame, result: int, error: int, crash: int) -> DataFrame:
        return df.select(
            "job_id", F.lit(result).alias("r"), F.lit(error).alias("e"), F.lit(crash).alias("c")
        )

    rows = [marked(jobs, 0, 0, 0), marked(results, 1, 0, 0), marked(errors, 0, 1, 0)]
    if crashed is not None:
        rows.append(marked(crashed, 0, 0, 1))
    return (
        m.union(*rows)
        .groupBy("job_id")
        .agg(*[F.sum(c).alias(c) for c in ("r", "e", "c")])
        .select(
            "job_id",
            F.when(F.col("c") > 0, m.FAILED)
            .when(F.col("e") == 0, m.COMPLETED)
            .when(F.col("r") > 0, m.PARTIAL)
            .otherwise(m.FAILED)
            .alias("status"),
            F.col("r").alias("result_count"),
            F.col("e").alias("errors"),
        )
    )


def fold_status(
    jobs: DataFrame,
    results: DataFrame,
    errors: DataFrame,
    order: list[str],
    crashed: DataFrame | None = None,
    per_part: int = PART_ITEMS,
) -> DataFrame:
    """G2. Final state ``job_id, part, status, result_count, error``.

    ``error`` joins the errors of a job in order by '; ', ``per_part`` of them per row; a job without
    errors has one row.  Only completed and partial jobs carry a result count.
    """
    counts = fold_counts(jobs, results, errors, crashed)
    texts = ordered_text(errors, ["job_id"], order, F.col("error"), "error", "; ", per_part)
    if crashed is not None:
        broken = crashed.groupBy("job_id").agg(F.min("error").alias("error"))
        texts = m.union(
            texts.join(broken, "job_id", "left_anti"),
            broken.select("job_id", F.lit(0).alias("part"), "error"),
        )
    return counts.join(texts, "job_id", "left").select(
        "job_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "status",
        F.when(F.col("status") != m.FAILED, F.col("result_count")).alias("result_count"),
        "error",
    )


def job_state(
    events: DataFrame, order: list[str], fields: list[str] | None = None
) -> DataFrame:
    """G3. Current state per job: of every field the last value that an event carries.

    ``max_by`` over the events that carry the field combines before the shuffle, so a job with very
    many events costs one row per task.  The result, with its ``order`` per field dropped, can be
    folded again (see the streaming form).
    """
    place = F.struct(*order)
    return events.groupBy("job_id").agg(
        *[
            F.max_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f)
            for f in fields or STATE_FIELDS
        ]
    )


def recent_jobs(jobs: DataFrame, live: DataFrame, limit: int = 50) -> DataFrame:
    """G4. The newest jobs of the index, then without those that have expired, so fewer may
    come back.  A top-n, not a sort; at most ``limit`` rows meet the join."""
    newest = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)
    return newest.join(live.select("job_id"), "job_id", "left_semi")


def prune(jobs: DataFrame, as_of: Column, ttl: str = RETENTION) -> DataFrame:
    """G5. Index entries created after ``as_of - ttl``; the boundary itself has expired."""
    return jobs.where(F.col("created_at") > as_of - F.expr(ttl))


def live_results(results: DataFrame, as_of: Column, ttl: str = RETENTION) -> DataFrame:
    """G5. Results of jobs whose *last* append is not older than ``ttl``: each append restarts it."""
    live = (
        results.groupBy("job_id")
        .agg(F.max("ts").alias("last"))
        .where(F.col("last") + F.expr(ttl) > as_of)
        .select("job_id")
    )
    return results.join(live, "job_id", "left_semi")


def job_results(results: DataFrame, order: list[str], job_id: str | None = None) -> DataFrame:
    """G6. Results in the order they were appended, of one job or of all."""
    if job_id is not None:
        return results.where(F.col("job_id") == job_id).orderBy(*order)
    return results.orderBy("job_id", *order)


def job_with_results(
    jobs: DataFrame,
    results: DataFrame,
    order: list[str],
    include: bool = True,
    per_part: int = PART_ITEMS,
) -> DataFrame:
    """G6b. Jobs with their results as an ordered array per ``part``, or without them.

    A part has ``per_part`` results; a job without results has one row with an empty array.
    """
    if not include:
        return jobs
    lists = ordered_lists(results, ["job_id"], order, F.col("document"), "results", per_part)
    nothing = F.array().cast("array<string>")
    return (
        jobs.join(lists, "job_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("results", F.coalesce("results", nothing))
    )


def reclaim(
    deliveries: DataFrame,
    acks: DataFrame,
    me: str,
    as_of: Column,
    min_idle: str = "interval 30 seconds",
    count: int = 10,
) -> DataFrame:
    """G7. Messages to take over: of the first ``count`` unacknowledged ones by id, those idle for
    at least ``min_idle`` and held by another consumer.

    Ids are numbers joined by dashes, time and sequence, and are ordered as such: 2 comes before 10.

    The last delivery per message combines before the shuffle; the first ``count`` are a top-n.
    """
    numbers = F.transform(F.split("message_id", "-"), lambda n: n.try_cast("bigint"))
    pending = (
        deliveries.groupBy("message_id")
        .agg(F.max(F.struct("delivered_at", "consumer")).alias("last"))
        .join(acks.select("message_id"), "message_id", "left_anti")
        .orderBy(numbers, "message_id")
        .limit(count)
    )
    return pending.where(
        (F.col("last.delivered_at") + F.expr(min_idle) <= as_of) & (F.col("last.consumer") != me)
    ).select("message_id", "last.consumer", "last.delivered_at")


def dedupe_results(results: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """G8. First result per job and table.

    Delivery is at least once: a job taken over runs again and appends its results again.  Reading
    results as they are shows them all; this is the option to see each table once.
    """
    keys = keys or ["job_id", *m.K4]
    rest = [c for c in results.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return results.groupBy(*keys).agg(first).select(*keys, "first.*")


FLAGS = ["no_cache", "generate_ai_docs", "only_if_changed"]


def decode_messages(messages: DataFrame) -> DataFrame:
    """G9. Queue messages (all text) to typed requests; messages without a job id are skipped.

    Empty names are null, flags are true only for ``"true"``, ``save_metadata`` and
    ``export_preformat`` default to true, formats are JSON, else by the older ``save_markdown``.
    """
    has = lambda c: c in messages.columns
    text = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    is_true = lambda c, default: F.coalesce(text(c), F.lit(default)) == "true"
    every = F.array(*[F.lit(f) for f in m.FORMATS])
    older = F.when(text("save_markdown") == "true", F.array(F.lit(m.MARKDOWN))).otherwise(
        F.array().cast("array<string>")
    )
    formats = (
        F.when(text("export_formats").isNotNull(), F.from_json(text("export_formats"), "array<string>"))
        .when(text("save_markdown").isNotNull(), older)
        .otherwise(every)
    )
    preformat = F.when(text("export_formats").isNotNull(), is_true("export_preformat", "true")).otherwise(
        F.lit(True)
    )
    return messages.where(F.coalesce("job_id", F.lit("")) != "").select(
        "job_id",
        *[F.nullif(text(f"{k}_name"), F.lit("")).alias(k) for k in m.K4[:3]],
        *[is_true(flag, "").alias(flag) for flag in FLAGS],
        is_true("save_metadata", "true").alias("save_metadata"),
        formats.alias("export_formats"),
        preformat.alias("export_preformat"),
    )


def new_jobs(scopes: DataFrame, now: Column, job_id: Column | None = None) -> DataFrame:
    """G10. Pending jobs for scopes; ``job_id`` defaults to a random UUID."""
    return scopes.withColumns(
        {
            "job_id": F.expr("uuid()") if job_id is None else job_id,
            "status": F.lit(m.PENDING),
            "created_at": now,
            "started_at": F.lit(None).cast("timestamp"),
            "completed_at": F.lit(None).cast("timestamp"),
            "error": F.lit(None).cast("string"),
            "result_count": F.lit(None).cast("bigint"),
        }
    )


def encode_messages(jobs: DataFrame) -> DataFrame:
    """G10. The queue message of a job: all text, names that are null empty."""
    as_text = lambda c: F.when(F.col(c), "true").otherwise("false")
    return jobs.select(
        "job_id",
        *[F.coalesce(F.col(k), F.lit("")).alias(f"{k}_name") for k in m.K4[:3]],
        *[as_text(c).alias(c) for c in [*FLAGS, "save_metadata"]],
        F.to_json("export_formats").alias("export_formats"),
        as_text("export_preformat").alias("export_preformat"),
    )


def fresh_answers(
    snapshots: DataFrame, keys: list[str], as_of: Column, ttl: str = FRESHNESS
) -> DataFrame:
    """G11. The latest answer per key that is younger than ``ttl``; empty answers do not count."""
    usable = snapshots.where((F.col("ts") > as_of - F.expr(ttl)) & (F.size("payload") > 0))
    return usable.groupBy(*keys).agg(F.max_by("payload", "ts").alias("payload"))


def needs_rescan(
    targets: DataFrame,
    snapshots: DataFrame,
    keys: list[str],
    as_of: Column,
    ttl: str = FRESHNESS,
    no_cache: bool = False,
) -> DataFrame:
    """G11. Targets without a fresh answer; with ``no_cache`` all of them."""
    if no_cache:
        return targets
    return targets.join(fresh_answers(snapshots, keys, as_of, ttl), keys, "left_anti")
