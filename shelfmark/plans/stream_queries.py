"""A6, G3, G7, G8 as streams over the given events, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions.text import document_path
from shelfmark.operators import describe, jobs
from shelfmark.plans import roles
from shelfmark.plans.job_queries import STATE_SQL, shown_state, updates
from shelfmark.plans.registry import query
from shelfmark.plans.roles import CAT, EV, SCHEMAS
from shelfmark.shared import new_folder, written
from shelfmark.sources.scans import apply_requests
from shelfmark.sources.store import read_exports, read_store
from shelfmark.streaming import scans


def event_stream(spark, sf, max_files: int = 1) -> DataFrame:
    raw = scans.read_scan_events(spark, f"{sf}/events.parquet*", SCHEMAS["events"], max_files)
    return raw.select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
    )


@query("a6_read_scan_events", f"WITH {EV} SELECT job_id, seq, event_type, props FROM ev")
def read_scan_events(spark, sf):
    path = new_folder(spark, "events")
    shown = event_stream(spark, sf).select("job_id", "seq", "event_type", "props")
    scans.write_append(shown, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("job_id string, seq bigint, event_type string, props string").parquet(
        f"{path}/out"
    )


@query("g3_stream_job_state", STATE_SQL)
def stream_job_state(spark, sf):
    path = new_folder(spark, "state")
    stream = updates(event_stream(spark, sf))
    scans.write_job_state(
        stream, f"{path}/out", f"{path}/checkpoint", ["ts", "seq"]
    ).awaitTermination()
    return shown_state(scans.read_job_state(spark, f"{path}/out"))


@query("g3_compacted_state", STATE_SQL)
def compacted_state(spark, sf):
    """The events in batches, whose folders are merged in levels, so that few are left."""
    path = new_folder(spark, "state")
    roles.t(spark, sf, "events").repartition(9, "event_id").write.parquet(f"{path}/events.parquet")
    stream = updates(event_stream(spark, path))
    scans.write_job_state(
        stream, f"{path}/out", f"{path}/checkpoint", ["ts", "seq"], fan=3
    ).awaitTermination()
    return shown_state(scans.read_job_state(spark, f"{path}/out"))


@query(
    "g8_stream_dedupe",
    f"WITH {EV} SELECT DISTINCT job_id, event_type FROM ev",
)
def stream_dedupe(spark, sf):
    path = new_folder(spark, "dedupe")
    stream = event_stream(spark, sf).select("job_id", "event_type", "ts")
    deduped = scans.dedupe_stream(stream, ["job_id", "event_type"], "60 days")
    scans.write_append(deduped, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    written = spark.read.schema("job_id string, event_type string").parquet(f"{path}/out")
    return written.select("job_id", "event_type")


ALL_FILES = 1_000_000  # of a micro-batch


# Sessions of a message's events without a pause of 30 seconds.
ABANDONED_SQL = f"""WITH {EV},
  steps AS (SELECT job_id AS message_id, ts, seq, event_type, coalesce(ts > lag(ts) OVER w + INTERVAL 30 SECOND, true)::INT
      AS begins
    FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
  sessions AS (SELECT message_id, nr, max(ts) AS last, max(ts) FILTER (event_type = 'view') AS delivered_at,
      max_by('w' || (seq % 3), (ts, 'w' || (seq % 3))) FILTER (event_type = 'view') AS consumer,
      bool_or(event_type = 'purchase') AS acked
    FROM (SELECT *, sum(begins) OVER (PARTITION BY message_id ORDER BY ts) AS nr FROM steps) GROUP BY ALL)
  SELECT message_id, consumer, strftime(delivered_at, '%Y-%m-%d %H:%M:%S') AS delivered_at FROM sessions
  WHERE delivered_at IS NOT NULL AND NOT acked AND consumer <> 'w0'
    AND last + INTERVAL 30 SECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM events)"""


def _abandoned(spark, events: DataFrame, path: str) -> DataFrame:
    """What the stream finds from where ``path``'s checkpoint left it, and before."""
    kind = F.col("event_type")
    deliveries = events.select(
        F.col("job_id").alias("message_id"),
        F.when(kind == "view", "delivered").when(kind == "purchase", "acked").alias("kind"),
        F.concat(F.lit("w"), F.col("seq") % 3).alias("consumer"),
        "ts",
    )
    found = scans.abandoned_stream(deliveries, "w0")
    scans.write_append(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    schema = "message_id string, consumer string, delivered_ms bigint"
    at = F.date_format(F.timestamp_millis("delivered_ms"), "yyyy-MM-dd HH:mm:ss")
    return spark.read.schema(schema).parquet(f"{path}/out").select(
        "message_id", "consumer", at.alias("delivered_at")
    )


@query("g7_stream_abandoned", ABANDONED_SQL)
def stream_abandoned(spark, sf):
    return _abandoned(spark, event_stream(spark, sf), new_folder(spark, "abandoned"))


@query("g7_stream_abandoned_batches", ABANDONED_SQL)
def stream_abandoned_batches(spark, sf):
    """The same events in three parts, one after the other in time; each comes when the stream has ended
    with those before, and is one micro-batch of however many files Spark writes."""
    path, out = new_folder(spark, "parts"), new_folder(spark, "abandoned")
    events = roles.t(spark, sf, "events")
    cuts = events.agg(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    late = F.when(F.col("ts") < F.lit(cuts[0]), 0).when(F.col("ts") < F.lit(cuts[1]), 1).otherwise(2)
    for k in range(3):
        events.where(late == k).write.mode("append").parquet(f"{path}/events.parquet")
        found = _abandoned(spark, event_stream(spark, path, ALL_FILES), out)
    return found


# One request per nation, without configuration; those of one region name instances that are gone.
@query(
    "g1_stream_scans",
    f"""WITH {CAT},
      request AS (SELECT 'job_' || n_nationkey AS job_id, CASE WHEN n_regionkey = 0 THEN 'gone_' || n_name
          ELSE n_name END AS instance FROM nation),
      described AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01'),
      target AS (SELECT job_id, c_acctbal >= 0 AND d.c_custkey IS NOT NULL AS found FROM request
        JOIN cat USING (instance) LEFT JOIN described d ON d.c_custkey = cat.c_custkey),
      counted AS (SELECT job_id, count(*) FILTER (found) AS r, count(*) FILTER (NOT found) AS e
        FROM target GROUP BY job_id)
      SELECT job_id, CASE WHEN coalesce(e, 1) = 0 THEN 'completed' WHEN coalesce(r, 0) > 0 THEN 'partial'
          ELSE 'failed' END AS status, coalesce(r, 0) AS result_count, coalesce(e, 1) AS errors
      FROM request LEFT JOIN counted USING (job_id)""",
)
def stream_scans(spark, sf):
    path = new_folder(spark, "scans")
    nations = scans.read_scan_events(spark, f"{sf}/nation.parquet*", SCHEMAS["nation"])
    gone = F.when(F.col("n_regionkey") == 0, "gone_").otherwise("")
    messages = nations.select(
        F.concat(F.lit("job_"), "n_nationkey").alias("job_id"),
        F.lit("").alias("config_name"),
        F.concat(gone, "n_name").alias("instance_name"),
        F.lit("").alias("schema_name"),
    )
    cat = roles.catalog(spark, sf)
    recent = roles.t(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01"))
    described = cat.join(
        recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"
    ).where(F.col("c_acctbal") >= 0)
    errors = cat.where(F.col("c_acctbal") < 0).select(*m.K4, F.lit("denied").alias("error"))
    scans.write_scans(
        messages, cat, described, errors, f"{path}/out", f"{path}/checkpoint"
    ).awaitTermination()
    return jobs.fold_counts(*scans.read_scans(spark, f"{path}/out"))


# Requests of every kind of options, run twice over the same facts, the second time without exports:
# what is saved, when, and exported.
@query(
    "g1_scan_options",
    f"""WITH {CAT},
      described AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders)
      SELECT config, instance, "schema", "table", n_nationkey % 5 <> 0 AS saved,
        CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN '2024-01-01' ELSE '2024-02-02' END
          AS updated_on, n_nationkey % 3 <> 1 AS markdown, n_nationkey % 3 <> 0 AS okf
      FROM cat JOIN nation ON n_name = instance SEMI JOIN described USING (c_custkey)""",
)
def scan_options(spark, sf):
    """Even nations are saved only if changed, every fifth is not saved; formats go round."""
    path = new_folder(spark, "options")
    key = F.col("n_nationkey")
    text = lambda condition: condition.cast("string")
    nations = scans.read_scan_events(spark, f"{sf}/nation.parquet*", SCHEMAS["nation"]).select(
        F.concat(F.lit("job_"), key).alias("job_id"),
        F.lit("").alias("config_name"),
        F.col("n_name").alias("instance_name"),
        F.lit("").alias("schema_name"),
        text(key % 5 != 0).alias("save_metadata"),
        text(key % 2 == 0).alias("only_if_changed"),
        F.when(key % 3 == 0, '["markdown"]').when(key % 3 == 1, '["okf"]').otherwise('["okf","markdown"]')
        .alias("export_formats"),
        F.lit("true").alias("export_preformat"),
    )
    again = nations.withColumn("export_formats", F.lit("[]"))
    cat = roles.catalog(spark, sf)
    facts = written(describe.columns_mysql(roles.raw_columns_mysql(spark, sf)), "facts")
    described = facts.select(*m.K4).distinct()
    errors = cat.limit(0).select(*m.K4, F.lit("").alias("error"))
    for day, messages in (("2024-01-01", nations), ("2024-02-02", again)):

        def apply(requests, results, at=F.lit(day).cast("timestamp")):
            apply_requests(requests, results, facts, f"{path}/store", f"{path}/exports", at)

        scans.write_scans(
            messages, cat, described, errors, f"{path}/out-{day}", f"{path}/checkpoint-{day}", apply
        ).awaitTermination()
    stored = read_store(spark, f"{path}/store").tables.select(
        *m.K4, F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on")
    )
    has = lambda f: F.max(F.col("format") == f)
    exported = read_exports(spark, f"{path}/exports").groupBy("path").agg(
        has(m.MARKDOWN).alias("markdown"), has(m.OKF).alias("okf")
    )
    return (
        described.withColumn("path", document_path())
        .join(stored, m.K4, "left")
        .join(exported, "path", "left")
        .select(*m.K4, F.col("updated_on").isNotNull().alias("saved"), "updated_on", "markdown", "okf")
    )
