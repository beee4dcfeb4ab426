"""G. Scan jobs as event tables.

Events play a job's life: signup = enqueued, view = running or delivered, click = table described,
error = table failed, purchase = acknowledged.  A job is one user's day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators import jobs
from shelfmark.plans import roles
from shelfmark.plans.registry import query
from shelfmark.plans.roles import CAT, EV, K4_SQL, ORD, t, text_time
from shelfmark.plans.scope_queries import SCOPES_SQL, scopes

AS_OF = "2024-01-20 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def of_type(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind)


def _error_text(events: DataFrame) -> DataFrame:
    return of_type(events, "error").select(
        "job_id", "seq", F.concat(F.lit("table "), "seq", F.lit(": "), "props").alias("error")
    )


def _all_jobs(events: DataFrame) -> DataFrame:
    return events.select("job_id").distinct()


# A scan of the scopes: customers with recent orders are described, those with a negative balance
# fail, the others do not exist.
SCAN_SQL = f"""{SCOPES_SQL},
described AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01'),
target AS (SELECT scope_id AS job_id, e.config, e.instance, e."schema", e."table", cat.c_custkey, c_acctbal < 0 AS failed,
   d.c_custkey IS NOT NULL AS found
  FROM expanded e JOIN cat USING ({K4_SQL}) LEFT JOIN described d ON d.c_custkey = cat.c_custkey)"""


def _scan(spark, sf) -> tuple[DataFrame, DataFrame]:
    cat = roles.catalog(spark, sf)
    recent = t(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01"))
    described = cat.join(
        recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"
    )
    errors = cat.where(F.col("c_acctbal") < 0).select(*m.K4, F.lit("denied").alias("error"))
    described = described.where(F.col("c_acctbal") >= 0)
    return jobs.scan(cat, scopes(spark, sf), described, errors)


@query(
    "g1_scan_results",
    f"WITH {SCAN_SQL} SELECT job_id, {K4_SQL}, c_custkey FROM target WHERE found AND NOT failed",
)
def scan_results(spark, sf):
    return _scan(spark, sf)[0].select("job_id", *m.K4, "c_custkey")


@query(
    "g1_scan_errors",
    f"""WITH {SCAN_SQL} SELECT job_id, concat_ws('/', {K4_SQL}) || ': ' ||
          CASE WHEN failed THEN 'denied' ELSE 'not found' END AS error
        FROM target WHERE failed OR NOT found
        UNION ALL SELECT scope_id, '*/*/*/' || "table" || ': not found' FROM scopes
        WHERE scope_id NOT IN (SELECT scope_id FROM expanded)""",
)
def scan_errors(spark, sf):
    return _scan(spark, sf)[1].select("job_id", "error")


STATUS_SQL = f"""{EV},
counted AS (SELECT job_id, count(*) FILTER (event_type = 'click') AS r,
    count(*) FILTER (event_type = 'error') AS e
  FROM ev GROUP BY job_id),
texts AS (SELECT job_id, part, string_agg('table ' || seq || ': ' || props, '; ' ORDER BY seq) AS error
  FROM (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 10000 AS part FROM ev
        WHERE event_type = 'error') GROUP BY job_id, part),
folded AS (SELECT job_id, CASE WHEN e = 0 THEN 'completed' WHEN r > 0 THEN 'partial' ELSE 'failed' END
    AS status, r, e FROM counted)"""


@query(
    "g2_fold_status",
    f"""WITH {STATUS_SQL} SELECT job_id, coalesce(part, 0)::INT AS part, status,
        CASE WHEN status <> 'failed' THEN r END AS result_count, error FROM folded LEFT JOIN texts USING (job_id)""",
)
def fold_status(spark, sf):
    events = roles.events(spark, sf)
    folded = jobs.fold_status(
        _all_jobs(events), of_type(events, "click"), _error_text(events), ["seq"]
    )
    return folded


@query(
    "g2_fold_counts",
    f"""WITH {STATUS_SQL}, crash AS (SELECT DISTINCT job_id FROM ev WHERE event_type = 'view' AND value > 50)
        SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM crash) THEN 'failed' ELSE status END AS status,
          r AS result_count, e AS errors FROM folded""",
)
def fold_counts(spark, sf):
    events = roles.events(spark, sf)
    crashed = of_type(events, "view").where(F.col("value") > 50).select(
        "job_id", F.lit("lost").alias("error")
    )
    return jobs.fold_counts(
        _all_jobs(events), of_type(events, "click"), of_type(events, "error"), crashed
    )


def updates(events: DataFrame) -> DataFrame:
    """Partial updates: each event carries only some fields."""
    kind = F.col("event_type")
    return events.select(
        "job_id",
        "seq",
        "ts",
        F.when(kind == "signup", "pending")
        .when(kind == "view", "running")
        .when(kind == "purchase", "completed")
        .when(kind == "error", "partial")
        .alias("status"),
        F.when(kind == "view", F.col("ts")).alias("started_at"),
        F.when(kind == "purchase", F.col("ts")).alias("completed_at"),
        F.when(kind == "error", F.col("props")).alias("error"),
        F.when(kind == "click", F.col("seq")).alias("result_count"),
    )


def shown_state(state: DataFrame) -> DataFrame:
    return state.select(
        "job_id",
        "status",
        text_time("started_at").alias("started_at"),
        text_time("completed_at").alias("completed_at"),
        "error",
        "result_count",
    )


STATE_SQL = f"""WITH {EV} SELECT job_id,
  max_by(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
         WHEN 'purchase' THEN 'completed' ELSE 'partial' END, seq) FILTER (event_type <> 'click') AS status,
  strftime(max(ts) FILTER (event_type = 'view'), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
  max_by(props, seq) FILTER (event_type = 'error') AS error,
  max(seq) FILTER (event_type = 'click') AS result_count
FROM ev GROUP BY job_id"""


@query("g3_job_state", STATE_SQL)
def job_state(spark, sf):
    return shown_state(jobs.job_state(updates(roles.events(spark, sf)), ["ts", "seq"]))


JOBS_SQL = f"""{EV}, job AS (SELECT job_id, min(ts) AS created_at, max(ts) AS ts FROM ev GROUP BY job_id)"""


def job_index(spark, sf) -> DataFrame:
    return (
        roles.events(spark, sf)
        .groupBy("job_id")
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_at"))
    )


@query(
    "g4_recent_jobs",
    f"""WITH {JOBS_SQL}, newest AS (SELECT * FROM job ORDER BY created_at DESC, job_id DESC LIMIT 50)
        SELECT job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM newest
        WHERE job_id IN (SELECT job_id FROM ev WHERE event_type <> 'view')""",
)
def recent_jobs(spark, sf):
    live = roles.events(spark, sf).where(F.col("event_type") != "view")
    return jobs.recent_jobs(job_index(spark, sf), live).select(
        "job_id", text_time("created_at").alias("created_at")
    )


@query(
    "g5_prune",
    f"""WITH {JOBS_SQL} SELECT job_id FROM job
        WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
)
def prune(spark, sf):
    return jobs.prune(job_index(spark, sf), as_of()).select("job_id")


@query(
    "g5_live_results",
    f"""WITH {JOBS_SQL} SELECT job_id, seq FROM ev WHERE event_type = 'click' AND job_id IN
        (SELECT job_id FROM ev WHERE event_type = 'click' GROUP BY job_id
         HAVING max(ts) + INTERVAL 7 DAY > TIMESTAMP '{AS_OF}')""",
)
def live_results(spark, sf):
    clicks = of_type(roles.events(spark, sf), "click")
    return jobs.live_results(clicks, as_of()).select("job_id", "seq")


@query(
    "g6_job_results",
    """SELECT conv_id AS job_id, turn AS seq, text AS document FROM conversations ORDER BY 1, 2""",
)
def job_results(spark, sf):
    results = t(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("text").alias("document")
    )
    return jobs.job_results(results, ["seq"])


@query(
    "g6b_job_with_results",
    """WITH job AS (SELECT DISTINCT conv_id AS job_id FROM conversations),
       result AS (SELECT conv_id AS job_id, part, string_agg(text, chr(10) || '~' ORDER BY turn) AS results,
         count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10000 AS part
           FROM conversations WHERE role = 'assistant') GROUP BY ALL)
       SELECT job_id, coalesce(part, 0)::INT AS part, coalesce(results, '') AS results, coalesce(n, 0) AS n FROM job LEFT JOIN result USING (job_id)""",
)
def job_with_results(spark, sf):
    talk = t(spark, sf, "conversations").withColumnsRenamed(
        {"conv_id": "job_id", "turn": "seq", "text": "document"}
    )
    answers = talk.where(F.col("role") == "assistant")
    full = jobs.job_with_results(talk.select("job_id").distinct(), answers, ["seq"])
    return full.select(
        "job_id",
        "part",
        F.array_join("results", "\n~").alias("results"),
        F.size("results").cast("bigint").alias("n"),
    )


MESSAGES_SQL = f"""{EV}, delivery AS (SELECT job_id AS message_id, 'w' || (seq % 3) AS consumer, ts
    FROM ev WHERE event_type = 'view'),
  pending AS (SELECT message_id, max(ts) AS delivered_at, max_by(consumer, ts) AS consumer FROM delivery
    WHERE message_id NOT IN (SELECT job_id FROM ev WHERE event_type = 'purchase') GROUP BY 1)"""


def messages(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deliveries and acknowledgements; a message is a job."""
    deliveries = of_type(events, "view").select(
        F.col("job_id").alias("message_id"),
        F.concat(F.lit("w"), F.col("seq") % 3).alias("consumer"),
        F.col("ts").alias("delivered_at"),
    )
    acks = of_type(events, "purchase").select(F.col("job_id").alias("message_id"))
    return deliveries, acks


@query(
    "g7_reclaim",
    f"""WITH {MESSAGES_SQL}, first AS (SELECT * FROM pending ORDER BY
          list_transform(string_split(message_id, '-'), lambda n: TRY_CAST(n AS BIGINT)), message_id LIMIT 10)
        SELECT message_id, consumer, strftime(delivered_at, '%Y-%m-%d %H:%M:%S.%f') AS delivered_at
        FROM first WHERE consumer <> 'w0' AND delivered_at + INTERVAL 30 SECOND <= TIMESTAMP '{AS_OF}'""",
)
def reclaim(spark, sf):
    deliveries, acks = messages(roles.events(spark, sf))
    taken = jobs.reclaim(deliveries, acks, "w0", as_of())
    return taken.withColumn("delivered_at", text_time("delivered_at"))


@query(
    "g8_dedupe_results",
    f"""WITH {ORD} SELECT o_orderpriority AS job_id, {K4_SQL}, min(o_orderkey) AS seq,
        min_by(o_orderstatus, o_orderkey) AS document FROM ord GROUP BY ALL""",
)
def dedupe_results(spark, sf):
    results = roles.orders(spark, sf).select(
        F.col("o_orderpriority").alias("job_id"),
        *m.K4,
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("document"),
    )
    return jobs.dedupe_results(results, ["seq"])


@query(
    "g9_decode_messages",
    """SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END
         AS config, CAST(user_id AS VARCHAR) AS instance, props->>'k' AS "schema",
         event_type = 'click' AS no_cache, event_type = 'signup' AS generate_ai_docs,
         false AS only_if_changed, event_type <> 'purchase' AS save_metadata,
         CASE event_type WHEN 'signup' THEN 'markdown' WHEN 'click' THEN '' WHEN 'purchase' THEN 'markdown'
              ELSE 'markdown,okf' END AS formats,
         event_type <> 'signup' AS export_preformat
       FROM events WHERE event_type <> 'error'""",
)
def decode_messages(spark, sf):
    kind = F.col("event_type")
    raw = t(spark, sf, "events").select(
        F.when(kind != "error", F.col("event_id").cast("string")).otherwise("").alias("job_id"),
        F.when(kind == "view", "").otherwise(kind).alias("config_name"),
        F.col("user_id").cast("string").alias("instance_name"),
        F.get_json_object("props", "$.k").alias("schema_name"),
        F.when(kind == "click", "true").otherwise("false").alias("no_cache"),
        F.when(kind == "signup", "true").otherwise("True").alias("generate_ai_docs"),
        F.when(kind == "purchase", "false").alias("save_metadata"),
        F.when(kind == "signup", '["markdown"]').when(kind == "click", "[]").alias("export_formats"),
        F.when(kind == "signup", "false").alias("export_preformat"),
        F.when(kind == "purchase", "true").alias("save_markdown"),
    )
    decoded = jobs.decode_messages(raw)
    return decoded.withColumn("formats", F.array_join("export_formats", ",")).drop("export_formats")


@query(
    "g10_new_jobs",
    f"""WITH {CAT} SELECT sha256(concat_ws('::', {K4_SQL})) AS job_id, config AS config_name,
        instance AS instance_name, CASE WHEN c_acctbal < 0 THEN '' ELSE "schema" END AS schema_name,
        'false' AS no_cache, 'true' AS save_metadata, '["markdown","okf"]' AS export_formats FROM cat""",
)
def new_jobs(spark, sf):
    requested = roles.catalog(spark, sf).select(
        "config",
        "instance",
        F.when(F.col("c_acctbal") >= 0, F.col("schema")).alias("schema"),
        F.sha2(F.concat_ws("::", *m.K4), 256).alias("key"),
        *[F.lit(False).alias(flag) for flag in jobs.FLAGS],
        F.lit(True).alias("save_metadata"),
        F.array(*[F.lit(f) for f in m.FORMATS]).alias("export_formats"),
        F.lit(True).alias("export_preformat"),
    )
    created = jobs.new_jobs(requested, roles.now(), F.col("key"))
    return jobs.encode_messages(created).select(
        "job_id", "config_name", "instance_name", "schema_name", "no_cache", "save_metadata",
        "export_formats",
    )


# Views are answers about a user; an answer with a value below 10 is empty.
FRESH_SQL = f"""{EV}, fresh AS (SELECT user_id, max_by(props, ts) AS payload FROM ev
  WHERE event_type = 'view' AND value >= 10 AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY
    AND ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id)"""


def _snapshots(spark, sf) -> DataFrame:
    views = of_type(roles.events(spark, sf), "view").where(F.col("ts") <= as_of())
    payload = F.when(F.col("value") >= 10, F.array("props")).otherwise(
        F.array().cast("array<string>")
    )
    return views.select("user_id", "ts", payload.alias("payload"))


@query(
    "g11_needs_rescan",
    f"WITH {FRESH_SQL} SELECT DISTINCT user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM fresh)",
)
def needs_rescan(spark, sf):
    targets = t(spark, sf, "events").select("user_id").distinct()
    return jobs.needs_rescan(targets, _snapshots(spark, sf), ["user_id"], as_of())


@query("g11_fresh_answers", f"WITH {FRESH_SQL} SELECT user_id, payload FROM fresh")
def fresh_answers(spark, sf):
    fresh = jobs.fresh_answers(_snapshots(spark, sf), ["user_id"], as_of())
    return fresh.select("user_id", F.element_at("payload", 1).alias("payload"))


