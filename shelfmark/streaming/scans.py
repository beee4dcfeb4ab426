"""A6, G3, G5, G7, G8 as streams.

A stream's own progress is its checkpoint; there are no acknowledgements or consumers to manage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.jobs import STATE_FIELDS, decode_messages, scan
from shelfmark.operators.scope import resolve_owner
from shelfmark.shared import written
from shelfmark.streaming import state


def read_scan_events(
    spark: SparkSession, path: str, schema: str, max_files: int = 1, format: str = "parquet"
) -> DataFrame:
    """A6. Scan messages or events as a stream, at most ``max_files`` files per batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .format(format)
        .load(path)
    )


def read_kafka_events(spark: SparkSession, schema: str, max_messages: int, **options: str) -> DataFrame:
    """A6. The same from Kafka (if its connector is on the class path); values are JSON."""
    raw = (
        spark.readStream.format("kafka")
        .options(**options)
        .option("maxOffsetsPerTrigger", max_messages)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def _latest(field: str, place: list[str]) -> Column:
    return F.max(F.when(F.col(field).isNotNull(), F.struct(*place, field))).alias(field)


def write_job_state(
    events: DataFrame,
    path: str,
    checkpoint: str,
    order: list[str],
    fields: list[str] | None = None,
    fan: int = state.FAN,
    ttl_seconds: float | None = None,
) -> StreamingQuery:
    """G3, G5. Fold each batch of events to one row per job and add it to the state in ``path``.

    The last value of a field is a maximum over its place, so batches can be folded one by one, merged and
    folded again when read: the stream keeps no state, however many jobs there are, and the folders it
    leaves are merged in levels, see ``state``.  A batch that runs twice is added once.

    With ``ttl_seconds`` jobs without an event for so long, up to the newest event of all, are dropped
    when folders are merged, and not read before that; the first of ``order`` is an event's time.  A job
    that has an event again after that may have fields from before.
    """
    fields = fields or STATE_FIELDS

    def fold(batch: DataFrame, batch_id: int) -> None:
        latest = [_latest(f, order) for f in fields]
        folded = batch.groupBy("job_id").agg(F.max(order[0]).alias("last_at"), *latest)
        state.add(folded, path, batch_id, lambda rows: _folded(rows, fields), fan, ttl_seconds)

    return (
        events.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _folded(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.groupBy("job_id").agg(*[F.max(f).alias(f) for f in ["last_at", *fields]])


def read_job_state(
    spark: SparkSession, path: str, fields: list[str] | None = None, ttl_seconds: float | None = None
) -> DataFrame:
    """G3, G5. Current state per job; with ``ttl_seconds`` only of jobs with an event within that time up
    to the newest one.  Only folders of the current manifest are read."""
    fields = fields or STATE_FIELDS
    current = state.latest(spark, path)
    if not current.segments:
        raise LookupError(f"{path}: no batch has been folded")
    latest = _folded(state.segments(spark, path, current.segments, current.schema), fields)
    if ttl_seconds is not None:
        newest = max((s.newest for s in current.segments if s.newest is not None), default=0)
        latest = latest.where(F.unix_micros("last_at") > newest - int(ttl_seconds * 1e6))
    return latest.select("job_id", *[F.col(f"{f}.{f}").alias(f) for f in fields])


def write_scans(
    messages: DataFrame,
    catalog: DataFrame,
    described: DataFrame,
    errors: DataFrame,
    path: str,
    checkpoint: str,
    apply: Callable[[DataFrame, DataFrame], object] | None = None,
) -> StreamingQuery:
    """G1. Run the scan requests of a message stream: decode, bind owners, expand, fan out.

    Per batch ``jobs``, ``results`` and ``errors`` are written below ``path``; a batch that runs
    twice writes the same folders again.  A request for an instance that nobody owns fails alone.
    ``apply(requests, results)`` then does what the requests' options say, see
    ``sources.scans.apply_requests``; saving and exporting again changes nothing but times.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        requests = written(decode_messages(batch).withColumnRenamed("config", "given"), "requests")
        owned = resolve_owner(requests, catalog).withColumn(
            "config", F.coalesce("given", "config")
        )
        refused = F.col("error").isNotNull() & F.col("given").isNull()
        scopes = owned.where(~refused).select(
            F.col("job_id").alias("scope_id"),
            "config",
            "instance",
            "schema",
            F.lit(None).cast("string").alias("table"),
        )
        results, failed = scan(catalog, scopes, described, errors)
        refusals = owned.where(refused).select("job_id", "error")
        frames = {
            "jobs": requests.select("job_id"),
            "results": results,
            "errors": failed.unionByName(refusals, allowMissingColumns=True),
        }
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        if apply is not None:
            found = batch.sparkSession.read.parquet(f"{path}/results/batch={batch_id}")
            apply(requests.withColumnRenamed("given", "config"), found)

    return (
        messages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_scans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, results and errors written so far, ready for the status fold."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("jobs", "results", "errors"))


def dedupe_stream(results: DataFrame, keys: list[str], ttl: str = "7 days") -> DataFrame:
    """G5, G8. First result per key; keys are forgotten once ``ttl`` has passed in event time, which
    bounds the state."""
    return results.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, all available input."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def abandoned_stream(
    deliveries: DataFrame, me: str, idle_seconds: int = 30, delay: str = "0 seconds"
) -> DataFrame:
    """G7. Messages idle for ``idle_seconds`` without acknowledgement, held by another consumer.

    ``deliveries``: ``message_id, kind ('delivered' or 'acked'), consumer, ts``.  What happens to a
    message without a pause of ``idle_seconds`` is one session; a session that closes with a delivery
    and without an acknowledgement was abandoned by whoever got the message last.  Sessions are made
    in event time, so batch borders, and the order within ``delay``, change nothing; a message that
    is delivered again after its pause can be abandoned again.  State is one row per open session.
    """
    delivered = F.when(F.col("kind") == "delivered", F.struct("ts", "consumer"))
    sessions = (
        deliveries.withWatermark("ts", delay)
        .groupBy("message_id", F.session_window("ts", f"{idle_seconds} seconds"))
        .agg(F.max(delivered).alias("last"), F.max(F.col("kind") == "acked").alias("acked"))
    )
    open_ = F.col("last").isNotNull() & ~F.coalesce("acked", F.lit(False))
    return sessions.where(open_ & (F.col("last.consumer") != me)).select(
        "message_id",
        F.col("last.consumer").alias("consumer"),
        F.unix_millis("last.ts").alias("delivered_ms"),
    )
