"""A6, G3, G7, G8 as streams, several files in several batches."""

from datetime import datetime, timedelta

from helpers import rows
from shelfmark.operators import jobs
from shelfmark.shared import new_folder
from shelfmark.streaming import scans

START = datetime(2024, 1, 1)
EVENT = "job_id string, seq int, ts timestamp, status string, error string"


def landed(spark, schema, *batches):
    """One file per batch, and the folder."""
    path = new_folder(spark, "landed")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def sec(n):
    return START + timedelta(seconds=n)


def test_state_over_batches_equals_state_at_once(spark):
    path = landed(
        spark, EVENT,
        [("j", 5, sec(5), None, "late"), ("k", 1, sec(1), "pending", None)],
        [("j", 1, sec(1), "pending", "early"), ("j", 2, sec(2), "running", None)],
        [("k", 2, sec(2), None, None), ("j", 3, sec(3), "completed", None)],
    )
    out, checkpoint = new_folder(spark, "out"), new_folder(spark, "checkpoint")
    fields = ["status", "error"]

    def run():
        events = scans.read_scan_events(spark, path, EVENT)
        scans.write_job_state(events, out, checkpoint, ["ts", "seq"], fields).awaitTermination()
        return rows(scans.read_job_state(spark, out, fields))

    expected = rows(jobs.job_state(spark.read.schema(EVENT).parquet(path), ["ts", "seq"], fields))
    assert run() == expected == [("j", "completed", "late"), ("k", "pending", None)]
    # One file per batch, as the source is told.
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    # More input later goes on from the checkpoint.
    spark.createDataFrame([("k", 9, sec(9), "failed", "x")], EVENT).write.mode("append").parquet(path)
    assert run() == [("j", "completed", "late"), ("k", "failed", "x")]


def test_dedupe_within_retention(spark):
    path = landed(
        spark, EVENT,
        [("j", 1, sec(1), "a", None), ("j", 2, sec(2), "a", None)],
        [("j", 3, sec(3), "a", None), ("j", 4, sec(4), "b", None)],
    )
    out = new_folder(spark, "out")
    stream = scans.dedupe_stream(scans.read_scan_events(spark, path, EVENT), ["job_id", "status"])
    scans.write_append(stream, out, new_folder(spark, "checkpoint")).awaitTermination()
    assert rows(spark.read.parquet(out), "job_id", "status") == [("j", "a"), ("j", "b")]


def test_abandoned_messages(spark):
    schema = "message_id string, kind string, consumer string, ts timestamp"
    path = landed(
        spark, schema,
        [("1", "delivered", "dead", sec(0)), ("2", "delivered", "me", sec(0)), ("3", "delivered", "dead", sec(0))],
        [("3", "acked", None, sec(10)), ("4", "delivered", "dead", sec(10)), ("1", "delivered", "dead2", sec(20))],
        [("4", "delivered", "slow", sec(80)), ("9", "delivered", "dead", sec(100))],
    )
    out = new_folder(spark, "out")
    found = scans.abandoned_stream(scans.read_scan_events(spark, path, schema), "me")
    scans.write_append(found, out, new_folder(spark, "checkpoint")).awaitTermination()
    got = rows(spark.read.parquet(out), "message_id", "consumer")
    # 2 is ours, 3 was acknowledged, 9 was delivered only now; 4 was idle until it was delivered again.
    assert got == [("1", "dead2"), ("4", "dead")]


def test_abandoned_messages_whatever_the_batches(spark):
    """An acknowledgement a batch before its delivery counts, and one after the pause does not."""
    schema = "message_id string, kind string, consumer string, ts timestamp"
    early = ("1", "acked", None, sec(12)), ("2", "delivered", "dead", sec(0)), ("3", "delivered", "dead", sec(5))
    late = ("1", "delivered", "dead", sec(10)), ("2", "acked", None, sec(31)), ("3", "acked", None, sec(35))
    end = (("9", "delivered", "dead", sec(200)),)
    for batches in ([early, late, end], [early + late, end], [early + late + end]):
        path, out = landed(spark, schema, *map(list, batches)), new_folder(spark, "out")
        stream = scans.read_scan_events(spark, path, schema)
        found = scans.abandoned_stream(stream, "me", delay="60 seconds")
        scans.write_append(found, out, new_folder(spark, "checkpoint")).awaitTermination()
        assert rows(spark.read.parquet(out), "message_id", "consumer") == [("2", "dead")]
