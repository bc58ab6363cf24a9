"""The same tables kept up to date from a stream of events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tablewright import Incremental, Scd2, materialize
from tablewright.plans.buckets import BUCKET
from tablewright.scratch import scratch_folder
from tablewright.streaming import append_stream, refresh_stream

from .registry import new_database, query, source

START = datetime(2023, 1, 1)
LATEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e WHERE n = 1
"""


def event_stream(spark, sf_dir):
    """The events table as a file stream, whether it is one file or a folder of files."""
    schema = source(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def events_in_batches(spark, sf_dir, batches: int = 4):
    """The events in several files, one micro-batch each, in no order of time."""
    path = scratch_folder(spark, "event-batches")
    source(spark, sf_dir, "events").repartition(batches, F.col("event_id") % 97).write.parquet(path)
    return spark.readStream.schema(source(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception() is not None:
        raise stream_query.exception()


@query("stream_merge", f"SELECT user_id, event_id, ts, event_type, value FROM ({LATEST}) l")
def stream_merge(spark, sf_dir):
    """The latest event of every user, whichever batch brings it."""
    table = f"{new_database(spark)}.latest"
    events = events_in_batches(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    config = Incremental(target_table=table, source="", unique_key="user_id", dedupe_order_by=["ts", "event_id"])
    finished(refresh_stream(events, config, scratch_folder(spark, "merge-stream")))
    return spark.table(table)


@query("stream_merge_bucketed", f"SELECT user_id, event_id, ts, event_type, value FROM ({LATEST}) l")
def stream_merge_bucketed(spark, sf_dir):
    """The same in buckets of the key: a batch rewrites those of its users only."""
    table = f"{new_database(spark)}.latest"
    events = events_in_batches(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    config = Incremental(target_table=table, source="", unique_key="user_id", dedupe_order_by=["ts", "event_id"], buckets=16)
    finished(refresh_stream(events, config, scratch_folder(spark, "merge-stream")))
    return spark.table(table).drop(BUCKET)


@query(
    "stream_scd2",
    f"""
    WITH s AS (SELECT user_id, event_type FROM ({LATEST}) l), clock AS (SELECT max(ts) AS run_ts FROM events)
    SELECT c_custkey AS user_id, 'view' AS event_type, TIMESTAMP '{START}' AS valid_from,
           CASE WHEN s.event_type <> 'view' THEN run_ts END AS valid_to,
           coalesce(s.event_type = 'view', TRUE) AS is_current, md5('view') AS row_hash
    FROM customer LEFT JOIN s ON user_id = c_custkey CROSS JOIN clock
    UNION ALL
    SELECT user_id, event_type, run_ts, NULL, TRUE, md5(event_type) FROM s CROSS JOIN clock
    WHERE event_type <> 'view' OR user_id NOT IN (SELECT c_custkey FROM customer)
    """,
)
def stream_scd2(spark, sf_dir):
    """Versions of each user's latest event type, starting from all customers as viewers."""
    table = f"{new_database(spark)}.users"
    config = Scd2(
        target_table=table,
        source=source(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "'view' AS event_type", "TIMESTAMP_NTZ '2023-01-01' AS ts", "0L AS event_id"),
        unique_key="user_id",
        tracked_columns=["event_type"],
        invalidate_hard_deletes=False,
        dedupe_order_by=["ts", "event_id"],
    )
    materialize(spark, config, run_ts=START)
    events = event_stream(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    finished(refresh_stream(events, config, scratch_folder(spark, "scd2-stream"), run_ts_column="ts"))
    return spark.table(table).drop("ts", "event_id")


@query("stream_append", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def stream_append(spark, sf_dir):
    table = f"{new_database(spark)}.log"
    events = event_stream(spark, sf_dir).filter(F.col("event_type") != "error")
    finished(append_stream(events.select("event_id", "ts", "user_id", "event_type", "value"), table, scratch_folder(spark, "append-stream")))
    return spark.table(table)
