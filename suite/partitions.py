"""Partitioned tables of events, orders and order lines."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tablewright import Incremental, Partitioned, materialize
from tablewright.functions import date_partition, list_partition, range_partition
from tablewright.operators import expire_rows, overwrite_by_value

from .merges import CHANGES, MERGED, changes
from .registry import new_database, query, source

EVENT_COLUMNS = "event_id, user_id, event_type, value, event_date"
EVENTS = "SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS event_date FROM events"


def dated_events(spark, sf_dir):
    return source(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.to_date("ts").alias("event_date")
    )


# The last days are delivered again, with errors left out and other values.
REDELIVERED = f"SELECT event_id, user_id, event_type, value * 2 AS value, event_date FROM ({EVENTS}) e WHERE event_date >= DATE '2024-01-21' AND event_type <> 'error'"
OVERWRITTEN = f"""
    WITH s AS ({REDELIVERED})
    SELECT {EVENT_COLUMNS} FROM ({EVENTS}) t WHERE event_date NOT IN (SELECT event_date FROM s)
    UNION ALL SELECT {EVENT_COLUMNS} FROM s
"""


def redelivered(events):
    return events.filter("event_date >= '2024-01-21' AND event_type <> 'error'").withColumn("value", F.col("value") * 2)


@query("insert_overwrite", OVERWRITTEN)
def insert_overwrite(spark, sf_dir):
    events = dated_events(spark, sf_dir)
    return overwrite_by_value(events, redelivered(events), "event_date")


@query("insert_overwrite_table", OVERWRITTEN)
def insert_overwrite_table(spark, sf_dir):
    """The same on a table partitioned by day: other days are neither read nor written."""
    table = f"{new_database(spark)}.events"
    events = dated_events(spark, sf_dir)
    for delivered in (events, redelivered(events)):
        config = Incremental(
            target_table=table, source=delivered, incremental_strategy="insert_overwrite", overwrite_column="event_date"
        )
        materialize(spark, config)
    return spark.table(table)


# Corrections: errors move to the next day, sign-ups are copied under new ids.
CORRECTIONS = f"""
    SELECT CASE WHEN event_type = 'signup' THEN -1 - event_id ELSE event_id END AS event_id, user_id, event_type,
           value * 2 AS value, CASE WHEN event_type = 'error' THEN event_date + 1 ELSE event_date END AS event_date
    FROM ({EVENTS}) e WHERE event_type IN ('error', 'signup')
"""


def corrections(events):
    return events.filter("event_type IN ('error', 'signup')").select(
        F.when(F.col("event_type") == "signup", -1 - F.col("event_id")).otherwise(F.col("event_id")).alias("event_id"),
        "user_id",
        "event_type",
        (F.col("value") * 2).alias("value"),
        F.when(F.col("event_type") == "error", F.date_add("event_date", 1)).otherwise(F.col("event_date")).alias("event_date"),
    )


@query(
    "partitioned_merge",
    f"""
    WITH t AS ({EVENTS}), s AS ({CORRECTIONS}), merged AS (
        SELECT {EVENT_COLUMNS} FROM t WHERE event_id NOT IN (SELECT event_id FROM s)
        UNION ALL SELECT {EVENT_COLUMNS} FROM s
    )
    SELECT * FROM merged WHERE event_date >= DATE '2024-01-31' - 20
    """,
)
def partitioned_merge(spark, sf_dir):
    """Events by day: late corrections move rows between days, then old days expire."""
    table = f"{new_database(spark)}.events"
    events = dated_events(spark, sf_dir)
    for delivered in (events, corrections(events)):
        config = Partitioned(
            target_table=table,
            source=delivered,
            unique_key="event_id",
            partition_by="event_date",
            cluster_by=["user_id", "event_type"],
            partition_expiration_days=20,
        )
        materialize(spark, config, run_ts=datetime(2024, 1, 31))
    return spark.table(table)


@query("partitioned_month", f"SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate_month FROM ({MERGED}) m")
def partitioned_month(spark, sf_dir):
    """Orders by month of a timestamp, through a derived partition column."""
    table = f"{new_database(spark)}.orders"
    orders = source(spark, sf_dir, "orders")
    for delivered in (orders, changes(orders)):
        config = Partitioned(
            target_table=table,
            source=delivered,
            unique_key="o_orderkey",
            partition_by="o_orderdate",
            partition_granularity="month",
        )
        materialize(spark, config)
    return spark.table(table)


@query(
    "partitioned_append",
    f"""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '__other__' END AS o_orderpriority_list
    FROM (SELECT * FROM orders UNION ALL ({CHANGES})) o
    """,
)
def partitioned_append(spark, sf_dir):
    """A keyless table partitioned by value list: later runs append."""
    table = f"{new_database(spark)}.orders"
    orders = source(spark, sf_dir, "orders")
    for delivered in (orders, changes(orders)):
        config = Partitioned(
            target_table=table,
            source=delivered,
            partition_by="o_orderpriority",
            partition_type="list",
            partition_range=["1-URGENT", "2-HIGH"],
        )
        materialize(spark, config)
    return spark.table(table)


@query("partition_expiry", f"SELECT * FROM ({EVENTS}) e WHERE event_date IS NULL OR event_date >= DATE '2024-01-31' - 10")
def partition_expiry(spark, sf_dir):
    return expire_rows(dated_events(spark, sf_dir), "event_date", 10, date(2024, 1, 31))


@query(
    "partition_granularities",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS by_hour, CAST(ts AS DATE) AS by_day,
           CAST(date_trunc('month', ts) AS DATE) AS by_month, CAST(date_trunc('year', ts) AS DATE) AS by_year
    FROM events
    """,
)
def partition_granularities(spark, sf_dir):
    ts = F.col("ts")
    return source(spark, sf_dir, "events").select(
        "event_id", *[date_partition(ts, g).alias(f"by_{g}") for g in ("hour", "day", "month", "year")]
    )


@query(
    "partition_range",
    """
    SELECT l_orderkey, l_linenumber, l_quantity,
           CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2
                WHEN l_quantity IS NOT NULL THEN 3 END AS bucket
    FROM lineitem
    """,
)
def partition_range(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", range_partition(F.col("l_quantity"), [10, 25, 40]).alias("bucket")
    )


@query(
    "partition_list",
    """
    SELECT o_orderkey, o_orderpriority,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority
                WHEN o_orderpriority IS NOT NULL THEN '__other__' END AS bucket
    FROM orders
    """,
)
def partition_list(spark, sf_dir):
    return source(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", list_partition(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("bucket")
    )
