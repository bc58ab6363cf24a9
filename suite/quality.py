"""Data checks, freshness, and analytics over events seen as a run log.

A user is a job, an event one run of it: the event type is its status (``error`` failed,
``purchase`` success), ``ts`` its creation, ``value`` its duration in seconds.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tablewright.operators import (
    expect,
    explode_steps,
    freshness,
    in_set,
    last_run,
    last_successful_run,
    min_rows,
    not_null,
    recent_runs,
    runs_per_key,
    status_summary,
    unique,
)

from .registry import query, source


@query(
    "checks",
    """
    SELECT check_name, failed_rows, failed_rows = 0 AS passed FROM (
        SELECT 'not_null(value)' AS check_name, count(*) FILTER (value IS NULL) AS failed_rows FROM events
        UNION ALL
        SELECT 'in_set(event_type)', count(*) FILTER (event_type NOT IN ('signup', 'purchase', 'view', 'click')) FROM events
        UNION ALL
        SELECT 'unique(event_id)', count(event_id) - count(DISTINCT event_id) FROM events
        UNION ALL
        SELECT 'min_rows(1000000)', greatest(1000000 - count(*), 0) FROM events
    ) c
    """,
)
def checks(spark, sf_dir):
    return expect(
        source(spark, sf_dir, "events"),
        [
            not_null("value"),
            in_set("event_type", ["signup", "purchase", "view", "click"]),
            unique("event_id"),
            min_rows(1_000_000),
        ],
    )


@query(
    "checks_composite_key",
    """
    SELECT 'unique(l_orderkey,l_linenumber)' AS check_name,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS failed_rows,
           count(*) = (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS passed
    FROM lineitem
    """,
)
def checks_composite_key(spark, sf_dir):
    return expect(source(spark, sf_dir, "lineitem"), [unique(["l_orderkey", "l_linenumber"])])


@query(
    "freshness",
    """
    SELECT *, CASE WHEN lag_seconds <= 86400 THEN 'fresh' ELSE 'stale' END AS status FROM (
        SELECT table_name, last_updated, date_diff('second', last_updated, TIMESTAMP '2024-01-31 00:00:00') AS lag_seconds
        FROM (SELECT 'orders' AS table_name, max(o_orderdate) AS last_updated FROM orders
              UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem
              UNION ALL SELECT 'events', date_trunc('second', max(ts)) FROM events) t) u
    """,
)
def freshness_query(spark, sf_dir):
    tables = {
        "orders": (source(spark, sf_dir, "orders"), "o_orderdate"),
        "lineitem": (source(spark, sf_dir, "lineitem"), "l_shipdate"),
        "events": (source(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts")), "ts"),
    }
    return freshness(tables, datetime(2024, 1, 31), timedelta(days=1))


RUNS = """
    SELECT event_id AS run_id, user_id AS job, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'running' END AS status,
           ts AS created_at, CAST(round(value * 1000) AS BIGINT) AS duration_ms,
           ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) AS finished_at
    FROM events
"""
RANKED = f"SELECT *, row_number() OVER (PARTITION BY job ORDER BY created_at DESC, run_id DESC) AS run_rank FROM ({RUNS}) r"


def runs(spark, sf_dir):
    duration = F.round(F.col("value") * 1000).cast("bigint")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("running")
    return source(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("job"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        duration.alias("duration_ms"),
        F.timestamp_add("MILLISECOND", duration, F.col("ts")).alias("finished_at"),
    )


LOG = {"key": "job", "at": "created_at", "tie": "run_id"}


@query("last_run_per_key", f"SELECT run_id, job, status, created_at, duration_ms, finished_at FROM ({RANKED}) r WHERE run_rank = 1")
def last_run_per_key(spark, sf_dir):
    return last_run(runs(spark, sf_dir), **LOG)


@query("runs_per_key", f"SELECT * FROM ({RANKED}) r WHERE run_rank <= 10")
def runs_per_key_query(spark, sf_dir):
    return runs_per_key(runs(spark, sf_dir), **LOG, limit=10)


@query("recent_runs", f"SELECT * FROM ({RUNS}) r ORDER BY created_at DESC, run_id DESC LIMIT 20")
def recent_runs_query(spark, sf_dir):
    return recent_runs(runs(spark, sf_dir), "created_at", "run_id", 20)


@query("recent_errors", f"SELECT * FROM ({RUNS}) r WHERE status = 'failed' ORDER BY created_at DESC, run_id DESC LIMIT 20")
def recent_errors(spark, sf_dir):
    return recent_runs(runs(spark, sf_dir), "created_at", "run_id", 20, F.col("status") == "failed")


LAST_SUCCESS = f"SELECT job, CASE WHEN status = 'success' THEN finished_at END AS last_successful_run FROM ({RANKED}) r WHERE run_rank = 1"


def successes(spark, sf_dir):
    return last_successful_run(runs(spark, sf_dir), **LOG, status="status", finished_at="finished_at")


@query("last_success", LAST_SUCCESS)
def last_success(spark, sf_dir):
    return successes(spark, sf_dir)


@query(
    "since_last_success",
    f"""SELECT event_id, user_id, ts FROM events JOIN ({LAST_SUCCESS}) s ON user_id = job
        WHERE last_successful_run IS NULL OR ts > last_successful_run - to_days(7)""",
)
def since_last_success(spark, sf_dir):
    """Source rows each job still has to process, with a week of overlap; all if it never succeeded."""
    events = source(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    since = F.col("last_successful_run") - F.expr("INTERVAL 7 DAYS")
    return (
        events.join(successes(spark, sf_dir), F.col("user_id") == F.col("job"))
        .filter(F.col("last_successful_run").isNull() | (F.col("ts") > since))
        .select("event_id", "user_id", "ts")
    )


@query(
    "status_summary",
    f"""
    SELECT count(*) AS total, count(*) FILTER (c_acctbal >= 0) AS active, count(*) FILTER (c_mktsegment <> 'BUILDING') AS scheduled,
           count(*) FILTER (status = 'failed') AS failing
    FROM customer LEFT JOIN (SELECT * FROM ({RANKED}) q WHERE run_rank = 1) r ON job = c_custkey
    """,
)
def status_summary_query(spark, sf_dir):
    """Customers as jobs: active if in credit, scheduled outside one segment, with their last status."""
    latest = last_run(runs(spark, sf_dir), **LOG).select("job", F.col("status").alias("last_status"))
    jobs = (
        source(spark, sf_dir, "customer")
        .join(latest, F.col("c_custkey") == F.col("job"), "left")
        .withColumn("status", F.when(F.col("c_acctbal") >= 0, "active").otherwise("paused"))
    )
    return status_summary(jobs, "status", F.col("c_mktsegment") != "BUILDING", "last_status")


@query(
    "step_metrics",
    f"""
    SELECT name, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed,
           CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(rows_in) AS BIGINT) AS rows_in
    FROM (SELECT 'extract' AS name, 'success' AS status, duration_ms // 2 AS duration_ms, 0 AS rows_in FROM ({RUNS}) a
          UNION ALL SELECT 'load', status, duration_ms, duration_ms % 100 FROM ({RUNS}) b) s
    GROUP BY name
    """,
)
def step_metrics(spark, sf_dir):
    """Two steps per run as a JSON trace, taken apart again and summed."""
    half = (F.col("duration_ms") / 2).cast("bigint")
    step = lambda name, status, ms, rows: F.struct(
        F.lit(name).alias("name"), status.alias("status"), ms.alias("duration_ms"), rows.alias("rows_in")
    )
    steps = F.array(
        step("extract", F.lit("success"), half, F.lit(0).cast("bigint")),
        step("load", F.col("status"), F.col("duration_ms"), F.col("duration_ms") % 100),
    )
    traces = runs(spark, sf_dir).select(F.to_json(F.struct(F.col("job").cast("string").alias("pipeline"), steps.alias("steps"))).alias("trace"))
    return (
        explode_steps(traces, "trace")
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.sum("duration_ms").alias("duration_ms"),
            F.sum("rows_in").alias("rows_in"),
        )
    )
