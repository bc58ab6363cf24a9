"""Analytics over a run-log table: one row per run of a named job.

``key`` names the job column, ``at`` the creation time, ``tie`` a unique id that settles
equal times. Rankings use ``row_number() <= n``, which Spark limits per task before the
shuffle, so a job holding much of the log does not pile up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column
from .merge import latest_per_key

FAILED = ("failed", "error")


def last_run(runs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest run of every job."""
    return latest_per_key(runs, [key], [at, tie])


def recent_runs(runs: DataFrame, at: str, tie: str, limit: int, where: Column | None = None) -> DataFrame:
    """The ``limit`` latest runs, optionally among those that satisfy ``where``."""
    chosen = runs if where is None else runs.filter(where)
    return chosen.orderBy(column(at).desc(), column(tie).desc()).limit(limit)


def runs_per_key(runs: DataFrame, key: str, at: str, tie: str, limit: int) -> DataFrame:
    """The ``limit`` latest runs of every job, numbered from the latest."""
    window = Window.partitionBy(column(key)).orderBy(column(at).desc(), column(tie).desc())
    return runs.withColumn("run_rank", F.row_number().over(window)).filter(F.col("run_rank") <= limit)


def last_successful_run(
    runs: DataFrame, key: str, at: str, tie: str, status: str, finished_at: str, success: str = "success"
) -> DataFrame:
    """Finish time of each job's *latest* run if that one succeeded, else NULL."""
    return last_run(runs, key, at, tie).select(
        column(key),
        F.when(column(status) == success, column(finished_at)).alias("last_successful_run"),
    )


def status_summary(
    jobs: DataFrame, status: str, scheduled: Column, last_status: str, active: str = "active"
) -> DataFrame:
    """One row: how many jobs there are, and how many are active, scheduled, failing."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(column(status) == active).alias("active"),
        F.count_if(scheduled).alias("scheduled"),
        F.count_if(column(last_status).isin(*FAILED)).alias("failing"),
    )


STEP_SCHEMA = (
    "run_id string, pipeline string, steps array<struct<name: string, status: string, "
    "started_at: string, finished_at: string, duration_ms: bigint, rows_in: bigint, "
    "rows_out: bigint, error: struct<type: string, message: string>>>"
)


def explode_steps(runs: DataFrame, trace: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per step from a JSON trace column."""
    parsed = runs.select(*[column(c) for c in keep], F.from_json(column(trace), STEP_SCHEMA).alias("trace"))
    return parsed.select(*[column(c) for c in keep], F.explode("trace.steps").alias("step")).select(
        *[column(c) for c in keep], "step.*"
    )
