from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import (
    CheckFailed,
    describe,
    enforce,
    expect,
    expire_rows,
    explode_steps,
    freshness,
    high_watermark,
    in_set,
    last_run,
    last_successful_run,
    min_rows,
    newer_than,
    newer_than_target,
    not_null,
    prune_snapshots,
    recent_runs,
    runs_per_key,
    status_summary,
    take_snapshot,
    unique,
)
from tablewright.plans.steps import StepLog

T = lambda d: datetime(2026, 1, d)


def test_expectations_in_one_pass(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (None, None)], "id int, grade string")
    checks = [not_null("id"), in_set("grade", ["A", "B"]), unique("id"), min_rows(3), min_rows(9)]
    assert [tuple(r) for r in expect(df, checks).collect()] == [
        ("not_null(id)", 1, False),
        ("in_set(grade)", 2, False),
        ("unique(id)", 1, False),
        ("min_rows(3)", 0, True),
        ("min_rows(9)", 5, False),
    ]
    with pytest.raises(CheckFailed, match=r"not_null\(id\): 1 rows; .*min_rows\(9\): 5 rows"):
        enforce(df, checks)
    assert enforce(df, [min_rows(4)]) is df
    with pytest.raises(ValueError):
        expect(df, [])


def test_freshness(spark):
    df = lambda *d: spark.createDataFrame([(x,) for x in d], "at timestamp_ntz")
    tables = {"new": (df(T(1), T(9)), "at"), "old": (df(T(1)), "at"), "none": (df(), "at")}
    assert rows(freshness(tables, T(10), timedelta(days=1))) == [
        ("new", T(9), 86400, "fresh"), ("none", None, None, "empty"), ("old", T(1), 777600, "stale"),
    ]


RUNS = "id int, job string, status string, created_at timestamp_ntz, finished_at timestamp_ntz"


def runs(spark):
    data = [
        (1, "a", "success", T(1), T(2)), (2, "a", "failed", T(3), T(4)), (3, "b", "failed", T(1), T(1)),
        (4, "b", "success", T(5), T(6)), (5, "b", "success", T(5), T(7)),
    ]
    return spark.createDataFrame(data, RUNS)


def test_run_history(spark):
    log = runs(spark)
    assert rows(last_run(log, "job", "created_at", "id"), "id") == [(2,), (5,)]
    assert [r.id for r in recent_runs(log, "created_at", "id", 3).collect()] == [5, 4, 2]
    failed = recent_runs(log, "created_at", "id", 5, F.col("status") == "failed")
    assert [r.id for r in failed.collect()] == [2, 3]
    assert rows(runs_per_key(log, "job", "created_at", "id", 2), "job", "run_rank", "id") == [
        ("a", 1, 2), ("a", 2, 1), ("b", 1, 5), ("b", 2, 4),
    ]
    # the latest run counts, not the latest success
    last = last_successful_run(log, "job", "created_at", "id", "status", "finished_at")
    assert rows(last) == [("a", None), ("b", T(7))]


def test_status_summary(spark):
    jobs = spark.createDataFrame(
        [("active", "0 4 * * *", "failed"), ("active", None, "success"), ("paused", None, "error")],
        "status string, cron string, last string",
    )
    assert rows(status_summary(jobs, "status", F.col("cron").isNotNull(), "last")) == [(3, 2, 1, 2)]


def test_step_log_counts_rows_and_reads_back(spark, tmp_path):
    log = StepLog("nightly", "run-1")
    with log.step("transform") as step:
        df = step.reading(spark.range(10)).filter("id % 2 = 0")
        step.writing(df).write.parquet(str(tmp_path / "out"))
    with log.step("nothing") as step:
        step.writing(spark.range(10).filter("id < 0").join(spark.range(3), "id")).collect()
    with pytest.raises(RuntimeError):
        with log.step("load"):
            raise RuntimeError("no disk")
    found = rows(log.frame(spark), "name", "status", "rows_in", "rows_out", "error")
    assert found == [
        ("load", "failed", None, None, "RuntimeError: no disk"),
        ("nothing", "success", None, 0, None),
        ("transform", "success", 10, 5, None),
    ]
    traces = spark.createDataFrame([(1, log.trace())], "id int, trace string")
    steps = explode_steps(traces, "trace", keep=["id"])
    assert rows(steps, "id", "name", "rows_in", "error.message") == [
        (1, "load", None, "no disk"), (1, "nothing", None, None), (1, "transform", 10, None),
    ]


def test_watermarks(spark):
    schema = "k int, at timestamp_ntz"
    target = spark.createDataFrame([(1, T(1)), (2, T(5))], schema)
    empty = spark.createDataFrame([], schema)
    source = spark.createDataFrame([(1, T(5)), (2, T(6)), (3, None)], schema)
    assert high_watermark(target, "at") == str(T(5)) and high_watermark(empty, "at") is None
    for df in (newer_than(source, "at", T(5)), newer_than_target(source, target, "at")):
        assert rows(df, "k") == [(2,)]
    for df in (newer_than(source, "at", None), newer_than_target(source, empty, "at")):
        assert df.count() == 3


def test_snapshots(spark):
    schema = "id int, snapshot_at timestamp_ntz, snapshot_id string"
    target = spark.createDataFrame([(1, T(1), "x"), (1, T(2), "y"), (9, None, None)], schema)
    source = spark.createDataFrame([(1,), (2,)], "id int")
    after = take_snapshot(target, source, T(3), "z", retain=2)
    assert rows(after, "id", "snapshot_id") == [(1, "y"), (1, "z"), (2, "z"), (9, None)]
    assert prune_snapshots(target, "snapshot_at", 5).count() == 3
    with pytest.raises(ValueError):
        prune_snapshots(target, "snapshot_at", 0)


def test_expire_rows(spark):
    df = spark.createDataFrame([(T(1).date(),), (T(5).date(),), (None,)], "d date")
    assert rows(expire_rows(df, "d", 5, "2026-01-10")) == [(None,), (T(5).date(),)]


def test_describe(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 'x') AS nested")
    assert rows(describe(df)) == [(1, "id", "int", False), (2, "nested", "struct<a:string>", False)]
