"""Runs that die between two commits are finished or undone by the next one."""

from datetime import datetime
from pathlib import Path

import pytest
from conftest import rows

from tablewright import FullRefresh, Incremental, Partitioned, Scd2, materialize
from tablewright.plans import commit, journal
from tablewright.plans.journal import intent, pending, settle

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)


def scd2(spark, table, *data):
    return Scd2(target_table=table, source=spark.createDataFrame(list(data), "id int, v string"), unique_key="id")


def versions(spark, table):
    return rows(spark.table(table), "id", "v", "valid_from", "valid_to", "is_current")


def location(spark, table):
    return Path(commit.described(spark, table)[1]["Location"].removeprefix("file:"))


@pytest.mark.parametrize("step", ["append", "replace_partitions", "settle"])
def test_scd2_dying_at_every_step(spark, table, monkeypatch, step):
    materialize(spark, scd2(spark, table, (1, "a"), (2, "b")), run_ts=T0)
    later = scd2(spark, table, (1, "x"), (2, "b"))

    def die(*args, **more):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(journal if step == "settle" else commit, step, die)
        with pytest.raises(RuntimeError, match="died"):
            materialize(spark, later, run_ts=T1)
    assert pending(spark, table)["kind"] == "versions"
    materialize(spark, later, run_ts=T1)
    want = [(1, "a", T0, T1, False), (1, "x", T1, None, True), (2, "b", T0, None, True)]
    assert versions(spark, table) == want and pending(spark, table) is None


def test_scd2_does_not_read_the_history(spark, table):
    materialize(spark, scd2(spark, table, (1, "a")), run_ts=T0)
    materialize(spark, scd2(spark, table, (1, "b")), run_ts=T1)
    history = list(location(spark, table).glob("is_current=false/*.parquet"))
    assert history
    for file in history:  # whoever reads it fails
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"unreadable" * 10)
    materialize(spark, scd2(spark, table, (1, "c"), (2, "d")), run_ts=T2, count_rows=False)
    assert rows(spark.table(table).filter("is_current"), "id", "v") == [(1, "c"), (2, "d")]


def test_only_the_died_runs_versions_are_undone(spark, table, monkeypatch):
    for k, at in enumerate((T0, T1)):
        materialize(spark, scd2(spark, table, (1, f"v{k}"), (2, f"w{k}")), run_ts=at)
    with monkeypatch.context() as m:
        m.setattr(commit, "replace_partitions", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            materialize(spark, scd2(spark, table, (1, "z"), (2, "w1")), run_ts=T2)
    materialize(spark, scd2(spark, table, (1, "v1"), (2, "w1")), run_ts=T2)
    assert versions(spark, table) == [
        (1, "v0", T0, T1, False), (1, "v1", T1, None, True), (2, "w0", T0, T1, False), (2, "w1", T1, None, True),
    ]


def test_rebuilt_table_dying_before_and_after_the_drop(spark, table, monkeypatch):
    config = lambda t, df: Incremental(target_table=t, source=df, unique_key="id", on_schema_change="sync_all_columns")
    second = spark.createDataFrame([(1, "n")], "id int, other string")
    for name, dropped in ((table, False), (table + "_d", True)):
        materialize(spark, config(name, spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")))

        def die(spark, name, made, dropped=dropped):
            if dropped:
                spark.sql(f"DROP TABLE {name}")
            raise RuntimeError("died")

        with monkeypatch.context() as m:
            m.setattr(commit, "finish_rename", die)
            with pytest.raises(RuntimeError):
                materialize(spark, config(name, second))
        materialize(spark, config(name, second.limit(0)))
        assert rows(spark.table(name), "id", "other") == [(1, "n"), (2, None)]
        assert pending(spark, name) is None


def test_full_refresh_of_a_partitioned_table_keeps_one_until_the_new_one_is_whole(spark, table):
    data = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    materialize(spark, Partitioned(target_table=table, source=data, partition_by="p", partition_type="list", partition_range=["a", "b"]))
    with pytest.raises(Exception, match="no way"):
        materialize(spark, FullRefresh(target_table=table, source=f"SELECT id, raise_error('no way') AS p FROM {table}"))
    assert spark.table(table).count() == 2
    materialize(spark, FullRefresh(target_table=table, source=f"SELECT id + 1 AS id FROM {table}"))
    assert rows(spark.table(table)) == [(2,), (3,)] and commit.partition_columns(spark, table) == []


def test_records_are_whole_and_told_apart_by_table(spark, table):
    spark.sql(f"CREATE DATABASE {table}_db")
    with pytest.raises(KeyError), intent(spark, f"{table}_db.t", "rename", made="x"):
        raise KeyError
    assert pending(spark, f"{table}_db.t") == {"kind": "rename", "made": "x"}
    assert pending(spark, f"`{table}_db`.`T`") == {"kind": "rename", "made": "x"} and pending(spark, "t") is None
    settle(spark, f"{table}_db.t")
    assert pending(spark, f"{table}_db.t") is None
    with intent(spark, f"{table}_db.t", "rename", made="y"):
        pass
    assert pending(spark, f"{table}_db.t") is None
