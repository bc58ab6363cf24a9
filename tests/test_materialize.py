from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright import AppendOnly, FullRefresh, Incremental, Partitioned, Scd1, Scd2, Snapshot, TableConfig, View, materialize
from tablewright.operators import SchemaChanged
from tablewright.plans import commit

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 15), datetime(2026, 2, 1)
ORDERS = "order_id int, amount int, updated_at date"


def df(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_unknown_config_is_refused(spark, table):
    with pytest.raises(ValueError, match="unknown materialization"):
        materialize(spark, TableConfig(target_table=table, source="SELECT 1"))


def test_full_refresh_replaces_rows_and_runs_hooks_in_order(spark, table):
    calls = []
    one = FullRefresh(
        target_table=table,
        source="SELECT 1 AS id, 'a' AS name",
        pre_hook=lambda s: calls.append(("pre", commit.table_exists(s, table))),
        post_hook=lambda s: calls.append(("post", commit.table_exists(s, table))),
    )
    assert materialize(spark, one) == {"strategy": "full_refresh", "table": table, "rows": 1}
    assert calls == [("pre", False), ("post", True)]
    two = FullRefresh(target_table=table, source=f"SELECT id + 1 AS id, name FROM {table}")
    materialize(spark, two)
    materialize(spark, two)
    assert rows(spark.table(table)) == [(3, "a")]
    materialize(spark, FullRefresh(target_table=table, source="SELECT 'other' AS shape WHERE false"))
    assert spark.table(table).columns == ["shape"] and spark.table(table).count() == 0


def test_failed_refresh_leaves_the_table_alone(spark, table):
    materialize(spark, FullRefresh(target_table=table, source="SELECT 1 AS id"))
    with pytest.raises(Exception, match="boom"):
        materialize(spark, FullRefresh(target_table=table, source="SELECT CAST(raise_error('boom') AS INT) AS id"))
    assert rows(spark.table(table)) == [(1,)]


def test_source_parameters_are_bound(spark, table):
    config = FullRefresh(target_table=table, source="SELECT :word AS w, :n AS n", params={"word": "it's", "n": 3})
    materialize(spark, config)
    assert rows(spark.table(table)) == [("it's", 3)]


def incremental(spark, table, strategy, source, **options):
    return materialize(spark, Incremental(target_table=table, source=source, incremental_strategy=strategy, **options))


def test_incremental_merge_with_watermark(spark, table):
    d = lambda n: date(2026, 1, n)
    first = df(spark, ORDERS, (1, 10, d(1)), (2, 20, d(2)), (3, 30, None))
    opts = dict(unique_key="order_id", incremental_column="updated_at")
    assert incremental(spark, table, "merge", first, **opts)["first_run"] is True
    later = df(spark, ORDERS, (1, 99, d(2)), (2, 21, d(3)), (3, 31, None), (4, 40, d(4)))
    result = incremental(spark, table, "merge", later, **opts)
    assert result == {"strategy": "incremental", "table": table, "first_run": False, "rows": 4}
    # a tie with the mark and a NULL do not pass
    assert rows(spark.table(table)) == [(1, 10, d(1)), (2, 21, d(3)), (3, 30, None), (4, 40, d(4))]


def test_incremental_zero_is_a_watermark(spark, table):
    incremental(spark, table, "merge", df(spark, "k int, seq int", (1, 0)), unique_key="k", incremental_column="seq")
    incremental(spark, table, "merge", df(spark, "k int, seq int", (1, -1), (2, 1)), unique_key="k", incremental_column="seq")
    assert rows(spark.table(table)) == [(1, 0), (2, 1)]


def test_incremental_timestamp_watermark(spark, table):
    schema = "k int, at timestamp_ntz"
    opts = dict(unique_key="k", incremental_column="at")
    incremental(spark, table, "merge", df(spark, schema, (1, datetime(2026, 1, 1, 0, 0, 0, 123456))), **opts)
    later = df(spark, schema, (1, datetime(2026, 1, 1, 0, 0, 0, 123456)), (2, datetime(2026, 1, 1, 0, 0, 0, 123457)))
    incremental(spark, table, "merge", later, **opts)
    assert spark.table(table).count() == 2


def test_incremental_delete_insert(spark, table):
    incremental(spark, table, "merge", df(spark, "k int, v int", (1, 1), (2, 2)), unique_key="k")
    incremental(spark, table, "delete+insert", df(spark, "k int, v int", (2, 5), (2, 6)), unique_key="k")
    assert rows(spark.table(table)) == [(1, 1), (2, 5), (2, 6)]


@pytest.mark.parametrize("kind", ["string", "double"])
def test_incremental_insert_overwrite(spark, table, kind):
    """Physically partitioned for a text column, rewritten for one unfit to name folders."""
    schema = f"day {kind}, n int"
    a, b, c = ("a", "b", "c") if kind == "string" else (1.5, 2.5, 3.5)
    opts = dict(overwrite_column="day")
    incremental(spark, table, "insert_overwrite", df(spark, schema, (a, 1), (a, 2), (b, 1), (None, 1)), **opts)
    assert bool(commit.partition_columns(spark, table)) == (kind == "string")
    incremental(spark, table, "insert_overwrite", df(spark, schema, (a, 9), (c, 3), (None, 8)), **opts)
    assert rows(spark.table(table), "day", "n") == [(None, 1), (None, 8), (a, 9), (b, 1), (c, 3)]


def test_insert_overwrite_needs_a_column(spark, table):
    with pytest.raises(ValueError, match="overwrite_column"):
        incremental(spark, table, "insert_overwrite", df(spark, "n int", (1,)))


def test_keyless_and_unknown_strategies_append(spark, table):
    incremental(spark, table, "merge", df(spark, "msg string", ("a",)))
    incremental(spark, table, "merge", df(spark, "msg string", ("a",)))
    with pytest.warns(UserWarning, match="appending"):
        incremental(spark, table, "upside-down", df(spark, "msg string", ("b",)), unique_key="msg")
    assert rows(spark.table(table)) == [("a",), ("a",), ("b",)]


@pytest.mark.parametrize(
    "policy, columns",
    [("ignore", ["k", "old"]), ("append_new_columns", ["k", "old", "new"]), ("sync_all_columns", ["k", "new"])],
)
def test_schema_policies_reach_the_table(spark, table, policy, columns):
    incremental(spark, table, "merge", df(spark, "k int, old int", (1, 1), (2, 2)), unique_key="k")
    incremental(spark, table, "merge", df(spark, "k int, new int", (2, 7), (3, 8)), unique_key="k", on_schema_change=policy)
    assert spark.table(table).columns == columns
    assert rows(spark.table(table), "k") == [(1,), (2,), (3,)]
    if "new" in columns:
        assert rows(spark.table(table), "k", "new") == [(1, None), (2, 7), (3, 8)]
    incremental(spark, table, "merge", df(spark, "k int", (4,)), unique_key="k", on_schema_change="ignore")
    assert spark.table(table).count() == 4


def test_schema_policy_fail(spark, table):
    incremental(spark, table, "merge", df(spark, "k int", (1,)), unique_key="k")
    with pytest.raises(SchemaChanged):
        incremental(spark, table, "merge", df(spark, "k int, n int", (1, 2)), unique_key="k", on_schema_change="fail")


EVENTS = "event_id int, event_date date, user_id int"


def partitioned(spark, table, source, run_ts=T1, **options):
    config = Partitioned(target_table=table, source=source, partition_by="event_date", **options)
    return materialize(spark, config, run_ts=run_ts)


@pytest.mark.parametrize("granularity", ["day", "month", "year", "hour"])
def test_partitioned_merge_moves_rows_and_drops_emptied_partitions(spark, table, granularity):
    d = date
    opts = dict(unique_key="event_id", partition_granularity=granularity, cluster_by=["user_id"])
    first = df(spark, EVENTS, (1, d(2024, 1, 1), 5), (2, d(2025, 2, 2), 6), (3, d(2025, 2, 2), 7), (9, None, 1))
    assert partitioned(spark, table, first, **opts)["first_run"] is True
    before = commit.partition_values(spark, table)
    later = df(spark, EVENTS, (1, d(2025, 2, 2), 50), (4, d(2026, 3, 3), 8), (9, None, 2))
    partitioned(spark, table, later, **opts)
    assert rows(spark.table(table), "event_id", "event_date", "user_id") == [
        (1, d(2025, 2, 2), 50), (2, d(2025, 2, 2), 6), (3, d(2025, 2, 2), 7), (4, d(2026, 3, 3), 8), (9, None, 2),
    ]
    after = commit.partition_values(spark, table)
    assert len(before) == 3 and len(after) == 3 and not any(v and v.startswith("2024") for v in after)


def test_a_partition_is_dropped_only_if_nothing_stays_or_arrives(spark, table):
    d, opts = date, dict(unique_key="event_id", dedupe_order_by="user_id", newest_wins=True)
    first = df(spark, EVENTS, (1, d(2024, 1, 1), 5), (2, d(2024, 1, 2), 6), (3, d(2024, 1, 2), 6), (4, d(2024, 1, 3), 6), (5, d(2024, 1, 5), 9))
    partitioned(spark, table, first, **opts)
    # 1 leaves the 1st for good; 2 leaves the 2nd, where 3 stays; 4 leaves the 3rd, which an older 5 names in vain
    later = df(spark, EVENTS, (1, d(2024, 1, 4), 7), (2, d(2024, 1, 4), 7), (4, d(2024, 1, 4), 7), (4, d(2024, 1, 9), 1), (5, d(2024, 1, 3), 8))
    partitioned(spark, table, later, **opts)
    assert rows(spark.table(table), "event_id", "event_date", "user_id") == [
        (1, d(2024, 1, 4), 7), (2, d(2024, 1, 4), 7), (3, d(2024, 1, 2), 6), (4, d(2024, 1, 4), 7), (5, d(2024, 1, 5), 9),
    ]
    assert sorted(commit.partition_values(spark, table)) == ["2024-01-02", "2024-01-04", "2024-01-05"]


def test_partitioned_merge_refuses_repeats_and_leaves_other_files(spark, table):
    opts = dict(unique_key="event_id")
    partitioned(spark, table, df(spark, EVENTS, (1, date(2024, 1, 1), 5), (2, date(2024, 1, 2), 6)), **opts)
    files = {f for f in spark.table(table).inputFiles() if "2024-01-02" in f}
    with pytest.raises(Exception, match="duplicate source key"):
        partitioned(spark, table, df(spark, EVENTS, (1, date(2024, 1, 3), 5), (1, date(2024, 1, 4), 6)), **opts)
    partitioned(spark, table, df(spark, EVENTS, (1, date(2024, 1, 3), 5)), **opts)
    assert {f for f in spark.table(table).inputFiles() if "2024-01-02" in f} == files
    assert rows(spark.table(table), "event_id", "event_date") == [(1, date(2024, 1, 3)), (2, date(2024, 1, 2))]


@pytest.mark.parametrize("granularity", ["day", "month"])
def test_the_mark_of_a_partitioned_table_needs_its_last_partition_only(spark, table, granularity, monkeypatch):
    from tablewright.plans import strategies

    read = []
    whole = strategies.high_watermark
    monkeypatch.setattr(strategies, "high_watermark", lambda t, n: read.append(t.inputFiles()) or whole(t, n))
    opts = dict(incremental_column="event_date", partition_granularity=granularity)
    partitioned(spark, table, df(spark, EVENTS, (1, date(2024, 1, 1), 5), (2, date(2024, 3, 2), 6), (3, None, 6)), **opts)
    partitioned(spark, table, df(spark, EVENTS, (4, date(2024, 3, 1), 5), (5, date(2024, 3, 2), 5), (6, date(2024, 3, 3), 5)), **opts)
    assert rows(spark.table(table), "event_id") == [(1,), (2,), (3,), (6,)]
    assert len(read) == 1 and all("2024-03" in f for f in read[0])


@pytest.mark.parametrize("granularity", ["day", "month", "year", "hour"])
def test_partition_expiry_is_exact_and_spares_null(spark, table, granularity):
    d = date
    opts = dict(partition_granularity=granularity, partition_expiration_days=10)
    data = df(spark, EVENTS, (1, d(2025, 12, 30), 1), (2, d(2026, 1, 4), 1), (3, d(2026, 1, 5), 1), (4, None, 1))
    partitioned(spark, table, data, **opts)
    assert spark.table(table).count() == 4  # the first run does not expire
    partitioned(spark, table, df(spark, EVENTS, (5, d(2026, 1, 6), 1)), run_ts=T1, **opts)
    assert rows(spark.table(table), "event_id") == [(3,), (4,), (5,)]


@pytest.mark.parametrize("kind, bounds", [("range", [date(2026, 1, 4), date(2026, 1, 6)]), ("list", [date(2026, 1, 4)])])
def test_partition_by_range_and_list(spark, table, kind, bounds):
    d = date
    opts = dict(partition_type=kind, partition_range=bounds, partition_expiration_days=10)
    data = df(spark, EVENTS, (1, d(2025, 12, 30), 1), (2, d(2026, 1, 4), 1), (3, d(2026, 1, 6), 1), (4, None, 1))
    partitioned(spark, table, data, **opts)
    values = set(commit.partition_values(spark, table))
    assert values == ({"0", "1", "2", None} if kind == "range" else {"2026-01-04", "__other__", None})
    partitioned(spark, table, df(spark, EVENTS, (5, d(2026, 1, 7), 1)), run_ts=T1, **opts)
    assert rows(spark.table(table), "event_id") == [(3,), (4,), (5,)]


def test_partitioned_key_holding_the_partition_column_reads_only_its_partitions(spark, table):
    opts = dict(unique_key="event_id,event_date")
    d = date
    partitioned(spark, table, df(spark, EVENTS, (1, d(2026, 1, 1), 1), (1, d(2026, 1, 2), 1)), **opts)
    partitioned(spark, table, df(spark, EVENTS, (1, d(2026, 1, 2), 5)), **opts)
    assert rows(spark.table(table), "event_id", "event_date", "user_id") == [(1, d(2026, 1, 1), 1), (1, d(2026, 1, 2), 5)]


def test_scd1_table(spark, table):
    config = lambda *data: Scd1(
        target_table=table, source=df(spark, "id int, price double", *data), unique_key="id", tracked_columns=["price"]
    )
    assert materialize(spark, config((1, 1.0), (2, 2.0)), run_ts=T0)["first_run"] is True
    materialize(spark, config((1, 1.5), (3, 3.0)), run_ts=T1)
    assert rows(spark.table(table)) == [(1, 1.5, T1), (2, 2.0, T0), (3, 3.0, T1)]


CUSTOMERS = "customer_id int, tier string"


def scd2_config(spark, table, *data, **options):
    source = df(spark, CUSTOMERS, *data)
    return Scd2(target_table=table, source=source, unique_key="customer_id", tracked_columns=["tier"], **options)


def versions(spark, table):
    return rows(spark.table(table), "customer_id", "tier", "valid_from", "valid_to", "is_current")


def test_scd2_table_over_three_runs(spark, table):
    materialize(spark, scd2_config(spark, table, (1, "a"), (2, "b")), run_ts=T0)
    materialize(spark, scd2_config(spark, table, (1, "x"), (3, "c")), run_ts=T1)
    materialize(spark, scd2_config(spark, table, (1, "a"), (3, "c")), run_ts=T2)
    expected = [
        (1, "a", T0, T1, False), (1, "a", T2, None, True), (1, "x", T1, T2, False), (2, "b", T0, T1, False), (3, "c", T1, None, True),
    ]
    assert versions(spark, table) == expected
    materialize(spark, scd2_config(spark, table, (1, "a"), (3, "c")), run_ts=datetime(2026, 3, 1))
    assert versions(spark, table) == expected
    materialize(spark, scd2_config(spark, table), run_ts=datetime(2026, 3, 2))
    assert spark.table(table).filter("is_current").count() == 0 and spark.table(table).count() == 5


def test_scd2_recovers_from_a_run_that_died_between_its_commits(spark, table, monkeypatch):
    materialize(spark, scd2_config(spark, table, (1, "a"), (2, "b")), run_ts=T0)
    later = scd2_config(spark, table, (1, "x"), (2, "b"))

    def die(*args, **kwargs):
        raise RuntimeError("executor gone")

    with monkeypatch.context() as patch:
        patch.setattr(commit, "replace_partitions", die)
        with pytest.raises(RuntimeError):
            materialize(spark, later, run_ts=T1)
    materialize(spark, later, run_ts=T1)
    assert versions(spark, table) == [(1, "a", T0, T1, False), (1, "x", T1, None, True), (2, "b", T0, None, True)]


def test_snapshots_are_pruned_by_partition(spark, table):
    def take(day, value):
        config = Snapshot(target_table=table, source=df(spark, "id int, val int", (1, value)), retain_snapshots=2)
        return materialize(spark, config, run_ts=datetime(2026, 1, day, 12, 30), snapshot_id=f"s{day}")

    assert take(1, 10)["snapshot_id"] == "s1"
    take(2, 20)
    result = take(3, 30)
    assert result["rows"] == 2
    assert rows(spark.table(table), "val", "snapshot_id", "snapshot_at") == [
        (20, "s2", datetime(2026, 1, 2, 12, 30)), (30, "s3", datetime(2026, 1, 3, 12, 30)),
    ]


def test_snapshot_dedupes_by_key(spark, table):
    source = df(spark, "id int, val int", (1, 1), (1, 2))
    config = Snapshot(target_table=table, source=source, unique_key="id", dedupe_order_by="val")
    materialize(spark, config, run_ts=T0)
    assert rows(spark.table(table), "id", "val") == [(1, 2)]
    with pytest.raises(ValueError, match="dedupe_order_by"):
        materialize(spark, Snapshot(target_table=table, source=source, unique_key="id"))


def test_append_only_never_dedupes(spark, table):
    config = AppendOnly(target_table=table, source=df(spark, "id int, msg string", (1, "a")))
    materialize(spark, config)
    assert materialize(spark, config)["rows"] == 2


def test_view_has_no_row_count(spark, table):
    spark.range(3).write.saveAsTable(f"{table}_base")
    view = View(target_table=table, source=f"SELECT sum(id) AS s FROM {table}_base")
    assert materialize(spark, view) == {"strategy": "view", "table": table}
    materialize(spark, View(target_table=table, source=f"SELECT max(id) AS m FROM {table}_base"))
    assert rows(spark.table(table)) == [(2,)]
    with pytest.raises(ValueError, match="SQL text"):
        materialize(spark, View(target_table=table, source=spark.range(1)))


def test_dotted_table_names(spark, table):
    spark.sql("CREATE DATABASE IF NOT EXISTS analytics")
    for _ in range(2):
        result = materialize(spark, FullRefresh(target_table=f"analytics.{table}", source="SELECT 1 AS x"))
    assert result["table"] == f"analytics.{table}"
    assert spark.table(f"analytics.{table}").agg(F.sum("x")).first()[0] == 1


def test_row_level_merge_is_left_to_table_formats_that_have_it(spark, table):
    materialize(spark, FullRefresh(target_table=table, source="SELECT 1 AS k, 2 AS v"))
    assert not commit.has_row_changes(spark, table)
    with pytest.raises(Exception, match="MERGE"):  # the statement is sound, the file table cannot
        commit.merge_into(spark.sql("SELECT 1 AS k, 3 AS v"), table, ["k"])


def test_staged_sources_are_removed_when_the_table_is_committed(spark, table):
    from pathlib import Path

    from tablewright.scratch import scratch_root

    def stages():
        return {p.name for p in Path(scratch_root(spark).removeprefix("file:")).iterdir() if p.name.startswith("source-")}

    before = stages()
    for v in (1, 2):
        materialize(spark, Scd2(target_table=table, source=f"SELECT 1 AS k, {v} AS v", unique_key="k", dedupe_order_by="v"))
    with pytest.raises(Exception, match="duplicate source key"):
        materialize(spark, Scd2(target_table=table, source="SELECT 1 AS k, id AS v FROM range(2)", unique_key="k"))
    assert stages() == before
    assert rows(spark.table(table), "v", "is_current") == [(1, False), (2, True)]


def test_tables_laid_out_otherwise_are_maintained_too(spark, table):
    """Partitioned where the strategy writes plain tables, plain where it partitions."""
    df(spark, "k int, part string, v int", (1, "a", 1), (2, "b", 2), (3, None, 3)).write.partitionBy("part").saveAsTable(table)
    columns = ["k", "part", "v"]
    incremental(spark, table, "merge", df(spark, "k int, part string, v int", (1, "c", 9), (3, None, 8)), unique_key="k")
    assert rows(spark.table(table), *columns) == [(1, "c", 9), (2, "b", 2), (3, None, 8)]
    assert set(commit.partition_values(spark, table)) == {"b", "c", None}
    incremental(spark, table, "delete+insert", df(spark, "k int, part string, v int", (3, "b", 7)), unique_key="k")
    assert rows(spark.table(table), *columns) == [(1, "c", 9), (2, "b", 2), (3, "b", 7)]
    assert set(commit.partition_values(spark, table)) == {"b", "c"}

    plain = spark.sql(
        "SELECT 1 AS customer_id, 'a' AS tier, TIMESTAMP_NTZ '2026-01-01' AS valid_from, CAST(NULL AS TIMESTAMP_NTZ) AS valid_to,"
        " true AS is_current, md5('a') AS row_hash"
    )
    plain.write.saveAsTable(f"{table}_dim")
    materialize(spark, scd2_config(spark, f"{table}_dim", (1, "b")), run_ts=T1)
    assert versions(spark, f"{table}_dim") == [(1, "a", T0, T1, False), (1, "b", T1, None, True)]

    spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2026-01-01' AS snapshot_at, 'x' AS snapshot_id").write.saveAsTable(f"{table}_snap")
    materialize(spark, Snapshot(target_table=f"{table}_snap", source="SELECT 2 AS id", retain_snapshots=1), run_ts=T1)
    assert rows(spark.table(f"{table}_snap"), "id") == [(2,)]
