from datetime import datetime

import pytest
from conftest import rows

from tablewright import AppendOnly, Incremental, Scd1, Scd2, materialize
from tablewright.streaming import append_stream, refresh_stream

SCHEMA = "id int, v string, at timestamp_ntz"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of files, one micro-batch each, in order of arrival."""
    folder = tmp_path / "feed"

    def put(*data):
        df = spark.createDataFrame([(i, v, datetime(2026, 1, d)) for i, v, d in data], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(str(folder))

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return put, stream


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_merge_over_batches_and_restarts(spark, table, feed, tmp_path):
    put, stream = feed
    config = Incremental(target_table=table, source="", unique_key="id", dedupe_order_by="at")
    put((1, "a", 1), (2, "b", 1), (2, "bb", 2))
    put((1, "c", 3))
    run(refresh_stream(stream(), config, str(tmp_path / "cp")))
    assert rows(spark.table(table), "id", "v") == [(1, "c"), (2, "bb")]
    put((3, "d", 4))
    run(refresh_stream(stream(), config, str(tmp_path / "cp")))
    assert rows(spark.table(table), "id", "v") == [(1, "c"), (2, "bb"), (3, "d")]


def test_stream_scd2_dates_versions_by_the_data(spark, table, feed, tmp_path):
    put, stream = feed
    config = Scd2(
        target_table=table, source="", unique_key="id", tracked_columns=["v"], invalidate_hard_deletes=False, dedupe_order_by="at"
    )
    put((1, "a", 1), (2, "b", 1))
    put((1, "x", 5))
    run(refresh_stream(stream(), config, str(tmp_path / "cp"), run_ts_column="at"))
    assert rows(spark.table(table), "id", "v", "valid_from", "valid_to") == [
        (1, "a", datetime(2026, 1, 1), datetime(2026, 1, 5)),
        (1, "x", datetime(2026, 1, 5), None),
        (2, "b", datetime(2026, 1, 1), None),
    ]


def test_stream_append_is_exactly_once(spark, table, feed, tmp_path):
    put, stream = feed
    put((1, "a", 1))
    put((1, "a", 1))
    run(append_stream(stream(), table, str(tmp_path / "cp")))
    run(append_stream(stream(), table, str(tmp_path / "cp")))
    assert rows(spark.table(table), "id", "v") == [(1, "a"), (1, "a")]


def test_older_events_of_later_batches_change_nothing(spark, table, feed, tmp_path):
    put, stream = feed
    for n, make in enumerate((Incremental, Scd1)):
        config = make(target_table=f"{table}_{n}", source="", unique_key="id", dedupe_order_by="at")
        if n == 0:
            put((1, "new", 9), (2, "b", 1))
            put((1, "old", 5), (2, "bb", 3), (3, "c", 2))
        run(refresh_stream(stream(), config, str(tmp_path / f"cp{n}")))
        assert rows(spark.table(f"{table}_{n}"), "id", "v") == [(1, "new"), (2, "bb"), (3, "c")]


def test_stream_and_batch_appends_share_a_table(spark, table, feed, tmp_path):
    put, stream = feed
    old = spark.createDataFrame([(k, "old", datetime(2026, 1, 1)) for k in range(5)], SCHEMA)
    old.write.saveAsTable(table)
    put((10, "a", 1), (11, "b", 1))
    put((12, "c", 2))
    run(append_stream(stream(), table, str(tmp_path / "cp")))
    assert spark.table(table).count() == 8
    materialize(spark, AppendOnly(target_table=table, source=old.limit(2)))
    assert spark.table(table).count() == 10
    put((13, "d", 3))
    run(append_stream(stream(), table, str(tmp_path / "cp")))
    assert spark.table(table).count() == 11 and spark.read.parquet(str(tmp_path / "feed")).count() == 4


def test_unfit_configs_are_refused(spark, feed):
    put, stream = feed
    put((1, "a", 1))
    bad = [
        AppendOnly(target_table="x", source=""),
        Incremental(target_table="x", source=""),
        Incremental(target_table="x", source="", unique_key="id", incremental_strategy="delete+insert"),
        Incremental(target_table="x", source="", unique_key="id", incremental_column="at"),
        Scd2(target_table="x", source="", unique_key="id"),
    ]
    for config in bad:
        with pytest.raises(ValueError):
            refresh_stream(stream(), config, "unused")
    assert Scd1(target_table="x", source="", unique_key="id")
