"""Marks kept with a table: right after every change, and read from added files only."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright import Incremental, materialize
from tablewright.operators import high_watermark
from tablewright.plans import marks


@pytest.fixture
def read(monkeypatch):
    """Number of files each reading of a mark scans."""
    seen, whole = [], marks.high_watermark

    def scan(df, name):
        seen.append(len({r[0] for r in df.select("_metadata.file_path").distinct().collect()}) if "_metadata" not in df.columns else -1)
        return whole(df, name)

    monkeypatch.setattr(marks, "high_watermark", scan)
    return seen


def delivery(spark, first, last, status="new"):
    return spark.range(first, last).select("id", (F.col("id") * 10).alias("at"), F.lit(status).alias("status")).coalesce(1)


def fresh(spark, table):
    return high_watermark(spark.table(table), "at")


def test_appends_read_only_files_added_since(spark, table, read):
    config = lambda source: Incremental(target_table=table, source=source, incremental_column="at")
    materialize(spark, config(delivery(spark, 0, 5)))
    for k in range(1, 5):
        materialize(spark, config(delivery(spark, 0, 5 * k + 5)))
        assert spark.table(table).count() == 5 * k + 5
    assert read == [1, 1, 1, 1]  # one new file a run, though the table has five
    assert marks.kept_mark(spark, table, "at") == fresh(spark, table) == 240
    assert marks.kept_mark(spark, table, "at") == 240 and len(read) == 5  # nothing was added


def test_others_appends_and_rewrites_are_noticed(spark, table, read):
    config = lambda source: Incremental(target_table=table, source=source, incremental_column="at")
    materialize(spark, config(delivery(spark, 0, 5)))
    materialize(spark, config(delivery(spark, 0, 8)))
    delivery(spark, 50, 60).write.insertInto(table)
    assert marks.kept_mark(spark, table, "at") == 590
    spark.sql(f"INSERT OVERWRITE {table} SELECT 1L, 20L, 'less'")
    assert marks.kept_mark(spark, table, "at") == 20
    spark.sql(f"TRUNCATE TABLE {table}")
    assert marks.kept_mark(spark, table, "at") is None
    materialize(spark, config(delivery(spark, 0, 3)))
    assert spark.table(table).count() == 3 and marks.kept_mark(spark, table, "at") == 20


@pytest.mark.parametrize("strategy", ["merge", "delete+insert"])
def test_rewrites_note_the_mark_from_what_came_in(spark, table, read, strategy):
    config = lambda source: Incremental(
        target_table=table, source=source, unique_key="id", incremental_column="at", incremental_strategy=strategy
    )
    materialize(spark, config(delivery(spark, 0, 5)))
    later = delivery(spark, 3, 9, "changed").withColumn("at", F.col("at") + 100)
    materialize(spark, config(later))
    before = len(read)
    assert marks.kept_mark(spark, table, "at") == fresh(spark, table) == 180 and len(read) == before
    materialize(spark, config(later))  # nothing is newer
    assert marks.kept_mark(spark, table, "at") == 180
    assert rows(spark.table(table), "id", "at", "status")[3:5] == [(3, 130, "changed"), (4, 140, "changed")]
    assert spark.table(table).count() == 9


def test_an_order_that_leaves_rows_out_is_not_trusted(spark, table):
    config = lambda source: Incremental(
        target_table=table, source=source, unique_key="id", incremental_column="at", dedupe_order_by=["rank"]
    )
    frame = lambda *data: spark.createDataFrame(data, "id int, at int, rank int")
    materialize(spark, config(frame((1, 10, 1))))
    materialize(spark, config(frame((1, 90, 1), (1, 20, 2))))
    assert marks.kept_mark(spark, table, "at") == fresh(spark, table) == 20


VALUES = {
    "int": (3, 7),
    "bigint": (-5, 1 << 40),
    "decimal(20,3)": (Decimal("1.500"), Decimal("12345678901234.125")),
    "date": (date(2024, 1, 31), date(2024, 2, 1)),
    "timestamp": (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5)),
    "timestamp_ntz": (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 500)),
    "string": ("a'b\\", 'ü"\n'),
    "double": (0.1, 2.5),
    "boolean": (False, True),
}


@pytest.mark.parametrize("kind", VALUES, ids=lambda k: k.partition("(")[0])
def test_marks_of_every_type(spark, table, kind):
    one, two = ([[v]] for v in VALUES[kind])
    spark.createDataFrame([[None]], f"at {kind}").write.saveAsTable(table)
    assert marks.kept_mark(spark, table, "at") is None
    for data in (two, one):
        spark.createDataFrame(data, f"at {kind}").write.insertInto(table)
        assert marks.kept_mark(spark, table, "at") == marks.kept_mark(spark, table, "at") == fresh(spark, table)
    assert repr(marks.kept_mark(spark, table, "at")) == repr(fresh(spark, table))


def test_a_column_of_another_type_is_read_anew(spark, table):
    materialize(spark, Incremental(target_table=table, source=delivery(spark, 0, 5), incremental_column="at"))
    assert marks.kept_mark(spark, table, "at") == 40
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('tablewright.mark.at' = '{{\"type\": \"string\", \"value\": \"z\"}}')")
    assert marks.kept_mark(spark, table, "at") == 40
