"""Values that a column cannot hold are refused, not cut."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright import Incremental, materialize
from tablewright.operators import delete_insert, merge
from tablewright.operators.schema import align_schemas, conform


@pytest.mark.parametrize("policy", ["ignore", "append_new_columns"])
def test_fractions_do_not_vanish(spark, policy):
    target = spark.createDataFrame([(1, 5)], "id int, v int")
    source = lambda *v: spark.createDataFrame(list(enumerate(v, 1)), "id int, v double")
    assert rows(merge(target, source(2.0, 7.0), "id", on_schema_change=policy)) == [(1, 2), (2, 7)]
    for lossy in (source(1.9), source(2.0, 2.7)):
        with pytest.raises(Exception, match="v is int, which cannot hold"):
            merge(target, lossy, "id", on_schema_change=policy).collect()
        with pytest.raises(Exception, match="cannot hold"):
            delete_insert(target, lossy, "id").collect()


@pytest.mark.parametrize(
    ("given", "wanted", "good", "bad"),
    [
        ("bigint", "int", 7, 1 << 40),
        ("double", "bigint", -3.0, float("nan")),
        ("double", "decimal(6,2)", 1.25, 1.255),
        ("decimal(6,3)", "decimal(6,1)", Decimal("1.500"), Decimal("1.510")),
        ("timestamp_ntz", "date", datetime(2026, 1, 2), datetime(2026, 1, 2, 3)),
        ("timestamp", "date", datetime(2026, 1, 2), datetime(2026, 1, 2, 3)),
    ],
)
def test_types(spark, given, wanted, good, bad):
    like = spark.createDataFrame([], f"v {wanted}")
    assert conform(spark.createDataFrame([(good,), (None,)], f"v {given}"), like).schema["v"].dataType.simpleString() == wanted
    kept = conform(spark.createDataFrame([(good,), (None,)], f"v {given}"), like).collect()
    assert kept[0][0] == (good.date() if isinstance(kept[0][0], date) else good) and kept[1][0] is None
    with pytest.raises(Exception, match="cannot hold"):
        conform(spark.createDataFrame([(bad,)], f"v {given}"), like).collect()


def test_floats_take_the_nearest_value(spark):
    like = spark.createDataFrame([], "v float, w double")
    found = conform(spark.createDataFrame([(0.1, 1 << 60)], "v double, w bigint"), like).first()
    assert abs(found["v"] - 0.1) < 1e-7 and found["w"] == float(1 << 60)


def test_sync_widens_columns(spark, table):
    for df in (spark.createDataFrame([(1, 5)], "id int, v int"), spark.createDataFrame([(2, 1 << 40)], "id bigint, v bigint")):
        materialize(spark, Incremental(target_table=table, source=df, unique_key="id", on_schema_change="sync_all_columns"))
    assert rows(spark.table(table)) == [(1, 5), (2, 1 << 40)] and dict(spark.table(table).dtypes)["v"] == "bigint"
    narrow = spark.createDataFrame([(2, 1.5)], "id int, v float")
    target, _ = align_schemas(spark.table(table), narrow, "sync_all_columns", ["id"])
    assert dict(target.dtypes)["v"] == "bigint"


def test_overwrite_whose_source_reads_the_target(spark, table):
    def source():
        old = spark.table(table) if spark.catalog.tableExists(table) else None
        n = F.lit(0) if old is None else F.lit(old.count())
        fixed = spark.createDataFrame([("a",), (None,)], "p string").withColumn("n", n.cast("bigint"))
        if old is None:
            return fixed
        counted = old.agg(F.count("*").alias("n"))
        return fixed.drop("n").crossJoin(counted)

    for _ in range(2):
        config = Incremental(target_table=table, source=source(), incremental_strategy="insert_overwrite", overwrite_column="p")
        materialize(spark, config)
    assert rows(spark.table(table), "p", "n") == [(None, 0), (None, 2), ("a", 2)]
