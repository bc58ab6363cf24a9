"""Plans at scale: what is shuffled, and that one hot key does not end up in one task."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.operators import delete_insert, merge, overwrite_by_value, scd1, scd1_initial, scd2, scd2_initial

T0, T1 = datetime(2026, 1, 1), datetime(2026, 2, 1)


@pytest.fixture
def skewed(spark):
    """No broadcasts, and a low bar for what adaptive execution calls a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def hot_target(spark, tmp_path, rows=60_000):
    """Half the rows share key 7, a few have none."""
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("id")).cast("bigint")
    df = spark.range(0, rows, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    df.write.parquet(str(tmp_path / "target"))
    return spark.read.parquet(str(tmp_path / "target"))


def changes(spark, tmp_path, rows=3_000):
    df = spark.range(rows).select(F.col("id").alias("k"), F.lit("new").alias("v"))
    df.write.parquet(str(tmp_path / "changes"))
    return spark.read.parquet(str(tmp_path / "changes"))


def test_merge_splits_a_hot_target_key(skewed, tmp_path):
    target, source = hot_target(skewed, tmp_path), changes(skewed, tmp_path)
    after = merge(target, source, "k")
    assert "skew=true" in final_plan(after)
    assert after.filter("k = 7 AND v = 'new'").count() == 30_001  # every even id, and 7 itself


def test_merge_with_latest_of_duplicates_splits_a_hot_target_key(skewed, tmp_path):
    target, source = hot_target(skewed, tmp_path), changes(skewed, tmp_path)
    assert "skew=true" in final_plan(merge(target, source, "k", dedupe_order_by="v"))


def test_scd1_and_delete_insert_split_a_hot_target_key(skewed, tmp_path):
    target, source = hot_target(skewed, tmp_path), changes(skewed, tmp_path)
    assert "skew=true" in final_plan(scd1(scd1_initial(target, T0), source, "k", ["v"], T1))
    assert "skew=true" in final_plan(delete_insert(target, source, "k"))


def test_scd2_splits_a_hot_current_key(skewed, tmp_path):
    target, source = hot_target(skewed, tmp_path), changes(skewed, tmp_path)
    assert "skew=true" in final_plan(scd2(scd2_initial(target, "k", ["v"], T0), source, "k", ["v"], T1))


def test_a_small_source_leaves_the_target_unshuffled(spark, tmp_path):
    target, source = hot_target(spark, tmp_path), changes(spark, tmp_path)
    for after in (merge(target, source, "k"), scd1(scd1_initial(target, T0), source, "k", ["v"], T1)):
        plan = after._jdf.queryExecution().executedPlan().toString()
        updated = plan.split("LeftOuter")[1].split("FileScan")[0]
        assert "SortMergeJoin" not in plan and "Exchange" not in updated


@pytest.fixture
def uncoalesced(skewed):
    skewed.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield skewed
    skewed.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_versions_of_few_keys_leave_facts_spread_over_tasks(uncoalesced):
    """Open versions, and closed ones too long for many bins: the facts are not dealt by the key alone."""
    from tablewright.operators.dimensions import join_as_of_binned

    uncoalesced.conf.set("spark.sql.shuffle.partitions", "16")
    facts = uncoalesced.range(0, 9_000, 1, 4).selectExpr("id", "id % 3 AS k", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, CAST(id AS int)) AS at")
    text = "SELECT id AS k, timestamp_ntz'2025-01-01' AS valid_from, {} AS valid_to FROM range(3)"
    for until in ("CAST(NULL AS timestamp_ntz)", "timestamp_ntz'2027-01-01'"):
        met = join_as_of_binned(facts, uncoalesced.sql(text.format(until)), "k", "at")
        of = met.groupBy(F.spark_partition_id().alias("task")).agg(F.count("valid_from").alias("rows")).collect()
        assert len(of) > 12 and max(r["rows"] for r in of) < 2_000 and sum(r["rows"] for r in of) == 9_000


def test_overwrite_splits_a_hot_value(skewed, tmp_path):
    target, source = hot_target(skewed, tmp_path), changes(skewed, tmp_path)
    after = overwrite_by_value(target, source, "k")
    assert "skew=true" in final_plan(after)
    assert after.filter("k = 7").count() == 1


def test_watermark_reaches_the_scan(spark, tmp_path):
    from tablewright.operators import newer_than

    source = changes(spark, tmp_path)
    plan = newer_than(source, "k", 2_990)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,2990)" in plan


def test_a_hot_partition_value_is_written_by_several_tasks(skewed, tmp_path):
    from tablewright.plans.commit import laid_out

    skewed.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400kb")  # more than a cold value has
    day = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string"))
    df = skewed.range(0, 60_000, 1, 8).select(day.alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    laid_out(df, ["day"], ["v"]).write.partitionBy("day").parquet(str(tmp_path / "out"))
    files = lambda d: len(list((tmp_path / "out" / f"day={d}").glob("*.parquet")))
    # a cold value may share a split shuffle partition with the hot one, but not all of them do
    assert files("hot") > 3 and min(files(d) for d in "0123456") <= 2


def test_first_load_of_a_dimension_refuses_repeated_keys(spark, table):
    from tablewright import Scd2, materialize

    config = Scd2(target_table=table, source="SELECT 1 AS k, id AS v FROM range(2)", unique_key="k")
    with pytest.raises(ValueError, match="duplicate source key"):
        materialize(spark, config)
    assert not spark.catalog.tableExists(table)
