import random
import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import as_of, current_rows, key_history, scd1, scd1_initial, scd2, scd2_initial, scd2_parts
from tablewright.operators.dimensions import join_as_of, join_as_of_binned

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 15), datetime(2026, 2, 1)
PRODUCTS = "id int, name string, price double"
CUSTOMERS = "customer_id int, name string, tier string"


def products(spark, *data):
    return spark.createDataFrame(data, PRODUCTS)


def customers(spark, *data):
    return spark.createDataFrame(data, CUSTOMERS)


def test_scd1_touches_only_tracked_changes(spark):
    target = scd1_initial(products(spark, (1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (5, "e", 5.0)), T0)
    source = products(spark, (1, "a", 1.5), (2, "b", 2.0), (3, "renamed", 3.0), (4, "d", 4.0))
    after = scd1(target, source, "id", ["price"], T1)
    assert rows(after) == [
        (1, "a", 1.5, T1),
        (2, "b", 2.0, T1),  # NULL to a value is a change
        (3, "c", 3.0, T0),  # only an untracked column differs: the row stays whole
        (4, "d", 4.0, T1),
        (5, "e", 5.0, T0),  # missing from the source: kept
    ]


def test_scd1_without_tracked_columns_touches_every_match(spark):
    target = scd1_initial(products(spark, (1, "a", 1.0), (2, "b", 2.0)), T0)
    assert rows(scd1(target, products(spark, (1, "a", 1.0)), "id", [], T1)) == [
        (1, "a", 1.0, T1),
        (2, "b", 2.0, T0),
    ]


def versions(df):
    return rows(df, "customer_id", "tier", "valid_from", "valid_to", "is_current")


def test_scd2_lifecycle(spark):
    first = scd2_initial(customers(spark, (1, "A", "gold"), (2, "B", "gold"), (3, "C", None)), "customer_id", ["tier"], T0)
    second = scd2(
        first,
        customers(spark, (1, "A", "gold"), (2, "B", "silver"), (3, "C", ""), (4, "D", "new")),
        "customer_id",
        ["tier"],
        T1,
    )
    assert versions(second) == [
        (1, "gold", T0, None, True),
        (2, "gold", T0, T1, False),
        (2, "silver", T1, None, True),
        (3, None, T0, None, True),  # NULL and '' hash alike
        (4, "new", T1, None, True),
    ]
    # key 1 disappears, key 2 goes back, key 4 changes an untracked column only
    third = scd2(second, customers(spark, (2, "B", "gold"), (3, "C", None), (4, "Dee", "new")), "customer_id", ["tier"], T2)
    assert versions(third) == [
        (1, "gold", T0, T2, False),
        (2, "gold", T0, T1, False),
        (2, "gold", T2, None, True),
        (2, "silver", T1, T2, False),
        (3, None, T0, None, True),
        (4, "new", T1, None, True),
    ]
    assert rows(current_rows(third).filter("customer_id = 4"), "name") == [("D",)]
    # a key that was deleted comes back
    fourth = scd2(third, customers(spark, (1, "A", "gold")), "customer_id", ["tier"], datetime(2026, 3, 1))
    assert rows(current_rows(fourth), "customer_id", "valid_from") == [(1, datetime(2026, 3, 1))]
    # the same source again changes nothing
    assert versions(scd2(third, customers(spark, (2, "B", "gold"), (3, "C", None), (4, "D", "new")), "customer_id", ["tier"], T2)) == versions(third)


def test_scd2_can_keep_missing_keys_open(spark):
    first = scd2_initial(customers(spark, (1, "A", "gold"), (2, "B", "gold")), "customer_id", ["tier"], T0)
    after = scd2(first, customers(spark, (1, "A", "x")), "customer_id", ["tier"], T1, close_missing=False)
    assert versions(after) == [(1, "gold", T0, T1, False), (1, "x", T1, None, True), (2, "gold", T0, None, True)]


def test_scd2_null_keys_are_inserted_and_their_older_copy_closed(spark):
    first = scd2_initial(customers(spark, (None, "A", "gold")), "customer_id", ["tier"], T0)
    after = scd2(first, customers(spark, (None, "A", "gold")), "customer_id", ["tier"], T1)
    assert versions(after) == [(None, "gold", T0, T1, False), (None, "gold", T1, None, True)]


def test_scd2_without_tracked_columns_hashes_all_attributes(spark):
    first = scd2_initial(customers(spark, (1, "A", "gold"), (2, "B", "gold")), "customer_id", [], T0)
    after = scd2(first, customers(spark, (1, "A", "gold"), (2, "Bee", "gold")), "customer_id", [], T1)
    assert rows(after, "customer_id", "name", "is_current") == [(1, "A", True), (2, "B", False), (2, "Bee", True)]


def test_scd2_composite_key_and_empty_source(spark):
    schema = "region string, product_id int, price int"
    first = scd2_initial(spark.createDataFrame([("eu", 1, 5), ("us", 1, 6)], schema), "region,product_id", ["price"], T0)
    after = scd2(first, spark.createDataFrame([("eu", 1, 7), ("us", 1, 6)], schema), "region,product_id", ["price"], T1)
    assert rows(after, "region", "price", "is_current") == [("eu", 5, False), ("eu", 7, True), ("us", 6, True)]
    gone = scd2(first, spark.createDataFrame([], schema), "region,product_id", ["price"], T1)
    assert rows(gone, "is_current") == [(False,), (False,)]


def test_scd2_parts_are_disjoint_and_complete(spark):
    first = scd2_initial(customers(spark, (1, "A", "a"), (2, "B", "b")), "customer_id", ["tier"], T0)
    source = customers(spark, (1, "A", "z"), (2, "B", "b"))
    second = scd2(first, source, "customer_id", ["tier"], T1)
    third = customers(spark, (1, "A", "y"))
    parts = scd2_parts(second, third, "customer_id", ["tier"], T2)
    whole = scd2(second, third, "customer_id", ["tier"], T2)
    assert versions(parts.history.unionByName(parts.closed).unionByName(parts.current)) == versions(whole)
    assert versions(parts.history) == [(1, "a", T0, T1, False)]


def test_scd2_refuses_duplicate_source_keys(spark):
    first = scd2_initial(customers(spark, (1, "A", "a")), "customer_id", ["tier"], T0)
    twice = customers(spark, (1, "A", "b"), (1, "A", "c"))
    with pytest.raises(Exception, match="duplicate source key"):
        scd2(first, twice, "customer_id", ["tier"], T1).collect()
    after = scd2(first, twice, "customer_id", ["tier"], T1, dedupe_order_by="tier")
    assert rows(current_rows(after), "tier") == [("c",)]


def test_as_of_is_half_open(spark):
    first = scd2_initial(customers(spark, (1, "A", "a")), "customer_id", ["tier"], T0)
    dim = scd2(first, customers(spark, (1, "A", "b")), "customer_id", ["tier"], T1)
    assert rows(as_of(dim, T1), "tier") == [("b",)]
    assert rows(as_of(dim, datetime(2026, 1, 14, 23, 59)), "tier") == [("a",)]
    assert rows(as_of(dim, datetime(2025, 12, 31)), "tier") == []
    facts = spark.createDataFrame([(10, 1, T0), (11, 1, T1), (12, 9, T1)], "f int, customer_id int, at timestamp_ntz")
    assert rows(join_as_of(facts, dim, "customer_id", "at"), "f", "tier") == [(10, "a"), (11, "b"), (12, None)]
    assert [r.tier for r in key_history(dim, F.col("customer_id") == 1).collect()] == ["a", "b"]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_binned_join_as_the_plain_one(spark, kind, how):
    pick = random.Random(5)
    versions, day = [], timedelta(days=1)
    for key in (1, 2, 3, None):
        at = datetime(1960, 1, 1)
        for n in range(60):
            length = pick.choice((1, 1, 2, 30, 400)) * day
            gap = pick.choice((0, 0, 3)) * day
            versions.append((key, f"v{n}", at, at + length))
            at += length + gap
        versions[-1] = (*versions[-1][:3], None)  # the open one
    versions.append((4, "only", datetime(2000, 1, 1), None))
    facts = [(n, pick.choice((1, 2, 3, 4, 5, None)), datetime(1959, 1, 1) + pick.randrange(30_000) * day) for n in range(400)] + [(999, 1, None)]
    times = lambda df, *names: df.withColumns({n: F.col(n).cast(kind) for n in names})
    dim = times(spark.createDataFrame(versions, "k int, v string, valid_from timestamp_ntz, valid_to timestamp_ntz"), "valid_from", "valid_to")
    fact = times(spark.createDataFrame(facts, "f int, k int, at timestamp_ntz"), "at")
    want, got = join_as_of(fact, dim, "k", "at", how=how), join_as_of_binned(fact, dim, "k", "at", how=how)
    assert got.columns == want.columns and rows(got) == rows(want)
    none = dim.filter("false")
    assert rows(join_as_of_binned(fact, none, "k", "at", how=how)) == rows(join_as_of(fact, none, "k", "at", how=how))


def test_binned_join_does_not_pair_a_key_with_all_its_versions(spark):
    """One key, 20,000 versions, 50,000 facts: join rows stay near the number of facts."""
    minute = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0)")
    dim = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("v"), minute.alias("valid_from"))
    dim = dim.withColumn("valid_to", F.col("valid_from") + F.expr("interval 1 minute"))
    fact = spark.range(50_000).withColumn("id", F.col("id") % 20_000).select(F.lit(1).alias("k"), F.col("id").alias("want"), minute.alias("at"))
    joined = join_as_of_binned(fact, dim, "k", "at")
    begin = time.time()
    assert joined.filter("v = want").count() == 50_000
    assert time.time() - begin < 60  # a billion pairs would take far longer
