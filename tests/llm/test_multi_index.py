"""Pairs within a Hamming distance against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import multi_index
from tablewright.llm.multi_index import ball, near_pairs


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def clusters(seed, centres=20, size=12, flips=5):
    """Random fingerprints, each with neighbours a few bits away."""
    picked = random.Random(seed)
    values = {0, (1 << 64) - 1, 1 << 63, 1}
    for _ in range(centres):
        centre = picked.getrandbits(64)
        values.add(centre)
        for _ in range(size):
            v = centre
            for _ in range(picked.randrange(flips + 1)):
                v ^= 1 << picked.randrange(64)
            values.add(v)
    return sorted(values)


def check(spark, values, most, **more):
    found = [tuple(r) for r in near_pairs(spark.createDataFrame([(signed(v),) for v in values], "f long"), "f", most, **more).collect()]
    want = {
        tuple(sorted((signed(a), signed(b)))) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= most
    }
    assert len(found) == len(set(found)) and set(found) == want
    return want


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5, 8])
def test_all_pairs_are_found_once(spark, most):
    assert bool(check(spark, clusters(most), most)) == (most > 0)


@pytest.mark.parametrize(("most", "hot"), [(2, 1), (3, 2), (4, 3)])
def test_hot_buckets_are_split_down_to_single_fingerprints(spark, most, hot):
    check(spark, clusters(most, centres=4, size=25, flips=4), most, hot=hot)


def test_large_balls_in_hot_buckets(spark):
    # all but the last segment alike: more of them near each other than a ball should enumerate
    picked = random.Random(2)
    check(spark, sorted({(0xABCDEF << 16) | picked.getrandbits(16) for _ in range(60)}), 6, hot=8)


def test_a_group_much_larger_than_a_bucket(spark, monkeypatch):
    """One centre and all its neighbours at one and two bits: 2,081 fingerprints."""
    centre = 0x0123456789ABCDEF
    values = [centre ^ f for f in ball(2, 64)]
    met, whole = [], multi_index._meet

    def meet(fetches, table, most):
        met.append(fetches.join(table.drop("f", "unused"), ["path", "bits"]).count())
        return whole(fetches, table, most)

    monkeypatch.setattr(multi_index, "_meet", meet)
    want = check(spark, values, 2)
    assert sum(met) < 60 * len(want)


def test_none_one_and_too_far(spark):
    check(spark, [], 2)
    check(spark, [7], 2)
    with pytest.raises(ValueError, match="bits"):
        near_pairs(spark.range(1), "id", 9)


def test_ball():
    assert ball(1, 4) == [0, 1, 2, 4, 8] and len(ball(2)) == 137 and len(set(ball(3, 10))) == len(ball(3, 10))


def test_hot_buckets_join_can_be_split(spark):
    """Neither side of the join that fetches stands behind an aggregate."""
    df = spark.createDataFrame([(v,) for v in range(100)], "f long").withColumn("path", F.lit(0)).withColumn("bits", F.col("f") % 3)
    fetches = df.withColumn("rest", F.lit(1))
    plan = multi_index._meet(fetches, df, 2)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "Aggregate" not in below and "Window" not in below
