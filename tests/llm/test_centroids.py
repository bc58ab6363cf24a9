"""Sharded clustering against plain integer loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from tablewright.llm import centroids, queries

from .conftest import SF


def plain(rows, dims, clusters=8, rounds=10):
    """[(id, vector)] -> (kept [(id, cluster, distance)], centroids), one vector at a time."""
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == dims and all(v is not None and math.isfinite(v) for v in vector):
            kept.append((key, [math.floor(1024 * float(v)) for v in vector]))

    def first(row):
        key, vector = row
        return (key is None, hashlib.sha256(f"3:{key}".encode()).hexdigest() if key is not None else "", vector)

    centres = [v for _, v in sorted(kept, key=first)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    return [(key, nearest(v)[1], nearest(v)[0]) for key, v in kept], centres


def compare(df, dims, **more):
    found = centroids.cluster(df, dims=dims, **more)
    rows, centres = plain([(r["vec_id"], r["embedding"]) for r in df.collect()], dims, **more)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.assigned.collect()), key=order) == sorted(rows, key=order)
    assert found.centroids.tolist() == centres
    return found


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_query_of_the_test_tables(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows, centres = plain([(r["vec_id"], r["embedding"]) for r in df.collect()], 64)
    inertia = [sum(d for _, c, d in rows if c == k) for k in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = {(key, c, d, inertia[c], sum(inertia), digests[c]) for key, c, d in rows}
    found = queries.op11_centroids(spark, SF)
    got = found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("dims", [1, 16, 37])
def test_shards_of_any_width(spark, dims):
    picked = random.Random(dims)
    rows = [(k, [picked.gauss(0, 3) for _ in range(dims)]) for k in range(60)]
    compare(vectors(spark, rows, "double"), dims, clusters=5, rounds=4)


def test_several_chunks_and_partitions(spark, monkeypatch):
    picked = random.Random(1)
    rows = [(k, [picked.gauss(k % 3, 1) for _ in range(20)]) for k in range(90)]
    monkeypatch.setattr(centroids, "CHUNK", 7)
    compare(vectors(spark, rows).repartition(5), 20, clusters=4, rounds=3)


def test_what_is_left_out(spark):
    good = [(k, [float(k), -float(k)]) for k in range(9)]
    bad = [(20, None), (21, []), (22, [1.0]), (23, [1.0, 2.0, 3.0]), (24, [1.0, None]), (25, [float("nan"), 1.0]), (26, [1.0, float("-inf")])]
    found = compare(vectors(spark, good + bad), 2, clusters=3)
    assert found.assigned.count() == 9


def test_ties_repeats_null_ids_and_empty_clusters(spark):
    rows = [(1, [0.0, 0.0])] * 4 + [(2, [2.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [9.0, 9.0])]
    found = compare(vectors(spark, rows), 2, clusters=6, rounds=3)
    assert found.assigned.filter("id is null").count() == 2 and found.assigned.count() == len(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    compare(vectors(spark, [(1, [1.0]), (2, [5.0])]), 1)
    none = centroids.with_inertia(centroids.cluster(vectors(spark, []), dims=1))
    assert none.count() == 0
    assert none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_extra_columns_and_other_names(spark):
    df = vectors(spark, [(k, [float(k % 4)]) for k in range(12)])
    named = df.select(F.col("vec_id").alias("my id"), F.col("embedding").alias("v.x"), F.lit(1).alias("cluster"), F.lit(2).alias("id"))
    found = centroids.cluster(named, dims=1, clusters=2, id_col="my id", vector_col="v.x")
    assert found.assigned.count() == 12


def test_components_beyond_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="cannot be clustered exactly"):
        centroids.cluster(vectors(spark, [(1, [1e9]), (2, [0.0])], "double"), dims=1)


def test_sums_beyond_64_bits():
    block = np.full((4, 1), centroids.LIMIT, np.int32)
    total, n = centroids.block_sums(block, np.zeros(4, np.int32), 2)
    for _ in range(40):
        total, n = total + total, n + n
    assert total[0][0] == 4 * centroids.LIMIT << 40 and n.tolist() == [4 << 40, 0]


def test_many_small_partitions_do_not_make_many_tasks(spark, monkeypatch):
    picked = random.Random(2)
    df = vectors(spark, [(k, [picked.gauss(k % 3, 1) for _ in range(20)]) for k in range(90)]).repartition(30)
    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.files.openCostInBytes": "128m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    deal = RDD.partitionBy  # more partitions than asked for: several are read by one task
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *more: deal(self, max(n, 31), *more))
    seen, nearest = [], centroids._Blocks.nearest

    def noting(self, now):
        found = nearest(self, now)
        seen.append(found.getNumPartitions())
        return found

    monkeypatch.setattr(centroids._Blocks, "nearest", noting)
    try:
        compare(df, 20, clusters=4, rounds=2)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(seen) == 3 and max(seen) <= spark.sparkContext.defaultParallelism
