"""Connected components of a graph given as a table of edges.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): every node's larger neighbours, then its smaller ones, are linked to the
smallest node known near it, until every component is a star around its smallest node. The
rounds grow with the logarithm of the longest chain, not with its length.

Each step is written to the shared folder, so a lost executor costs one step at most; the
smallest neighbour is combined before its shuffle, and it joins the edges through a plain
join that adaptive execution can split where a node has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import own_shuffle
from ..scratch import discard_later, remove_folder, scratch_folder


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node it reaches.

    Rows with a null end and loops are no edges.
    """
    spark = edges.sparkSession
    folder = scratch_folder(spark, "components")
    discard_later(folder)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = keep(start.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "0")
    before, k = None, 0
    while (now := _digest(current)) != before:
        large = keep(_large_star(current), f"large-{k}")
        following = keep(_small_star(large), str(k + 1))
        for done in (f"large-{k}", str(k)):
            remove_folder(spark, f"{folder}/{done}")
        before, current, k = now, following, k + 1
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node, linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    linked = both.filter(F.col("v") > F.col("u")).join(own_shuffle(least), "u")
    return linked.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours, linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    others = edges.join(own_shuffle(least), "u").filter(F.col("v") > F.col("least"))
    return (
        others.select(F.col("v").alias("u"), F.col("least").alias("v"))
        .unionByName(least.select("u", F.col("least").alias("v")))
        .distinct()
    )
