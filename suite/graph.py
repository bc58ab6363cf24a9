"""Dependency questions over customers as a tree: each depends on the one at half its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import (
    cycle_nodes,
    cycle_path,
    downstream_subgraph,
    propagate_failures,
    reachable_nodes,
    reachable_pairs,
    run_status,
    topological_levels,
    topological_order,
)

from .registry import query, source

EDGES = "SELECT c_custkey // 2 AS upstream, c_custkey AS downstream FROM customer WHERE c_custkey // 2 <> c_custkey"
CLOSURE = f"""
    WITH RECURSIVE e AS ({EDGES}), c AS (
        SELECT upstream AS a, downstream AS b FROM e
        UNION
        SELECT c.a, e.downstream FROM c JOIN e ON c.b = e.upstream
    )
"""


def edges(spark, sf_dir):
    parent = F.floor(F.col("c_custkey") / 2).cast("bigint")
    tree = source(spark, sf_dir, "customer").select(parent.alias("upstream"), F.col("c_custkey").alias("downstream"))
    return tree.filter("upstream <> downstream")


def indebted(spark, sf_dir):
    return source(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")


@query("closure_upstream", f"{CLOSURE} SELECT b AS root, a AS node FROM c WHERE b IN (SELECT max(c_custkey) FROM customer)")
def closure_upstream(spark, sf_dir):
    """Everything the last node depends on."""
    last = source(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("root"))
    return reachable_pairs(edges(spark, sf_dir), last, direction="upstream")


DEEPEST = "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10"


@query("closure_downstream", f"{CLOSURE} SELECT a AS root, b AS node FROM c WHERE a IN ({DEEPEST})")
def closure_downstream(spark, sf_dir):
    """Everything that depends on each of the ten customers deepest in debt."""
    deepest = source(spark, sf_dir, "customer").orderBy("c_acctbal", "c_custkey").limit(10).select("c_custkey")
    return reachable_pairs(edges(spark, sf_dir), deepest)


@query("affected_nodes", f"{CLOSURE} SELECT DISTINCT b AS node FROM c WHERE a IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def affected_nodes(spark, sf_dir):
    """Nodes that depend on any indebted customer."""
    return reachable_nodes(edges(spark, sf_dir), indebted(spark, sf_dir))


LEVELS = f"{CLOSURE} SELECT c_custkey AS node, CAST(1 + (SELECT count(*) FROM c WHERE b = c_custkey) AS INTEGER) AS level FROM customer"


@query("topo_levels", LEVELS)
def topo_levels(spark, sf_dir):
    return topological_levels(edges(spark, sf_dir))


@query("topo_order", f"{LEVELS} ORDER BY level, node")
def topo_order(spark, sf_dir):
    return topological_order(edges(spark, sf_dir))


# The tree plus one edge from its last leaf back to the root.
LOOPED = EDGES + " UNION ALL SELECT max(c_custkey), min(c_custkey) FROM customer"


@query("cycle_nodes", f"{CLOSURE.replace(EDGES, LOOPED)} SELECT a AS node FROM c WHERE a = b")
def cycle_nodes_query(spark, sf_dir):
    """Nodes on a cycle once the last leaf feeds the root."""
    back = source(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("upstream"), F.min("c_custkey").alias("downstream"))
    return cycle_nodes(edges(spark, sf_dir).unionByName(back))


@query(
    "cycle_path",
    f"""{CLOSURE.replace(EDGES, LOOPED)}, cycle AS (SELECT a AS node FROM c WHERE a = b)
        SELECT row_number() OVER (ORDER BY node) - 1 AS position, node FROM cycle
        UNION ALL SELECT count(*), min(node) FROM cycle""",
)
def cycle_path_query(spark, sf_dir):
    """The same cycle in order: on the way down numbers grow."""
    back = source(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("upstream"), F.min("c_custkey").alias("downstream"))
    return cycle_path(edges(spark, sf_dir).unionByName(back))


@query(
    "order_chains",
    f"""SELECT o_orderkey AS node,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS level
        FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)""",
)
def order_chains(spark, sf_dir):
    """Each order of a customer waits for the one before: long chains of nodes with one parent."""
    orders = source(spark, sf_dir, "orders")
    before = F.expr("lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)")
    chained = orders.select(before.alias("upstream"), F.col("o_orderkey").alias("downstream"))
    return topological_levels(chained.filter("upstream is not null"))


@query(
    "subgraph",
    f"""{CLOSURE}, inside AS (
            SELECT c_custkey AS node FROM customer WHERE c_acctbal < 0
            UNION SELECT b FROM c WHERE a IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
        SELECT upstream, downstream FROM e
        WHERE upstream IN (SELECT node FROM inside) AND downstream IN (SELECT node FROM inside)""",
)
def subgraph(spark, sf_dir):
    return downstream_subgraph(edges(spark, sf_dir), indebted(spark, sf_dir))


STATES = f"""{CLOSURE}, s AS (
        SELECT c_custkey AS node,
               CASE WHEN c_custkey IN (SELECT b FROM c JOIN customer f ON f.c_custkey = a WHERE f.c_acctbal < -900) THEN 'skipped'
                    WHEN c_acctbal < -900 THEN 'failed' ELSE 'success' END AS state
        FROM customer)"""


def states(spark, sf_dir):
    outcomes = source(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), "c_acctbal")
    return propagate_failures(edges(spark, sf_dir), outcomes, F.col("c_acctbal") < -900)


@query("skip_propagation", f"{STATES} SELECT node, state FROM s")
def skip_propagation(spark, sf_dir):
    return states(spark, sf_dir)


@query(
    "run_status",
    f"""{STATES} SELECT count(*) FILTER (state = 'success') AS succeeded, count(*) FILTER (state = 'failed') AS failed,
            count(*) FILTER (state = 'skipped') AS skipped,
            CASE WHEN count(*) FILTER (state <> 'success') > 0 THEN 'partial' ELSE 'success' END AS status FROM s""",
)
def run_status_query(spark, sf_dir):
    return run_status(states(spark, sf_dir))
