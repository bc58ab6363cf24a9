import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import (
    CycleFound,
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
from tablewright.operators import lineage

DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "b")]


def graph(spark, edges, kind="string"):
    return spark.createDataFrame(list(edges), f"upstream {kind}, downstream {kind}")


def names(spark, *nodes, kind="string"):
    return spark.createDataFrame([(n,) for n in nodes], f"node {kind}")


def test_reachability_both_ways(spark):
    edges = graph(spark, DIAMOND)
    assert rows(reachable_nodes(edges, names(spark, "b"))) == [("d",), ("e",)]
    assert rows(reachable_nodes(edges, names(spark, "d"), "upstream")) == [("a",), ("b",), ("c",)]
    assert rows(reachable_nodes(edges, names(spark, "nowhere"))) == []
    pairs = reachable_pairs(edges, names(spark, "a", "c"))
    assert rows(pairs) == [("a", n) for n in "bcde"] + [("c", "d"), ("c", "e")]
    assert reachable_pairs(edges).count() == 9
    with pytest.raises(ValueError):
        reachable_nodes(edges, names(spark, "a"), "sideways")


def test_levels_and_order(spark):
    edges = graph(spark, DIAMOND)
    assert rows(topological_levels(edges), "level", "node") == [(1, "a"), (2, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert [r.node for r in topological_order(edges).collect()] == list("abcde")
    # a long way and a short cut: the level is that of the long way
    cut = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "d")])
    assert rows(topological_levels(cut), "level", "node") == [(1, "a"), (1, "x"), (2, "b"), (3, "c"), (4, "d")]


def test_cycles(spark):
    loop = graph(spark, DIAMOND + [("e", "b"), ("z", "z"), ("e", "tail"), ("head", "a")])
    assert rows(cycle_nodes(loop)) == [("b",), ("d",), ("e",), ("z",)]
    with pytest.raises(CycleFound):
        topological_levels(loop)
    assert rows(cycle_nodes(graph(spark, DIAMOND))) == []
    assert rows(topological_levels(graph(spark, [])), "node") == []


def check_path(df, edges):
    """The rows form one simple cycle of ``edges``, from the least node on any."""
    found = cycle_path(df).orderBy("position").collect()
    path = [r["node"] for r in found]
    assert [r["position"] for r in found] == list(range(len(path)))
    on = {a for a, b in closure(edges) if a == b}
    if not on:
        assert path == []
        return path
    assert path[0] == path[-1] == min(on) and len(set(path)) == len(path) - 1
    assert set(zip(path, path[1:], strict=False)) <= set(edges)
    return path


def test_cycle_path(spark):
    tail = [("e", "tail"), ("head", "a"), ("z", "z")]
    assert check_path(graph(spark, DIAMOND + [("e", "b"), *tail]), DIAMOND + [("e", "b"), *tail]) == ["b", "d", "e", "b"]
    ring = [(k, (k + 1) % 9) for k in range(9)] + [(20, 21), (21, 20), (8, 20)]
    assert check_path(graph(spark, ring, "int"), ring) == [*range(9), 0]
    assert check_path(graph(spark, [("a", "a"), ("a", "b")]), [("a", "a")]) == ["a", "a"]
    assert check_path(graph(spark, DIAMOND), DIAMOND) == []


def test_cycle_path_of_a_random_graph(spark):
    pick = random.Random(1)
    edges = {(pick.randrange(30), pick.randrange(30)) for _ in range(36)}
    edges |= {(100 + k, 101 + k) for k in range(20)} | {(3, 100), (120, 3)}  # a long stretch with one parent each
    check_path(graph(spark, edges, "int"), edges)


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    """2,000 nodes in a row, and a cycle of as many: rounds grow with the logarithm."""
    rounds, add = [], lineage.Rounds.add
    monkeypatch.setattr(lineage.Rounds, "add", lambda self, *a, **k: rounds.append(1) or add(self, *a, **k))
    n = 2_000
    chain = spark.range(n).select(F.col("id").alias("upstream"), (F.col("id") + 1).alias("downstream"))
    levels = {r["node"]: r["level"] for r in topological_levels(chain).collect()}
    assert levels == {k: k + 1 for k in range(n + 1)} and len(rounds) < 20
    looped = chain.union(spark.createDataFrame([(n, 0)], "upstream long, downstream long"))
    assert [r["node"] for r in cycle_path(looped).orderBy("position").collect()] == [*range(n + 1), 0]
    assert len(rounds) < 60


def test_levels_through_joins_and_stretches(spark):
    """A ladder: stretches of different length that meet again and again."""
    edges, top = set(), 0
    for k in range(5):
        below = top + 100
        for length in (1, 3 + k):
            path = [top, *[top + 10 * length + j for j in range(length)], below]
            edges |= set(zip(path, path[1:], strict=False))
        top = below
    level = {}
    for node in sorted({n for e in edges for n in e}):
        level[node] = 1 + max((level[a] for a, b in edges if b == node), default=0)
    assert rows(topological_levels(graph(spark, edges, "int"))) == sorted(level.items())


def test_subgraph(spark):
    edges = graph(spark, DIAMOND)
    assert rows(downstream_subgraph(edges, names(spark, "b"))) == [("b", "d"), ("d", "e")]


def test_failures_propagate_and_a_skipped_node_does_not_fail(spark):
    edges = graph(spark, DIAMOND)
    outcomes = spark.createDataFrame([(n, n in "bd") for n in "abcdex"], "node string, failed boolean")
    states = propagate_failures(edges, outcomes, F.col("failed"))
    assert rows(states) == [
        ("a", "success"), ("b", "failed"), ("c", "success"), ("d", "skipped"), ("e", "skipped"), ("x", "success"),
    ]
    assert rows(run_status(states)) == [(3, 1, 2, "partial")]
    fine = propagate_failures(edges, outcomes, F.lit(False))
    assert rows(run_status(fine)) == [(6, 0, 0, "success")]


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for root in {a for a, _ in edges}:
        todo, seen = list(out[root]), set()
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += out.get(node, ())
        found |= {(root, n) for n in seen}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pick = random.Random(seed)
    edges = {(pick.randrange(25), pick.randrange(25)) for _ in range(30)} | {(3, n) for n in range(20)}  # 3 is a hub
    expected = closure(edges)
    df = graph(spark, edges, "int")
    assert set(rows(reachable_pairs(df))) == {(a, b) for a, b in expected if a != b}
    assert rows(cycle_nodes(df)) == sorted((a,) for a, b in expected if a == b)

    order = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    level = {}
    for node in sorted({n for e in order for n in e}):
        level[node] = 1 + max((level[a] for a, b in order if b == node), default=0)
    assert rows(topological_levels(graph(spark, order, "int"))) == sorted(level.items())


def test_only_the_answer_stays_in_the_shared_folder(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    folders = lambda: {f.name for f in shared.iterdir() if f.is_dir()}
    edges, looped = graph(spark, DIAMOND), graph(spark, [*DIAMOND, ("e", "b")])
    questions = [
        lambda: reachable_nodes(edges, names(spark, "a")),
        lambda: reachable_pairs(edges, names(spark, "a")),
        lambda: topological_levels(edges),
        lambda: cycle_nodes(looped),
        lambda: downstream_subgraph(edges, names(spark, "b")),
    ]
    for ask in questions:
        before = folders()
        found = ask()
        left = folders() - before
        assert len(left) == 1 and left.pop().startswith("answer-")
        assert found.count() > 0
    before = folders()
    with pytest.raises(CycleFound):
        topological_levels(looped)
    assert folders() == before


def test_a_hub_is_split(skewed_edges):
    from tablewright.operators.lineage import _links

    spark, edges = skewed_edges
    links = _links(edges)
    frontier = spark.range(2_000).select(F.col("id").alias("node"))
    step = links.join(frontier, links.near == frontier.node).select(F.col("far").alias("node"))
    step.collect()
    assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed_edges(spark):
    """A hub with most of the edges, no broadcasts, and a low bar for what counts as skewed."""
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
    hub = F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id") % 2_000)
    yield spark, spark.range(0, 60_000, 1, 8).select(hub.cast("bigint").alias("upstream"), F.sha2(F.col("id").cast("string"), 256).alias("downstream"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def planned_rounds(spark, monkeypatch, ask):
    """The plans of a walk's rounds after the first."""
    plans, add = [], lineage.Rounds.add

    def noting(self, df, *more, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(self, df, *more, **options)

    monkeypatch.setattr(lineage.Rounds, "add", noting)
    links = spark.range(1, 3_000).selectExpr("id DIV 2 AS upstream", "id AS downstream")
    count = ask(links, spark.sql("SELECT 2999L AS node"), direction="upstream").count()
    return count, plans[1:]


def test_links_and_pairs_found_do_not_go_through_the_driver(spark, monkeypatch):
    count, plans = planned_rounds(spark, monkeypatch, lineage.reachable_pairs)
    assert count == 12 and plans and not any("Broadcast" in p for p in plans)


def test_links_and_nodes_found_do_not_go_through_the_driver(spark, monkeypatch):
    count, plans = planned_rounds(spark, monkeypatch, reachable_nodes)
    assert count == 12 and plans and not any("Broadcast" in p for p in plans)
