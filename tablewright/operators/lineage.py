"""Questions about a dependency graph held as an edge table (upstream, downstream).

Every answer is a loop of joins that carries only the nodes new in the last round and
writes each round to the shared scratch folder. State is linear in nodes and edges; only
:func:`reachable_pairs` produces pairs, because pairs are what it is asked for. Of what is
written only the answer stays, as one table.

Long ways cost few jobs. Walks take ``HOPS`` steps before they look up what they have seen. Through
nodes with one parent each, as in trees and chains, every node's pointer is doubled: to its parent's
parent, then the fourth ancestor, the eighth and so on, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..scratch import Rounds, discarding_stages, staged
from .merge import own_shuffle

UP, DOWN = "upstream", "downstream"
#: Steps of a walk in one job.
HOPS = 3


class CycleFound(ValueError):
    """The graph has a cycle where an order was asked for."""


def _answer(question: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write the answer once and remove what was written on the way to it."""

    @wraps(question)
    def ask(edges: DataFrame, *args, **kwargs) -> DataFrame:
        with discarding_stages(edges.sparkSession):
            return staged(question(edges, *args, **kwargs), "answer", keep=True)

    return ask


def _links(edges: DataFrame, direction: str = DOWN) -> DataFrame:
    """Distinct edges, written once, pointing the way the walk goes (``near`` to ``far``)."""
    if direction not in (UP, DOWN):
        raise ValueError(f"direction {direction!r} is neither {UP!r} nor {DOWN!r}")
    near, far = (UP, DOWN) if direction == DOWN else (DOWN, UP)
    return staged(edges.select(F.col(near).alias("near"), F.col(far).alias("far")).distinct(), "edges")


def _dealt(df: DataFrame) -> DataFrame:
    """For the side of a join that grows with the graph: both sides are shuffled. A walk's next steps
    look large to the planner, which would send the links to the driver, once a step, instead."""
    return df.hint("merge")


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("near").alias("node")).union(links.select(F.col("far").alias("node"))).distinct()


def _schema(links: DataFrame, **extra) -> StructType:
    kind = links.schema["near"].dataType
    return StructType(
        [StructField("node", kind)] + [StructField(n, kind if t is None else t) for n, t in extra.items()]
    )


@_answer
def reachable_nodes(edges: DataFrame, roots: DataFrame, direction: str = DOWN) -> DataFrame:
    """Distinct nodes reached from any root by at least one edge.

    ``roots`` has one column. A root is in the result only if another path leads to it.
    """
    links = _links(edges, direction)
    rounds = Rounds(links.sparkSession, "reach", _schema(links))
    start = own_shuffle(roots.toDF("node").distinct())

    def steps(frontier: DataFrame) -> DataFrame:
        reached = []
        for _ in range(HOPS):
            frontier = _dealt(links).join(frontier, F.col("near") == F.col("node")).select(F.col("far").alias("node")).distinct()
            reached.append(frontier)
        return reduce(DataFrame.union, reached).distinct()

    frontier = rounds.add(steps(start))
    while rounds.new:
        frontier = rounds.add(steps(frontier).join(_dealt(rounds.all()), ["node"], "left_anti"))
    return rounds.all()


@_answer
def reachable_pairs(edges: DataFrame, roots: DataFrame | None = None, direction: str = DOWN) -> DataFrame:
    """(root, node) for every node reached from each root, the root itself left out.

    Without ``roots`` this is the whole transitive closure, whose size is the answer's own.
    """
    links = _links(edges, direction)
    rounds = Rounds(links.sparkSession, "closure", _schema(links, root=None))
    first = links.select(F.col("far").alias("node"), F.col("near").alias("root"))
    if roots is not None:
        first = first.join(roots.toDF("root").distinct(), ["root"], "left_semi").select("node", "root")
    frontier = rounds.add(first)
    while rounds.new:
        reached = []
        for _ in range(HOPS):
            frontier = (
                frontier.join(_dealt(links), F.col("node") == F.col("near"))
                .select(F.col("far").alias("node"), "root")
                .distinct()
            )
            reached.append(frontier)
        steps = reduce(DataFrame.union, reached).distinct()
        frontier = rounds.add(steps.join(_dealt(rounds.all()), ["node", "root"], "left_anti"))
    return rounds.all().filter(F.col("node") != F.col("root")).select("root", "node")


def _jumps(parents: DataFrame) -> list[DataFrame]:
    """Tables (node, to, steps, done), the k-th pointing every node at its ancestor 2**k steps up.

    ``parents`` (node, to) has every node once. Where fewer ancestors are left a pointer stops at the
    last, which has no parent itself, and the node is done. Nodes on or behind a cycle never are;
    doubling ends when a round settles none.
    """
    schema = StructType([*parents.select("node", "to").schema.fields, StructField("steps", LongType()), StructField("done", BooleanType())])
    rounds = Rounds(parents.sparkSession, "jumps", schema)
    one, undone = F.lit(1).cast("bigint"), None
    tables = [rounds.add(parents.select("node", "to", one.alias("steps"), F.lit(False).alias("done")), counting=~F.col("done"))]
    while rounds.new and rounds.new != undone:
        undone, now = rounds.new, tables[-1]
        further = now.select(F.col("node").alias("via"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        met = now.join(further, F.col("to") == F.col("via"), "left")
        ended = F.col("via").isNull()
        steps = F.col("steps") + F.coalesce("more", F.lit(0))
        tables.append(
            rounds.add(met.select("node", F.coalesce("beyond", "to").alias("to"), steps.alias("steps"), ended.alias("done")), counting=~F.col("done"))
        )
    return tables


def _ancestors(tables: list[DataFrame], start: DataFrame) -> DataFrame:
    """Distinct nodes of ``start`` (node) and all their ancestors that have a parent, by the
    tables of :func:`_jumps`: every round doubles how far up is known."""
    found = start.select("node").distinct()
    if start.isEmpty():
        return found
    for table in tables:
        up = table.join(own_shuffle(found), ["node"], "left_semi").select(F.col("to").alias("node"))
        found = staged(found.union(up).distinct(), "ancestors")
    known = tables[0].select("node")
    return found.join(known, ["node"], "left_semi")


def _single_parents(links: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, to) of nodes with exactly one parent, and (near, far, parents) of the other edges.

    Nodes of ``roots`` (node) count as having several.
    """
    n = links.groupBy(F.col("far").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    counted = links.join(own_shuffle(n), links.far == n.node).select("near", "far", "parents")
    if roots is not None:
        forced = roots.select(F.col("node").alias("root"))
        counted = counted.join(forced, F.col("far") == F.col("root"), "left").select(
            "near", "far", F.when(F.col("root").isNull(), F.col("parents")).otherwise(F.lit(2).cast("bigint")).alias("parents")
        )
    counted = staged(counted, "counted")
    return counted.filter("parents = 1").select(F.col("far").alias("node"), F.col("near").alias("to")), counted.filter("parents > 1")


def _contracted(joins: DataFrame, settled: DataFrame) -> DataFrame:
    """(near, far, weight, via): an edge for every edge of ``joins``, from the last ancestor of its
    start that has not one parent; ``via`` is the start itself. NULL for a start on or behind a cycle."""
    above = settled.select("node", F.col("to").alias("top"), "steps", "done")
    met = joins.join(above, joins.near == above.node, "left")
    top = F.when(F.col("node").isNull(), F.col("near")).when(F.col("done"), F.col("top"))
    return met.select(top.alias("near"), "far", (F.coalesce("steps", F.lit(0)) + 1).alias("weight"), F.col("near").alias("via"))


def _peel(links: DataFrame) -> DataFrame:
    """(node, level) of all nodes that do not lie on or behind a cycle.

    Level 1 waits for nothing; a node's level is one more than its deepest parent's. Nodes with one parent
    take theirs from the nearest ancestor that has none or several, found by doubling pointers. Among
    those, a round follows the edges of the nodes that just became ready and adds up, per node reached,
    how many of its parents are; each edge is followed once. Nodes still waiting are carried on.
    """
    schema = _schema(links, ready=LongType(), parents=LongType(), done=BooleanType(), level=LongType())
    single, joins = _single_parents(links)
    settled = _jumps(single)[-1]
    edges = _contracted(joins, settled).groupBy("near", "far").agg(F.max("weight").alias("weight"))
    waits_for = own_shuffle(edges.groupBy(F.col("far").alias("node")).agg(F.count(F.lit(1)).alias("parents")))
    counted = staged(edges.join(waits_for, F.col("far") == F.col("node")).select("near", "far", "weight", "parents"), "contracted")

    rounds = Rounds(links.sparkSession, "levels", schema)
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sources = links.select(F.col("near").alias("node")).distinct().join(links.select(F.col("far").alias("node")).distinct(), ["node"], "left_anti")
    frontier = rounds.add(
        sources.select("node", none.alias("ready"), none.alias("parents"), F.lit(True).alias("done"), one.alias("level")), counting=F.col("done")
    )
    more = not counted.isEmpty()
    while more and rounds.new:
        done = frontier.filter("done").select("node", "level")
        reached = counted.join(done, counted.near == done.node).select(
            F.col("far").alias("node"), one.alias("ready"), "parents", (F.col("level") + F.col("weight")).alias("level")
        )
        waiting = frontier.filter("NOT done").select("node", "ready", "parents", "level")
        totals = (
            reached.unionByName(waiting)
            .groupBy("node")
            .agg(F.sum("ready").alias("ready"), F.max("parents").alias("parents"), F.max("level").alias("level"))
        )
        frontier = rounds.add(
            totals.select("node", "ready", "parents", (F.col("ready") == F.col("parents")).alias("done"), "level"), counting=F.col("done")
        )
    tops = rounds.all().filter("done").select("node", "level")
    below = settled.filter("done").join(tops.withColumnRenamed("node", "top"), F.col("to") == F.col("top"))
    levels = tops.union(below.select("node", F.col("level") + F.col("steps")))
    return levels.select("node", F.col("level").cast("int").alias("level"))


@_answer
def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): nodes of one level depend only on lower levels and may run together."""
    links = _links(edges)
    levels = staged(_peel(links), "peeled")
    stuck = _nodes(links).join(levels, ["node"], "left_anti")
    if not stuck.isEmpty():
        raise CycleFound("the graph has a cycle; cycle_path() names one")
    return levels


def topological_order(edges: DataFrame) -> DataFrame:
    """Nodes upstream first, by name within a level."""
    return topological_levels(edges).orderBy("level", "node")


def _core(links: DataFrame) -> DataFrame:
    """Edges left after peeling from both ends: cycles and the paths between them."""
    ahead = _peel(links).select(F.col("node").alias("near"))
    links = staged(links.join(ahead, ["near"], "left_anti").select("near", "far"), "core")
    if links.isEmpty():
        return links
    flipped = links.select(F.col("far").alias("near"), F.col("near").alias("far"))
    behind = _peel(flipped).select(F.col("node").alias("far"))
    return staged(links.join(behind, ["far"], "left_anti").select("near", "far"), "core")


def _colours(core: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches it, itself included."""
    rounds = Rounds(core.sparkSession, "colours", _schema(core, colour=None))
    changed = rounds.add(_nodes(core).select("node", F.col("node").alias("colour")))
    while rounds.new:
        offers, offered = [], changed
        for _ in range(HOPS):
            offered = (
                core.join(offered, core.near == offered.node)
                .groupBy(F.col("far").alias("node"))
                .agg(F.max("colour").alias("colour"))
            )
            offers.append(offered)
        offered = reduce(DataFrame.union, offers).groupBy("node").agg(F.max("colour").alias("colour"))
        known = rounds.all().groupBy("node").agg(F.max("colour").alias("known"))
        changed = rounds.add(
            offered.join(known, ["node"]).filter(F.col("colour") > F.col("known")).select("node", "colour")
        )
    return staged(rounds.all().groupBy("node").agg(F.max("colour").alias("colour")), "coloured")


def _settled_components(core: DataFrame) -> DataFrame:
    """(node, colour) of the strongly connected component around each colour's own node."""
    coloured = _colours(core)
    rounds = Rounds(core.sparkSession, "components", _schema(core, colour=None))
    frontier = rounds.add(coloured.filter(F.col("node") == F.col("colour")).select("node", "colour"))
    while rounds.new:
        back = (
            core.join(frontier, core.far == frontier.node)
            .select(F.col("near").alias("node"), "colour")
            .distinct()
            .join(coloured, ["node", "colour"], "left_semi")
        )
        frontier = rounds.add(back.join(rounds.all(), ["node", "colour"], "left_anti"))
    return rounds.all()


def _components(links: DataFrame) -> DataFrame:
    """(node, colour): the strongly connected component of every node that may lie on a cycle.

    Propagates the greatest node forwards and walks back inside each colour; what that settles leaves.
    """
    core, found = staged(links, "core"), None
    while not core.isEmpty():
        settled = staged(_settled_components(core), "members")
        found = settled if found is None else found.union(settled)
        rest = core.join(settled.select(F.col("node").alias("near")), ["near"], "left_anti")
        rest = rest.join(settled.select(F.col("node").alias("far")), ["far"], "left_anti")
        rest = staged(rest.select("near", "far"), "rest")
        core = rest if rest.isEmpty() else _core(rest)
    return _nodes(links).select("node", F.col("node").alias("colour")).limit(0) if found is None else found


def _rings(table: DataFrame) -> DataFrame:
    """Nodes on a cycle of nodes with one parent each, from the pointers that never end.

    Where they point after ever more steps are ever fewer nodes, until only those on cycles are left.
    """
    now, size = staged(table.filter("NOT done").select("node", "to"), "ring"), None
    while True:
        ends = now.select(F.col("to").alias("node")).distinct()
        if size == (size := ends.count()):
            return ends
        further = now.select(F.col("node").alias("via"), F.col("to").alias("beyond"))
        now = staged(now.join(further, F.col("to") == F.col("via")).select("node", F.col("beyond").alias("to")), "ring")


def _on_cycles(links: DataFrame) -> DataFrame:
    core = _core(links)
    if core.isEmpty():
        return core.select(F.col("near").alias("node"))
    # a stretch of nodes with one parent each is one edge from its top
    single, joins = _single_parents(core)
    tables = _jumps(single)
    hops = staged(_contracted(joins, tables[-1]).filter("near is not null"), "hops")
    of = _components(hops.select("near", "far").distinct())
    start, end = of.toDF("near", "from"), of.toDF("far", "into")
    inner = hops.join(start, ["near"]).join(end, ["far"]).filter(F.col("from") == F.col("into"))
    inner = staged(inner.select("near", "via"), "inner")
    stretches = _ancestors(tables, inner.select(F.col("via").alias("node")))
    return inner.select(F.col("near").alias("node")).union(stretches).union(_rings(tables[-1])).distinct()


@_answer
def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes that lie on a cycle (can reach themselves).

    Peels what cannot be on a cycle, contracts stretches of nodes with one parent, then finds strongly
    connected components by propagating the greatest node forwards and walking back inside each
    colour. No node pairs are formed, so a large component stays linear.
    """
    return _on_cycles(_links(edges))


@_answer
def cycle_path(edges: DataFrame) -> DataFrame:
    """(position, node): one cycle in order, from the least node that lies on any back to it.

    Each node and the next are an edge. No rows if there is no cycle. Of the ways back one with
    the fewest nodes of several parents is taken, then one of least length.

    Stretches of nodes with one parent are contracted by doubling pointers; a breadth-first walk over the rest
    notes every node's parent until it meets the start again. The parents lead back from there, and
    the pointers unfold the stretches, both by doubling as well.
    """
    links = _links(edges)
    on = staged(_on_cycles(links), "on")
    start = staged(on.agg(F.min("node").alias("node")).filter("node is not null"), "start")
    inner = links.join(on.toDF("near"), ["near"], "left_semi").join(on.toDF("far"), ["far"], "left_semi")
    inner = staged(inner.select("near", "far"), "inner")

    single, joins = _single_parents(inner, roots=start)
    tables = _jumps(single)
    hops = staged(_contracted(joins, tables[-1]).filter("near is not null"), "hops")
    kind = links.schema["near"].dataType
    schema = _schema(links, parent=None, via=None, weight=LongType(), length=LongType())
    rounds = Rounds(links.sparkSession, "walk", schema)
    none = F.lit(None).cast(kind)
    zero = F.lit(0).cast("bigint")
    frontier = rounds.add(start.select("node", none.alias("parent"), none.alias("via"), zero.alias("weight"), zero.alias("length")))
    back = None
    while rounds.new and (back is None or back.isEmpty()):
        reached = hops.join(frontier, hops.near == frontier.node).select(
            F.col("far").alias("node"), F.col("near").alias("parent"), hops.via, hops.weight, (F.col("length") + hops.weight).alias("length")
        )
        order = F.struct("length", "parent", "via", "weight")
        best = reached.groupBy("node").agg(F.min(order).alias("best")).select("node", "best.parent", "best.via", "best.weight", "best.length")
        best = staged(best, "reached")
        back = best.join(start, ["node"], "left_semi")
        frontier = rounds.add(best.join(rounds.all().select("node"), ["node"], "left_anti"))
    if back is None:
        return start.select(F.lit(0).cast("bigint").alias("position"), "node").limit(0)

    # the walk's parents, from the last node before the start
    walked = rounds.all().filter("parent is not null")
    ups = _jumps(walked.select("node", F.col("parent").alias("to")))
    passed = _ancestors(ups, back.select(F.col("parent").alias("node")))
    taken = walked.join(own_shuffle(passed), ["node"], "left_semi").select("via", "weight", "length")
    taken = staged(taken.union(back.select("via", "weight", "length")), "taken")  # the hops of the cycle

    # a hop runs from its top down to ``via``; every node on it lies above ``via``, at the steps its pointers count
    between = _ancestors(tables, taken.select(F.col("via").alias("node")))
    places = tables[-1].join(own_shuffle(between), ["node"], "left_semi").select("node", F.col("to").alias("top"), "steps")
    hop_of = taken.select((F.col("length") - F.col("weight")).alias("from"), "via")
    tops = tables[-1].select("node", F.col("to").alias("top"))
    hop_of = hop_of.join(tops, hop_of.via == tops.node, "left").select("from", F.coalesce("top", "via").alias("top"))
    firsts = hop_of.select(F.col("from").alias("position"), F.col("top").alias("node"))
    inside = places.join(hop_of, ["top"]).select((F.col("from") + F.col("steps")).alias("position"), "node")
    last = back.select(F.col("length").alias("position"), "node")
    return firsts.union(inside).union(last)


def downstream_subgraph(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct edges among the roots and everything below them.

    An edge that starts inside ends inside, so one semi join on its start is enough.
    """
    inside = own_shuffle(reachable_nodes(edges, roots).union(roots.toDF("node")).distinct())
    return edges.select(UP, DOWN).distinct().join(_dealt(inside.toDF(UP)), [UP], "left_semi").select(UP, DOWN)


def propagate_failures(edges: DataFrame, outcomes: DataFrame, failed: Column) -> DataFrame:
    """(node, state) for every node of ``outcomes``: failed, skipped or success.

    A node below any failed one never runs, so it counts as skipped even if it would have
    failed itself. ``outcomes`` has a ``node`` column; ``failed`` is a predicate on it.
    """
    broken = outcomes.filter(failed).select("node")
    skipped = reachable_nodes(edges, broken).withColumn("below", F.lit(True))
    return outcomes.join(skipped, ["node"], "left").select(
        "node",
        F.when(F.col("below"), F.lit("skipped")).when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("state"),
    )


def run_status(states: DataFrame) -> DataFrame:
    """One row: counts per state and the overall status, partial unless all succeeded."""
    return states.agg(
        F.count_if(F.col("state") == "success").alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.when(F.count_if(F.col("state") != "success") > 0, F.lit("partial")).otherwise(F.lit("success")).alias("status"),
    )
