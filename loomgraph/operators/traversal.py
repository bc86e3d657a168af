"""Distances, components by direction, orders and peelings: rounds of joins from a frontier.

Every round is written to the shared folder, so its lineage is short and only the nodes that changed are joined again.
Distances that don't exist are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators.components import star_components
from loomgraph.scratch import materialize


def _arcs(g: PropertyGraph, reverse: bool) -> DataFrame:
    a = g.arcs()
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") if reverse and g.directed else a


def bfs_from(g: PropertyGraph, sources: DataFrame, reverse: bool = False, max_depth: int | None = None) -> DataFrame:
    """``(source, id, distance)`` of all that is reached from each of ``sources (id)``, in steps."""
    arcs = materialize(_arcs(g, reverse).select("src", "dst").distinct(), "bfs-arcs")
    frontier = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct(), "bfs")
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.select("source", F.col("id").alias("src")).join(arcs, "src").select("source", F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(depth)), "bfs")
        seen = seen.unionByName(frontier)
    return seen


def multi_source_bfs(g: PropertyGraph, sources: DataFrame, reverse: bool = False) -> DataFrame:
    """``(id, distance)`` of all that is reached, in steps from the nearest of the sources."""
    one = PropertyGraph(g.vertices, g.edges.withColumn("w", F.lit(1.0)), g.directed)
    arcs = materialize(_arcs(one, reverse).select("src", "dst").distinct(), "bfs-arcs")
    seen = frontier = materialize(sources.select("id", F.lit(0).alias("distance")).distinct(), "bfs")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select(F.col("id").alias("src")).join(arcs, "src").select(F.col("dst").alias("id")).distinct()
        both = materialize(seen.join(step.withColumn("new", F.lit(True)), "id", "full").select("id", F.coalesce("distance", F.lit(depth)).alias("distance")), "bfs")
        frontier, seen = both.where(F.col("distance") == depth), both
    return seen


def bfs(g: PropertyGraph, source: int, reverse: bool = False, max_depth: int | None = None) -> DataFrame:
    """``(id, distance)`` for every node."""
    found = bfs_from(g, g.vertices.where(F.col("id") == source), reverse, max_depth)
    return g.vertices.select("id").join(found.select("id", "distance"), "id", "left")


def shortest_from(g: PropertyGraph, sources: DataFrame, reverse: bool = False) -> DataFrame:
    """``(source, id, distance)`` by weight, of all that is reached.  Raises ValueError on a negative weight."""
    arcs = materialize(_arcs(g, reverse).groupBy("src", "dst").agg(F.min("w").alias("w")), "sssp-arcs")
    if not arcs.where("w < 0").isEmpty():
        raise ValueError("a weight is negative")
    best = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")).distinct(), "sssp")
    frontier = best
    while not frontier.isEmpty():
        step = frontier.select("source", F.col("id").alias("src"), "distance").join(arcs, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        both = materialize(best.join(step, ["source", "id"], "full").select("source", "id", "distance", "new"), "sssp")
        better = F.col("distance").isNull() | (F.col("new") < F.col("distance"))
        frontier = both.where(better & F.col("new").isNotNull()).select("source", "id", F.col("new").alias("distance"))
        best = both.select("source", "id", F.least("distance", "new").alias("distance"))
    return best


def dijkstra(g: PropertyGraph, source: int, reverse: bool = False) -> DataFrame:
    """``(id, distance)`` for every node, by weight."""
    found = shortest_from(g, g.vertices.where(F.col("id") == source), reverse)
    return g.vertices.select("id").join(found.select("id", "distance"), "id", "left")


def shortest_paths(g: PropertyGraph, source: int) -> DataFrame:
    """``(target, nodeIds, costs)``: one shortest path to each node that is reached, the one over the smallest
    predecessors, with the costs up to each node."""
    d = materialize(dijkstra(g, source).where("distance is not null"), "paths-d")
    arcs = g.arcs().groupBy("src", "dst").agg(F.min("w").alias("w"))
    tight = arcs.join(d.select(F.col("id").alias("src"), F.col("distance").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("distance").alias("b")), "dst").where((F.col("a") + F.col("w") == F.col("b")) & (F.col("dst") != source) & (F.col("src") != F.col("dst")))
    # Steps of no weight could lead in a circle: such a predecessor must be nearer in steps.
    hops = materialize(bfs_from(PropertyGraph(d.select("id"), tight.select("src", "dst", "w"), True), d.where(F.col("id") == source).select("id")).select("id", F.col("distance").alias("h")), "paths-h")
    tight = tight.join(hops.select(F.col("id").alias("src"), F.col("h").alias("hs")), "src").join(hops.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst").where("hs + 1 = hd")
    parent = materialize(tight.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(d, "id"), "paths-parent")
    frontier = materialize(d.where(F.col("id") == source).select(F.col("id").alias("target"), F.array("id").alias("nodeIds"), F.array("distance").alias("costs")), "paths")
    out = frontier
    while not frontier.isEmpty():
        step = frontier.join(parent, F.col("target") == F.col("parent")).select(F.col("id").alias("target"), F.concat("nodeIds", F.array("id")).alias("nodeIds"), F.concat("costs", F.array("distance")).alias("costs"))
        frontier = materialize(step, "paths")
        out = out.unionByName(frontier)
    return out


def all_simple_paths(g: PropertyGraph, source: int, target: int, cutoff: int) -> DataFrame:
    """``(path)``: all paths without repeated nodes of at most ``cutoff`` steps; nodes from which the target is out of
    reach in the steps that are left are never entered."""
    near = materialize(bfs(g, target, reverse=True, max_depth=cutoff).where("distance is not null").select("id", "distance"), "simple-d")
    arcs = g.arcs().select("src", "dst").distinct().join(near.select(F.col("id").alias("dst"), F.col("distance").alias("left")), "dst")
    paths = g.vertices.where(F.col("id") == source).select(F.array("id").alias("path"))
    done = paths.where(F.lit(source == target))
    for step in range(1, cutoff + 1):
        at = paths.where(F.element_at("path", -1) != target) if source != target or step > 1 else paths
        grown = at.join(arcs, F.element_at("path", -1) == F.col("src")).where((F.col("left") <= cutoff - step) & ~F.array_contains("path", F.col("dst")))
        paths = materialize(grown.select(F.concat("path", F.array("dst")).alias("path")), "simple")
        done = done.unionByName(paths.where(F.element_at("path", -1) == target))
    return done


def reachable_counts(g: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """``(id, reachable)``, the node itself included; for an undirected graph from the sizes of components."""
    if g.directed:
        return bfs_from(g, g.vertices if sources is None else sources).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("reachable"))
    c = components(g)
    return c.join(c.groupBy("component").agg(F.count("*").alias("reachable")), "component").select("id", "reachable")


def components(g: PropertyGraph) -> DataFrame:
    """``(id, component)``: connected, or for directed graphs weakly connected, named by the smallest node."""
    found = star_components(g.edges, "src", "dst")
    return g.vertices.select("id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame, column: str = "component") -> DataFrame:
    return labels.groupBy(column).agg(F.count("*").alias("size"))


def largest_component(g: PropertyGraph) -> PropertyGraph:
    """The subgraph of the component with the most nodes, of equals the one with the smallest name."""
    from loomgraph.operators.tools import subgraph

    c = materialize(components(g), "largest")
    best = component_sizes(c).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    return subgraph(g, c.join(F.broadcast(best), "component", "left_semi").select("id"))


def strong_components(g: PropertyGraph) -> DataFrame:
    """``(id, component)`` of a directed graph, named by the smallest node.

    Nodes without edges in or out among those left are components of their own and go.  Of what is left every node takes
    the smallest id that reaches it; those that reach such a root back within its colour are its component."""
    left = materialize(g.edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    nodes = materialize(g.vertices.select("id"), "scc-nodes")
    done: list[DataFrame] = []
    while True:
        trimmed = True
        while trimmed:
            inner = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            alone = nodes.join(inner, "id", "left_anti")
            done.append(alone.select("id", F.col("id").alias("component")))
            nodes = materialize(nodes.join(inner, "id", "left_semi"), "scc-nodes")
            keep = nodes.select("id")
            before = left
            left = materialize(left.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
            trimmed = before.count() != left.count()
        if nodes.isEmpty():
            break
        colour = nodes.select("id", F.col("id").alias("c"))
        changed = True
        while changed:
            into = left.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = materialize(colour.join(into, "id", "left").select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("x")), "scc-colour")
            changed = not new.where("x").isEmpty()
            colour = new.select("id", "c")
        same = left.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("k")), "dst").where("c = k").select("src", "dst", "c")
        same = materialize(same, "scc-same")
        found = frontier = materialize(colour.where("id = c"), "scc-found")
        while not frontier.isEmpty():
            step = same.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "c").distinct()
            frontier = materialize(step.join(found, "id", "left_anti"), "scc-found")
            found = found.unionByName(frontier)
        done.append(found.select("id", F.col("c").alias("component")))
        nodes = materialize(nodes.join(found, "id", "left_anti"), "scc-nodes")
        keep = nodes.select("id")
        left = materialize(left.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def core_numbers(g: PropertyGraph) -> DataFrame:
    """``(id, core)``: the largest k for which the node is in a subgraph where all have k neighbours.

    Each round a node lowers its bound to the h-index of its neighbours' bounds; the bounds settle on the core numbers.
    Raises ValueError where the graph has loops."""
    if not g.edges.where("src = dst").isEmpty():
        raise ValueError("the graph has loops")
    arcs = materialize(g.arcs().select("src", "dst").distinct(), "core-arcs")
    bound = materialize(g.vertices.select("id").join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")), "id", "left").na.fill(0), "core")
    while True:
        # Counting neighbours by bound first keeps a hub's rows few.
        by = arcs.join(bound.select(F.col("id").alias("dst"), F.col("core").alias("b")), "dst").join(bound.select(F.col("id").alias("src"), F.col("core").alias("own")), "src")
        by = by.groupBy("src", F.least("b", "own").alias("b")).agg(F.count("*").alias("n"))
        down = Window.partitionBy("src").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
        h = by.select("src", F.least(F.col("b"), F.sum("n").over(down)).alias("h")).groupBy(F.col("src").alias("id")).agg(F.max("h").alias("h"))
        new = materialize(bound.join(h, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0).cast("long"))).alias("core"), (F.coalesce("h", F.lit(0).cast("long")) < F.col("core")).alias("x")), "core")
        bound = new.select("id", "core")
        if new.where("x").isEmpty():
            return bound


def topological_levels(g: PropertyGraph) -> DataFrame:
    """``(id, level)``: the longest way to a node from one without edges in; raises ValueError on a cycle."""
    left = materialize(g.edges.select("src", "dst").distinct(), "topo")
    nodes, level, out = materialize(g.vertices.select("id"), "topo-nodes"), 0, None
    while not nodes.isEmpty():
        free = materialize(nodes.join(left.select(F.col("dst").alias("id")), "id", "left_anti"), "topo-free")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        one = free.select("id", F.lit(level).alias("level"))
        out = one if out is None else out.unionByName(one)
        nodes = materialize(nodes.join(free, "id", "left_anti"), "topo-nodes")
        left = materialize(left.join(free.withColumnRenamed("id", "src"), "src", "left_anti"), "topo")
        level += 1
    return out if out is not None else nodes.select("id", F.lit(0).alias("level"))


def topological_order(g: PropertyGraph) -> DataFrame:
    """``(id, place)``: an order in which all edges point forward, by level and id."""
    from loomgraph.graph import dense_ids

    return dense_ids(topological_levels(g), ["level", "id"], "place").select("id", "place")


def bipartition(g: PropertyGraph) -> DataFrame:
    """One row ``(bipartite)``.  Each node is doubled, and each edge joins opposite copies: a component that holds both
    copies of a node has an odd cycle."""
    if g.directed:
        raise ValueError("an undirected graph is asked for")
    e = g.edges.select((2 * F.col("src")).alias("a"), (2 * F.col("dst") + 1).alias("b"), (2 * F.col("src") + 1).alias("c"), (2 * F.col("dst")).alias("d"))
    c = star_components(e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("c").alias("u"), F.col("d").alias("v")))).alias("e")).select("e.*"))
    both = c.groupBy(F.floor(F.col("node") / 2).alias("id")).agg((F.count_distinct("component") == 1).alias("odd"))
    return both.agg((~F.coalesce(F.bool_or("odd"), F.lit(False))).alias("bipartite"))


def minimum_spanning_forest(g: PropertyGraph) -> DataFrame:
    """``(src, dst, w)`` of a minimum spanning forest, ties by src and dst: each round every component takes its lightest
    edge outwards."""
    edges = materialize(g.edges.where("src <> dst").select("src", "dst", "w"), "msf-edges")
    label, tree = g.vertices.select("id", F.col("id").alias("component")), edges.where(F.lit(False))
    while True:
        e = edges.join(label.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
        e = materialize(e.select("src", "dst", "w", "a", "b"), "msf-edges")
        if e.isEmpty():
            return tree
        pick = e.select(F.explode(F.array("a", "b")).alias("k"), F.struct("w", "src", "dst").alias("e")).groupBy("k").agg(F.min("e").alias("e")).select("e.*").distinct()
        tree = materialize(tree.unionByName(pick.select("src", "dst", "w")), "msf")
        label = materialize(components(PropertyGraph(g.vertices, tree, False)), "msf-labels")
        edges = e.select("src", "dst", "w")


def independent_set(g: PropertyGraph, seed: int = 42) -> DataFrame:
    """``(id)``: a maximal independent set; each round the nodes whose hash is smallest among their neighbours' join."""
    arcs = materialize(g.arcs().where("src <> dst").select("src", "dst").distinct(), "mis-arcs")
    left, chosen = materialize(g.vertices.select("id", F.xxhash64(F.lit(seed), "id").alias("h")), "mis"), None
    while not left.isEmpty():
        p = left.select(F.col("id").alias("dst"), F.struct("h", F.col("id").alias("i")).alias("p"))
        least = arcs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(p, "dst").groupBy(F.col("src").alias("id")).agg(F.min("p").alias("m"))
        won = materialize(left.join(least, "id", "left").where(F.col("m").isNull() | (F.struct("h", F.col("id").alias("i")) < F.col("m"))).select("id"), "mis-won")
        chosen = won if chosen is None else chosen.unionByName(won)
        gone = won.unionByName(arcs.join(won.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")))
        left = materialize(left.join(gone.distinct(), "id", "left_anti"), "mis")
    return chosen if chosen is not None else left.select("id")


def is_independent(g: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """One row ``(independent)``."""
    from loomgraph.operators.tools import subgraph

    return subgraph(g, nodes).edges.where("src <> dst").agg((F.count("*") == 0).alias("independent"))


def heavy_matching(g: PropertyGraph) -> DataFrame:
    """``(src, dst, w)``: a matching of at least half the largest weight: each round the edges that are heaviest at both
    of their ends, ties by id, are taken."""
    left, out = materialize(g.edges.where("src <> dst").select("src", "dst", "w"), "match"), None
    while not left.isEmpty():
        key = F.struct("w", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d"))
        best = left.select(F.explode(F.array("src", "dst")).alias("id"), key.alias("k")).groupBy("id").agg(F.max("k").alias("k"))
        both = left.withColumn("k", key).join(best.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(best.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
        won = materialize(both.where("k = a and k = b").select("src", "dst", "w"), "match-won")
        out = won if out is None else out.unionByName(won)
        used = won.select(F.explode(F.array("src", "dst")).alias("id"))
        left = materialize(left.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "w"), "match")
    return out if out is not None else left


def colouring(g: PropertyGraph, seed: int = 42) -> DataFrame:
    """``(id, colour)``: neighbours have different colours; each colour is a maximal independent set of what is left."""
    from loomgraph.operators.tools import subgraph

    left, out, colour = g, None, 0
    while not left.vertices.isEmpty():
        one = independent_set(left, seed + colour)
        named = one.select("id", F.lit(colour).alias("colour"))
        out = named if out is None else out.unionByName(named)
        rest = left.vertices.join(one, "id", "left_anti")
        sub = subgraph(left, rest)
        left = PropertyGraph(materialize(sub.vertices.select("id"), "colour-v"), materialize(sub.edges.select("src", "dst", "w"), "colour-e"), g.directed)
        colour += 1
    return out if out is not None else g.vertices.select("id", F.lit(0).alias("colour"))
