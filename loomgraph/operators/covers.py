"""Covers ``(id, label)``, in which a node may be in several sets, and measures of nodes that go by labels or squares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators.communities import labelled_edges
from loomgraph.operators.triangles import node_triangles
from loomgraph.scratch import materialize

NORMALIZATIONS = ("min", "geometric_mean", "arithmetic_mean", "max", "joint_entropy")


def _h(x: Column, n: Column) -> Column:
    return F.when(x > 0, -x * F.log2(x / n)).otherwise(0.0)


def overlapping_nmi_distance(a: DataFrame, b: DataFrame, nodes: DataFrame, normalization: str = "max") -> DataFrame:
    """One row ``(distance)``: one less the normalised mutual information of two covers of ``nodes``.

    A set's entropy given the other cover is the least over the sets of that cover that it meets, counting those only
    that agree with it more than they differ; a set that meets none keeps its own.  Equal covers are at 0, and so are two without
    sets; a cover without sets and another one are at 1.
    """
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"normalization is one of {NORMALIZATIONS}")
    sets = lambda c, s, k: c.select("id", F.col("label").alias(s)).distinct().groupBy(s).agg(F.count("*").cast("double").alias(k))
    one, two = materialize(sets(a, "a", "x"), "cover-a"), materialize(sets(b, "b", "y"), "cover-b")
    total = nodes.agg(F.count("*").cast("double").alias("n"))
    common = a.select("id", F.col("label").alias("a")).distinct().join(b.select("id", F.col("label").alias("b")).distinct(), "id").groupBy("a", "b").agg(F.count("*").cast("double").alias("d"))
    x, y, d, n = (F.col(c) for c in "xydn")
    own = lambda size: _h(size, n) + _h(n - size, n)
    neither, only_y, only_x = n + d - x - y, y - d, x - d
    joint = _h(neither, n) + _h(only_y, n) + _h(only_x, n) + _h(d, n)
    agrees = _h(neither, n) + _h(d, n) >= _h(only_y, n) + _h(only_x, n)
    met = common.join(one, "a").join(two, "b").join(F.broadcast(total))
    met = materialize(met.select("a", "b", F.when(agrees, joint - own(y)).otherwise(own(x)).alias("x_given"), F.when(agrees, joint - own(x)).otherwise(own(y)).alias("y_given")), "cover-met")

    def entropies(own_sets: DataFrame, key: str, size: Column, given: str, h: str) -> DataFrame:
        least = met.groupBy(key).agg(F.min(given).alias("g"))
        each = own_sets.join(F.broadcast(total)).join(least, key, "left").select(own(size).alias("h"), F.least(own(size), F.coalesce("g", own(size))).alias("g"))
        return each.agg(F.count("*").alias(f"k_{h}"), F.coalesce(F.sum("h"), F.lit(0.0)).alias(f"h_{h}"), F.coalesce(F.sum("g"), F.lit(0.0)).alias(f"g_{h}"))

    both = entropies(one, "a", x, "x_given", "x").join(F.broadcast(entropies(two, "b", y, "y_given", "y")))
    hx, hy = F.col("h_x"), F.col("h_y")
    mutual = (hx - F.col("g_x") + hy - F.col("g_y")) / 2
    under = {"min": F.least(hx, hy), "geometric_mean": F.sqrt(hx * hy), "arithmetic_mean": (hx + hy) / 2, "max": F.greatest(hx, hy), "joint_entropy": hx + hy - mutual}[normalization]
    nmi = F.when((hx == 0) & (hy == 0), 1.0).when(under == 0, 0.0).otherwise(mutual / under)
    empty_x, empty_y = F.col("k_x") == 0, F.col("k_y") == 0
    distance = F.when(empty_x & empty_y, 0.0).when(empty_x | empty_y, 1.0).otherwise(1 - F.least(F.greatest(nmi, F.lit(0.0)), F.lit(1.0)))
    return both.select(distance.alias("distance"))


def cover_hub_dominance(g: PropertyGraph, cover: DataFrame) -> DataFrame:
    """``(label, score)``: the largest number of neighbours that a node has in a set of a cover, over the other nodes of it; 1 for a
    set of one node."""
    c = cover.select("id", "label").distinct()
    a = g.arcs().where("src <> dst").select("src", "dst").distinct()
    inner = a.join(c.select(F.col("id").alias("src"), "label"), "src").join(c.select(F.col("id").alias("dst"), "label"), ["dst", "label"]).groupBy("label", "src").agg(F.count("*").alias("d"))
    most, size = inner.groupBy("label").agg(F.max("d").alias("d")), c.groupBy("label").agg(F.count("*").alias("size"))
    return size.join(most, "label", "left").select("label", F.when(F.col("size") > 1, F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0).alias("score"))


def combined_partition(parts: list[DataFrame]) -> DataFrame:
    """``(id, label)``: nodes that all of several partitions hold together, named by their smallest node."""
    named = reduce(lambda x, y: x.join(y, "id"), (p.select("id", F.col("label").alias(f"l{i}")) for i, p in enumerate(parts)))
    keys = [f"l{i}" for i in range(len(parts))]
    return named.join(named.groupBy(*keys).agg(F.min("id").alias("label")), keys).select("id", "label")


def square_clustering(g: PropertyGraph) -> DataFrame:
    """``(id, score)``: of the squares that a node could be in, given its neighbours' degrees, the share that are there.

    The squares at u are the pairs of common neighbours that u has with other nodes, so one count of common neighbours by
    pair of nodes gives squares and triangles; no pair of neighbours is looked at by itself.  Raises ValueError where the graph
    has loops."""
    if not g.edges.where("src = dst").isEmpty():
        raise ValueError("the graph has loops")
    a = materialize(g.arcs().select("src", "dst").distinct(), "squares-arcs")
    d = a.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    around = a.join(d.select(F.col("id").alias("dst"), F.col("d").alias("e")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("e").alias("around"))
    # Each pair once, with the smaller node first.
    half = a.select(F.col("dst").alias("m"), F.col("src").alias("u")).join(a.select(F.col("dst").alias("m"), F.col("src").alias("v")), "m").where("u < v").groupBy("u", "v").agg(F.count("*").alias("c"))
    half = materialize(half.join(a.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("edge")), ["u", "v"], "left"), "squares-pairs")
    by = half.select(F.explode(F.array("u", "v")).alias("id"), "c", "edge").groupBy("id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("squares"), F.sum(F.when(F.col("edge") == 1, F.col("c")).otherwise(0)).alias("twice"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    possible = (F.col("d") - 1) * F.col("around") - 2 * pairs - F.col("squares") - F.col("twice")
    s = d.join(around, "id").join(by, "id").select("id", F.when(possible > 0, F.col("squares") / possible).otherwise(F.col("squares")).alias("score"))
    return g.vertices.select("id").join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def permanence(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(id, intra_clustering, permanence)``: how firmly a node sits in its part: its neighbours there over the most it has in another
    part (one at least) and over its degree, less what its neighbours there lack to know each other.  A node without
    edges has -1."""
    one = PropertyGraph(g.vertices, g.edges.where("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1.0)), False)
    to = one.arcs().join(labels.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.count("*").alias("k"))
    by = to.join(labels, "id").groupBy("id").agg(F.sum("k").alias("d"), F.sum(F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(0)).alias("own"), F.max(F.when(F.col("to") != F.col("label"), F.col("k"))).alias("pull"))
    inner = one.with_edges(materialize(labelled_edges(one, labels).where("a = b").select("src", "dst", "w"), "permanence-inner"))
    t = node_triangles(inner).select("id", F.col("triangles").alias("t")) if "triangles" in node_triangles(inner).columns else node_triangles(inner).toDF("id", "t")
    cin = F.when(F.col("own") > 1, F.coalesce("t", F.lit(0)) / (F.col("own") * (F.col("own") - 1) / 2)).otherwise(0.0)
    x = g.vertices.select("id").join(by, "id", "left").join(t, "id", "left").select("id", cin.alias("intra_clustering"), F.when(F.col("d") > 0, F.col("own") / F.greatest("pull", F.lit(1)) / F.col("d")).otherwise(0.0).alias("p"))
    return x.select("id", "intra_clustering", (F.col("p") - (1 - F.col("intra_clustering"))).alias("permanence"))
