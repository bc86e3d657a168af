"""Partitions of a graph: how good they are, how alike, what is left when they are contracted, and how to find them.

A partition is ``(id, label)``, a cover the same with several rows for a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.scratch import materialize


def labelled_edges(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """Edges with the labels ``a`` and ``b`` of their ends."""
    e = g.edges.select("src", "dst", "w")
    return e.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")


def label_table(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(label, size, inner, inner_edges, cut, volume)`` of each part: nodes, weight and number of its edges, weight that
    leaves it, and summed weighted degrees with loops twice."""
    e = labelled_edges(g, labels)
    inner = e.where("a = b").groupBy(F.col("a").alias("label")).agg(F.sum("w").alias("inner"), F.count("*").alias("inner_edges"))
    out = e.where("a <> b").select(F.explode(F.array("a", "b")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("cut"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    t = size.join(inner, "label", "left").join(out, "label", "left").na.fill(0.0, ["inner", "cut"]).na.fill(0, ["inner_edges"])
    return t.withColumn("volume", 2 * F.col("inner") + F.col("cut"))


def coverage(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """One row ``(coverage)``: the share of weight within parts."""
    return labelled_edges(g, labels).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))


def modularity(g: PropertyGraph, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row ``(modularity)``."""
    t = label_table(g, labels).agg(F.sum("inner").alias("i"), F.sum(F.col("volume") * F.col("volume")).alias("v"), F.sum("volume").alias("s"))
    return t.select((F.col("i") / (F.col("s") / 2) - gamma * F.col("v") / (F.col("s") * F.col("s"))).alias("modularity"))


def edge_cut(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """One row ``(edge_cut)``: the weight between parts."""
    return labelled_edges(g, labels).agg(F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)).alias("edge_cut"))


def conductances(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(label, score)``: the cut over the smaller volume of a part and the rest; 1 where one of these is 0."""
    t = label_table(g, labels)
    s = t.agg(F.sum("volume").alias("s"))
    least = F.least(F.col("volume"), F.col("s") - F.col("volume"))
    return t.join(F.broadcast(s)).select("label", F.when(least > 0, F.col("cut") / least).otherwise(1.0).alias("score"))


def expansions(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(label, score)``: the cut over the smaller number of nodes of a part and the rest."""
    t = label_table(g, labels)
    n = t.agg(F.sum("size").alias("n"))
    least = F.least(F.col("size"), F.col("n") - F.col("size"))
    return t.join(F.broadcast(n)).select("label", F.when(least > 0, F.col("cut") / least).otherwise(F.lit(None)).alias("score"))


def intra_density(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(label, score)``: edges over possible edges within a part; 1 for a single node."""
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return label_table(g, labels).select("label", F.when(F.col("size") > 1, F.col("inner_edges") / pairs).otherwise(1.0).alias("score"))


def hub_dominance(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(label, score)``: the largest number of neighbours that a node has in its part, over the other nodes there."""
    e = labelled_edges(g, labels).where("a = b and src <> dst")
    d = e.select(F.col("a").alias("label"), F.explode(F.array("src", "dst")).alias("id")).groupBy("label", "id").agg(F.count("*").alias("d"))
    most = d.groupBy("label").agg(F.max("d").alias("d"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    return size.join(most, "label", "left").select("label", F.when(F.col("size") > 1, F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0).alias("score"))


def stable_nodes(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(id, stable)``: 1 where a node has more weight to its own part than to any other; nodes without edges have."""
    a = g.arcs().where("src <> dst").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst")
    by = a.groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w")).join(labels, "id")
    s = by.groupBy("id").agg(F.sum(F.when(F.col("to") == F.col("label"), F.col("w")).otherwise(0.0)).alias("own"), F.max(F.when(F.col("to") != F.col("label"), F.col("w"))).alias("other"))
    return labels.select("id").join(s, "id", "left").select("id", F.when(F.coalesce(F.col("own") > F.coalesce("other", F.lit(0.0)), F.lit(True)), 1).otherwise(0).alias("stable"))


def local_coverage(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(id, score)``: the share of a node's weight that goes to its own part; null without edges."""
    a = g.arcs().join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    s = a.groupBy(F.col("src").alias("id")).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"))
    return g.vertices.select("id").join(s, "id", "left")


def fragmentation(g: PropertyGraph, labels: DataFrame, components: DataFrame) -> DataFrame:
    """``(label, score)``: one less the share of a part that lies in one component ``(id, component)`` of the graph."""
    n = labels.join(components, "id").groupBy("label", "component").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg((1 - F.max("n") / F.sum("n")).alias("score"))


def evaluation(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(weighted_average, average, least, greatest)`` of the parts' scores, weighted by their sizes."""
    t = scores.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
    return t.agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("weighted_average"), F.avg("score").alias("average"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def coarsened(g: PropertyGraph, labels: DataFrame) -> PropertyGraph:
    """Each part one node; weights between parts and, as loops, within them are summed."""
    e = labelled_edges(g, labels)
    a, b = (F.col("a"), F.col("b")) if g.directed else (F.least("a", "b"), F.greatest("a", "b"))
    edges = e.select(a.alias("src"), b.alias("dst"), "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return PropertyGraph(labels.select(F.col("label").alias("id")).distinct(), edges, g.directed)


def projected(coarse: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the nodes from labels ``(id, label)`` of their parts."""
    return labels.join(coarse.select(F.col("id").alias("label"), F.col("label").alias("__l")), "label").select("id", F.col("__l").alias("label"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, label)``: parts of nodes that both partitions hold together, named by their smallest node."""
    j = a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id")
    names = j.groupBy("a", "b").agg(F.min("id").alias("label"))
    return j.join(names, ["a", "b"]).select("id", "label")


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a, b, n)``: nodes by both labels."""
    return a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id").groupBy("a", "b").agg(F.count("*").alias("n"))


def _pair_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(both, first, second, pairs)``: node pairs together in both, in each, and all."""
    n = contingency(a, b)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    x = n.agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("both"), F.sum("n").alias("n"))
    first = n.groupBy("a").agg(F.sum("n").alias("k")).agg(F.coalesce(F.sum(pairs("k")), F.lit(0.0)).alias("first"))
    second = n.groupBy("b").agg(F.sum("n").alias("k")).agg(F.coalesce(F.sum(pairs("k")), F.lit(0.0)).alias("second"))
    return x.join(F.broadcast(first)).join(F.broadcast(second)).select("both", "first", "second", pairs("n").alias("pairs"))


def jaccard_dissimilarity(a: DataFrame, b: DataFrame) -> DataFrame:
    under = F.col("first") + F.col("second") - F.col("both")
    return _pair_counts(a, b).select(F.when(under > 0, 1 - F.col("both") / under).otherwise(0.0).alias("distance"))


def rand_dissimilarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(distance)``: the share of node pairs on which the partitions disagree."""
    return _pair_counts(a, b).select(((F.col("first") + F.col("second") - 2 * F.col("both")) / F.col("pairs")).alias("distance"))


def adjusted_rand_dissimilarity(a: DataFrame, b: DataFrame) -> DataFrame:
    chance = F.col("first") * F.col("second") / F.col("pairs")
    most = (F.col("first") + F.col("second")) / 2
    return _pair_counts(a, b).select(F.when(most != chance, 1 - (F.col("both") - chance) / (most - chance)).otherwise(0.0).alias("distance"))


def graph_rand_dissimilarity(g: PropertyGraph, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(distance)``: the share of edges on which the partitions disagree."""
    x = labelled_edges(g, a).select("src", "dst", (F.col("a") == F.col("b")).alias("p"))
    y = labelled_edges(g, b).select("src", "dst", (F.col("a") == F.col("b")).alias("q"))
    return x.join(y, ["src", "dst"]).agg(F.avg((F.col("p") != F.col("q")).cast("double")).alias("distance"))


def nmi_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(distance)``: one less the normalised mutual information; 0 where both have no entropy."""
    n = contingency(a, b)
    total = n.agg(F.sum("n").alias("t"))
    xs = n.groupBy("a").agg(F.sum("n").alias("x"))
    ys = n.groupBy("b").agg(F.sum("n").alias("y"))
    p = lambda c: F.col(c) / F.col("t")
    h = lambda df, c: df.join(F.broadcast(total)).agg((-F.sum(p(c) * F.log2(p(c)))).alias(f"h{c}"))
    mi = n.join(xs, "a").join(ys, "b").join(F.broadcast(total)).agg(F.sum(p("n") * F.log2(F.col("n") * F.col("t") / (F.col("x") * F.col("y")))).alias("mi"))
    j = mi.join(F.broadcast(h(xs, "x"))).join(F.broadcast(h(ys, "y")))
    return j.select(F.when(F.col("hx") + F.col("hy") > 0, 1 - 2 * F.col("mi") / (F.col("hx") + F.col("hy"))).otherwise(0.0).alias("distance"))


def cover_f1(cover: DataFrame, reference: DataFrame) -> DataFrame:
    """``(label, score)``: the best F1 of each set of a cover against the sets of another."""
    n = cover.select("id", F.col("label").alias("a")).join(reference.select("id", F.col("label").alias("b")), "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    x = cover.groupBy(F.col("label").alias("a")).agg(F.count("*").alias("x"))
    y = reference.groupBy(F.col("label").alias("b")).agg(F.count("*").alias("y"))
    best = n.join(x, "a").join(y, "b").groupBy("a").agg(F.max(2 * F.col("n") / (F.col("x") + F.col("y"))).alias("f"))
    return x.join(best, "a", "left").select(F.col("a").alias("label"), F.coalesce("f", F.lit(0.0)).alias("score"))


def partition_sizes(labels: DataFrame) -> DataFrame:
    """``(size, parts)``."""
    return labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("parts"))


def generated_labels(g: PropertyGraph, kind: str, k: int = 2, seed: int = 42) -> DataFrame:
    """``(id, label)``: ``singleton``, ``one``, ``random`` (of k) or ``balanced`` (k runs of ids of nearly one size)."""
    if kind == "balanced":
        from loomgraph.graph import dense_ids

        n = g.vertices.agg(F.count("*").alias("n"))
        return dense_ids(g.vertices.select("id"), ["id"], "at").join(F.broadcast(n)).select("id", F.floor(F.col("at") * k / F.col("n")).alias("label"))
    label = {"singleton": F.col("id"), "one": F.lit(0).cast("long"), "random": F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(k))}[kind]
    return g.vertices.select("id", label.alias("label"))


def label_propagation(g: PropertyGraph, rounds: int = 5) -> DataFrame:
    """``(id, label)``: each round all nodes take the label of most weight among their neighbours, the smallest of
    several; nodes without edges keep theirs."""
    a = materialize(g.arcs().where("src <> dst"), "lpa-arcs")
    labels = g.vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        w = a.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
        best = w.groupBy("id").agg(F.max_by(-F.col("label"), F.struct("w", -F.col("label"))).alias("m")).select("id", (-F.col("m")).alias("m"))
        labels = materialize(labels.join(best, "id", "left").select("id", F.coalesce("m", "label").alias("label")), "lpa")
    return labels


def louvain(g: PropertyGraph, gamma: float = 1.0, rounds: int = 8, levels: int = 6) -> DataFrame:
    """``(id, label)``: multi-level modularity optimisation.

    In each round half of the nodes, by a hash that changes with the round, may move to the neighbouring part with the
    largest gain, so that two nodes that would swap parts don't do so for ever.  Then parts become nodes, until nothing
    moves any more."""
    member = g.vertices.select("id", F.col("id").alias("label"))
    level = PropertyGraph(g.vertices.select("id"), materialize(g.edges.select("src", "dst", "w"), "louvain-edges"), False)
    for at in range(levels):
        arcs = materialize(level.arcs().where("src <> dst"), "louvain-arcs")
        loops = level.edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("loop"))
        total = level.edges.agg(F.sum("w").alias("total"))
        vol = level.vertices.join(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")), "id", "left").join(loops, "id", "left")
        vol = materialize(vol.select("id", (F.coalesce("d", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("vol")), "louvain-volumes")
        labels, moved_any = level.vertices.select("id", F.col("id").alias("label")), False
        for r in range(rounds):
            named = labels.join(vol, "id")
            parts = named.groupBy("label").agg(F.sum("vol").alias("part"))
            to = arcs.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), F.col("label").alias("to")).agg(F.sum("w").alias("w"))
            own = to.join(labels, "id").where("to = label").select("id", F.col("w").alias("own"))
            here = named.join(parts, "label").join(own, "id", "left").select("id", "label", "vol", F.col("part").alias("mine"), F.coalesce("own", F.lit(0.0)).alias("own"))
            x = to.join(here, "id").where("to <> label").join(parts.select(F.col("label").alias("to"), F.col("part").alias("theirs")), "to").join(F.broadcast(total))
            gain = (F.col("w") - F.col("own")) / F.col("total") + gamma * ((F.col("mine") - F.col("vol")) - F.col("theirs")) * F.col("vol") / (2 * F.col("total") * F.col("total"))
            turn = F.pmod(F.xxhash64(F.lit(at * rounds + r), "id"), F.lit(2)) == 0
            best = x.withColumn("gain", gain).where((F.col("gain") > 1e-12) & turn).groupBy("id").agg((-F.max(F.struct("gain", (-F.col("to")).alias("k")))["k"]).alias("m"))
            new = materialize(labels.join(best, "id", "left").select("id", F.coalesce("m", "label").alias("label"), F.col("m").isNotNull().alias("moved")), "louvain-labels")
            labels, changed = new.select("id", "label"), new.where("moved").count()
            moved_any |= changed > 0
            if not changed and r:
                break
        if not moved_any:
            break
        member = materialize(projected(labels, member), "louvain-member")
        coarse = coarsened(level, labels)
        level = PropertyGraph(materialize(coarse.vertices, "louvain-v"), materialize(coarse.edges, "louvain-e"), False)
    names = member.groupBy("label").agg(F.min("id").alias("name"))
    return member.join(names, "label").select("id", F.col("name").alias("label"))


def set_conductance(g: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """One row ``(conductance)`` of a set of nodes."""
    labels = g.vertices.select("id").join(nodes.select("id").distinct().withColumn("__in", F.lit(1)), "id", "left").select("id", F.coalesce("__in", F.lit(0)).cast("long").alias("label"))
    return conductances(g, labels).where("label = 1").select(F.col("score").alias("conductance"))


def sweep_cut(g: PropertyGraph, scores: DataFrame) -> DataFrame:
    """``(id)``: of the nodes by falling score over degree, the run from the first whose conductance is least."""
    d = g.degrees().select("id", "weighted_degree")
    r = scores.where("score > 0").join(d, "id").withColumn("at", F.row_number().over(Window.orderBy((F.col("score") / F.greatest("weighted_degree", F.lit(1e-300))).desc(), "id")))
    e = g.edges.join(r.select(F.col("id").alias("src"), F.col("at").alias("a")), "src", "left").join(r.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst", "left").where("src <> dst")
    # An edge is cut from the first of its ends on until the second.
    steps = e.select(F.least("a", "b").alias("at"), "w").unionByName(e.where("a is not null and b is not null").select(F.greatest("a", "b").alias("at"), (-F.col("w")).alias("w"))).where("at is not null")
    change = r.select("id", "at", "weighted_degree").join(steps.groupBy("at").agg(F.sum("w").alias("w")), "at", "left").na.fill(0.0, ["w"])
    run = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    total = g.edges.agg((2 * F.sum("w")).alias("t"))
    c = change.select("id", "at", F.sum("w").over(run).alias("cut"), F.sum("weighted_degree").over(run).alias("vol")).join(F.broadcast(total))
    least = F.least(F.col("vol"), F.col("t") - F.col("vol"))
    best = c.where(least > 0).agg(F.min_by("at", F.struct(F.col("cut") / least, "at")).alias("best"))
    return c.join(F.broadcast(best)).where("at <= best").select("id")
