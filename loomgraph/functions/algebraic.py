"""Graph algorithms as products over semirings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.semirings import MIN_PLUS, Semiring, adjacency, matrix_matrix, matrix_vector, transposed
from loomgraph.graph import PropertyGraph
from loomgraph.operators.closing import closed_edges
from loomgraph.scratch import materialize


def pagerank_matrix(g: PropertyGraph) -> DataFrame:
    """``(i, j, v)``: the share of j's weight out that goes to i."""
    a = g.arcs()
    out = a.groupBy("src").agg(F.sum("w").alias("out")).where("out > 0")
    return adjacency(a.join(out, "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / F.col("out")).alias("w")))


def pagerank(g: PropertyGraph, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """``(id, score)`` by products of the PageRank matrix with the scores; what sits on nodes without edges out is spread evenly."""
    m = materialize(pagerank_matrix(g), "pagerank-matrix")
    sinks = g.vertices.select("id").join(m.select(F.col("j").alias("id")).distinct(), "id", "left_anti").withColumn("sink", F.lit(True))
    nodes = materialize(g.vertices.select("id").join(sinks, "id", "left"), "pagerank-nodes")
    n = nodes.count()
    x = nodes.select(F.col("id").alias("i"), F.lit(1.0 / n if n else 0.0).alias("v"))
    for _ in range(rounds):
        lost = nodes.where("sink").join(x, F.col("id") == F.col("i")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("lost"))
        into = matrix_vector(m, x).withColumnRenamed("v", "into")
        new = nodes.select(F.col("id").alias("i")).join(into, "i", "left").join(F.broadcast(lost))
        x = materialize(new.select("i", ((1 - damping + damping * F.col("lost")) / n + damping * F.coalesce("into", F.lit(0.0))).alias("v")), "pagerank-vector")
    return x.select(F.col("i").alias("id"), F.col("v").alias("score"))


def _settled(g: PropertyGraph, source: int, m: DataFrame, s: Semiring) -> DataFrame:
    """``(id, distance)``: x = min(x, m x) from the source until it settles; raises ValueError where it doesn't in as many rounds as
    there are nodes."""
    m = materialize(m, "path-matrix")
    x = materialize(g.vertices.where(F.col("id") == source).select(F.col("id").alias("i"), F.lit(0.0).alias("v")), "path-vector")
    for _ in range(g.vertices.count() + 1):
        step = matrix_vector(m, x, s).withColumnRenamed("v", "new")
        both = materialize(x.join(step, "i", "full").select("i", F.least("v", "new").alias("v"), (F.col("v").isNull() | (F.col("new") < F.col("v"))).alias("changed")), "path-vector")
        x = both.select("i", "v")
        if both.where("changed").isEmpty():
            return g.vertices.select("id").join(x.select(F.col("i").alias("id"), F.col("v").alias("distance")), "id", "left")
    raise ValueError("the graph has a cycle of negative weight")


def bellman_ford(g: PropertyGraph, source: int) -> DataFrame:
    """``(id, distance)``: weighted distances by min-plus products; negative weights are allowed, negative cycles aren't."""
    lightest = g.arcs().groupBy(F.col("dst").alias("i"), F.col("src").alias("j")).agg(F.min("w").alias("v"))
    return _settled(g, source, lightest, MIN_PLUS)


def bfs(g: PropertyGraph, source: int) -> DataFrame:
    """``(id, distance)``: steps by min-plus products with all weights 1."""
    one = g.arcs().select(F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("v")).distinct()
    return _settled(g, source, one, MIN_PLUS)


def triangles(g: PropertyGraph) -> DataFrame:
    """One row ``(triangles)``: the sum of the square of the adjacency matrix where that has an edge.  The product is taken at these
    places alone and in blocks: its other entries, the open wedges, are never written."""
    return closed_edges(g).where("first").agg(F.coalesce((F.sum("score") / 3).cast("long"), F.lit(0).cast("long")).alias("triangles"))


def incidence_counts(g: PropertyGraph) -> DataFrame:
    """``(i, j, v)``: common neighbours of nodes, by a product of the adjacency matrix with its transpose."""
    m = materialize(g.arcs().where("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("j")).distinct().withColumn("v", F.lit(1).cast("long")), "incidence")
    return matrix_matrix(m, transposed(m)).where("i <> j")
