"""Node embeddings by random projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.scratch import materialize


def fast_random_projection(g: PropertyGraph, dims: int = 8, weights: tuple[float, ...] = (0.0, 1.0, 1.0), seed: int = 12345) -> DataFrame:
    """``(id, d, x)``: a sparse random vector for each node, averaged over neighbours once for each weight and summed with
    these.  The random signs follow from the node, the dimension and the seed by integer arithmetic."""
    h = (F.col("id") * 1103515245 + F.col("d") * 12345 + seed) % 2147483648
    start = g.vertices.select("id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("d"))
    sign = F.when(h % 6 == 0, 1.0).when(h % 6 == 1, -1.0).otherwise(0.0)
    x = start.select("id", "d", sign.alias("x"))
    out_weight = g.arcs().groupBy("src").agg(F.sum("w").alias("s"))
    p = materialize(g.arcs().join(out_weight, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("p")), "rp-arcs")
    total = x.select("id", "d", (F.col("x") * weights[0]).alias("x"))
    for w in weights[1:]:
        x = materialize(p.join(x.select(F.col("id").alias("dst"), "d", "x"), "dst").groupBy(F.col("src").alias("id"), "d").agg(F.sum(F.col("p") * F.col("x")).alias("x")), "rp")
        total = total.unionByName(x.select("id", "d", (F.col("x") * w).alias("x")))
    return total.groupBy("id", "d").agg(F.sum("x").alias("x"))
