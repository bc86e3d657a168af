"""Connected components by alternating large-star and small-star rounds.

Each round joins the edges with the smallest neighbour of each node and re-hangs them there; the number of rounds grows
with the logarithm of the number of nodes.  Nothing is gathered on the driver but a row count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def star_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the smallest node that it reaches.

    Direction, repeats and loops of the edges don't matter; a row with a null end is no edge.  An empty table gives an
    empty result.  A node that has only loops is its own component.
    """
    hi: Column = F.greatest(u, v)
    lo: Column = F.least(u, v)
    ends = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(hi.alias("u"), lo.alias("v")).distinct()
    ends = materialize(ends, "components-0")
    tree, before = ends.where("u <> v"), None
    for i in range(max_rounds):
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = materialize(moved.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), f"components-{i + 1}")
        now = _state(tree)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(tree.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )
