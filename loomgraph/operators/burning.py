"""Edge scores from random processes on a graph; hashes take the place of random numbers, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, dense_ids
from loomgraph.scratch import materialize


def _uniform(seed: int, *keys: Column | str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def forest_fire_score(g: PropertyGraph, p: float, target: float, fires: int = 64, seed: int = 42, max_rounds: int = 10_000) -> DataFrame:
    """``(src, dst, score)``: how often fires burn an edge, over the most that any edge burns.

    A fire starts at a random node.  Each node on fire sets alight a geometric number of its neighbours that this fire hasn't
    reached (each further one with probability p), and those edges burn.  ``fires`` fires burn at a time, each with its own
    frontier, until edges have burned target times their number.
    """
    if not 0 <= p < 1:
        raise ValueError("p lies in [0, 1)")
    arcs = materialize(g.arcs().where("src <> dst").select("src", "dst").distinct(), "fire-arcs")
    starts = materialize(dense_ids(arcs.select(F.col("src").alias("id")).distinct(), ["id"], "at"), "fire-starts")
    n, wanted = starts.count(), target * g.edges.count()
    burned, total = None, 0
    for batch in range(max_rounds):
        if not n or total >= wanted:
            break
        fire = g.vertices.sparkSession.range(batch * fires, (batch + 1) * fires).withColumnRenamed("id", "fire")
        front = fire.select("fire", F.pmod(F.xxhash64(F.lit(seed), "fire"), F.lit(n)).alias("at")).join(starts, "at").select("fire", "id")
        seen = front = materialize(front, "fire-front")
        while not front.isEmpty():
            fresh = front.withColumnRenamed("id", "src").join(arcs, "src").join(seen.withColumnRenamed("id", "dst"), ["fire", "dst"], "left_anti")
            place = F.row_number().over(Window.partitionBy("fire", "src").orderBy(F.xxhash64(F.lit(seed + 1), "fire", "src", "dst"), "dst"))
            many = F.floor(F.log(_uniform(seed + 2, "fire", "src")) / math.log(p)) if p else F.lit(0)
            lit = materialize(fresh.withColumn("place", place).where(F.col("place") <= many).select("fire", "src", "dst"), "fire-lit")
            new = lit.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if not g.directed else lit.select("src", "dst")
            sums = new.groupBy("src", "dst").agg(F.count("*").alias("k"))
            burned = materialize((sums if burned is None else burned.unionByName(sums)).groupBy("src", "dst").agg(F.sum("k").alias("k")), "fire-burned")
            front = materialize(lit.select("fire", F.col("dst").alias("id")).distinct(), "fire-front")
            seen = materialize(seen.unionByName(front), "fire-seen")
        total = (burned.agg(F.sum("k")).first()[0] or 0) if burned is not None else 0
        if not total and not p:
            break
    scores = g.edges.select("src", "dst")
    if burned is None:
        return scores.withColumn("score", F.lit(0.0))
    most = burned.agg(F.max("k").alias("most"))
    return scores.join(burned, ["src", "dst"], "left").join(F.broadcast(most)).select("src", "dst", (F.coalesce("k", F.lit(0)) / F.greatest("most", F.lit(1))).alias("score"))


def random_node_edge_score(g: PropertyGraph, node_share: float = 0.8, batch: float = 0.1, seed: int = 42) -> DataFrame:
    """``(src, dst, score)``: an edge's place, over the number of edges, in an order of removal: each removal takes, with probability
    ``node_share``, a random edge of a random node that has one, else a random edge.

    Removals go by batches of this share of the edges that are left, in which degrees count as they are at its beginning; within a
    batch edges go in the order of exponential variates with their rates.
    """
    left = materialize(g.edges.select("src", "dst"), "removal")
    total, done, out = left.count(), 0, None
    while done < total:
        ends = left.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        sums = left.agg(F.count("*").alias("m")).crossJoin(ends.agg(F.count("*").alias("n")))
        d = lambda c: ends.select(F.col("id").alias(c), F.col("d").alias(f"d_{c}"))
        rate = node_share / F.col("n") * (1 / F.col("d_src") + 1 / F.col("d_dst")) + (1 - node_share) / F.col("m")
        timed = left.join(d("src"), "src").join(d("dst"), "dst").join(F.broadcast(sums)).select("src", "dst", (-F.log(_uniform(seed + done, "src", "dst")) / rate).alias("t"))
        size = max(1, math.ceil((total - done) * batch)) if total - done > 20 else total - done
        placed = materialize(dense_ids(timed, ["t", "src", "dst"], "at"), "removal")
        gone = placed.where(F.col("at") < size).select("src", "dst", ((F.col("at") + done) / total).alias("score"))
        out = gone if out is None else out.unionByName(gone)
        left = placed.where(F.col("at") >= size).select("src", "dst")
        done += size
    return out if out is not None else left.withColumn("score", F.lit(0.0))
