"""Graphs made from ranges and hashes: every row follows from its number and the seed, in any task and any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, canonical
from loomgraph.operators.tools import hashed


def ring_lattice(spark: SparkSession, n: int, k: int) -> PropertyGraph:
    """Each node next to the k on either side."""
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s")).select("src", ((F.col("src") + F.col("s")) % n).alias("dst"))
    return PropertyGraph(spark.range(n), canonical(e, False), False)


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 42) -> PropertyGraph:
    """A ring lattice, of whose edges the share p ends elsewhere; raises ValueError unless 2k < n - 1."""
    if 2 * k >= n - 1:
        raise ValueError("2k must be less than n - 1")
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s"))
    other = (F.col("src") + 1 + F.floor(hashed(seed + 1, "src", "s") * (n - 1))) % n
    e = e.select("src", F.when(hashed(seed, "src", "s") < p, other).otherwise((F.col("src") + F.col("s")) % n).cast("long").alias("dst"))
    return PropertyGraph(spark.range(n), canonical(e, False).dropDuplicates(["src", "dst"]), False)


def random_graph(spark: SparkSession, n: int, p: float, directed: bool = False, seed: int = 42) -> PropertyGraph:
    """G(n, p).  Edges are reached by geometric skips within each node's row, so that rows of absent pairs are never
    made; a row has as many draws as it could have edges with a margin, and running sums of skips."""
    expected = n * p
    draws = int(expected + 8 * (expected + 1) ** 0.5 + 8)
    e = spark.range(n).select(F.col("id").alias("src"), F.sequence(F.lit(1), F.lit(draws)).alias("t"))
    skip = lambda t: (F.floor(F.log(1 - hashed(seed, "src", t)) / F.log(F.lit(1 - p))) + 1).cast("long")
    e = e.select("src", F.transform("t", skip).alias("s"))
    e = e.select("src", F.expr("aggregate(s, array(-1L), (a, x) -> concat(a, array(element_at(a, -1) + x)))").alias("at"))
    e = e.select("src", F.explode(F.slice("at", 2, draws)).alias("dst")).where(f"dst < {n}").where("src <> dst" if directed else "src < dst")
    return PropertyGraph(spark.range(n), canonical(e, directed), directed)


def planted_partition(spark: SparkSession, n: int, parts: int, p_in: float, p_out: float, seed: int = 42) -> PropertyGraph:
    """Nodes of the same residue are joined with p_in, others with p_out; node attribute ``label``."""
    g = random_graph(spark, n, max(p_in, p_out), seed=seed)
    keep = F.when(F.col("src") % parts == F.col("dst") % parts, p_in).otherwise(p_out) / max(p_in, p_out)
    return PropertyGraph(spark.range(n).withColumn("label", F.col("id") % parts), g.edges.where(hashed(seed + 1, "src", "dst") < keep), False)


def rmat(spark: SparkSession, scale: int, edge_factor: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 42) -> PropertyGraph:
    """2**scale nodes and up to edge_factor edges for each, every bit of both ends drawn by quadrant; repeats merge."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        u = hashed(seed + bit, "id")
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    e = spark.range((1 << scale) * edge_factor).select(src.alias("src"), dst.alias("dst")).where("src <> dst")
    return PropertyGraph(spark.range(1 << scale), canonical(e, False).dropDuplicates(["src", "dst"]), False)


def chung_lu(degrees: DataFrame, seed: int = 42) -> PropertyGraph:
    """Expected degrees ``(id, degree)``: every node sends out half of its degree in stubs, each of which ends at a node
    drawn in proportion to degrees.  Stubs find their node by the range of a running sum that they fall into."""
    from pyspark.sql import Window

    run = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    sums = degrees.select("id", (F.sum("degree").over(run) - F.col("degree")).cast("long").alias("lo"), "degree")
    total = degrees.agg(F.sum("degree").alias("t"))
    places = sums.where("degree > 0").select(F.col("id").alias("dst"), F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("degree") - 1)).alias("place"))
    stubs = degrees.where("degree >= 2").join(F.broadcast(total)).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.floor(F.col("degree") / 2))).alias("s"), "t")
    stubs = stubs.select("src", F.floor(hashed(seed, "src", "s") * F.col("t")).alias("place"))
    e = stubs.join(places, "place").where("src <> dst").select("src", "dst")
    return PropertyGraph(degrees.select("id"), canonical(e, False).dropDuplicates(["src", "dst"]), False)


def stochastic_blockmodel(spark: SparkSession, labels: DataFrame, affinity: list[list[float]], seed: int = 42) -> PropertyGraph:
    """Nodes 0 to n - 1 with labels ``(id, label)``, joined with the probability that their labels have."""
    n, most = labels.count(), max(map(max, affinity))
    g = random_graph(spark, n, most, seed=seed)
    rows = [(i, j, p / most) for i, r in enumerate(affinity) for j, p in enumerate(r)]
    table = F.broadcast(spark.createDataFrame(rows, "a int, b int, p double"))
    e = g.edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").join(table, ["a", "b"])
    return PropertyGraph(labels, e.where(hashed(seed + 1, "src", "dst") < F.col("p")).select("src", "dst", "w"), False)


def realizable(degrees: DataFrame) -> DataFrame:
    """One row ``(realizable)``: the Erdős–Gallai test, on counts of equal degrees."""
    from pyspark.sql import Window

    by = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    k = by.select("degree", "n", F.sum("n").over(down).alias("k"), F.sum(F.col("n") * F.col("degree")).over(down).alias("left"))
    below = k.select(F.col("degree").alias("d2"), F.col("n").alias("n2"))
    pairs = k.join(below, F.col("d2") < F.col("degree"), "left")  # distinct degrees only
    ok = pairs.groupBy("degree", "k", "left").agg(F.coalesce(F.sum(F.least("d2", "k") * F.col("n2")), F.lit(0)).alias("r"))
    even = degrees.agg((F.sum("degree") % 2 == 0).alias("even"))
    return ok.agg(F.bool_and(F.col("left") <= F.col("k") * (F.col("k") - 1) + F.col("r")).alias("fits")).join(F.broadcast(even)).select((F.col("fits") & F.col("even")).alias("realizable"))


def seir(g: PropertyGraph, seeds: DataFrame, p: float, exposed: int, infectious: int, steps: int, seed: int = 42) -> DataFrame:
    """``(t, state, count)`` of an epidemic: S, exposed for some steps, infectious for some, then removed."""
    from loomgraph.scratch import materialize

    arcs = materialize(g.arcs().where("src <> dst").select("src", "dst").distinct(), "seir-arcs")
    state = materialize(g.vertices.select("id").join(seeds.select("id", F.lit(0).alias("since")), "id", "left").select("id", (F.col("since") - exposed).alias("since")), "seir")
    out = None
    for t in range(steps + 1):
        age = F.lit(t) - F.col("since")
        named = state.withColumn("state", F.when(F.col("since").isNull(), "S").when(age < exposed, "E").when(age < exposed + infectious, "I").otherwise("R"))
        census = named.groupBy("state").agg(F.count("*").alias("count")).select(F.lit(t).alias("t"), "state", "count")
        out = census if out is None else out.unionByName(census)
        hit = named.where("state = 'I'").select(F.col("id").alias("src")).join(arcs, "src").where(hashed(seed + t, "src", "dst") < p).select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(t + 1))
        state = materialize(state.join(hit, "id", "left").select("id", F.coalesce("since", "hit").alias("since")), "seir")
    return out


def degree_preserving_shuffle(g: PropertyGraph, seed: int = 42) -> PropertyGraph:
    """Nodes of equal degree trade places."""
    from pyspark.sql import Window

    from loomgraph.operators.tools import remapped

    d = g.degrees().select("id", "degree")
    a = d.withColumn("n", F.row_number().over(Window.partitionBy("degree").orderBy("id")))
    b = d.select(F.col("id").alias("dense"), "degree", F.row_number().over(Window.partitionBy("degree").orderBy(F.xxhash64(F.lit(seed), "id"), "id")).alias("n"))
    return remapped(g, a.join(b, ["degree", "n"]).select("id", "dense"))
