"""Measures of single nodes that need their neighbours at most, and statistics over all nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph


def degree_centrality(g: PropertyGraph, normalized: bool = True, incoming: bool = False, ignore_loops: bool = True) -> DataFrame:
    """``(id, score)``: the degree, divided by the number of nodes (less one where loops are there and ignored)."""
    loops = g.edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(1))
    d = g.degrees(incoming).join(loops, "id", "left").withColumn("loop", F.coalesce("loop", F.lit(0)))
    score = F.col("degree") - (F.col("loop") if ignore_loops else F.lit(0))
    if not normalized:
        return d.select("id", score.cast("double").alias("score"))
    n = d.agg(F.count("*").alias("n"), F.max("loop").alias("any_loop"))
    most = F.col("n") - (F.col("any_loop") if ignore_loops else F.lit(0))
    return d.join(F.broadcast(n)).select("id", (score / most).alias("score"))


def sfigality(g: PropertyGraph) -> DataFrame:
    """``(id, score)``: the share of neighbours with a larger degree; null for nodes without neighbours."""
    d = g.degrees().select("id", "degree")
    a = g.arcs().join(d.select(F.col("id").alias("src"), F.col("degree").alias("own")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("other")), "dst")
    s = a.groupBy(F.col("src").alias("id")).agg(F.avg((F.col("other") > F.col("own")).cast("double")).alias("score"))
    return g.vertices.select("id").join(s, "id", "left")


def laplacian_centrality(g: PropertyGraph, normalized: bool = False) -> DataFrame:
    """``(id, score)``: by how much the Laplacian energy drops without the node, with whole degrees."""
    d = g.degrees().select("id", F.floor("weighted_degree").cast("double").alias("d"))
    a = g.arcs().join(d.select(F.col("id").alias("dst"), F.col("d").alias("dv")), "dst")
    around = a.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * (F.col("w") + 2 * F.col("dv"))).alias("around"))
    out = d.join(around, "id", "left").select("id", (F.col("d") * F.col("d") + F.coalesce("around", F.lit(0.0))).alias("score"))
    if not normalized:
        return out
    energy = d.agg(F.sum(F.col("d") * F.col("d")).alias("x")).join(F.broadcast(g.arcs().agg(F.sum(F.col("w") * F.col("w")).alias("y")))).select((F.col("x") + F.coalesce("y", F.lit(0.0))).alias("energy"))
    return out.join(F.broadcast(energy)).select("id", (F.col("score") / F.col("energy")).alias("score"))


def ranking(scores: DataFrame) -> DataFrame:
    """``(id, score, place)``: by falling score, ties by id.  Places are counted in ranges, not in one task."""
    from loomgraph.graph import dense_ids

    return dense_ids(scores.select("id", "score"), [F.col("score").desc(), F.col("id")], "place")


def fractional_ranks(scores: DataFrame) -> DataFrame:
    """``(id, score, rank)``: from 1 by rising score, ties sharing their mean rank; ranks follow from counts of equal
    scores."""
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("score", (below + (F.col("n") + 1) / 2).alias("rank"))
    return scores.join(placed, "score").select("id", "score", "rank")


def relative_rank_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, ratio)``: a node's rank by the one scores over that by the other, the larger over the smaller."""
    x, y = (fractional_ranks(s).select("id", F.col("rank").alias(n)) for s, n in ((a, "a"), (b, "b")))
    return x.join(y, "id").select("id", (F.greatest("a", "b") / F.least("a", "b")).alias("ratio"))


def gini(values: DataFrame, column: str = "score") -> DataFrame:
    """One row ``(gini)``, from counts of equal values."""
    counts = values.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.select("x", "n", F.sum("n").over(w).alias("upto"))
    s = run.agg(F.sum("n").alias("N"), F.sum(F.col("x") * F.col("n")).alias("S"), F.sum(F.col("x") * F.col("n") * (2 * F.col("upto") - F.col("n") + 1)).alias("T"))
    return s.select(F.when(F.col("S") != 0, (F.col("T") - F.lit(0.0)) / (F.col("N") * F.col("S")) - (F.col("N") + 1) / F.col("N")).otherwise(0.0).alias("gini"))


def degree_distribution(g: PropertyGraph) -> DataFrame:
    """``(degree, nodes)``."""
    return g.degrees().groupBy("degree").agg(F.count("*").alias("nodes"))


def assortativity(g: PropertyGraph, values: DataFrame) -> DataFrame:
    """One row ``(assortativity)``: the correlation over edges of the numeric values ``(id, value)`` of their ends."""
    e = g.edges.join(values.select(F.col("id").alias("src"), F.col("value").cast("double").alias("x")), "src").join(values.select(F.col("id").alias("dst"), F.col("value").cast("double").alias("y")), "dst")
    return e.agg(F.corr("x", "y").alias("assortativity"))


def assortativity_nominal(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """One row ``(assortativity)``: how much more edges stay within labels ``(id, label)`` than by chance."""
    a = g.arcs() if not g.directed else g.edges.select("src", "dst", "w")
    e = a.join(labels.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst")
    mix = e.groupBy("x", "y").agg(F.count("*").alias("n"))
    total = mix.agg(F.sum("n").alias("m"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = mix.groupBy(F.col("x").alias("k")).agg(F.sum("n").alias("a")), mix.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    same, by = F.col("same") / F.col("m"), F.coalesce("ab", F.lit(0)) / (F.col("m") * F.col("m"))
    return total.join(F.broadcast(chance)).select(((same - by) / (1 - by)).alias("assortativity"))


def summary(values: DataFrame, column: str = "score") -> DataFrame:
    """One row of statistics: count, least, quartiles, greatest, mean, deviation, skewness, kurtosis."""
    c = F.col(column).cast("double")
    quartiles = [F.percentile(c, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return values.agg(F.count(c).alias("n"), F.min(c).alias("least"), *quartiles, F.max(c).alias("greatest"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("deviation"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))


def histogram(values: DataFrame, bins: int, column: str = "score") -> DataFrame:
    """``(bin, n)`` of equally wide bins between the least and the greatest value."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return values.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(pearson, spearman)`` of two scores."""
    x, y = (fractional_ranks(s).select("id", F.col("score").alias(n), F.col("rank").alias(f"r{n}")) for s, n in ((a, "a"), (b, "b")))
    return x.join(y, "id").agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def centralization(scores: DataFrame) -> DataFrame:
    """One row ``(centralization)``: the mean distance of the scores from their maximum, over the largest possible."""
    s = scores.agg(F.max("score").alias("m"), F.sum("score").alias("t"), F.count("*").alias("n"))
    return s.select(((F.col("n") * F.col("m") - F.col("t")) / ((F.col("n") - 1) * F.col("m"))).alias("centralization"))
