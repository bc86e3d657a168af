"""Communities by moves, level by level: Leiden for modularity, and the map equation.

A round looks at all nodes at once: each sums its weight to the parts next to it, and a part of the nodes, by a hash that changes
with the round, goes where that gains most.  A round that doesn't better the objective is taken back and tried with fewer
nodes.  A level ends when three rounds in turn bring less than the tolerance, or when an eighth of the nodes gains nothing.
So the objective gets better with every round that counts, and the search ends by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators.communities import coarsened, labelled_edges
from loomgraph.operators.components import star_components
from loomgraph.scratch import materialize

_LEAST, _QUIET = 1e-9, 3


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


@dataclass(frozen=True)
class _Level:
    """A graph whose nodes may stand for many: arcs without loops, and (id, vol, out) with loops in vol, twice."""

    graph: PropertyGraph
    arcs: DataFrame
    nodes: DataFrame
    total: float  # twice the weight of all edges


def _level(g: PropertyGraph) -> _Level:
    graph = PropertyGraph(materialize(g.vertices.select("id"), "level-v"), materialize(g.edges.select("src", "dst", "w"), "level-e"), False)
    arcs = materialize(graph.arcs().where("src <> dst"), "level-arcs")
    loops = graph.edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("loop"))
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out"))
    n = graph.vertices.join(out, "id", "left").join(loops, "id", "left").na.fill(0.0, ["out", "loop"])
    nodes = materialize(n.select("id", (F.col("out") + 2 * F.col("loop")).alias("vol"), "out"), "level-nodes")
    return _Level(graph, arcs, nodes, nodes.agg(F.sum("vol")).first()[0] or 0.0)


def _ties(level: _Level, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, to, w)``: each node's weight to the parts next to it; ``(label, vol, cut)`` of the parts."""
    to = level.arcs.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    to = materialize(to, "moves-ties")
    cut = to.join(labels, "id").where("to <> label").groupBy("label").agg(F.sum("w").alias("cut"))
    vol = level.nodes.join(labels, "id").groupBy("label").agg(F.sum("vol").alias("vol"))
    return to, materialize(vol.join(cut, "label", "left").na.fill(0.0, ["cut"]), "moves-parts")


# -- objectives: what parts are worth and the weight between them; what a move gains --------------------------------------


def _modularity(gamma: float) -> tuple[Callable, Callable]:
    def worth(parts: DataFrame, total: float) -> tuple[float, float]:
        inner, expected = F.sum(F.col("vol") - F.col("cut")) / total, gamma * F.sum(F.col("vol") * F.col("vol")) / (total * total)
        row = parts.agg((inner - expected).alias("q"), F.sum("cut").alias("exits")).first()
        return row["q"] or 0.0, row["exits"] or 0.0

    def gain(total: float, exits: float) -> Column:
        apart = F.col("vol_to") - (F.col("vol_own") - F.col("vol"))
        return 2 * (F.col("w") - F.col("own")) / total - 2 * gamma * F.col("vol") * apart / (total * total)

    return worth, gain


def _map_equation() -> tuple[Callable, Callable]:
    def worth(parts: DataFrame, total: float) -> tuple[float, float]:
        """Less the codelength, but for the nodes' own term, which no move changes."""
        cut, vol = F.col("cut") / total, F.col("vol") / total
        sums = parts.agg(F.sum(cut).alias("q"), F.sum(2 * _xlogx(cut) - _xlogx(cut + vol)).alias("rest"), F.sum("cut").alias("exits"))
        row = sums.select((F.col("rest") - _xlogx(F.col("q"))).alias("l"), "exits").first()
        return row["l"] or 0.0, row["exits"] or 0.0

    def gain(total: float, exits: float) -> Column:
        p = lambda c: F.col(c) / total
        cut_own, vol_own = p("cut_own") - p("out") + 2 * p("own"), p("vol_own") - p("vol")
        cut_to, vol_to = p("cut_to") + p("out") - 2 * p("w"), p("vol_to") + p("vol")
        q = F.lit(exits / total)
        then = _xlogx(q + cut_own - p("cut_own") + cut_to - p("cut_to")) - 2 * (_xlogx(cut_own) + _xlogx(cut_to)) + _xlogx(cut_own + vol_own) + _xlogx(cut_to + vol_to)
        now = _xlogx(q) - 2 * (_xlogx(p("cut_own")) + _xlogx(p("cut_to"))) + _xlogx(p("cut_own") + p("vol_own")) + _xlogx(p("cut_to") + p("vol_to"))
        return now - then

    return worth, gain


# -- moves ----------------------------------------------------------------------------------------------------------------


def _moved(level: _Level, labels: DataFrame, objective: tuple[Callable, Callable], max_rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """(labels, by how much they are worth more)."""
    worth, gain = objective
    ties, parts = _ties(level, labels)
    (value, exits), share, quiet = worth(parts, level.total), 2, 0
    began = value
    for r in range(max_rounds):
        own = parts.select("label", F.col("vol").alias("vol_own"), F.col("cut").alias("cut_own"))
        there = parts.select(F.col("label").alias("to"), F.col("vol").alias("vol_to"), F.col("cut").alias("cut_to"))
        kept = ties.join(labels, "id").where("to = label").select("id", F.col("w").alias("own"))
        here = level.nodes.join(labels, "id").join(own, "label").join(kept, "id", "left").na.fill(0.0, ["own"])
        turn = F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(share)) == 0
        asked = ties.join(here.where(turn), "id").where("to <> label").join(there, "to").withColumn("gain", gain(level.total, exits)).where(F.col("gain") > _LEAST)
        best = asked.groupBy("id").agg((-F.max(F.struct("gain", (-F.col("to")).alias("k")))["k"]).alias("m"))
        new = materialize(labels.join(best, "id", "left").select("id", F.coalesce("m", "label").alias("label"), F.col("m").isNotNull().alias("moved")), "moves")
        if new.where("moved").isEmpty():
            quiet += 1
            if quiet == _QUIET:
                break
            continue
        tried = new.select("id", "label")
        new_ties, new_parts = _ties(level, tried)
        new_value, new_exits = worth(new_parts, level.total)
        if new_value > value + _LEAST:
            quiet = quiet + 1 if new_value < value + tolerance else 0
            labels, ties, parts, value, exits = tried, new_ties, new_parts, new_value, new_exits
            if quiet == _QUIET:
                break
        elif share >= 8:
            break
        else:
            share *= 2
    else:
        raise RuntimeError(f"moves didn't settle in {max_rounds} rounds")
    return labels, value - began


def connected_parts(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """``(id, label)``: the connected pieces of parts, named by their smallest nodes."""
    inside = labelled_edges(g, labels).where("a = b and src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    pieces = star_components(inside).select(F.col("node").alias("id"), F.col("component").alias("piece"))
    return g.vertices.select("id").join(pieces, "id", "left").select("id", F.coalesce("piece", "id").alias("label"))


def _refined(level: _Level, labels: DataFrame, gamma: float) -> DataFrame:
    """``(id, label)``: connected subsets of the parts.  Nodes begin by themselves.  In a round some of those still alone
    and well connected to their part join the subset in it that gains most, if that is well connected, too; subsets joined are
    those that no node leaves in the round, so each stays connected."""
    whole = level.nodes.join(labels, "id").groupBy(F.col("label").alias("part")).agg(F.sum("vol").alias("part_vol"))
    base = level.nodes.join(labels.withColumnRenamed("label", "part"), "id").join(whole, "part")
    base = materialize(base.select("id", "vol", "part", "part_vol"), "refine-base")
    inner = level.arcs.join(base.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(base.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst").where("a = b")
    inner = materialize(inner.select("src", "dst", "w"), "refine-arcs")
    subset = base.select("id", F.col("id").alias("label"))
    for r in range(4):
        to = materialize(inner.join(subset.withColumnRenamed("id", "dst").withColumnRenamed("label", "to"), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w")), "refine-ties")
        out = to.join(subset, "id").where("to <> label").groupBy("label").agg(F.sum("w").alias("out"))
        sets = base.join(subset, "id").groupBy("label").agg(F.sum("vol").alias("set_vol"), F.count("*").alias("n"), F.first("part_vol").alias("part_vol")).join(out, "label", "left").na.fill(0.0, ["out"])
        tied = F.col("out") >= gamma * F.col("set_vol") * (F.col("part_vol") - F.col("set_vol")) / level.total
        goes = (F.col("n") == 1) & (F.pmod(F.xxhash64(F.lit(r), "label"), F.lit(2)) == 0)
        sets = materialize(sets.select("label", "set_vol", tied.alias("tied"), (goes & tied).alias("goes")), "refine-sets")
        movers = subset.join(sets.where("goes").select("label", F.col("set_vol").alias("vol")), "label").select("id", "vol")
        there = sets.where("tied and not goes").select(F.col("label").alias("to"), "set_vol")
        gain = F.col("w") - gamma * F.col("vol") * F.col("set_vol") / level.total
        best = to.join(movers, "id").join(there, "to").withColumn("gain", gain).where(F.col("gain") > _LEAST).groupBy("id").agg((-F.max(F.struct("gain", (-F.col("to")).alias("k")))["k"]).alias("m"))
        subset = materialize(subset.join(best, "id", "left").select("id", F.coalesce("m", "label").alias("label")), "refine")
    return subset


def _named(member: DataFrame) -> DataFrame:
    names = member.groupBy("label").agg(F.min("id").alias("name"))
    return member.join(names, "label").select("id", F.col("name").alias("label"))


def leiden(g: PropertyGraph, gamma: float = 1.0, tolerance: float = 1e-4, max_rounds: int = 200, max_levels: int = 20) -> DataFrame:
    """``(id, label)``: communities of an undirected graph by the Leiden method; each is connected and named by its smallest
    node.

    After the moves of a level each community is refined into well connected subsets; these become the nodes of the
    next level, which begins with the communities as they are.  Ends when a level brings less modularity than the tolerance; raises
    RuntimeError where rounds or levels don't settle.
    """
    objective = _modularity(gamma)
    member = materialize(g.vertices.select("id", F.col("id").alias("label")), "leiden-member")  # node of the present level
    level, labels = _level(g), g.vertices.select("id", F.col("id").alias("label"))
    for _ in range(max_levels):
        labels, more = _moved(level, labels, objective, max_rounds, tolerance)
        refined = materialize(_refined(level, labels, gamma), "leiden-refined")
        if more < tolerance or refined.where("id <> label").isEmpty():
            found = member.join(labels.withColumnRenamed("id", "at").withColumnRenamed("label", "community"), F.col("label") == F.col("at")).select("id", F.col("community").alias("label"))
            return materialize(connected_parts(g, _named(found)), "leiden")
        community = refined.join(labels.withColumnRenamed("label", "community"), "id").groupBy(F.col("label").alias("id")).agg(F.min("community").alias("label"))
        community = materialize(community, "leiden-community")
        member = materialize(member.join(refined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label").select("id", F.col("to").alias("label")), "leiden-member")
        level, labels = _level(coarsened(level.graph, refined)), community
    raise RuntimeError(f"Leiden didn't settle in {max_levels} levels")


def codelength(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """One row ``(codelength)``: the bits a step of a random walk costs by the map equation of two levels."""
    level = _level(g)
    _, parts = _ties(level, labels)
    if not level.total:
        return g.vertices.sparkSession.createDataFrame([(0.0,)], "codelength double")
    cut, vol = F.col("cut") / level.total, F.col("vol") / level.total
    of_parts = parts.agg(F.sum(cut).alias("q"), F.sum(_xlogx(cut + vol) - 2 * _xlogx(cut)).alias("rest"))
    of_nodes = level.nodes.agg(F.sum(_xlogx(F.col("vol") / level.total)).alias("nodes"))
    return of_parts.join(F.broadcast(of_nodes)).select((_xlogx(F.col("q")) + F.col("rest") - F.col("nodes")).alias("codelength"))


def map_equation_communities(g: PropertyGraph, tolerance: float = 1e-4, max_rounds: int = 200, max_levels: int = 20) -> DataFrame:
    """``(id, label)``: communities of an undirected graph whose codelength no level's moves lower any more, by the tolerance at
    least, named by their smallest nodes.  Raises RuntimeError where rounds or levels don't settle."""
    objective = _map_equation()
    member, level = g.vertices.select("id", F.col("id").alias("label")), _level(g)
    for _ in range(max_levels):
        labels, more = _moved(level, level.graph.vertices.select("id", F.col("id").alias("label")), objective, max_rounds, tolerance)
        if more < tolerance:
            return materialize(_named(member), "map-equation")
        member = materialize(member.join(labels.select(F.col("id").alias("label"), F.col("label").alias("to")), "label").select("id", F.col("to").alias("label")), "map-member")
        level = _level(coarsened(level.graph, labels))
    raise RuntimeError(f"the map equation didn't settle in {max_levels} levels")
