"""Property graphs as two DataFrames.

vertices has a long ``id`` and any other columns; edges has long ``src`` and ``dst``, a double ``w`` and any other
columns.  An undirected edge is stored once, with src <= dst.  Nothing here runs a job except where it says so.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.scratch import materialize


@dataclass(frozen=True)
class PropertyGraph:
    """A graph; every change makes a new one, lazily."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    # -- scans ----------------------------------------------------------------------------------------------------

    def arcs(self) -> DataFrame:
        """Each edge as seen from its ends: an undirected edge both ways, a loop once."""
        e = self.edges.select("src", "dst", "w")
        if self.directed:
            return e
        back = e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return e.unionByName(back)

    def neighbours(self, node: int, incoming: bool = False) -> DataFrame:
        """``(id, w)`` of the nodes next to one."""
        here, there = ("dst", "src") if incoming and self.directed else ("src", "dst")
        return self.arcs().where(F.col(here) == node).select(F.col(there).alias("id"), "w")

    def has_edge(self, pairs: DataFrame) -> DataFrame:
        """pairs ``(u, v)`` with ``has_edge``."""
        known = self.arcs().select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct().withColumn("has_edge", F.lit(True))
        return pairs.join(known, ["u", "v"], "left").withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))

    def weight_of(self, pairs: DataFrame) -> DataFrame:
        """pairs ``(u, v)`` with the edge's ``w``, 0 where there is none."""
        known = self.arcs().groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.sum("w").alias("w"))
        return pairs.join(known, ["u", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))

    def node_pairs(self, candidates: DataFrame) -> DataFrame:
        """Of candidate pairs those u < v whose ends are both nodes; all pairs of a graph are never formed."""
        ids = self.vertices.select("id")
        kept = candidates.where("u < v").join(ids.withColumnRenamed("id", "u"), "u", "left_semi")
        return kept.join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")

    # -- changes --------------------------------------------------------------------------------------------------

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return replace(self, edges=edges)

    def add_nodes(self, ids: DataFrame) -> PropertyGraph:
        new = ids.select("id").distinct().join(self.vertices.select("id"), "id", "left_anti")
        return replace(self, vertices=self.vertices.unionByName(new, allowMissingColumns=True))

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without some nodes and the edges at them."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone, self.edges["src"] == gone["id"], "left_anti")
        edges = edges.join(gone, edges["dst"] == gone["id"], "left_anti")
        return replace(self, vertices=self.vertices.join(gone, "id", "left_anti"), edges=edges)

    def add_edges(self, edges: DataFrame, add_missing: bool = False, check_multi: bool = False) -> PropertyGraph:
        """With more edges; their missing ends become nodes, or known pairs are skipped, if asked for."""
        new = canonical(edges, self.directed)
        if check_multi:
            new = new.dropDuplicates(["src", "dst"]).join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        out = replace(self, edges=self.edges.unionByName(new, allowMissingColumns=True))
        if add_missing:
            out = out.add_nodes(new.select(F.explode(F.array("src", "dst")).alias("id")))
        return out

    def remove_edges(self, pairs: DataFrame) -> PropertyGraph:
        gone = canonical(pairs.select("src", "dst"), self.directed).select("src", "dst").distinct()
        return self.with_edges(self.edges.join(gone, ["src", "dst"], "left_anti"))

    def remove_all_edges(self) -> PropertyGraph:
        return self.with_edges(self.edges.where(F.lit(False)))

    def remove_self_loops(self) -> PropertyGraph:
        return self.with_edges(self.edges.where("src <> dst"))

    def remove_multi_edges(self) -> PropertyGraph:
        """Of parallel edges the lightest stays."""
        first = Window.partitionBy("src", "dst").orderBy("w")
        return self.with_edges(self.edges.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))

    def set_weights(self, changes: DataFrame, add: bool = False) -> PropertyGraph:
        """changes ``(src, dst, w)``: the new weight of an edge, or what is added to it; edges that aren't there yet
        are made."""
        new = canonical(changes, self.directed).groupBy("src", "dst").agg(F.sum("w").alias("__w"))
        both = self.edges.join(new, ["src", "dst"], "full")
        changed = F.coalesce("w", F.lit(0.0)) + F.col("__w") if add else F.col("__w")
        return self.with_edges(both.withColumn("w", F.coalesce(changed, "w")).drop("__w").select(*self.edges.columns))

    def swap_edges(self, swaps: DataFrame) -> PropertyGraph:
        """swaps ``(s1, t1, s2, t2)``: these two edges become s1-t2 and s2-t1."""
        gone = swaps.select(F.expr("stack(2, s1, t1, s2, t2) as (src, dst)"))
        new = swaps.select(F.expr("stack(2, s1, t2, s2, t1) as (src, dst)")).withColumn("w", F.lit(1.0))
        return self.remove_edges(gone).add_edges(new)

    # -- attributes -----------------------------------------------------------------------------------------------

    def attach_node_attribute(self, values: DataFrame, name: str) -> PropertyGraph:
        """values ``(id, value)``."""
        return replace(self, vertices=self.vertices.drop(name).join(values.select("id", F.col("value").alias(name)), "id", "left"))

    def attach_edge_attribute(self, values: DataFrame, name: str) -> PropertyGraph:
        """values ``(src, dst, value)``."""
        own = canonical(values, self.directed, keep=["value"]).select("src", "dst", F.col("value").alias(name))
        return self.with_edges(self.edges.drop(name).join(own, ["src", "dst"], "left"))

    def index_edges(self) -> PropertyGraph:
        """With a dense edge id ``eid``, by src and dst."""
        return self.with_edges(dense_ids(self.edges.drop("eid"), ["src", "dst", "w"], "eid"))

    # -- cardinalities --------------------------------------------------------------------------------------------

    def degrees(self, incoming: bool = False) -> DataFrame:
        """``(id, degree, weighted_degree)`` for every node; a loop counts once."""
        end = "dst" if incoming and self.directed else "src"
        d = self.arcs().groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
        return self.vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))

    def isolated(self) -> DataFrame:
        """``(id)`` of nodes without edges."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return self.vertices.select("id").join(ends, "id", "left_anti")

    def counts(self) -> DataFrame:
        """One row ``(nodes, edges, self_loops, total_weight)``."""
        e = self.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total_weight"))
        return self.vertices.agg(F.count("*").alias("nodes")).join(F.broadcast(e))

    # -- checks ---------------------------------------------------------------------------------------------------

    def problems(self) -> DataFrame:
        """``(problem, rows)``: what is wrong with the tables; all counts of a consistent graph are 0."""
        v, e = self.vertices, self.edges
        ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
        found = [
            ("null or negative id", v.where("id is null or id < 0")),
            ("repeated id", v.groupBy("id").count().where("count > 1")),
            ("end that is no node", ends.join(v, "id", "left_anti")),
            ("parallel edges", e.groupBy("src", "dst").count().where("count > 1")),
            ("weight that is null or not finite", e.where("w is null or isnan(w) or abs(w) = double('infinity')")),
        ]
        if not self.directed:
            found.append(("edge that isn't canonical", e.where("src > dst")))
        out = None
        for name, rows in found:
            one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), "rows")
            out = one if out is None else out.unionByName(one)
        return out


def canonical(edges: DataFrame, directed: bool, keep: list[str] | None = None) -> DataFrame:
    """Edges with a weight, 1 unless given, and undirected ones with src <= dst."""
    w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
    more = [c for c in (edges.columns if keep is None else keep) if c not in ("src", "dst", "w")]
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    src, dst = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    return edges.select(src.alias("src"), dst.alias("dst"), w.alias("w"), *more)


def from_edges(edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None) -> PropertyGraph:
    """A graph of edges ``(src, dst[, w, ...])``; its nodes are the ends, if none are given."""
    e = canonical(edges, directed)
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct() if vertices is None else vertices
    return PropertyGraph(v, e, directed)


def from_coo(rows: DataFrame, n: int, directed: bool = False) -> PropertyGraph:
    """A graph of nodes 0 to n - 1 from coordinates ``(row, col[, data])``."""
    weight = F.col("data").cast("double") if "data" in rows.columns else F.lit(1.0)
    edges = rows.select(F.col("row").alias("src"), F.col("col").alias("dst"), weight.alias("w"))
    return from_edges(edges, directed, rows.sparkSession.range(n))


def from_csr(indptr: DataFrame, indices: DataFrame, directed: bool = True) -> PropertyGraph:
    """A graph from compressed rows: indptr ``(id, first, end)``, the slots of each node, and indices ``(slot, target[,
    w])``.  A slot finds its node by a range condition on sorted ranges, made an equality by exploding the ranges."""
    slots = indptr.where("first < end").select("id", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("slot"))
    weight = F.col("w") if "w" in indices.columns else F.lit(1.0)
    edges = slots.join(indices, "slot").select(F.col("id").alias("src"), F.col("target").alias("dst"), weight.alias("w"))
    if not directed:
        edges = edges.where("src <= dst")
    return PropertyGraph(indptr.select("id"), canonical(edges, directed), directed)


def to_csr(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """indptr ``(id, first, end)`` and indices ``(slot, target, w)`` of a graph's arcs."""
    arcs = dense_ids(graph.arcs(), ["src", "dst"], "slot")
    indptr = arcs.groupBy(F.col("src").alias("id")).agg(F.min("slot").alias("first"), (F.max("slot") + 1).alias("end"))
    indptr = graph.vertices.select("id").join(indptr, "id", "left").select("id", F.coalesce("first", F.lit(0).cast("long")).alias("first"), F.coalesce("end", F.lit(0).cast("long")).alias("end"))
    return indptr, arcs.select("slot", F.col("dst").alias("target"), "w")


def from_tables(nodes: DataFrame, edges: DataFrame, key: str = "node_id", weight: str | None = None, directed: bool = True) -> PropertyGraph:
    """A graph from two tables, nodes by any key and edges ``(source, target, ...)``.

    Nodes get dense ids in the order of their keys and keep their columns.  Raises ValueError on null or repeated keys,
    on ends that are no nodes and on null or non-finite weights; this runs a job."""
    v = dense_ids(nodes, [key], "id")
    ids = v.select("id", F.col(key).alias("__key"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    more = [c for c in edges.columns if c not in ("source", "target", weight)]
    named = edges.select("source", "target", w.alias("w"), *more)
    found = named.join(ids.select(F.col("id").alias("src"), F.col("__key").alias("source")), "source", "left")
    found = found.join(ids.select(F.col("id").alias("dst"), F.col("__key").alias("target")), "target", "left")
    wrong = found.agg(F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("ends"), F.count_if(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))).alias("weights")).first()
    keys = nodes.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).first()
    if keys["n"] != keys["d"]:
        raise ValueError("node keys are null or repeat")
    if wrong["ends"] or wrong["weights"]:
        raise ValueError(f"{wrong['ends']} edges end at no node, {wrong['weights']} weights are null or not finite")
    return PropertyGraph(v, canonical(found.drop("source", "target"), directed), directed)


def dense_ids(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with 0, 1, ... in the given order.  Rows are sorted in ranges; one count for each partition gives its first
    number, so no task sees all rows."""
    spark, columns = df.sparkSession, df.columns
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = ranged.select(*columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    numbered = numbered.withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    # Read twice, the rows might be dealt differently; a written table keeps them where they are.
    numbered = materialize(numbered, "dense")
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("n"))
    first = sizes.select(F.col("__part"), (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__first"))
    return numbered.join(F.broadcast(first), "__part").select(*columns, (F.coalesce("__first", F.lit(0)) + F.col("__at")).cast("long").alias(name))


def register(df: DataFrame, name: str) -> None:
    """A result, or a table of nodes, as a view for SQL."""
    df.createOrReplaceTempView(name)


# -- graphs over the driver's tables -----------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_graph(spark: SparkSession, sf_dir: str, least: int = 1) -> PropertyGraph:
    """Parts bought in one order, weighted by the number of such orders; edges lighter than ``least`` are left out."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = line.select("l_orderkey", F.col("l_partkey").alias("src")), line.select("l_orderkey", F.col("l_partkey").alias("dst"))
    edges = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")).where(F.col("w") >= least)
    return PropertyGraph(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges, False)


def nation_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Trade between nations: from the supplier's to the customer's, weighted by line items."""
    line = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    o, c, s = (_read(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    joined = line.join(o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(s.select("s_suppkey", "s_nationkey"), "s_suppkey")
    edges = joined.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return PropertyGraph(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), edges, True)


def supply_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and the suppliers they bought from, weighted by line items; a supplier's id is 10**9 + its key."""
    line = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    edges = line.join(o, "o_orderkey").groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10**9).alias("dst")).agg(F.count("*").cast("double").alias("w"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    s = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10**9).alias("id"))
    return PropertyGraph(c.unionByName(s), edges, False)


def order_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """From customers to their orders, and from orders to the suppliers of their items: ids are 4 times the keys, plus 0, 1
    and 2.  No path comes back to where it began."""
    o = _read(spark, sf_dir, "orders").select((4 * F.col("o_custkey")).alias("src"), (4 * F.col("o_orderkey") + 1).alias("dst"))
    line = _read(spark, sf_dir, "lineitem").select((4 * F.col("l_orderkey") + 1).alias("src"), (4 * F.col("l_suppkey") + 2).alias("dst")).join(o.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    edges = o.unionByName(line).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return PropertyGraph(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges, True)


def order_chains(spark: SparkSession, sf_dir: str, days: int = 90) -> PropertyGraph:
    """Orders, each joined with the same customer's one before if that is at most so many days older; edges carry the later
    order's ``status``."""
    o = _read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = o.select("o_orderkey", "o_orderstatus", "o_orderdate", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderdate").over(w).alias("then"))
    e = e.where(F.col("o_orderdate") <= F.col("then") + F.expr(f"interval {days} days"))
    edges = e.select(F.least("before", "o_orderkey").alias("src"), F.greatest("before", "o_orderkey").alias("dst"), F.lit(1.0).alias("w"), F.col("o_orderstatus").alias("status"))
    return PropertyGraph(o.select(F.col("o_orderkey").alias("id")), edges, False)


def urgent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)``: urgent orders of one day, each with the one before it by key."""
    o = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    e = o.select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")).alias("before")).where("before is not null")
    return e.select(F.least("before", "o_orderkey").alias("src"), F.greatest("before", "o_orderkey").alias("dst"))


def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event types that follow each other for a user, weighted by how often; types are numbered by name."""
    e = _read(spark, sf_dir, "events")
    types = e.select("event_type").distinct()
    ids = types.withColumn("id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select("event_type", F.lead("event_type").over(after).alias("following")).where("following is not null")
    named = steps.join(ids.withColumnRenamed("id", "src"), "event_type").join(ids.select(F.col("event_type").alias("following"), F.col("id").alias("dst")), "following")
    return PropertyGraph(ids.select("id", "event_type"), named.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), True)
