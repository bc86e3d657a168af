"""Registered queries over changed graphs, files written and read again, and products over semirings, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.catalogue import _ALL, _NATION, _labels, _query, _whole
from loomgraph.functions import semirings
from loomgraph.operators import traversal
from loomgraph.scratch import scratch_path
from loomgraph.sources import formats, markup

# -- changes --------------------------------------------------------------------------------------------------------------

_NEXT = "nx AS MATERIALIZED (SELECT id AS src, id + 1 AS dst, 10.0 AS w FROM v WHERE id + 1 IN (SELECT id FROM v))"


def _next_parts(g: G.PropertyGraph) -> DataFrame:
    """Each part with the one of the next key, at weight 10."""
    after = g.vertices.select(F.col("id").alias("dst"))
    return g.vertices.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(after, "dst", "left_semi").select("src", "dst", F.lit(10.0).alias("w"))


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and who delivers them, as numbers above those of all parts."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return sold.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000000).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


_SUPPLY = "su AS (SELECT l_partkey AS src, l_suppkey + 1000000000 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)"

_query("added_edges", f"WITH {_ALL}, {_SUPPLY} SELECT src, dst, w FROM e UNION ALL SELECT src, dst, w FROM su")(
    lambda s, d: _whole(s, d).add_edges(_supply(s, d), add_missing=True).edges.select("src", "dst", "w")
)
_query("added_nodes", f"WITH v AS (SELECT p_partkey AS id FROM part), {_SUPPLY} SELECT id FROM v UNION SELECT src FROM su UNION SELECT dst FROM su")(
    lambda s, d: G.part_graph(s, d).add_edges(_supply(s, d), add_missing=True).vertices.select("id")
)
_query("added_unless_known", f"WITH {_ALL}, {_NEXT} SELECT src, dst, w FROM e UNION ALL SELECT src, dst, w FROM nx WHERE (src, dst) NOT IN (SELECT src, dst FROM e)")(
    lambda s, d: (g := _whole(s, d)).add_edges(_next_parts(g), check_multi=True).edges.select("src", "dst", "w")
)
_query("removed_edges", f"WITH {_ALL}, {_NEXT} SELECT src, dst, w FROM e WHERE (src, dst) NOT IN (SELECT src, dst FROM nx)")(
    lambda s, d: (g := _whole(s, d)).remove_edges(_next_parts(g)).edges.select("src", "dst", "w")
)
_query("weights_set", f"WITH {_ALL}, {_NEXT} SELECT src, dst, coalesce(nx.w, e.w) AS w FROM e FULL JOIN nx USING (src, dst)")(
    lambda s, d: (g := _whole(s, d)).set_weights(_next_parts(g)).edges.select("src", "dst", "w")
)
_query("weights_increased", f"WITH {_ALL}, {_NEXT} SELECT src, dst, coalesce(e.w, 0) + coalesce(nx.w, 0) AS w FROM e FULL JOIN nx USING (src, dst)")(
    lambda s, d: (g := _whole(s, d)).set_weights(_next_parts(g), add=True).edges.select("src", "dst", "w")
)
_query("multi_edges_removed", f"WITH {_ALL}, {_NEXT} SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT src, dst, w FROM nx) GROUP BY 1, 2")(
    lambda s, d: (g := _whole(s, d)).add_edges(_next_parts(g)).remove_multi_edges().edges.select("src", "dst", "w")
)
_query("indexed_edges", f"WITH {_ALL} SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM e")(lambda s, d: _whole(s, d).index_edges().edges.select("src", "dst", "w", "eid"))
_query("next_part_edges", f"WITH {_ALL}, {_NEXT} SELECT nx.src AS u, nx.dst AS v, e.src IS NOT NULL AS has_edge, coalesce(e.w, 0) AS w FROM nx LEFT JOIN e ON e.src = nx.src AND e.dst = nx.dst")(
    lambda s, d: (g := _whole(s, d)).has_edge(g.weight_of(_next_parts(g).select(F.col("src").alias("u"), F.col("dst").alias("v")))).select("u", "v", "has_edge", "w")
)
_query("node_attribute", "SELECT p_partkey AS id, p_brand AS brand FROM part")(lambda s, d: G.part_graph(s, d).attach_node_attribute(_labels(s, d).withColumnRenamed("label", "value"), "brand").vertices.select("id", "brand"))
_query("edge_attribute", f"WITH {_ALL}, {_NEXT} SELECT e.src, e.dst, e.w, nx.w AS planned FROM e LEFT JOIN nx USING (src, dst)")(
    lambda s, d: (g := _whole(s, d)).attach_edge_attribute(_next_parts(g).withColumnRenamed("w", "value"), "planned").edges.select("src", "dst", "w", "planned")
)


@_query(
    "swapped_edges",
    f"""WITH {_ALL}, x AS MATERIALIZED (SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM e),
p AS (SELECT x.src AS s1, x.dst AS t1, y.src AS s2, y.dst AS t2 FROM x JOIN x y ON y.eid = x.eid + 1 WHERE x.eid % 4 = 0)
SELECT src, dst, w FROM x WHERE NOT (eid % 4 = 1 OR (eid % 4 = 0 AND eid + 1 <= (SELECT max(eid) FROM x)))
UNION ALL SELECT least(s1, t2), greatest(s1, t2), 1.0 FROM p UNION ALL SELECT least(s2, t1), greatest(s2, t1), 1.0 FROM p""",
)
def swapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every four edges, in order, the first two swap their ends."""
    g = _whole(spark, sf_dir)
    x = g.index_edges().edges
    one = x.where("eid % 4 = 0").select("eid", F.col("src").alias("s1"), F.col("dst").alias("t1"))
    two = x.where("eid % 4 = 1").select((F.col("eid") - 1).alias("eid"), F.col("src").alias("s2"), F.col("dst").alias("t2"))
    return g.swap_edges(one.join(two, "eid").select("s1", "t1", "s2", "t2")).edges.select("src", "dst", "w")


# -- files, written and read again (part keys are dense and count from 0) ------------------------------------------------------------------------------------------

_WRITTEN = f"WITH {_ALL} SELECT src, dst"


def _relabelled(g: G.PropertyGraph) -> DataFrame:
    """Edges by the labels that their ends had in the file, the smaller number first."""
    name = g.vertices.select("id", F.col("label").cast("long").alias("label"))
    e = g.edges.join(name.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(name.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w")


@_query("edge_list_file", f"{_WRITTEN}, w FROM e")
def edge_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "edge-list")
    formats.write_edge_list(_whole(spark, sf_dir), path, separator=",", weights=True, first=1)
    return formats.read_graph(spark, path, "edgelist", separator=",", first=1).edges.select("src", "dst", "w")


@_query("snap_file", f"{_WRITTEN}, CAST(1 AS DOUBLE) AS w FROM e")
def snap_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a list are whatever strings they are; they come back as labels."""
    path = scratch_path(spark, "snap")
    formats.write_edge_list(_whole(spark, sf_dir), path, separator="\t")
    return _relabelled(formats.read_snap(spark, path, directed=False))


@_query("metis_file", f"{_WRITTEN}, CAST(1 AS DOUBLE) AS w FROM e")
def metis_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metis")
    formats.write_metis(_whole(spark, sf_dir), path)
    return formats.read_graph(spark, path, "metis").edges.select("src", "dst", "w")


@_query("gml_file", f"{_WRITTEN}, w FROM e")
def gml_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "gml")
    markup.write_gml(_whole(spark, sf_dir), path)
    return formats.read_graph(spark, path, "gml").edges.select("src", "dst", "w")


@_query("graphml_file", f"{_WRITTEN}, w FROM e")
def graphml_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graphml")
    markup.write_graphml(_whole(spark, sf_dir), path)
    return _relabelled(formats.read_graph(spark, path, "graphml"))


@_query("gexf_file", f"{_WRITTEN}, w FROM e")
def gexf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "gexf")
    markup.write_gexf(_whole(spark, sf_dir), path)
    return _relabelled(formats.read_graph(spark, path, "gexf"))


@_query("snapshot_file", f"{_WRITTEN}, w FROM e")
def snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    formats.write_snapshot(_whole(spark, sf_dir), path)
    return formats.read_snapshot(spark, path).edges.select("src", "dst", "w")


@_query("partition_file", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS label FROM part")
def partition_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "partition")
    formats.write_partition(_labels(spark, sf_dir, "p_size").select("id", F.col("label").cast("long").alias("label")), path)
    return formats.read_partition(spark, path)


@_query("cover_file", "SELECT DISTINCT l_partkey AS id, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS label FROM lineitem")
def cover_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a supplier delivers is a set; sets come back by their lines."""
    path = scratch_path(spark, "cover")
    formats.write_cover(_supply(spark, sf_dir).select(F.col("src").alias("id"), F.col("dst").alias("label")), path)
    return formats.read_cover(spark, path)


@_query(
    "dgs_file",
    """SELECT row_number() OVER (ORDER BY event_id) AS n, CASE event_type WHEN 'click' THEN 'EDGE_ADDITION' WHEN 'purchase' THEN 'EDGE_WEIGHT_INCREMENT' ELSE 'EDGE_REMOVAL' END AS type,
user_id AS u, CAST(event_id % 7 AS BIGINT) + 1000000 AS v, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS w FROM events""",
)
def dgs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in their order; a removal has no weight in the file."""
    path = scratch_path(spark, "dgs")
    kind = F.when(F.col("event_type") == "click", "EDGE_ADDITION").when(F.col("event_type") == "purchase", "EDGE_WEIGHT_INCREMENT").otherwise("EDGE_REMOVAL")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").cast("long").alias("u"), (F.col("event_id") % 7 + 1000000).alias("v"), F.col("value").alias("w"))
    formats.write_dgs(e, path)
    return G.dense_ids(formats.read_dgs(spark, path), ["seq"], "k").select((F.col("k") + 1).alias("n"), "type", "u", "v", "w")


# -- semirings --------------------------------------------------------------------------------------------------------------


def _square(spark: SparkSession, sf_dir: str, s: semirings.Semiring) -> DataFrame:
    m = semirings.adjacency(G.nation_graph(spark, sf_dir).arcs())
    return semirings.matrix_matrix(m, m, s)


_PATHS = f"WITH {_NATION}, z AS (SELECT x.src AS i, y.dst AS j, x.w AS a, y.w AS b FROM a x JOIN a y ON x.dst = y.src)"
_query("max_plus_square", f"{_PATHS} SELECT i, j, max(a + b) AS v FROM z GROUP BY 1, 2")(lambda s, d: _square(s, d, semirings.MAX_PLUS))
_query("min_max_square", f"{_PATHS} SELECT i, j, min(greatest(a, b)) AS v FROM z GROUP BY 1, 2")(lambda s, d: _square(s, d, semirings.MIN_MAX))
_query("max_min_square", f"{_PATHS} SELECT i, j, max(least(a, b)) AS v FROM z GROUP BY 1, 2")(lambda s, d: _square(s, d, semirings.MAX_MIN))
_query("logical_square", f"{_PATHS} SELECT i, j, max(CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END) AS v FROM z GROUP BY 1, 2")(lambda s, d: _square(s, d, semirings.LOGICAL))
_query("galois_square", f"{_PATHS} SELECT i, j, bit_xor(CAST(a AS BIGINT) & CAST(b AS BIGINT)) AS v FROM z GROUP BY 1, 2")(lambda s, d: _square(s, d, semirings.GALOIS))
_query("element_sums", f"WITH {_NATION} SELECT i, j, sum(w) AS v FROM (SELECT src AS i, dst AS j, w FROM a UNION ALL SELECT dst, src, w FROM a) GROUP BY 1, 2")(
    lambda s, d: semirings.element_add(m := semirings.adjacency(G.nation_graph(s, d).arcs()), semirings.transposed(m))
)
_query("element_products", f"WITH {_NATION} SELECT x.src AS i, x.dst AS j, x.w * y.w AS v FROM a x JOIN a y ON x.src = y.dst AND x.dst = y.src")(
    lambda s, d: semirings.element_multiply(m := semirings.adjacency(G.nation_graph(s, d).arcs()), semirings.transposed(m))
)
_query("row_sums", f"WITH {_ALL} SELECT src AS i, sum(w) AS v FROM a GROUP BY 1")(lambda s, d: semirings.row_reduce(semirings.adjacency(_whole(s, d).arcs())))
_query("column_maxima", f"WITH {_ALL} SELECT dst AS i, max(w) AS v FROM a GROUP BY 1")(lambda s, d: semirings.column_reduce(semirings.adjacency(_whole(s, d).arcs()), semirings.MAX_PLUS))

# -- forests ----------------------------------------------------------------------------------------------------------------


def _forest_sql(rounds: int) -> str:
    """A lightest forest's weight, for whole weights: at each k below the heaviest, how many more components the edges up to
    k leave than all edges do.  Labels spread for that many rounds at all k."""
    steps = ["k AS (SELECT unnest(range(0, CAST((SELECT max(w) FROM e) AS BIGINT) + 1)) AS k)", "r0 AS (SELECT k, id, id AS c FROM v, k)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT k, id, min(c) AS c FROM (SELECT k, id, c FROM r{i} UNION ALL SELECT k, dst, c FROM r{i} JOIN a ON src = id AND w <= k) GROUP BY 1, 2)")
    return ", ".join(steps) + f", n AS (SELECT k, count(DISTINCT c) AS n FROM r{rounds} GROUP BY 1), m AS (SELECT min(n) AS m FROM n)"


@_query("spanning_forest_weight", f"WITH {_ALL}, {_forest_sql(12)} SELECT (SELECT count(*) FROM v) - m AS edges, CAST((SELECT sum(n - m) FROM n) AS DOUBLE) AS weight FROM m")
def spanning_forest_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges the lightest forest has, and what they weigh."""
    return traversal.minimum_spanning_forest(_whole(spark, sf_dir)).agg(F.count("*").alias("edges"), F.sum("w").alias("weight"))
