"""The registered graph queries, each over graphs that Spark derives from the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.functions import embedding, semirings
from loomgraph.operators import centrality, communities, degree, distances, links, tools, traversal, triangles
from loomgraph.streaming import events

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# -- graphs in SQL ----------------------------------------------------------------------------------------------------


def _part(least: int) -> str:
    return f"""l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
e AS MATERIALIZED (SELECT x.l_partkey AS src, y.l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM l x JOIN l y
  ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2 HAVING count(*) >= {least}),
v AS (SELECT p_partkey AS id FROM part),
a AS MATERIALIZED (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e),
d AS MATERIALIZED (SELECT id, count(dst) AS degree, coalesce(sum(w), 0.0) AS wd FROM v LEFT JOIN a ON id = src GROUP BY id)"""


_NATION = """e AS MATERIALIZED (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation),
a AS (SELECT src, dst, w FROM e)"""
_BRAND = "b AS (SELECT p_partkey AS id, p_brand AS label FROM part), t AS (SELECT p_partkey AS id, p_type AS label FROM part)"
_TRIANGLES = """tri AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst),
te AS (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri),
ts AS MATERIALIZED (SELECT e.src, e.dst, e.w, count(te.src) AS t FROM e LEFT JOIN te ON e.src = te.src AND e.dst = te.dst GROUP BY 1, 2, 3),
tn AS (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri),
tv AS MATERIALIZED (SELECT v.id, count(tn.id) AS t FROM v LEFT JOIN tn ON v.id = tn.id GROUP BY 1)"""
_ALL = _part(1)


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _whole(spark: SparkSession, sf_dir: str) -> G.PropertyGraph:
    """The co-purchase graph, written once for the operators that read it often."""
    from loomgraph.scratch import materialize

    g = G.part_graph(spark, sf_dir)
    return G.PropertyGraph(g.vertices, materialize(g.edges, "part-graph"), False)


def _labels(spark: SparkSession, sf_dir: str, column: str = "p_brand") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col(column).alias("label"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- scans, counts, degrees -------------------------------------------------------------------------------------------

_query("g_edges", f"WITH {_ALL} SELECT src, dst, w FROM e")(lambda s, d: G.part_graph(s, d).edges)
_query("g_arcs", f"WITH {_ALL} SELECT src, dst, w FROM a")(lambda s, d: G.part_graph(s, d).arcs())
_query("g_nation_edges", f"WITH {_NATION} SELECT src, dst, w FROM e")(lambda s, d: G.nation_graph(s, d).edges)
_query(
    "g_supply_edges",
    "SELECT o_custkey AS src, l_suppkey + 1000000000 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)(lambda s, d: G.supply_graph(s, d).edges)
_query(
    "graph_counts",
    f"WITH {_NATION} SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, count(*) FILTER (src = dst) AS self_loops, sum(w) AS total_weight FROM e",
)(lambda s, d: G.nation_graph(s, d).counts())
_query("degrees", f"WITH {_ALL} SELECT id, degree, wd AS weighted_degree FROM d")(lambda s, d: G.part_graph(s, d).degrees())
_query(
    "degrees_in",
    f"WITH {_NATION} SELECT id, count(src) AS degree, coalesce(sum(w), 0.0) AS weighted_degree FROM v LEFT JOIN e ON id = dst GROUP BY id",
)(lambda s, d: G.nation_graph(s, d).degrees(incoming=True))
_query("isolated_nodes", f"WITH {_ALL} SELECT id FROM d WHERE degree = 0")(lambda s, d: G.part_graph(s, d).isolated())
_query("graph_problems", None)(lambda s, d: G.part_graph(s, d).problems())
_query(
    "max_degrees",
    f"""WITH {_NATION}, o AS (SELECT src, count(*) AS n, sum(w) AS w FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n, sum(w) AS w FROM e GROUP BY 1)
SELECT (SELECT max(n) FROM o) AS max_degree, (SELECT max(w) FROM o) AS max_weighted_degree, (SELECT max(n) FROM i) AS max_in_degree, (SELECT max(w) FROM i) AS max_weighted_in_degree""",
)(lambda s, d: tools.max_degrees(G.nation_graph(s, d)))
_query("density", f"WITH {_ALL} SELECT round(2.0 * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 9) AS density FROM v")(
    lambda s, d: _rounded(tools.density(G.part_graph(s, d)), "density", digits=9)
)
_query("volume", f"WITH {_ALL} SELECT 2 * sum(w) AS volume FROM e")(lambda s, d: tools.volume(G.part_graph(s, d)))
_query("degree_distribution", f"WITH {_ALL} SELECT degree, count(*) AS nodes FROM d GROUP BY 1")(lambda s, d: degree.degree_distribution(G.part_graph(s, d)))

# -- transforms -------------------------------------------------------------------------------------------------------

_query("subgraph", f"WITH {_ALL} SELECT src, dst, w FROM e WHERE src % 3 = 0 AND dst % 3 = 0")(
    lambda s, d: tools.subgraph(g := G.part_graph(s, d), g.vertices.where("id % 3 = 0")).edges
)
_query("subgraph_neighbours", f"WITH {_ALL} SELECT src, dst, w FROM e WHERE src % 7 = 0 OR dst % 7 = 0")(
    lambda s, d: tools.subgraph_and_neighbours(g := G.part_graph(s, d), g.vertices.where("id % 7 = 0")).edges
)
_query("transpose", f"WITH {_NATION} SELECT dst AS src, src AS dst, w FROM e")(lambda s, d: tools.transpose(G.nation_graph(s, d)).edges)
_query("to_undirected", f"WITH {_NATION} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, w FROM e")(lambda s, d: tools.to_undirected(G.nation_graph(s, d)).edges)
_query("remove_self_loops", f"WITH {_NATION} SELECT src, dst, w FROM e WHERE src <> dst")(lambda s, d: G.nation_graph(s, d).remove_self_loops().edges)
_query("append", f"WITH {_NATION} SELECT src, dst, w FROM e UNION ALL SELECT src + n, dst + n, w FROM e, (SELECT max(id) + 1 AS n FROM v)")(
    lambda s, d: tools.append(g := G.nation_graph(s, d), g).edges
)
_query(
    "remove_nodes", f"WITH {_ALL} SELECT src, dst, w FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0"
)(lambda s, d: (g := G.part_graph(s, d)).remove_nodes(g.vertices.where("id % 5 = 0")).edges)
_query(
    "compacted",
    f"WITH {_ALL}, c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM d WHERE degree > 0), o AS MATERIALIZED (SELECT x.n AS src, y.n AS dst, w FROM e JOIN c x ON x.id = src JOIN c y ON y.id = dst) SELECT * FROM o",
)(lambda s, d: tools.compacted(tools.subgraph(g := G.part_graph(s, d), g.degrees().where("degree > 0")))[0].edges)
_query(
    "graph_difference",
    f"""WITH e1 AS (SELECT src, dst, w FROM (WITH {_part(1)} SELECT * FROM e)), e2 AS (SELECT src, dst, w FROM (WITH {_part(2)} SELECT * FROM e))
SELECT 'EDGE_REMOVAL' AS type, src AS u, dst AS v, CAST(NULL AS DOUBLE) AS w FROM e1 WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e2)""",
)(lambda s, d: tools.difference(G.part_graph(s, d), G.part_graph(s, d, 2)))

# -- node measures ----------------------------------------------------------------------------------------------------

_query("degree_centrality", f"WITH {_ALL} SELECT id, round(degree / (SELECT CAST(count(*) AS DOUBLE) FROM v), 9) AS score FROM d")(
    lambda s, d: _rounded(degree.degree_centrality(G.part_graph(s, d)), "score", digits=9)
)
_query(
    "sfigality",
    f"WITH {_ALL}, s AS (SELECT a.src, avg(CASE WHEN y.degree > x.degree THEN 1.0 ELSE 0.0 END) AS score FROM a JOIN d x ON x.id = a.src JOIN d y ON y.id = a.dst GROUP BY 1) SELECT id, round(score, 6) AS score FROM v LEFT JOIN s ON id = src",
)(lambda s, d: _rounded(degree.sfigality(_whole(s, d)), "score"))
_query(
    "laplacian_centrality",
    f"WITH {_ALL} SELECT x.id, CAST(any_value(floor(x.wd) * floor(x.wd)) + coalesce(sum(a.w * (a.w + 2 * floor(y.wd))), 0) AS DOUBLE) AS score FROM d x LEFT JOIN a ON a.src = x.id LEFT JOIN d y ON y.id = a.dst GROUP BY 1",
)(lambda s, d: degree.laplacian_centrality(_whole(s, d)))
_query("degree_ranking", f"WITH {_ALL} SELECT id, degree AS score, row_number() OVER (ORDER BY degree DESC, id) - 1 AS place FROM d")(
    lambda s, d: degree.ranking(G.part_graph(s, d).degrees().select("id", F.col("degree").alias("score")))
)
_query(
    "fractional_ranks",
    f"WITH {_ALL} SELECT id, degree AS score, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS rank FROM d",
)(lambda s, d: degree.fractional_ranks(G.part_graph(s, d).degrees().select("id", F.col("degree").alias("score"))))
_query(
    "gini_degree",
    f"WITH {_ALL}, r AS (SELECT degree AS x, row_number() OVER (ORDER BY degree) AS i FROM d) SELECT round(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r",
)(lambda s, d: _rounded(degree.gini(G.part_graph(s, d).degrees(), "degree"), "gini"))
_query("assortativity_degree", f"WITH {_ALL} SELECT round(corr(x.degree, y.degree), 6) AS assortativity FROM e JOIN d x ON x.id = src JOIN d y ON y.id = dst")(
    lambda s, d: _rounded(degree.assortativity(g := _whole(s, d), g.degrees().select("id", F.col("degree").alias("value"))), "assortativity")
)
_query(
    "assortativity_nominal",
    f"""WITH {_ALL}, {_BRAND}, m AS (SELECT x.label AS p, y.label AS q, count(*) AS n FROM a JOIN b x ON x.id = src JOIN b y ON y.id = dst GROUP BY 1, 2),
s AS (SELECT sum(n) AS t, sum(n) FILTER (p = q) AS same FROM m), r AS (SELECT p, sum(n) AS n FROM m GROUP BY 1), c AS (SELECT q, sum(n) AS n FROM m GROUP BY 1),
ch AS (SELECT sum(r.n * c.n) AS ab FROM r JOIN c ON p = q)
SELECT round((1.0 * same / t - 1.0 * ab / (t * t)) / (1 - 1.0 * ab / (t * t)), 6) AS assortativity FROM s, ch""",
)(lambda s, d: _rounded(degree.assortativity_nominal(_whole(s, d), _labels(s, d)), "assortativity"))
_query(
    "degree_summary",
    f"WITH {_ALL} SELECT count(*) AS n, CAST(min(degree) AS DOUBLE) AS least, quantile_cont(CAST(degree AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(degree AS DOUBLE), 0.5) AS median, quantile_cont(CAST(degree AS DOUBLE), 0.75) AS q3, CAST(max(degree) AS DOUBLE) AS greatest, round(avg(degree), 6) AS mean, round(stddev_samp(degree), 6) AS deviation FROM d",
)(lambda s, d: _rounded(degree.summary(G.part_graph(s, d).degrees(), "degree").drop("skewness", "kurtosis"), "mean", "deviation"))

# -- triangles and edge scores ----------------------------------------------------------------------------------------

_query("triangles_edge", f"WITH {_ALL}, {_TRIANGLES} SELECT src, dst, t AS score FROM ts")(lambda s, d: triangles.triangle_edge_score(_whole(s, d)))
_query("triangles_node", f"WITH {_ALL}, {_TRIANGLES} SELECT id, t AS triangles FROM tv")(lambda s, d: triangles.node_triangles(_whole(s, d)))
_query(
    "local_clustering",
    f"WITH {_ALL}, {_TRIANGLES} SELECT id, CASE WHEN degree > 1 THEN CAST(2 * t AS DOUBLE) / (degree * (degree - 1)) ELSE 0.0 END AS score FROM tv JOIN d USING (id)",
)(lambda s, d: triangles.local_clustering(_whole(s, d)))
_query(
    "clustering",
    f"""WITH {_ALL}, {_TRIANGLES} SELECT round(avg(CASE WHEN degree > 1 THEN 2.0 * t / (degree * (degree - 1)) ELSE 0.0 END), 6) AS average_local,
round(sum(t) / sum(degree * (degree - 1) / 2.0), 6) AS global FROM tv JOIN d USING (id)""",
)(lambda s, d: _rounded(triangles.clustering(_whole(s, d)), "average_local", "global"))
_query(
    "quadrangles_edge",
    f"""WITH {_ALL} SELECT e.src, e.dst, count(z.src) AS score FROM e LEFT JOIN a x ON x.src = e.src AND x.dst <> e.dst LEFT JOIN a y ON y.src = e.dst AND y.dst <> e.src AND y.dst <> x.dst
LEFT JOIN a z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1, 2""",
)(lambda s, d: triangles.quadrangle_edge_score(_whole(s, d)))
_query(
    "jaccard_distance",
    f"WITH {_ALL}, {_TRIANGLES} SELECT src, dst, 1 - CAST(t AS DOUBLE) / (x.degree + y.degree - t) AS score FROM ts JOIN d x ON x.id = src JOIN d y ON y.id = dst",
)(lambda s, d: triangles.jaccard_distance(_whole(s, d)))
_query(
    "adamic_adar_distance",
    f"""WITH {_ALL}, {_TRIANGLES}, u AS (SELECT a AS src, b AS dst, c AS id FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, c, a FROM tri),
s AS (SELECT src, dst, 1 / sum(1 / ln(degree)) AS score FROM u JOIN d USING (id) GROUP BY 1, 2) SELECT e.src, e.dst, round(score, 6) AS score FROM e LEFT JOIN s USING (src, dst)""",
)(lambda s, d: _rounded(triangles.adamic_adar_distance(_whole(s, d)), "score"))
_query(
    "scan_score",
    f"WITH {_ALL}, {_TRIANGLES} SELECT src, dst, (t + 1) / sqrt((x.degree + 1) * (y.degree + 1)) AS score FROM ts JOIN d x ON x.id = src JOIN d y ON y.id = dst",
)(lambda s, d: triangles.scan_score(_whole(s, d)))
_query(
    "chance_corrected_triangles",
    f"""WITH {_ALL}, {_TRIANGLES} SELECT src, dst, CASE WHEN t > 0 THEN CAST(t * ((SELECT count(*) FROM v) - 2) AS DOUBLE) / ((x.degree - 1) * (y.degree - 1)) WHEN x.degree = 1 OR y.degree = 1 THEN 1.0 ELSE 0.0 END AS score
FROM ts JOIN d x ON x.id = src JOIN d y ON y.id = dst""",
)(lambda s, d: triangles.chance_corrected_triangles(_whole(s, d)))
_query(
    "geometric_mean_score",
    f"WITH {_ALL}, o AS MATERIALIZED (SELECT src, dst, w / sqrt(x.wd * y.wd) AS score FROM e JOIN d x ON x.id = src JOIN d y ON y.id = dst) SELECT * FROM o",
)(lambda s, d: triangles.geometric_mean_score(g := _whole(s, d), g.edges.select("src", "dst", F.col("w").alias("score"))))
_query(
    "multiscale_score",
    f"""WITH {_ALL}, o AS MATERIALIZED (SELECT src, dst, round(greatest(1 - pow(1 - w / x.wd, x.degree - 1), 1 - pow(1 - w / y.wd, y.degree - 1)), 6) AS score
FROM e JOIN d x ON x.id = src JOIN d y ON y.id = dst) SELECT * FROM o""",
)(lambda s, d: _rounded(triangles.multiscale_score(g := _whole(s, d), g.edges.select("src", "dst", F.col("w").alias("score"))), "score"))
_LOCAL = """r AS (SELECT least(src, dst) AS s, greatest(src, dst) AS t, rank() OVER (PARTITION BY src ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY src) AS k FROM o)
SELECT s AS src, t AS dst, round(max(CASE WHEN k > 1 THEN 1 - ln(r) / ln(k) ELSE 1.0 END), 6) AS score FROM r GROUP BY 1, 2"""
_query("local_degree_score", f"WITH {_ALL}, o AS (SELECT src, dst, degree AS score FROM a JOIN d ON id = dst), {_LOCAL}")(
    lambda s, d: _rounded(triangles.local_degree_score(_whole(s, d)), "score")
)
_query("local_filter_score", f"WITH {_ALL}, o AS (SELECT src, dst, w AS score FROM a), {_LOCAL}")(
    lambda s, d: _rounded(triangles.local_filter_score(g := _whole(s, d), g.edges.select("src", "dst", F.col("w").alias("score"))), "score")
)
_query(
    "simmelian_overlap",
    f"""WITH {_ALL}, {_TRIANGLES}, ta AS (SELECT src, dst, t FROM ts UNION ALL SELECT dst, src, t FROM ts),
r AS (SELECT src, dst FROM ta QUALIFY rank() OVER (PARTITION BY src ORDER BY t DESC) <= 10)
SELECT e.src, e.dst, count(y.src) AS score FROM e LEFT JOIN r x ON x.src = e.src AND x.dst <> e.dst LEFT JOIN r y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2""",
)(lambda s, d: triangles.simmelian_overlap_score(g := _whole(s, d), triangles.triangle_edge_score(g)))
_query("normalized_scores", f"WITH {_ALL} SELECT src, dst, round((w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()), 6) AS score FROM e")(
    lambda s, d: _rounded(triangles.normalized_scores(_whole(s, d).edges.select("src", "dst", F.col("w").alias("score"))), "score")
)
_query(
    "sparsify_scan",
    f"""WITH {_ALL}, {_TRIANGLES}, s AS (SELECT src, dst, w, (t + 1) / sqrt((x.degree + 1) * (y.degree + 1)) AS score FROM ts JOIN d x ON x.id = src JOIN d y ON y.id = dst)
SELECT src, dst, w FROM s WHERE score >= 0.4""",
)(lambda s, d: triangles.threshold_filter(g := _whole(s, d), triangles.scan_score(g), 0.4).edges)
_query("sparsify_local_degree", None)(lambda s, d: triangles.sparsified(g := _whole(s, d), triangles.local_degree_score(g), 0.3).edges)
_query("prefix_jaccard", None)(lambda s, d: triangles.prefix_jaccard_score(g := _whole(s, d), triangles.triangle_edge_score(g)))

# -- link prediction --------------------------------------------------------------------------------------------------

_MISSING = "n AS MATERIALIZED (SELECT DISTINCT x.dst AS u, y.dst AS v FROM a x JOIN a y ON x.src = y.src AND x.dst < y.dst ANTI JOIN a z ON z.src = x.dst AND z.dst = y.dst)"
_query("missing_links", f"WITH {_ALL}, {_MISSING} SELECT u, v FROM n")(lambda s, d: links.missing_links(_whole(s, d)))
_query(
    "pair_features",
    f"""WITH {_ALL}, c AS (SELECT e.src AS u, e.dst AS v, count(y.src) AS c, coalesce(sum(1 / ln(d.degree)) FILTER (y.src IS NOT NULL), 0) AS aa, coalesce(sum(1.0 / d.degree) FILTER (y.src IS NOT NULL), 0) AS ra
FROM e JOIN a x ON x.src = e.src LEFT JOIN a y ON y.src = e.dst AND y.dst = x.dst LEFT JOIN d ON d.id = x.dst GROUP BY 1, 2)
SELECT u, v, c AS common_neighbors, p.degree + q.degree - c AS total_neighbors, round(1.0 * c / (p.degree + q.degree - c), 9) AS jaccard, round(aa, 9) AS adamic_adar, round(ra, 9) AS resource_allocation,
p.degree * q.degree AS preferential_attachment, round(c / sqrt(p.degree * q.degree), 9) AS neighborhood_distance, p.degree AS u_degree, q.degree AS v_degree
FROM c JOIN d p ON p.id = u JOIN d q ON q.id = v""",
)(
    lambda s, d: _rounded(
        links.edge_features(_whole(s, d)), "jaccard", "adamic_adar", "resource_allocation", "neighborhood_distance", digits=9
    )
)
_AUC_PAIRS = "p AS (SELECT src AS u, dst AS v, 1 AS label FROM e UNION ALL SELECT u, v, 0 FROM n)"
_SCORED = f"{_MISSING}, {_AUC_PAIRS}, sc AS (SELECT x.degree * y.degree AS score, label FROM p JOIN d x ON x.id = u JOIN d y ON y.id = v)"


def _scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _whole(spark, sf_dir)
    pairs = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("label")).unionByName(links.missing_links(g).withColumn("label", F.lit(0)))
    return links.attachment_scores(g, pairs).select("score", "label")


_CURVE = "g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1), k AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(pos) FROM g) AS p, (SELECT sum(neg) FROM g) AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
_query("roc_curve", f"WITH {_ALL}, {_SCORED}, {_CURVE} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM k")(
    lambda s, d: _rounded(links.roc_curve(_scored_pairs(s, d)), "fpr", "tpr")
)
_query("precision_recall_curve", f"WITH {_ALL}, {_SCORED}, {_CURVE} SELECT score, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM k")(
    lambda s, d: _rounded(links.precision_recall_curve(_scored_pairs(s, d)), "recall", "precision")
)
_query(
    "auc",
    f"WITH {_ALL}, {_SCORED}, {_CURVE}, x AS (SELECT fp / n AS f, tp / p AS t, coalesce(lag(fp / n) OVER w, 0) AS f0, coalesce(lag(tp / p) OVER w, 0) AS t0 FROM k WINDOW w AS (ORDER BY score DESC)) SELECT round(sum((f - f0) * (t + t0) / 2), 6) AS auc FROM x",
)(lambda s, d: _rounded(links.area_under_roc(_scored_pairs(s, d)), "auc"))

# -- communities ------------------------------------------------------------------------------------------------------

_LE = f"{_BRAND}, le AS MATERIALIZED (SELECT src, dst, w, x.label AS a1, y.label AS b1 FROM e JOIN b x ON x.id = src JOIN b y ON y.id = dst)"
_LT = f"""{_LE}, lt AS MATERIALIZED (SELECT z.label, z.size, coalesce(i.w, 0.0) AS inner_w, coalesce(i.n, 0) AS inner_n, coalesce(c.w, 0.0) AS cut, 2 * coalesce(i.w, 0.0) + coalesce(c.w, 0.0) AS vol
FROM (SELECT label, count(*) AS size FROM b GROUP BY 1) z LEFT JOIN (SELECT a1 AS label, sum(w) AS w, count(*) AS n FROM le WHERE a1 = b1 GROUP BY 1) i USING (label)
LEFT JOIN (SELECT label, sum(w) AS w FROM (SELECT a1 AS label, w FROM le WHERE a1 <> b1 UNION ALL SELECT b1, w FROM le WHERE a1 <> b1) GROUP BY 1) c USING (label))"""
_query("coverage", f"WITH {_ALL}, {_LE} SELECT round(coalesce(sum(w) FILTER (a1 = b1), 0) / sum(w), 6) AS coverage FROM le")(
    lambda s, d: _rounded(communities.coverage(_whole(s, d), _labels(s, d)), "coverage")
)
_query("modularity", f"WITH {_ALL}, {_LT} SELECT round(sum(inner_w) / (sum(vol) / 2) - sum(vol * vol) / (sum(vol) * sum(vol)), 6) AS modularity FROM lt")(
    lambda s, d: _rounded(communities.modularity(_whole(s, d), _labels(s, d)), "modularity")
)
_query("edge_cut", f"WITH {_ALL}, {_LE} SELECT sum(w) FILTER (a1 <> b1) AS edge_cut FROM le")(lambda s, d: communities.edge_cut(_whole(s, d), _labels(s, d)))
_query("conductances", f"WITH {_ALL}, {_LT}, x AS (SELECT *, sum(vol) OVER () AS s FROM lt) SELECT label, round(CASE WHEN least(vol, s - vol) > 0 THEN cut / least(vol, s - vol) ELSE 1.0 END, 6) AS score FROM x")(
    lambda s, d: _rounded(communities.conductances(_whole(s, d), _labels(s, d)), "score")
)
_query("expansions", f"WITH {_ALL}, {_LT}, x AS (SELECT *, sum(size) OVER () AS s FROM lt) SELECT label, round(cut / least(size, s - size), 6) AS score FROM x")(
    lambda s, d: _rounded(communities.expansions(_whole(s, d), _labels(s, d)), "score")
)
_query("intra_density", f"WITH {_ALL}, {_LT} SELECT label, round(CASE WHEN size > 1 THEN inner_n / (size * (size - 1) / 2.0) ELSE 1.0 END, 6) AS score FROM lt")(
    lambda s, d: _rounded(communities.intra_density(_whole(s, d), _labels(s, d)), "score")
)
_query(
    "hub_dominance",
    f"""WITH {_ALL}, {_LE}, z AS (SELECT label, count(*) AS size FROM b GROUP BY 1), i AS (SELECT a1 AS label, src AS id FROM le WHERE a1 = b1 UNION ALL SELECT a1, dst FROM le WHERE a1 = b1),
m AS (SELECT label, max(n) AS n FROM (SELECT label, id, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1)
SELECT z.label, round(CASE WHEN size > 1 THEN coalesce(n, 0) / (size - 1.0) ELSE 1.0 END, 6) AS score FROM z LEFT JOIN m USING (label)""",
)(lambda s, d: _rounded(communities.hub_dominance(_whole(s, d), _labels(s, d)), "score"))
_query(
    "stable_nodes",
    f"""WITH {_ALL}, {_BRAND}, w AS (SELECT src AS id, y.label AS tl, sum(w) AS w FROM a JOIN b y ON y.id = dst GROUP BY 1, 2),
s AS (SELECT id, coalesce(max(w) FILTER (tl = label), 0) AS own, coalesce(max(w) FILTER (tl <> label), 0) AS other FROM w JOIN b USING (id) GROUP BY 1)
SELECT b.id, CASE WHEN s.id IS NULL OR own > other THEN 1 ELSE 0 END AS stable FROM b LEFT JOIN s USING (id)""",
)(lambda s, d: communities.stable_nodes(_whole(s, d), _labels(s, d)))
_query(
    "local_coverage",
    f"WITH {_ALL}, {_BRAND}, s AS (SELECT src, coalesce(sum(w) FILTER (x.label = y.label), 0) / sum(w) AS score FROM a JOIN b x ON x.id = src JOIN b y ON y.id = dst GROUP BY 1) SELECT id, round(score, 6) AS score FROM v LEFT JOIN s ON src = id",
)(lambda s, d: _rounded(communities.local_coverage(_whole(s, d), _labels(s, d)), "score"))
_query("coarsened", f"WITH {_ALL}, {_LE} SELECT least(a1, b1) AS src, greatest(a1, b1) AS dst, sum(w) AS w FROM le GROUP BY 1, 2")(
    lambda s, d: communities.coarsened(_whole(s, d), _labels(s, d)).edges
)
_query("partition_intersection", f"WITH {_BRAND} SELECT b.id, min(b.id) OVER (PARTITION BY b.label, t.label) AS label FROM b JOIN t USING (id)")(
    lambda s, d: communities.intersection(_labels(s, d), _labels(s, d, "p_type"))
)
_PAIRS = f"""{_BRAND}, n AS (SELECT b.label AS x, t.label AS y, count(*) AS n FROM b JOIN t USING (id) GROUP BY 1, 2),
c AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM n) AS s, (SELECT sum(k * (k - 1) / 2.0) FROM (SELECT sum(n) AS k FROM n GROUP BY x)) AS f,
(SELECT sum(k * (k - 1) / 2.0) FROM (SELECT sum(n) AS k FROM n GROUP BY y)) AS g, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM n) AS p)"""
_query("jaccard_dissimilarity", f"WITH {_PAIRS} SELECT round(1 - s / (f + g - s), 6) AS distance FROM c")(
    lambda s, d: _rounded(communities.jaccard_dissimilarity(_labels(s, d), _labels(s, d, "p_type")), "distance")
)
_query("rand_dissimilarity", f"WITH {_PAIRS} SELECT round((f + g - 2 * s) / p, 6) AS distance FROM c")(
    lambda s, d: _rounded(communities.rand_dissimilarity(_labels(s, d), _labels(s, d, "p_type")), "distance")
)
_query("adjusted_rand", f"WITH {_PAIRS} SELECT round(1 - (s - f * g / p) / ((f + g) / 2 - f * g / p), 6) AS distance FROM c")(
    lambda s, d: _rounded(communities.adjusted_rand_dissimilarity(_labels(s, d), _labels(s, d, "p_type")), "distance")
)
_query(
    "nmi_distance",
    f"""WITH {_PAIRS}, t1 AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM n), xs AS (SELECT x, sum(n) AS nx FROM n GROUP BY 1), ys AS (SELECT y, sum(n) AS ny FROM n GROUP BY 1),
h AS (SELECT (SELECT -sum(nx / t * log2(nx / t)) FROM xs, t1) AS hx, (SELECT -sum(ny / t * log2(ny / t)) FROM ys, t1) AS hy, (SELECT sum(n / t * log2(n * t / (nx * ny))) FROM n JOIN xs USING (x) JOIN ys USING (y), t1) AS mi)
SELECT round(1 - 2 * mi / (hx + hy), 6) AS distance FROM h""",
)(lambda s, d: _rounded(communities.nmi_distance(_labels(s, d), _labels(s, d, "p_type")), "distance"))
_query(
    "graph_rand",
    f"WITH {_ALL}, {_BRAND} SELECT round(avg(CASE WHEN (x.label = y.label) <> (p.label = q.label) THEN 1.0 ELSE 0.0 END), 6) AS distance FROM e JOIN b x ON x.id = src JOIN b y ON y.id = dst JOIN t p ON p.id = src JOIN t q ON q.id = dst",
)(lambda s, d: _rounded(communities.graph_rand_dissimilarity(_whole(s, d), _labels(s, d), _labels(s, d, "p_type")), "distance"))


def _lpa_sql(rounds: int) -> str:
    parts = ["l0 AS (SELECT id, id AS label FROM v)"]
    for i in range(rounds):
        parts.append(
            f"m{i} AS (SELECT id, label FROM (SELECT src AS id, label, sum(w) AS w FROM a JOIN l{i} ON l{i}.id = dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1), "
            f"l{i + 1} AS MATERIALIZED (SELECT l{i}.id, coalesce(m{i}.label, l{i}.label) AS label FROM l{i} LEFT JOIN m{i} USING (id))"
        )
    return f"WITH {_ALL}, {', '.join(parts)} SELECT id, label FROM l{rounds}"


_query("label_propagation_3", _lpa_sql(3))(lambda s, d: communities.label_propagation(_whole(s, d), 3))
_query("louvain", None)(lambda s, d: communities.louvain(_whole(s, d)))

# -- traversal --------------------------------------------------------------------------------------------------------

_query(
    "bfs",
    f"WITH RECURSIVE {_ALL}, r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS n UNION SELECT dst, n + 1 FROM r JOIN a ON src = r.id WHERE n < 20) SELECT v.id, min(n) AS distance FROM v LEFT JOIN r ON r.id = v.id GROUP BY 1",
)(lambda s, d: traversal.bfs(_whole(s, d), 1))


def _sssp_sql(rounds: int) -> str:
    parts = ["r0 AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS x)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM r{i} UNION ALL SELECT dst, x + w FROM r{i} JOIN a ON src = id) GROUP BY 1)")
    return f"WITH {_ALL}, {', '.join(parts)} SELECT v.id, x AS distance FROM v LEFT JOIN r{rounds} ON r{rounds}.id = v.id"


_query("distance_between", f"SELECT CAST(1 AS BIGINT) AS source, CAST(42 AS BIGINT) AS target, (SELECT distance FROM ({_sssp_sql(24)}) WHERE id = 42) AS distance")(
    lambda s, d: distances.distance_between(_whole(s, d), 1, 42)
)
_query(
    "steps_between",
    f"WITH RECURSIVE {_ALL}, r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS n UNION SELECT dst, n + 1 FROM r JOIN a ON src = r.id WHERE n < 20) SELECT CAST(1 AS BIGINT) AS source, CAST(42 AS BIGINT) AS target, (SELECT min(n) FROM r WHERE id = 42) AS distance",
)(lambda s, d: distances.steps_between(_whole(s, d), 1, 42))
_query("nearest_100", f"SELECT id, distance FROM ({_sssp_sql(24)}) WHERE distance IS NOT NULL ORDER BY distance, id LIMIT 100")(lambda s, d: distances.nearest(_whole(s, d), 1, 100))
_query(
    "all_pairs_distances",
    f"WITH RECURSIVE {_NATION}, k0 AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM a UNION ALL SELECT id, id, 0.0 FROM v) GROUP BY 1, 2), "
    + ", ".join(f"k{i + 1} AS MATERIALIZED (SELECT x.src, y.dst, min(x.w + y.w) AS w FROM k{i} x JOIN k{i} y ON x.dst = y.src GROUP BY 1, 2)" for i in range(5))
    + " SELECT src, dst, w AS distance FROM k5",
)(lambda s, d: distances.all_pairs(G.nation_graph(s, d)))
_query("dijkstra", _sssp_sql(24))(lambda s, d: traversal.dijkstra(_whole(s, d), 1))
def _components_sql(rounds: int) -> str:
    parts = ["c0 AS (SELECT id, id AS c FROM v)"]
    for i in range(rounds):
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT id, c FROM c{i} UNION ALL SELECT dst, c FROM a JOIN c{i} ON src = id) GROUP BY 1)")
    return ", ".join(parts)


_query("connected_components", f"WITH {_ALL}, {_components_sql(16)} SELECT id, c AS component FROM c16")(lambda s, d: traversal.components(_whole(s, d)))
_query("component_sizes", f"WITH {_ALL}, {_components_sql(16)} SELECT c AS component, count(*) AS size FROM c16 GROUP BY 1")(
    lambda s, d: traversal.component_sizes(traversal.components(_whole(s, d)))
)
_HEAVY = f"{_NATION}, h AS (SELECT src, dst, w FROM e WHERE w > (SELECT avg(w) FROM e)), q AS (SELECT src AS i, dst AS j FROM h UNION SELECT q.i, h.dst FROM q JOIN h ON h.src = q.j)"


def _heavy(spark: SparkSession, sf_dir: str) -> G.PropertyGraph:
    """Trade above the mean."""
    g = G.nation_graph(spark, sf_dir)
    mean = g.edges.agg(F.avg("w").alias("m"))
    return g.with_edges(g.edges.join(F.broadcast(mean)).where("w > m").drop("m"))


_query(
    "strong_components",
    f"WITH RECURSIVE {_HEAVY}, s AS (SELECT x.i, min(x.j) AS m FROM q x JOIN q y ON x.i = y.j AND x.j = y.i GROUP BY 1) SELECT id, least(id, coalesce(m, id)) AS component FROM v LEFT JOIN s ON i = id",
)(lambda s, d: traversal.strong_components(_heavy(s, d)))
_query(
    "reachable_counts",
    f"WITH RECURSIVE {_HEAVY}, p AS (SELECT i, j FROM q UNION SELECT id, id FROM v) SELECT i AS id, count(*) AS reachable FROM p GROUP BY 1",
)(lambda s, d: traversal.reachable_counts(_heavy(s, d)))
#: Distances up to 4 between all pairs: few are beyond 2 steps, so only these are looked up one by one.
_DIST = """n2 AS MATERIALIZED (SELECT DISTINCT x.src AS s, y.dst AS t FROM a x JOIN a y ON x.dst = y.src WHERE x.src <> y.dst),
q2 AS MATERIALIZED (SELECT s, t FROM n2 UNION SELECT src, dst FROM a), u2 AS MATERIALIZED (SELECT x.id AS s, y.id AS t FROM v x, v y WHERE x.id <> y.id EXCEPT SELECT s, t FROM q2),
n3 AS MATERIALIZED (SELECT DISTINCT u2.s, u2.t FROM u2 JOIN a ON a.src = u2.s JOIN q2 ON q2.s = a.dst AND q2.t = u2.t), u3 AS (SELECT s, t FROM u2 EXCEPT SELECT s, t FROM n3),
n4 AS (SELECT DISTINCT u3.s, u3.t FROM u3 JOIN a ON a.src = u3.s JOIN n3 ON n3.s = a.dst AND n3.t = u3.t),
m AS MATERIALIZED (SELECT src AS s, dst AS id, 1 AS n FROM a UNION ALL SELECT s, t, 2 FROM (SELECT s, t FROM n2 EXCEPT SELECT src, dst FROM a) UNION ALL SELECT s, t, 3 FROM n3 UNION ALL SELECT s, t, 4 FROM n4)"""
_query("hop_plot", f"WITH {_ALL}, {_DIST}, c AS (SELECT n, count(*) AS k FROM m GROUP BY 1) SELECT n AS distance, CAST(sum(k) OVER (ORDER BY n) AS BIGINT) AS pairs FROM c")(
    lambda s, d: distances.hop_plot(_whole(s, d))
)
_query("diameter", f"WITH {_ALL}, {_DIST} SELECT coalesce(max(n), 0) AS diameter FROM m")(lambda s, d: distances.diameter(_whole(s, d)))
_query(
    "effective_diameter",
    f"WITH {_ALL}, {_DIST}, k AS (SELECT s, n, count(*) AS k FROM m GROUP BY 1, 2), u AS (SELECT s, n, sum(k) OVER (PARTITION BY s ORDER BY n) + 1 AS k FROM k), h AS (SELECT s, min(n) AS h FROM u WHERE k >= (SELECT ceil(0.9 * count(*)) FROM v) GROUP BY 1) SELECT round(avg(h), 6) AS diameter FROM h",
)(lambda s, d: _rounded(distances.effective_diameter(_whole(s, d)), "diameter"))
_query("approximate_hop_plot", None)(lambda s, d: distances.approximate_hop_plot(_whole(s, d)))
_query("approximate_effective_diameter", None)(lambda s, d: distances.approximate_effective_diameter(_whole(s, d)))
_query("approximate_closeness", None)(lambda s, d: distances.approximate_closeness(_whole(s, d)))
_query("algebraic_distances", None)(lambda s, d: distances.algebraic_distances(g := _whole(s, d), g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))


def _core_sql(rounds: int) -> str:
    """Bounds from degrees, each lowered to the h-index of its neighbours' bounds, for that many rounds."""
    steps = ["r0 AS (SELECT id, degree AS core FROM d)"]
    for i in range(rounds):
        steps.append(
            f"h{i} AS (SELECT src AS id, max(least(core, rn)) AS h FROM (SELECT src, core, row_number() OVER (PARTITION BY src ORDER BY core DESC) AS rn FROM a JOIN r{i} ON id = dst) GROUP BY 1), "
            f"r{i + 1} AS MATERIALIZED (SELECT id, least(core, coalesce(h, 0)) AS core FROM r{i} LEFT JOIN h{i} USING (id))"
        )
    return ", ".join(steps)


_query("core_numbers", f"WITH {_ALL}, {_core_sql(30)} SELECT id, core FROM r30")(lambda s, d: traversal.core_numbers(_whole(s, d)))
_query("spanning_forest", None)(lambda s, d: traversal.minimum_spanning_forest(G.part_graph(s, d)))
_query("independent_set", None)(lambda s, d: traversal.independent_set(_whole(s, d)))
_query("heavy_matching", None)(lambda s, d: traversal.heavy_matching(_whole(s, d)))
_query("bipartite", "SELECT count(*) = 0 AS bipartite FROM (SELECT o_custkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE (src < 1000000000) = (dst < 1000000000)")(lambda s, d: traversal.bipartition(G.supply_graph(s, d)))
_query(
    "topological_levels",
    """WITH o AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o FROM orders), l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_orderkey IN (SELECT o FROM o))
SELECT 4 * c AS id, 0 AS level FROM (SELECT DISTINCT c FROM o) UNION ALL SELECT 4 * o + 1, 1 FROM o UNION ALL SELECT 4 * s + 2, 2 FROM (SELECT DISTINCT s FROM l)""",
)(lambda s, d: traversal.topological_levels(G.order_graph(s, d)))
_query("shortest_paths", None)(lambda s, d: traversal.shortest_paths(G.part_graph(s, d), 1))
_query("simple_paths", None)(lambda s, d: traversal.all_simple_paths(_heavy(s, d), 0, 1, 3))

# -- centralities -----------------------------------------------------------------------------------------------------


def _pagerank_sql(base: str, rounds: int) -> str:
    parts = ["o AS (SELECT src, sum(w) AS o FROM a GROUP BY 1)", "p AS MATERIALIZED (SELECT src, dst, w / o AS p FROM a JOIN o USING (src))", "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)", "r0 AS (SELECT id, 1 / n AS x FROM v, n)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT v.id, (0.15 + 0.85 * (SELECT coalesce(sum(x), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o))) / n.n + 0.85 * coalesce(i.x, 0) AS x "
            f"FROM v LEFT JOIN (SELECT dst, sum(p * x) AS x FROM p JOIN r{i} ON id = src GROUP BY 1) i ON i.dst = v.id, n)"
        )
    return f"WITH {base}, {', '.join(parts)} SELECT id, round(x, 9) AS score FROM r{rounds}"


_query("pagerank_20", _pagerank_sql(_ALL, 20))(lambda s, d: _rounded(centrality.pagerank(G.part_graph(s, d), tolerance=None, max_rounds=20), "score", digits=9))
_query("pagerank_nation_20", _pagerank_sql(_NATION, 20))(lambda s, d: _rounded(centrality.pagerank(G.nation_graph(s, d), tolerance=None, max_rounds=20), "score", digits=9))


def _power_sql(rounds: int, step: str, start: str, each: bool) -> str:
    unit = "SELECT id, x / (SELECT sqrt(sum(x * x)) FROM {0}) AS x FROM {0}"
    parts = [f"r0 AS (SELECT id, {start} AS x FROM v)"]
    for i in range(rounds):
        parts.append(f"s{i} AS MATERIALIZED (SELECT v.id, {step.format('coalesce(i.x, 0)')} AS x FROM v LEFT JOIN (SELECT dst, sum({'w * x' if each else 'w * (1 + x)'}) AS x FROM a JOIN r{i} ON id = src GROUP BY 1) i ON i.dst = v.id)")
        parts.append(f"r{i + 1} AS MATERIALIZED ({unit.format(f's{i}') if each else f'SELECT id, x FROM s{i}'})")
    return f"WITH {_NATION}, {', '.join(parts)}, z AS ({unit.format(f'r{rounds}')}) SELECT id, round(x, 6) AS score FROM z"


_query("eigenvector_20", _power_sql(20, "{0}", "1.0 / (SELECT count(*) FROM v)", True))(lambda s, d: _rounded(centrality.eigenvector(G.nation_graph(s, d), 20), "score"))
_query("katz_10", _power_sql(10, "0.1 + 0.000001 * {0}", "1.0", False))(lambda s, d: _rounded(centrality.katz(G.nation_graph(s, d), 1e-6, 0.1, 10), "score"))
_query(
    "closeness",
    f"""WITH {_ALL}, {_DIST}, c AS (SELECT s, sum(n) AS d, count(*) AS r, sum(1.0 / n) AS h FROM m GROUP BY 1)
SELECT id, round(CASE WHEN d > 0 THEN 1.0 * r * r / (d * ((SELECT count(*) FROM v) - 1)) ELSE 0.0 END, 6) AS closeness, round(coalesce(h, 0) / ((SELECT count(*) FROM v) - 1), 6) AS harmonic FROM v LEFT JOIN c ON s = id""",
)(lambda s, d: _rounded(centrality.closeness(_whole(s, d)), "closeness", "harmonic"))
_query(
    "top_harmonic_closeness",
    f"WITH {_ALL}, {_DIST} SELECT s AS id, round(sum(1.0 / n) / ((SELECT count(*) FROM v) - 1), 6) AS score FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)(lambda s, d: _rounded(distances.top_harmonic_closeness(_whole(s, d), 20), "score"))
_query("betweenness", None)(lambda s, d: centrality.betweenness(_heavy(s, d)))
_query("estimated_betweenness", None)(lambda s, d: centrality.estimated_betweenness(_whole(s, d), 16))
_query("approximate_pagerank", None)(lambda s, d: centrality.approximate_pagerank(g := _whole(s, d), g.vertices.where("id = 1")))

# -- more of the whole graph, ranks and parts --------------------------------------------------------------------------

_query("merge", f"WITH {_ALL} SELECT src, dst, CASE WHEN w >= 2 THEN 1.0 ELSE w END AS w FROM e")(
    lambda s, d: tools.merge(tools.to_unweighted(G.part_graph(s, d, 2)), G.part_graph(s, d)).edges.select("src", "dst", "w")
)
_query("augmented", f"WITH {_NATION} SELECT src, dst, w FROM e UNION ALL SELECT -1, id, 1.0 FROM v")(
    lambda s, d: tools.augmented(G.nation_graph(s, d)).edges.select("src", "dst", "w")
)
_query("eccentricity", f"WITH {_ALL}, {_DIST} SELECT v.id, coalesce(m.id, v.id) AS farthest, coalesce(n, 0) AS distance FROM v LEFT JOIN m ON s = v.id QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY n DESC, m.id) = 1")(
    lambda s, d: distances.eccentricity(_whole(s, d))
)
_query("contingency", f"WITH {_BRAND} SELECT b.label AS a, t.label AS b, count(*) AS n FROM b JOIN t USING (id) GROUP BY 1, 2")(
    lambda s, d: communities.contingency(_labels(s, d), _labels(s, d, "p_type"))
)
_query("partition_sizes", f"WITH {_BRAND}, c AS (SELECT count(*) AS size FROM b GROUP BY label) SELECT size, count(*) AS parts FROM c GROUP BY 1")(
    lambda s, d: communities.partition_sizes(_labels(s, d))
)
_query(
    "set_conductance",
    f"""WITH {_ALL}, t AS (SELECT sum(wd) FILTER (id % 10 = 0) AS own, sum(wd) FILTER (id % 10 <> 0) AS rest FROM d), c AS (SELECT sum(w) AS cut FROM a WHERE src % 10 = 0 AND dst % 10 <> 0)
SELECT round(cut / least(own, rest), 6) AS conductance FROM t, c""",
)(lambda s, d: _rounded(communities.set_conductance(g := _whole(s, d), g.vertices.where("id % 10 = 0")), "conductance"))
_query(
    "degree_correlation",
    f"""WITH {_ALL}, r AS (SELECT degree AS x, wd AS y, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS rx,
rank() OVER (ORDER BY wd) + (count(*) OVER (PARTITION BY wd) - 1) / 2.0 AS ry FROM d) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""",
)(
    lambda s, d: _rounded(
        degree.correlation((g := G.part_graph(s, d).degrees()).select("id", F.col("degree").alias("score")), g.select("id", F.col("weighted_degree").alias("score"))), "pearson", "spearman"
    )
)
_query(
    "degree_histogram",
    f"""WITH {_ALL}, x AS (SELECT min(degree) AS lo, max(degree) AS hi FROM d)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((degree - lo) / CAST(hi - lo AS DOUBLE) * 10), 9) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM d, x GROUP BY 1""",
)(lambda s, d: degree.histogram(G.part_graph(s, d).degrees(), 10, "degree"))
_query("degree_centralization", f"WITH {_ALL} SELECT round((count(*) * max(degree) - sum(degree)) / ((count(*) - 1.0) * max(degree)), 6) AS centralization FROM d")(
    lambda s, d: _rounded(degree.centralization(G.part_graph(s, d).degrees().select("id", F.col("degree").cast("double").alias("score"))), "centralization")
)
_query(
    "clustering_per_degree",
    f"WITH {_ALL}, {_TRIANGLES} SELECT degree, round(avg(CASE WHEN degree > 1 THEN 2.0 * t / (degree * (degree - 1)) ELSE 0.0 END), 6) AS score FROM tv JOIN d USING (id) GROUP BY 1",
)(lambda s, d: _rounded(triangles.clustering_per_degree(_whole(s, d)), "score"))
_query("same_community", f"WITH {_ALL}, {_BRAND} SELECT src AS u, dst AS v, CAST(x.label = y.label AS DOUBLE) AS score FROM e JOIN b x ON x.id = src JOIN b y ON y.id = dst")(
    lambda s, d: links.same_community_index(_labels(s, d), _whole(s, d).edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
)

# -- algebra and embeddings -------------------------------------------------------------------------------------------

_query("laplacian_matrix", f"WITH {_NATION}, x AS (SELECT src, dst, w FROM a WHERE src <> dst) SELECT src AS i, dst AS j, -w AS v FROM x UNION ALL SELECT src, src, sum(w) FROM x GROUP BY 1")(
    lambda s, d: semirings.laplacian(G.nation_graph(s, d).arcs())
)
_query("min_plus_square", f"WITH {_NATION} SELECT x.src AS i, y.dst AS j, min(x.w + y.w) AS v FROM a x JOIN a y ON x.dst = y.src GROUP BY 1, 2")(
    lambda s, d: semirings.matrix_matrix(m := semirings.adjacency(G.nation_graph(s, d).arcs()), m, semirings.MIN_PLUS)
)
_query("matrix_vector", f"WITH {_NATION} SELECT src AS i, CAST(sum(w * dst) AS DOUBLE) AS v FROM a GROUP BY 1")(
    lambda s, d: semirings.matrix_vector(semirings.adjacency((g := G.nation_graph(s, d)).arcs()), g.vertices.select(F.col("id").alias("i"), F.col("id").cast("double").alias("v")))
)
_query(
    "random_projection",
    f"""WITH {_NATION}, dm AS (SELECT unnest(range(0, 8)) AS d), h AS (SELECT id, d, (id * 1103515245 + d * 12345 + 12345) % 2147483648 AS h FROM v, dm),
x0 AS (SELECT id, d, CASE h % 6 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS x FROM h), o AS (SELECT src, sum(w) AS o FROM a GROUP BY 1), p AS (SELECT src, dst, w / o AS p FROM a JOIN o USING (src)),
x1 AS (SELECT src AS id, d, sum(p * x) AS x FROM p JOIN x0 ON x0.id = dst GROUP BY 1, 2), x2 AS (SELECT src AS id, d, sum(p * x) AS x FROM p JOIN x1 ON x1.id = dst GROUP BY 1, 2)
SELECT id, CAST(d AS INTEGER) AS d, round(sum(x), 6) AS x FROM (SELECT id, d, 0.0 * x AS x FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY 1, 2""",
)(lambda s, d: _rounded(embedding.fast_random_projection(G.nation_graph(s, d)), "x"))

# -- events -----------------------------------------------------------------------------------------------------------

_query("event_transitions", "SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: events.transitions(s.read.parquet(f"{d}/events.parquet"), "user_id", "event_type", ["ts", "event_id"])
)
_query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")(
    lambda s, d: _rounded(events.windowed_activity(s.read.parquet(f"{d}/events.parquet")), "value", digits=4)
)
_query(
    "event_sessions",
    """WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, k""",
)(lambda s, d: events.sessions(s.read.parquet(f"{d}/events.parquet")))
_TYPES = "CASE event_type WHEN 'click' THEN 'EDGE_ADDITION' WHEN 'purchase' THEN 'EDGE_WEIGHT_INCREMENT' ELSE 'EDGE_REMOVAL' END"
_query(
    "event_replay",
    f"""WITH x AS (SELECT event_id AS seq, {_TYPES} AS type, user_id AS src, CAST(event_id % 7 AS BIGINT) + 1000000 AS dst, value AS w FROM events),
c AS (SELECT *, coalesce(max(seq) FILTER (type = 'EDGE_REMOVAL') OVER (PARTITION BY src, dst), -1) AS cut FROM x),
b AS (SELECT *, max(seq) FILTER (type = 'EDGE_ADDITION') OVER (PARTITION BY src, dst) AS base FROM c WHERE seq > cut)
SELECT src, dst, round(sum(w), 6) AS w FROM b WHERE seq >= base GROUP BY 1, 2""",
)(
    lambda s, d: _rounded(
        events.replay(
            s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.expr(_TYPES).alias("type"), F.col("user_id").alias("u"), (F.col("event_id") % 7 + 1000000).alias("v"), F.col("value").alias("w"))
        ).edges,
        "w",
    )
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty parts with the highest PageRank in the co-purchase graph, with their names."""
    rank = centrality.pagerank(G.part_graph(spark, sf_dir), tolerance=None, max_rounds=20)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    return rank.join(part, "id").orderBy(F.desc("score"), "id").limit(20)


def _all() -> None:
    from loomgraph import catalogue_forms, catalogue_more  # noqa: F401 - they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
