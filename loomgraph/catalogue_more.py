"""More registered graph queries with their DuckDB SQL: results under events, communities by moves, covers, matchings, randomised graphs,
sampled paths and walks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.catalogue import _ALL, _BRAND, _DIST, _NATION, _TRIANGLES, _labels, _pagerank_sql, _query, _rounded, _whole
from loomgraph.functions import algebraic
from loomgraph.operators import bmatching, communities, covers, dynamic, extras, partitioning, sampled, traversal
from loomgraph.plans import randomize
from loomgraph.scratch import materialize, scratch_path

# -- orders as chains, and events on them --------------------------------------------------------------------------------

_CHAINS = """oc AS (SELECT o_orderkey, o_orderstatus, lag(o_orderkey) OVER w AS before, o_orderdate - lag(o_orderdate) OVER w AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
base AS MATERIALIZED (SELECT least(before, o_orderkey) AS src, greatest(before, o_orderkey) AS dst, o_orderstatus AS status FROM oc WHERE gap <= INTERVAL 90 DAY),
ur AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS before FROM orders WHERE o_orderpriority = '1-URGENT'),
added AS (SELECT least(before, o_orderkey) AS src, greatest(before, o_orderkey) AS dst FROM ur WHERE before IS NOT NULL),
nodes AS MATERIALIZED (SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 20000),
links AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst FROM base WHERE status <> 'P' UNION SELECT src, dst FROM added) WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
la AS MATERIALIZED (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains go apart before orders of status P, urgent orders of one day are tied, and cheap orders go."""
    none = F.lit(None).cast("long")
    cut = G.order_chains(spark, sf_dir).edges.where("status = 'P'").select(F.lit(1).cast("long").alias("seq"), F.lit("EDGE_REMOVAL").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"))
    tied = G.urgent_links(spark, sf_dir).select(F.lit(2).cast("long").alias("seq"), F.lit("EDGE_ADDITION").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"))
    gone = _orders(spark, sf_dir).where("o_totalprice < 20000").select(F.lit(3).cast("long").alias("seq"), F.lit("NODE_REMOVAL").alias("type"), F.col("o_orderkey").alias("u"), none.alias("v"))
    return cut.unionByName(tied).unionByName(gone).withColumn("w", F.lit(1.0))


@_query(
    "dynamic_components",
    f"WITH RECURSIVE {_CHAINS}, reach AS (SELECT id, id AS c FROM nodes UNION SELECT dst, c FROM reach JOIN la ON src = id) SELECT id, min(c) AS component FROM reach GROUP BY 1",
)
def dynamic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = dynamic.ComponentStore(spark, scratch_path(spark, "components"), shards=16).create(G.order_chains(spark, sf_dir))
    return store.apply(_order_events(spark, sf_dir)).labels()


@_query(
    "updated_distances",
    f"""WITH RECURSIVE {_CHAINS}, s AS (SELECT least(src, dst) AS id FROM links ORDER BY 1 LIMIT 1), o AS (SELECT o_orderkey AS id FROM orders),
full_links AS (SELECT src, dst FROM (SELECT src, dst FROM base WHERE status <> 'P' UNION SELECT src, dst FROM added)), fa AS MATERIALIZED (SELECT src, dst FROM full_links UNION ALL SELECT dst, src FROM full_links),
r AS (SELECT id, 0 AS n FROM s UNION SELECT fa.dst, n + 1 FROM r JOIN fa ON fa.src = r.id WHERE n < 200) SELECT o.id, CAST(min(n) AS DOUBLE) AS distance FROM o LEFT JOIN r ON r.id = o.id GROUP BY 1""",
)
def updated_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from an order, known before the events and made right after them."""
    old = G.order_chains(spark, sf_dir)
    base = materialize(old.edges, "chains")
    old = G.PropertyGraph(old.vertices, base.select("src", "dst", "w"), False)
    added = materialize(G.urgent_links(spark, sf_dir).join(base.where("status <> 'P'").select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(1.0).alias("w")), "tied")
    removed = base.where("status = 'P'").select("src", "dst", "w").join(added.select("src", "dst"), ["src", "dst"], "left_anti")
    kept = base.where("status <> 'P'").select("src", "dst", "w")
    new = G.PropertyGraph(old.vertices, kept.unionByName(added), False)
    dear = _orders(spark, sf_dir).where("o_totalprice >= 20000").select(F.col("o_orderkey").alias("id"))
    first = new.edges.join(dear.withColumnRenamed("id", "src"), "src", "left_semi").join(dear.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.min("src")).first()[0]
    return dynamic.updated_distances(traversal.bfs(old, first), new, added, removed, weighted=False)


@_query(
    "affected_nodes",
    f"""WITH RECURSIVE {_CHAINS}, ca AS MATERIALIZED (SELECT src, dst FROM base UNION ALL SELECT dst, src FROM base),
e AS (SELECT min(src) AS u, max(dst) AS v FROM base), x AS (SELECT u AS id, 0 AS n FROM e UNION SELECT dst, n + 1 FROM x JOIN ca ON src = id WHERE n < 200),
y AS (SELECT v AS id, 0 AS n FROM e UNION SELECT dst, n + 1 FROM y JOIN ca ON src = id WHERE n < 200),
d AS (SELECT coalesce(x.id, y.id) AS id, min(x.n) AS a, min(y.n) AS b FROM x FULL JOIN y ON x.id = y.id GROUP BY 1)
SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS before, least(a, b) + 1 AS after FROM d WHERE a IS NULL OR b IS NULL OR greatest(a, b) > least(a, b) + 1""",
)
def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edge between the first and the last order in a chain would change."""
    g = G.order_chains(spark, sf_dir)
    ends = g.edges.agg(F.min("src").alias("u"), F.max("dst").alias("v")).first()
    return dynamic.affected_nodes(g, ends["u"], ends["v"])


# -- communities ----------------------------------------------------------------------------------------------------------

@_query("leiden_checks", f"WITH {_ALL} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS disconnected, true AS better_than_brands FROM v")
def leiden_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a community, communities that aren't connected, and whether their modularity is above that of the brands."""
    g = _whole(spark, sf_dir)
    found = partitioning.leiden(g, tolerance=1e-3)
    pieces = partitioning.connected_parts(g, found).join(found.withColumnRenamed("label", "community"), "id").groupBy("community").agg(F.count_distinct("label").alias("n"))
    apart = pieces.agg(F.count(F.when(F.col("n") > 1, 1)).alias("disconnected"))
    worth = communities.modularity(g, found).crossJoin(communities.modularity(g, _labels(spark, sf_dir)).withColumnRenamed("modularity", "brands"))
    return found.agg(F.count("*").alias("nodes")).crossJoin(apart).crossJoin(worth.select((F.col("modularity") > F.col("brands")).alias("better_than_brands")))


_query(
    "codelength",
    f"""WITH {_ALL}, {_BRAND}, m AS (SELECT sum(wd) AS m FROM d), n AS (SELECT sum(CASE WHEN wd > 0 THEN wd / m * log2(wd / m) ELSE 0 END) AS n FROM d, m),
p AS (SELECT label, sum(wd) / max(m) AS p FROM d JOIN b USING (id), m GROUP BY 1), c AS (SELECT x.label, sum(w) / max(m) AS q FROM a JOIN b x ON x.id = src JOIN b y ON y.id = dst, m WHERE x.label <> y.label GROUP BY 1),
pq AS (SELECT label, p, coalesce(q, 0) AS q FROM p LEFT JOIN c USING (label)),
s AS (SELECT sum(q) AS q, sum((p + q) * log2(p + q)) - 2 * sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) AS r FROM pq) SELECT round(q * log2(q) + r - n, 6) AS codelength FROM s, n""",
)(lambda s, d: _rounded(partitioning.codelength(_whole(s, d), _labels(s, d)), "codelength"))
_query("map_equation")(lambda s, d: partitioning.map_equation_communities(_whole(s, d), tolerance=1e-3))

# -- squares, permanence, covers ------------------------------------------------------------------------------------------

_query(
    "square_clustering",
    f"""WITH {_ALL}, p AS MATERIALIZED (SELECT x.src AS u, y.src AS v, count(*) AS c FROM a x JOIN a y ON x.dst = y.dst WHERE x.src <> y.src GROUP BY 1, 2),
q AS (SELECT u AS id, sum(c * (c - 1) // 2) AS s FROM p GROUP BY 1), t AS (SELECT u AS id, sum(c) AS t FROM p JOIN a ON src = u AND dst = v GROUP BY 1),
r AS (SELECT src AS id, sum(degree) AS r FROM a JOIN d ON id = dst GROUP BY 1),
z AS (SELECT d.id, coalesce(s, 0) AS s, (degree - 1) * coalesce(r, 0) - degree * (degree - 1) - coalesce(s, 0) - coalesce(t, 0) AS k FROM d LEFT JOIN q USING (id) LEFT JOIN t USING (id) LEFT JOIN r USING (id))
SELECT id, CASE WHEN k > 0 THEN CAST(s AS DOUBLE) / CAST(k AS DOUBLE) ELSE CAST(s AS DOUBLE) END AS score FROM z""",
)(lambda s, d: covers.square_clustering(_whole(s, d)))
_query(
    "permanence",
    f"""WITH {_ALL}, {_BRAND}, k AS (SELECT src AS id, y.label AS t, count(*) AS k FROM a JOIN b y ON y.id = dst GROUP BY 1, 2),
o AS (SELECT k.id, sum(k) AS deg, coalesce(sum(k) FILTER (t = label), 0) AS own, coalesce(max(k) FILTER (t <> label), 0) AS pull FROM k JOIN b USING (id) GROUP BY 1),
i AS MATERIALIZED (SELECT src, dst FROM e JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE x.label = y.label),
tr AS (SELECT x.src AS p, x.dst AS q, y.dst AS r FROM i x JOIN i y ON y.src = x.dst JOIN i z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT id, count(*) AS n FROM (SELECT p AS id FROM tr UNION ALL SELECT q FROM tr UNION ALL SELECT r FROM tr) GROUP BY 1),
z AS (SELECT v.id, CASE WHEN own > 1 THEN coalesce(n, 0) / (own * (own - 1) / 2.0) ELSE 0.0 END AS c, CASE WHEN deg > 0 THEN CAST(own AS DOUBLE) / greatest(pull, 1) / deg ELSE 0.0 END AS f FROM v LEFT JOIN o USING (id) LEFT JOIN n USING (id))
SELECT id, round(c, 9) AS intra_clustering, round(f - (1 - c), 9) AS permanence FROM z""",
)(lambda s, d: _rounded(covers.permanence(_whole(s, d), _labels(s, d)), "intra_clustering", "permanence", digits=9))
_COVERS = """ca AS (SELECT DISTINCT p_partkey AS id, label FROM (SELECT p_partkey, p_brand AS label FROM part UNION ALL SELECT p_partkey, CAST(p_size // 10 AS VARCHAR) FROM part)),
cb AS (SELECT DISTINCT p_partkey AS id, label FROM (SELECT p_partkey, p_type AS label FROM part UNION ALL SELECT p_partkey, CAST(p_size // 7 AS VARCHAR) FROM part))"""


def _cover(spark: SparkSession, sf_dir: str, column: str, width: int) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.explode(F.array(column, F.floor(F.col("p_size") / width).cast("string"))).alias("label"))


_query(
    "overlapping_nmi",
    f"""WITH {_COVERS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM part), x AS (SELECT label AS a, CAST(count(*) AS DOUBLE) AS x FROM ca GROUP BY 1), y AS (SELECT label AS b, CAST(count(*) AS DOUBLE) AS y FROM cb GROUP BY 1),
k AS (SELECT ca.label AS a, cb.label AS b, CAST(count(*) AS DOUBLE) AS d FROM ca JOIN cb USING (id) GROUP BY 1, 2),
c AS (SELECT a, b, x, y, [n + d - x - y, y - d, x - d, d] AS l, n FROM k JOIN x USING (a) JOIN y USING (b), n),
h AS (SELECT a, b, x, y, n, list_transform(l, lambda v: CASE WHEN v > 0 THEN -v * log2(v / n) ELSE 0 END) AS h FROM c),
o AS (SELECT *, (-x * log2(x / n) - CASE WHEN n > x THEN (n - x) * log2((n - x) / n) ELSE 0 END) AS hx, (-y * log2(y / n) - CASE WHEN n > y THEN (n - y) * log2((n - y) / n) ELSE 0 END) AS hy, h[1] + h[4] >= h[2] + h[3] AS t, list_sum(h) AS j FROM h),
gx AS (SELECT a, max(hx) AS h, least(max(hx), min(CASE WHEN t THEN j - hy ELSE hx END)) AS g FROM o GROUP BY 1), gy AS (SELECT b, max(hy) AS h, least(max(hy), min(CASE WHEN t THEN j - hx ELSE hy END)) AS g FROM o GROUP BY 1),
s AS (SELECT (SELECT sum(h) FROM gx) AS hx, (SELECT sum(h - g) FROM gx) AS ix, (SELECT sum(h) FROM gy) AS hy, (SELECT sum(h - g) FROM gy) AS iy)
SELECT round(1 - (ix + iy) / 2 / greatest(hx, hy), 6) AS distance FROM s""",
)(lambda s, d: _rounded(covers.overlapping_nmi_distance(_cover(s, d, "p_brand", 10), _cover(s, d, "p_type", 7), s.read.parquet(f"{d}/part.parquet")), "distance"))
_query(
    "cover_hub_dominance",
    f"""WITH {_ALL}, {_COVERS}, i AS (SELECT x.label, src, count(*) AS n FROM a JOIN ca x ON x.id = src JOIN ca y ON y.id = dst AND y.label = x.label GROUP BY 1, 2),
m AS (SELECT label, max(n) AS n FROM i GROUP BY 1) SELECT label, CASE WHEN count(*) > 1 THEN CAST(coalesce(max(n), 0) AS DOUBLE) / (count(*) - 1) ELSE 1.0 END AS score FROM ca LEFT JOIN m USING (label) GROUP BY 1""",
)(lambda s, d: covers.cover_hub_dominance(_whole(s, d), _cover(s, d, "p_brand", 10)))
_query("combined_partition", f"WITH {_BRAND} SELECT b.id, min(b.id) OVER (PARTITION BY b.label, t.label) AS label FROM b JOIN t USING (id)")(lambda s, d: covers.combined_partition([_labels(s, d), _labels(s, d, "p_type")]))

# -- matchings, randomised graphs -----------------------------------------------------------------------------------------

_query("b_matching")(lambda s, d: bmatching.b_matching(_whole(s, d), 3))


@_query("b_matching_checks", f"WITH {_ALL} SELECT CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS blocking, (SELECT count(*) FROM v WHERE id IN (SELECT src FROM a)) AS linked")
def b_matching_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with too many mates, mates without an edge, edges left out though they fit; nodes that have a neighbour."""
    g = _whole(spark, sf_dir)
    linked = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("linked"))
    return bmatching.b_matching_problems(g, bmatching.b_matching(g, 3), 3).crossJoin(linked)


_SHUFFLED = f"WITH {_ALL} SELECT id, degree, (SELECT count(*) FROM e) AS edges, CAST(0 AS BIGINT) AS repeated FROM d"


def _kept(g: G.PropertyGraph) -> DataFrame:
    """Every node's degree, the number of edges, and how many are loops or there twice."""
    once = g.edges.where("src <> dst").select("src", "dst").distinct().agg(F.count("*").alias("once"))
    total = g.edges.agg(F.count("*").alias("edges")).crossJoin(once).select("edges", (F.col("edges") - F.col("once")).alias("repeated"))
    return g.degrees().select("id", "degree").crossJoin(F.broadcast(total))


_query("curveball_degrees", _SHUFFLED)(lambda s, d: _kept(randomize.global_curveball(_whole(s, d), 3)))
_query("edge_switching_degrees", _SHUFFLED)(lambda s, d: _kept(randomize.edge_switching(_whole(s, d), 2)))
_query("configuration_degrees", f"WITH {_ALL} SELECT id, degree, (SELECT count(*) FROM e) AS edges FROM d")(lambda s, d: _configured(s, d))


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stubs that each part has in a random pairing with the co-purchase graph's degrees (a loop has two), and the pairs."""
    wanted = materialize(_whole(spark, sf_dir).degrees().select("id", "degree"), "wanted")
    made = randomize.configuration_model(wanted, simple=False)
    stubs = made.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = made.edges.agg(F.count("*").alias("edges"))
    return wanted.select("id").join(stubs, "id", "left").na.fill(0, ["degree"]).crossJoin(F.broadcast(n))


_query(
    "hyperbolic_parts",
    """WITH n AS (SELECT 2 * ln(count(*)) - 2 AS r FROM part), p AS MATERIALIZED (SELECT p_partkey AS id, n.r + ln(p_size / 51.0) AS r, 6.283185307179586 * ((p_partkey * 37) % 1009) / 1009.0 AS phi FROM part, n)
SELECT x.id AS src, y.id AS dst FROM p x JOIN p y ON x.id < y.id, n WHERE cosh(x.r) * cosh(y.r) - sinh(x.r) * sinh(y.r) * cos(x.phi - y.phi) <= cosh(n.r)""",
)(lambda s, d: _hyperbolic(s, d).edges.select("src", "dst"))


def _hyperbolic(spark: SparkSession, sf_dir: str) -> G.PropertyGraph:
    """Parts as points of a hyperbolic disk, out by size and around by key; the disk grows with their number, so that the mean degree
    doesn't."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    radius = 2 * math.log(part.count()) - 2
    points = part.select(F.col("p_partkey").alias("id"), (F.lit(radius) + F.log(F.col("p_size") / 51.0)).alias("r"), (F.lit(6.283185307179586) * ((F.col("p_partkey") * 37) % 1009) / 1009.0).alias("phi"))
    return randomize.hyperbolic_graph(points, radius)


# -- sampled paths and walks ----------------------------------------------------------------------------------------------

_query("sampled_betweenness")(lambda s, d: sampled.sampled_betweenness(_whole(s, d), 0.05).scores)
_query("k_path_visits")(lambda s, d: sampled.simple_path_visits(_whole(s, d), 4, 2000))


def _hash_sql(*keys: str) -> str:
    h = "1"
    for k in keys:
        h = f"((({h} * 48271 + {k} + 11) * 48271) % 2147483647)"
    return f"(({h} + 0.5) / 2147483647.0)"


def _walk_sql(length: int, p: float, q: float) -> str:
    parts = ["r0 AS (SELECT k AS walk, id AS start, 0 AS step, id, CAST(NULL AS BIGINT) AS before FROM v, range(2) t(k))"]
    for i in range(1, length + 1):
        near = "true" if i == 1 else "EXISTS (SELECT 1 FROM a z WHERE z.src = r.before AND z.dst = a.dst)"
        bias = f"CASE WHEN a.dst = r.before THEN {1 / p} WHEN {near} THEN 1.0 ELSE {1 / q} END"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT walk, start, {i} AS step, dst AS id, src AS before FROM (SELECT r.walk, r.start, a.dst, a.src, -ln({_hash_sql('r.walk', 'r.start', str(i), 'a.dst')}) / (a.w * {bias}) AS race "
            f"FROM r{i - 1} r JOIN a ON a.src = r.id) QUALIFY row_number() OVER (PARTITION BY walk, start ORDER BY race, dst) = 1)"
        )
    return f"WITH {_NATION}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT walk, start, step, id FROM r{i}" for i in range(length + 1))


_query("second_order_walks", _walk_sql(5, 0.25, 4.0))(lambda s, d: sampled.second_order_walks(G.nation_graph(s, d), 5, 0.25, 4.0, 2))

# -- edge scores, forests, volumes ----------------------------------------------------------------------------------------

_query("score_ranks", f"WITH {_ALL} SELECT src, dst, row_number() OVER (ORDER BY w DESC, src, dst) - 1 AS rank FROM e")(
    lambda s, d: extras.score_ranks(_whole(s, d).edges.select("src", "dst", F.col("w").alias("score")), reverse=True)
)
_query("same_brand_score", f"WITH {_ALL}, {_BRAND} SELECT src, dst, CAST(CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS DOUBLE) AS score FROM e JOIN b x ON x.id = src JOIN b y ON y.id = dst")(
    lambda s, d: extras.same_part_score(_whole(s, d), _labels(s, d))
)
_query("ball_volumes", f"WITH {_ALL}, {_DIST} SELECT v.id, 1 + count(s) AS n FROM v LEFT JOIN m ON s = v.id AND m.n <= 2 GROUP BY 1")(lambda s, d: extras.ball_volumes(_whole(s, d), 2))

# -- the same by matrices -------------------------------------------------------------------------------------------------

_query("algebraic_triangles", f"WITH {_ALL}, {_TRIANGLES} SELECT count(*) AS triangles FROM tri")(lambda s, d: algebraic.triangles(_whole(s, d)))
_query("algebraic_pagerank", _pagerank_sql(_NATION, 20))(lambda s, d: _rounded(algebraic.pagerank(G.nation_graph(s, d), rounds=20), "score", digits=9))
_query(
    "algebraic_bellman_ford",
    f"""WITH {_NATION}, r0 AS (SELECT CAST(1 AS BIGINT) AS id, 0.0 AS x), {", ".join(f"r{i + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM r{i} UNION ALL SELECT dst, x + w FROM r{i} JOIN a ON src = id) GROUP BY 1)" for i in range(24))}
SELECT id, x AS distance FROM v LEFT JOIN r24 USING (id)""",
)(lambda s, d: algebraic.bellman_ford(G.nation_graph(s, d), 1))
_query("algebraic_bfs", f"WITH RECURSIVE {_ALL}, r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS n UNION SELECT dst, n + 1 FROM r JOIN a ON src = r.id WHERE n < 20) SELECT v.id, CAST(min(n) AS DOUBLE) AS distance FROM v LEFT JOIN r ON r.id = v.id GROUP BY 1")(
    lambda s, d: algebraic.bfs(_whole(s, d), 1)
)
