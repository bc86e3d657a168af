"""Graphs made by hand with known results."""

import pytest
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.functions import semirings
from loomgraph.operators import centrality, communities, degree, links, tools, traversal, triangles
from loomgraph.plans import generators
from loomgraph.streaming import events


def make(spark, edges, n=None, directed=False):
    rows = [(e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for e in edges]
    v = spark.range(n) if n is not None else None
    return G.from_edges(spark.createDataFrame(rows, "src long, dst long, w double"), directed, v)


def values(df, key="id", value="score"):
    return {r[key]: r[value] for r in df.collect()}


KITE = [(0, 2), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5)]
BAUR = [(2, 4), (3, 4), (4, 5), (5, 7), (6, 7), (6, 8), (6, 9), (6, 11), (7, 12), (8, 9), (8, 10), (8, 11), (8, 13), (9, 10), (9, 11), (9, 13), (10, 11), (10, 13), (10, 14), (11, 13), (11, 14), (12, 15), (13, 14), (14, 15)]


def test_betweenness_of_a_kite(spark):
    assert values(centrality.betweenness(make(spark, KITE, 6))) == {0: 0.0, 1: 0.0, 2: 15.0, 3: 3.0, 4: 3.0, 5: 1.0}


def test_cores_and_clustering(spark):
    g = make(spark, BAUR, 16)
    assert [values(traversal.core_numbers(g), value="core")[i] for i in range(16)] == [0, 0, 1, 1, 1, 1, 3, 2, 4, 4, 4, 4, 2, 4, 3, 2]
    lcc = values(triangles.local_clustering(g))
    assert [round(lcc[i], 4) for i in range(16)] == [0, 0, 0, 0, 0, 0, 0.5, 0, 0.8, 0.8, 0.8, 0.6667, 0, 0.8, 0.5, 0]


def test_directed_distances_and_components(spark):
    g = make(spark, [(0, 1, 2), (1, 2, 3), (2, 0, 1), (2, 3, 0)], 5, True)
    assert values(traversal.bfs(g, 0), value="distance") == {0: 0, 1: 1, 2: 2, 3: 3, 4: None}
    assert values(traversal.dijkstra(g, 0), value="distance") == {0: 0.0, 1: 2.0, 2: 5.0, 3: 5.0, 4: None}
    assert values(traversal.strong_components(g), value="component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert values(traversal.components(g), value="component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    paths = {r["target"]: (r["nodeIds"], r["costs"]) for r in traversal.shortest_paths(g, 0).collect()}
    assert paths[3] == ([0, 1, 2, 3], [0.0, 2.0, 5.0, 5.0]) and 4 not in paths
    with pytest.raises(ValueError):
        traversal.topological_levels(g)


def test_pagerank_with_a_dangling_node(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 0)], 3, True)
    teleport = spark.createDataFrame([(0, 3.0), (1, 3.0)], "id long, weight double")
    s = values(centrality.pagerank(g, tolerance=1e-12, max_rounds=200, teleport=teleport))
    assert s[0] == pytest.approx(1 / 2.85, abs=1e-6) and s[1] == pytest.approx(1.85 / 2.85, abs=1e-6) and s[2] == pytest.approx(0, abs=1e-9)


def test_loops_are_refused_where_they_make_no_sense(spark):
    g = make(spark, [(0, 1), (1, 1)], 2)
    for f in (triangles.local_clustering, traversal.core_numbers):
        with pytest.raises(ValueError):
            f(g)
    assert values(g.degrees(), value="degree") == {0: 1, 1: 2}


def test_changes(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 2)], 4)
    one = spark.createDataFrame([(1,)], "id long")
    assert g.remove_nodes(one).edges.select("src", "dst").collect() == [(2, 2)]
    assert g.remove_self_loops().edges.count() == 2
    more = g.add_edges(spark.createDataFrame([(5, 0), (1, 0)], "src long, dst long"), add_missing=True, check_multi=True)
    assert more.edges.count() == 4 and more.vertices.count() == 5
    added = g.set_weights(spark.createDataFrame([(0, 1, 2.5)], "src long, dst long, w double"), add=True)
    assert {(r["src"], r["dst"]): r["w"] for r in added.edges.collect()}[(0, 1)] == 3.5
    assert all(r["rows"] == 0 for r in g.problems().collect())
    assert {r["id"] for r in g.isolated().collect()} == {3}


def test_csr_round_trip_and_dense_ids(spark):
    g = make(spark, BAUR, 16)
    back = G.from_csr(*G.to_csr(g), directed=False)
    assert sorted(back.edges.collect()) == sorted(g.edges.collect())
    ids = G.dense_ids(spark.range(100).select((F.col("id") * 7).alias("id")), ["id"], "n").collect()
    assert all(r["id"] == 7 * r["n"] for r in ids) and len(ids) == 100


def test_tables_with_bad_ends(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "node_id string, x int")
    good = spark.createDataFrame([("a", "b")], "source string, target string")
    assert G.from_tables(nodes, good).edges.select("src", "dst").collect() == [(0, 1)]
    with pytest.raises(ValueError):
        G.from_tables(nodes, spark.createDataFrame([("a", "z")], "source string, target string"))


def test_communities(spark):
    g = make(spark, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)], 6)
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, label long")
    assert communities.modularity(g, labels).first()[0] == pytest.approx(6 / 7 - 0.5)
    found = values(communities.louvain(g), value="label")
    assert len({found[i] for i in range(3)}) == 1 and len(set(found.values())) == 2
    assert communities.nmi_distance(labels, labels).first()[0] == pytest.approx(0)
    cut = {r["id"] for r in communities.sweep_cut(g, spark.createDataFrame([(i, 1.0 / (i + 1)) for i in range(6)], "id long, score double")).collect()}
    assert cut == {0, 1, 2}


def test_peelings_and_matchings(spark):
    g = make(spark, BAUR, 16)
    mis = traversal.independent_set(g)
    assert traversal.is_independent(g, mis).first()[0]
    m = traversal.heavy_matching(g).collect()
    ends = [x for r in m for x in (r["src"], r["dst"])]
    assert len(ends) == len(set(ends)) and len(m) >= 4
    tree = traversal.minimum_spanning_forest(g)
    assert tree.count() == 13
    colours = values(traversal.colouring(g), value="colour")
    assert all(colours[a] != colours[b] for a, b in BAUR)
    assert not traversal.bipartition(g).first()[0]
    assert traversal.bipartition(make(spark, [(0, 1), (1, 2), (2, 3), (3, 0)], 4)).first()[0]


def test_simple_paths(spark):
    g = make(spark, [(0, 1), (1, 2), (0, 2), (2, 3)], 4, True)
    assert sorted(r["path"] for r in traversal.all_simple_paths(g, 0, 3, 3).collect()) == [[0, 1, 2, 3], [0, 2, 3]]


def test_links(spark):
    g = make(spark, KITE, 6)
    pairs = spark.createDataFrame([(3, 4)], "u long, v long")
    r = links.pair_features(g, pairs).first()
    assert r["common_neighbors"] == 2 and r["jaccard"] == 1.0 and r["preferential_attachment"] == 4
    p = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    assert links.area_under_roc(p).first()[0] == pytest.approx(0.75)


def test_semirings(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (0, 2, 9.0)], "i long, j long, v double")
    two = {(r["i"], r["j"]): r["v"] for r in semirings.matrix_matrix(m, m, semirings.MIN_PLUS).collect()}
    assert two == {(0, 2): 5.0}


def test_generators(spark):
    assert generators.ring_lattice(spark, 10, 2).edges.count() == 20
    g = generators.random_graph(spark, 300, 0.05)
    assert abs(g.edges.count() - 0.05 * 300 * 299 / 2) < 200
    with pytest.raises(ValueError):
        generators.watts_strogatz(spark, 5, 2, 0.1)
    assert generators.realizable(spark.createDataFrame([(0, 3), (1, 1), (2, 1), (3, 1)], "id long, degree long")).first()[0]
    assert not generators.realizable(spark.createDataFrame([(0, 3), (1, 1)], "id long, degree long")).first()[0]
    census = generators.seir(make(spark, KITE, 6), spark.range(1), 1.0, 1, 1, 3).groupBy("t").agg(F.sum("count").alias("n")).collect()
    assert all(r["n"] == 6 for r in census)


def test_replay(spark):
    rows = [(0, "NODE_ADDITION", 0, None, None), (1, "NODE_ADDITION", 1, None, None), (2, "EDGE_ADDITION", 0, 1, 3.14), (3, "EDGE_WEIGHT_INCREMENT", 0, 1, 2.1), (4, "NODE_ADDITION", 2, None, None), (5, "EDGE_ADDITION", 1, 2, 1.0), (6, "NODE_REMOVAL", 2, None, None), (7, "NODE_RESTORATION", 2, None, None)]
    g = events.replay(spark.createDataFrame(rows, "seq long, type string, u long, v long, w double"))
    assert [(r["src"], r["dst"], round(r["w"], 2)) for r in g.edges.collect()] == [(0, 1, 5.24)]
    assert g.vertices.count() == 3


def test_degree_statistics(spark):
    g = make(spark, KITE, 6)
    assert values(degree.degree_centrality(g))[2] == pytest.approx(4 / 6)
    assert degree.gini(g.degrees(), "degree").first()[0] == pytest.approx(0.25)
    assert tools.density(g).first()[0] == pytest.approx(0.4)
    assert tools.difference(g, make(spark, KITE[1:], 6)).select("type").collect() == [("EDGE_REMOVAL",)]


def test_empty_graph(spark):
    g = make(spark, [], 0)
    assert centrality.pagerank(g).count() == 0 and traversal.components(g).count() == 0
    assert triangles.triangle_edge_score(g).count() == 0 and traversal.independent_set(g).count() == 0
