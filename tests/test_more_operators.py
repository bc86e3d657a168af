"""Squares, covers, b-matchings, randomised and generated graphs, sampled paths and walks."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, from_edges
from loomgraph.functions import algebraic
from loomgraph.operators import bmatching, burning, centrality, covers, extras, sampled, traversal
from loomgraph.plans import randomize


def graph_of(spark, edges, n):
    return PropertyGraph(spark.range(n), spark.createDataFrame([(min(e[:2]), max(e[:2]), float(e[2]) if len(e) > 2 else 1.0) for e in edges], "src long, dst long, w double").repartition(2), False)


@pytest.fixture(scope="module")
def sparse(spark):
    rng = random.Random(4)
    edges = {}
    while len(edges) < 90:
        edges[tuple(sorted(rng.sample(range(40), 2)))] = rng.randint(1, 4)
    edges = [(*e, w) for e, w in edges.items()]
    near = {i: set() for i in range(42)}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    return graph_of(spark, edges, 42), edges, near


def test_square_clustering(sparse):
    g, _, near = sparse
    want = {}
    for u, nu in near.items():
        squares = possible = 0
        for v, w in itertools.combinations(nu, 2):
            common = len(near[v] & near[w])
            squares += common - 1
            possible += len(near[v]) + len(near[w]) - common - 1 - 2 * (w in near[v])
        want[u] = squares / possible if possible > 0 else squares
    assert {r["id"]: r["score"] for r in covers.square_clustering(g).collect()} == pytest.approx(want)


def test_permanence(sparse):
    g, _, near = sparse
    label = {u: u % 3 for u in near}
    found = {r["id"]: r for r in covers.permanence(g, g.vertices.select("id", (F.col("id") % 3).alias("label"))).collect()}
    for u, nu in near.items():
        own = [v for v in nu if label[v] == label[u]]
        pull = max(Counter(label[v] for v in nu if label[v] != label[u]).values(), default=0)
        ties = sum(b in near[a] for a, b in itertools.combinations(own, 2))
        cin = ties / math.comb(len(own), 2) if len(own) > 1 else 0.0
        assert found[u]["intra_clustering"] == pytest.approx(cin)
        assert found[u]["permanence"] == pytest.approx((len(own) / max(pull, 1) / len(nu) if nu else 0.0) - (1 - cin))


def test_overlapping_nmi(spark):
    frame = lambda sets: spark.createDataFrame([(i, k) for k, s in enumerate(sets) for i in s], "id long, label long")
    n, x = 30, [set(range(10)), set(range(8, 20)), set(range(20, 30))]
    y = [set(range(11)), set(range(11, 20)), set(range(15, 30)), {3}]
    h = lambda k: -k * math.log2(k / n) if k else 0.0
    own = lambda s: h(len(s)) + h(n - len(s))

    def given(a, b):
        d = len(a & b)
        p, q, r = n + d - len(a) - len(b), len(b) - d, len(a) - d
        return h(p) + h(q) + h(r) + h(d) - own(b) if h(p) + h(d) >= h(q) + h(r) else own(a)

    def entropy(sets, others):
        return sum(map(own, sets)), sum(min([own(a), *(given(a, b) for b in others if a & b)]) for a in sets)

    (hx, gx), (hy, gy) = entropy(x, y), entropy(y, x)
    mutual = (hx - gx + hy - gy) / 2
    under = {"min": min(hx, hy), "geometric_mean": math.sqrt(hx * hy), "arithmetic_mean": (hx + hy) / 2, "max": max(hx, hy), "joint_entropy": hx + hy - mutual}
    nodes = spark.range(n)
    for name, value in under.items():
        assert covers.overlapping_nmi_distance(frame(x), frame(y), nodes, name).first()["distance"] == pytest.approx(1 - mutual / value)
    none = frame(x).where("false")
    for a, b, want in ((frame(x), frame(x), 0.0), (none, none, 0.0), (frame(x), none, 1.0)):
        assert covers.overlapping_nmi_distance(a, b, nodes).first()["distance"] == pytest.approx(want, abs=1e-12)


def test_cover_hub_dominance(spark, sparse):
    g, _, near = sparse
    sets = {0: set(range(12)), 1: set(range(8, 30)), 2: {41}}
    cover = spark.createDataFrame([(i, k) for k, s in sets.items() for i in s], "id long, label long")
    want = {k: max(len(near[u] & s) for u in s) / (len(s) - 1) if len(s) > 1 else 1.0 for k, s in sets.items()}
    assert {r["label"]: r["score"] for r in covers.cover_hub_dominance(g, cover).collect()} == pytest.approx(want)


@pytest.mark.parametrize("b", [1, 2, 3])
def test_b_matching_is_the_greedy_one(sparse, b):
    g, edges, _ = sparse
    left, want = Counter({i: b for i in range(42)}), set()
    for a, c, w in sorted(((min(e[:2]), max(e[:2]), e[2]) for e in edges), key=lambda e: (-e[2], e[0], e[1])):
        if left[a] and left[c]:
            left[a] -= 1
            left[c] -= 1
            want.add((a, c, float(w)))
    mates = bmatching.b_matching(g, b)
    assert {tuple(r) for r in mates.select("src", "dst", "w").collect()} == want
    assert tuple(bmatching.b_matching_problems(g, mates, b).first()) == (0, 0, 0)
    fewer = mates.where("src <> 0 and dst <> 0")
    assert bmatching.b_matching_problems(g, fewer, b).first()["blocking"] > 0


def degrees_of(g):
    return {r["id"]: r["degree"] for r in g.degrees().collect()}


def simple(g):
    rows = [(r["src"], r["dst"]) for r in g.edges.collect()]
    return len(rows) == len(set(rows)) and all(a < b for a, b in rows)


def test_randomised_graphs_keep_degrees(sparse):
    g, edges, _ = sparse
    old = {tuple(sorted(e[:2])) for e in edges}
    for made in (randomize.global_curveball(g, 4), randomize.edge_switching(g, 3)):
        assert simple(made) and degrees_of(made) == degrees_of(g)
        assert len(old - {(r["src"], r["dst"]) for r in made.edges.collect()}) > 10
    with pytest.raises(ValueError):
        randomize.global_curveball(g.with_edges(g.edges.unionByName(g.edges.limit(1))))


def test_configuration_model_and_powerlaw(spark):
    degrees = randomize.powerlaw_degrees(spark, 200, 2, 20, 2.0)
    drawn = [r["degree"] for r in degrees.collect()]
    assert sum(drawn) % 2 == 0 and min(drawn) == 2 and max(drawn) <= 20
    share = sum(k**-2.0 for k in range(2, 21))
    assert abs(drawn.count(2) / 200 - 2**-2.0 / share) < 0.12
    made = randomize.configuration_model(degrees)
    assert simple(made) and degrees_of(made) == {r["id"]: r["degree"] for r in degrees.collect()}
    again = randomize.configuration_model(randomize.powerlaw_degrees(spark, 200, 2, 20, 2.0))
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, made.edges.collect()))
    with pytest.raises(ValueError):
        randomize.configuration_model(spark.createDataFrame([(0, 1)], "id long, degree long"))
    with pytest.raises(RuntimeError):
        randomize.configuration_model(spark.createDataFrame([(0, 2)], "id long, degree long"), max_rounds=2)


def test_preferential_attachment(spark):
    g = randomize.preferential_attachment(spark, 300, 3)
    d = degrees_of(g)
    assert simple(g) and len(d) == 300 and min(d.values()) >= 1 and 700 < sum(d.values()) / 2 <= 891
    assert max(d.values()) > 20  # hubs
    first = [(r["src"], r["dst"]) for r in g.edges.where("dst = 3").collect()]
    assert first and all(a < 3 for a, _ in first)


@pytest.mark.parametrize("radius", [6.0, 9.0])
def test_hyperbolic_graph(spark, radius):
    points = randomize.hyperbolic_points(spark, 400, 2.6, radius).cache()
    p = {r["id"]: (r["r"], r["phi"]) for r in points.collect()}
    assert all(0 <= r <= radius for r, _ in p.values())
    far = lambda a, b: math.cosh(a[0]) * math.cosh(b[0]) - math.sinh(a[0]) * math.sinh(b[0]) * math.cos(a[1] - b[1])
    want = {(i, j) for i in p for j in p if i < j and far(p[i], p[j]) <= math.cosh(radius)}
    assert {(r["src"], r["dst"]) for r in randomize.hyperbolic_graph(points, radius).edges.collect()} == want


def test_sampled_betweenness(sparse):
    g, _, _ = sparse
    exact = {r["id"]: r["score"] / (42 * 41) for r in centrality.betweenness(g).collect()}
    for adaptive in (True, False):
        found = sampled.sampled_betweenness(g, 0.08, 0.1, adaptive)
        assert all(abs(r["score"] - exact[r["id"]]) <= 0.08 for r in found.scores.collect())
    assert found.samples == sampled.samples_for(sampled.vertex_diameter_bound(g), 0.08, 0.1)


def test_sampled_paths_are_shortest(spark):
    ring = from_edges(spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)], "src long, dst long"))
    inner = Counter(r["sample"] for r in sampled.sampled_paths(ring, 0, 60).collect())
    assert max(inner.values()) == 3 and all(k <= 3 for k in inner.values())  # at most four steps on a ring of nine
    apart = from_edges(spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long"))
    assert sampled.sampled_paths(apart, 0, 20).count() == 0


def test_second_order_walks(spark, sparse):
    g, _, near = sparse
    rows = sampled.second_order_walks(g, 6, p=0.01, q=1.0, walks=2).collect()
    walks = {}
    for r in rows:
        walks.setdefault((r["walk"], r["start"]), {})[r["step"]] = r["id"]
    assert len(walks) == 84
    back = steps = 0
    for (_, start), at in walks.items():
        assert at[0] == start
        for k in range(1, len(at)):
            assert at[k] in near[at[k - 1]]
            if k > 1:
                steps += 1
                back += at[k] == at[k - 2]
    assert back / steps > 0.9
    vectors = sampled.node2vec(g, 8, 5, 2).collect()
    assert len(vectors) == 42 and all(len(r["vector"]) == 8 for r in vectors)


def test_simple_path_visits(sparse):
    g, _, near = sparse
    found = {r["id"]: r["score"] for r in sampled.simple_path_visits(g, 4, 500).collect()}
    assert found[40] == 0 and sum(found.values()) > 42 and max(found, key=found.get) in sorted(near, key=lambda u: -len(near[u]))[:12]


def test_fires_and_removals(sparse):
    g, edges, near = sparse
    fires, places = burning.forest_fire_score(g, 0.5, 1.0, fires=64).collect(), burning.random_node_edge_score(g, batch=0.4).collect()
    for found in (fires, places):
        scores = {(r["src"], r["dst"]): r["score"] for r in found}
        assert len(scores) == len(edges) and 0 <= min(scores.values()) and max(scores.values()) <= 1
    assert sorted(r["score"] for r in places) == pytest.approx([k / 90 for k in range(90)])
    assert max(r["score"] for r in fires) == 1.0
    assert {r["score"] for r in burning.forest_fire_score(g, 0.0, 1.0).collect()} == {0.0}


def test_union_of_maximum_forests(spark, sparse):
    g, edges, near = sparse

    def joined(a, b, above):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for p, q, w in edges:
                for y in ((q,) if p == x else (p,) if q == x else ()):
                    if w > above and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return b in seen

    want = {(min(a, b), max(a, b)) for a, b, w in edges if not joined(a, b, w)}
    union = {(r["src"], r["dst"]): r["w"] for r in extras.union_maximum_forest(g).collect()}
    assert set(union) == want
    one = extras.random_maximum_forest(g).collect()
    assert {(r["src"], r["dst"]) for r in one} <= want and len(one) == 42 - len({r["component"] for r in traversal.components(g).collect()})


def test_edge_extras(sparse):
    g, edges, near = sparse
    scores = g.edges.select("src", "dst", F.col("w").alias("score"))
    ranks = {(r["src"], r["dst"]): r["rank"] for r in extras.score_ranks(scores, reverse=True).collect()}
    order = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    assert [ranks[e[0], e[1]] for e in order] == list(range(90))
    kept = extras.locally_sparsified(g, lambda x: x.edges.select("src", "dst", F.col("w").alias("score")), 0.5).edges.count()
    assert 30 <= kept <= 75
    assert all(0 <= r["score"] <= 1 for r in extras.algebraic_nearness(g, 4, 5).collect())
    mates = bmatching.b_matching(g, 1)
    coarse = extras.matching_coarsened(g, mates)
    assert coarse.vertices.count() == 42 - mates.count() and coarse.edges.agg(F.sum("w")).first()[0] == sum(e[2] for e in edges)
    sizes = {r["core"]: r["nodes"] for r in extras.core_sizes(g).collect()}
    assert sizes[0] == 42 and list(sizes.values()) and all(sizes[k] >= sizes[j] for k in sizes for j in sizes if k < j)
    assert extras.k_core_communities(g, 2).count() == sizes[2]
    two = {u: len({u} | near[u] | {x for v in near[u] for x in near[v]}) for u in near}
    assert {r["id"]: r["n"] for r in extras.ball_volumes(g, 2).collect()} == two
    a, b = (g.vertices.select("id", (F.col("id") % k).alias("label")) for k in (2, 4))
    assert abs(extras.sampled_node_rand(a, b, 4000).first()[0] - 0.25) < 0.05 and extras.sampled_node_rand(a, a, 50).first()[0] == 0
    assert extras.sampled_graph_rand(g, a, a, 0.5).first()[0] == 0


def test_algebraic_versions_agree(spark, sparse):
    g, edges, near = sparse
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(algebraic.bellman_ford(g, 0)) == rows(traversal.dijkstra(g, 0))
    assert rows(algebraic.bfs(g, 0)) == rows(traversal.bfs(g, 0))
    want = sum(b in near[a] and c in near[a] and c in near[b] for a, b, c in itertools.combinations(range(42), 3))
    assert algebraic.triangles(g).first()[0] == want
    one, two = ({r["id"]: r["score"] for r in x.collect()} for x in (algebraic.pagerank(g, rounds=60), centrality.pagerank(g)))
    assert one == pytest.approx(two, abs=1e-6)
    common = {(r["i"], r["j"]): r["v"] for r in algebraic.incidence_counts(g).collect()}
    assert all(v == len(near[i] & near[j]) for (i, j), v in common.items())
    down = PropertyGraph(spark.range(3), spark.createDataFrame([(0, 1, 1.0), (1, 2, -2.0), (2, 1, 1.0)], "src long, dst long, w double"), True)
    with pytest.raises(ValueError):
        algebraic.bellman_ford(down, 0)
