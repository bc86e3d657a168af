"""Triangles in blocks, against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.functions import algebraic
from loomgraph.operators import closing, links, triangles


def _want(rows):
    """The degrees of ends, triangles and sums over third nodes of each edge row."""
    near, degree = {}, Counter()
    for a, b in rows:
        degree[a] += 1
        degree[b] += a != b
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for a, b in rows:
        third = near.get(a, set()) & near.get(b, set()) if a != b else set()
        out.append((a, b, degree[a], degree[b], len(third), round(sum(1 / math.log(degree[x]) for x in third), 9), round(sum(1 / degree[x] for x in third), 9)))
    return sorted(out)


def _graph(spark, rows):
    return G.from_edges(spark.createDataFrame(rows, "src long, dst long"))


def _random(kind):
    r = random.Random(7)
    if kind == "no order":
        pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(400)}
    elif kind == "groups":
        pairs = {tuple(sorted((k + x, k + y))) for k in range(0, 200, 20) for x, y in (r.sample(range(20), 2) for _ in range(60))} | {(5, 30), (5, 31), (30, 31), (19, 20)}
    else:  # a hub, loops, parallel edges, far ids
        pairs = {(0, x) for x in range(1, 80)} | {tuple(sorted(r.sample(range(1, 80), 2))) for _ in range(150)} | {(10**12, 10**12 + 1), (79, 10**12)}
        return [(a, b) for p in sorted(pairs) for a, b in [p] * (1 + (p[1] % 7 == 0))] + [(3, 3), (3, 3), (200, 200)]
    return sorted(pairs)


@pytest.mark.parametrize("kind", ["no order", "groups", "hub"])
@pytest.mark.parametrize("size", [10**6, 60, 12])
def test_closed_edges(spark, monkeypatch, kind, size):
    rows = _random(kind)
    monkeypatch.setattr(closing, "_CANDIDATES", 50)
    got = closing.closed_edges(_graph(spark, rows), third=True, edges_a_block=size)
    found = sorted((*tuple(r)[:5], round(r["aa"], 9), round(r["ra"], 9)) for r in got.select("src", "dst", "du", "dv", "score", "aa", "ra").collect())
    assert found == _want(rows)
    assert got.where("first").count() == len(set(rows))


def test_no_edges(spark):
    g = G.PropertyGraph(spark.range(3), _graph(spark, [(0, 1)]).edges.where(F.lit(False)), False)
    assert closing.closed_edges(g).count() == 0 and {r["triangles"] for r in triangles.node_triangles(g).collect()} == {0}


def test_wedges_are_not_written(spark, monkeypatch):
    """Scores that follow from common neighbours go by blocks: what lists triangles one by one isn't called."""
    rows = _random("groups")
    want = _want(rows)
    monkeypatch.setattr(triangles, "triangles", None)
    g = _graph(spark, rows)
    count = sum(x[4] for x in want) // 3
    assert algebraic.triangles(g).first()[0] == count
    assert triangles.node_triangles(g).agg(F.sum("triangles")).first()[0] == 3 * count
    wedges = sum(d * (d - 1) / 2 for d in Counter(x for r in rows for x in r).values())
    assert abs(triangles.clustering(g).first()["global"] - 3 * count / wedges) < 1e-12
    by = {r[:2]: r for r in want}
    assert all(r["score"] == by[r["src"], r["dst"]][4] for r in triangles.triangle_edge_score(g).collect())
    scores = {f: {(r["src"], r["dst"]): r["score"] for r in getattr(triangles, f)(g).collect()} for f in ("jaccard_distance", "adamic_adar_distance", "scan_score", "chance_corrected_triangles")}
    for (a, b), (_, _, du, dv, t, aa, _) in by.items():
        assert abs(scores["jaccard_distance"][a, b] - (1 - t / (du + dv - t))) < 1e-12
        assert scores["adamic_adar_distance"][a, b] is None if not t else abs(scores["adamic_adar_distance"][a, b] - 1 / aa) < 1e-6
        assert abs(scores["scan_score"][a, b] - (t + 1) / math.sqrt((du + 1) * (dv + 1))) < 1e-12
    pairs = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    rounded = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert rounded(links.edge_features(g)) == rounded(links.pair_features(g, pairs))
