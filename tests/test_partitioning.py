"""Leiden and map equation on graphs with known communities, and by their invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, from_edges
from loomgraph.operators import communities, partitioning, traversal


def blocks(parts, size, p_in, p_out, seed=3):
    rng = random.Random(seed)
    n = parts * size
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (p_in if i // size == j // size else p_out)]


@pytest.fixture(scope="module")
def planted(spark):
    edges = blocks(5, 20, 0.5, 0.01)
    return PropertyGraph(spark.range(102), spark.createDataFrame([(*e, 1.0) for e in edges], "src long, dst long, w double").repartition(2), False), edges


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["label"], set()).add(r["id"])
    assert all(min(s) == k for k, s in out.items())
    return sorted(map(sorted, out.values()))


WANT = [list(range(20 * k, 20 * k + 20)) for k in range(5)] + [[100], [101]]


def test_leiden_finds_planted_parts(planted):
    g, _ = planted
    assert groups(partitioning.leiden(g)) == WANT


def test_leiden_is_connected_and_no_worse_than_louvain(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)}
    g = PropertyGraph(spark.range(60), spark.createDataFrame([(*e, float(rng.randint(1, 3))) for e in sorted(edges)], "src long, dst long, w double"), False)
    found = partitioning.leiden(g)
    inside = communities.labelled_edges(g, found).where("a = b").select("src", "dst", "w")
    pieces = traversal.components(PropertyGraph(g.vertices, inside, False)).join(found, "id").groupBy("label").agg(F.count_distinct("component").alias("n"))
    assert pieces.where("n > 1").isEmpty() and found.count() == 60
    value = lambda labels: communities.modularity(g, labels).first()["modularity"]
    assert value(found) >= value(communities.louvain(g)) - 0.02


def python_codelength(edges, label):
    vol, cut, node, total = {}, {}, {}, 0.0
    for a, b in edges:
        total += 2
        for x, y in ((a, b), (b, a)):
            node[x] = node.get(x, 0) + 1
            vol[label[x]] = vol.get(label[x], 0) + 1
            if label[x] != label[y]:
                cut[label[x]] = cut.get(label[x], 0) + 1
    f = lambda x: x / total * math.log2(x / total) if x else 0.0
    return f(sum(cut.values())) - 2 * sum(map(f, cut.values())) - sum(map(f, node.values())) + sum(f(vol[k] + cut.get(k, 0)) for k in vol)


def test_codelength(planted):
    g, edges = planted
    for k in (1, 20, 33):
        labels = g.vertices.select("id", F.floor(F.col("id") / k).alias("label"))
        assert partitioning.codelength(g, labels).first()["codelength"] == pytest.approx(python_codelength(edges, {i: i // k for i in range(102)}))


def test_map_equation_finds_planted_parts(planted):
    g, _ = planted
    assert groups(partitioning.map_equation_communities(g)) == WANT


def test_no_edges(spark):
    g = from_edges(spark.createDataFrame([(1, 1)], "src long, dst long"))
    for found in (partitioning.leiden(g), partitioning.map_equation_communities(g)):
        assert [tuple(r) for r in found.collect()] == [(1, 1)]
