"""Counts of nodes by distance, in one task for each part of a graph and in rounds over all, against plain Python."""

import random

import pytest

from loomgraph import graph as G
from loomgraph.operators import closing, distances
from loomgraph.scratch import materialize


def _want(rows, directed, targets, max_depth):
    out = {}
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        if not directed:
            near.setdefault(b, set()).add(a)
    for start in {x for r in rows for x in r}:
        seen, front, depth = {start}, {start}, 0
        while front and (max_depth is None or depth < max_depth):
            depth += 1
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            if hit := front & targets:
                out[start, depth] = (len(hit), min(hit))
    return out


@pytest.mark.parametrize("directed, few, max_depth", [(False, False, None), (False, True, 2), (True, False, None), (True, True, None)])
def test_level_counts_in_tasks(spark, monkeypatch, directed, few, max_depth):
    r = random.Random(3)
    rows = sorted({(k + x, k + y) for k in range(0, 600, 150) for x, y in (sorted(r.sample(range(140), 2)) for _ in range(200))} | {(7, 7)})
    ids = {x for e in rows for x in e}
    targets = {x for x in ids if x % 5 == 0} | {10**6} if few else ids
    g = G.from_edges(spark.createDataFrame(rows, "src long, dst long"), directed)
    want = _want(rows, directed, targets, max_depth)
    chosen = spark.createDataFrame([(x,) for x in targets], "id long") if few else None
    made = []
    monkeypatch.setattr(distances, "materialize", lambda df, name, *a: made.append(name) or materialize(df, name, *a))
    for held, block, bitmaps in ((8_000_000, 500_000, 64 << 20), (8_000_000, 40, 1 << 12)):
        for name, x in (("_HELD", held), ("_BLOCK", block), ("_BITMAPS", bitmaps)):
            monkeypatch.setattr(distances, name, x)
        got = {(x["id"], x["distance"]): (x["n"], x["least"]) for x in distances.level_counts(g, chosen, max_depth=max_depth).collect()}
        assert got == want
    assert "levels" not in made  # no table for a round
    monkeypatch.setattr(distances, "_HELD", 10)
    assert distances._level_counts_apart(g, chosen, False, max_depth) is None
