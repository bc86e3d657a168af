"""Triangles of an undirected graph in blocks: what each edge's ends have in common, without a row for each wedge.

Ids are cut into blocks where the fewest edges cross.  A task has three blocks I <= J <= L and the edges between them, and closes
the edges from I to J by the neighbours in L.  Only those tasks are made whose three kinds of edges all exist, so a graph whose
edges stay near each other's ids is sent once; one without such order is sent as often as there are blocks, and has fewer blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.scratch import materialize

#: Edges that a block should have, entries of a task's table of marks, candidates and hits that are looked at together.
_EDGES, _MARKS, _CANDIDATES = 1_500_000, 1 << 21, 1 << 22
_MOST_BLOCKS = 1024


def _nodes(edges: DataFrame) -> DataFrame:
    """``(id, step, degree)`` of nodes with edges: edges to larger ids less those from smaller ones, and all; a loop counts once."""
    one = F.lit(1).cast("long")
    up = edges.select(F.col("src").alias("id"), F.when(F.col("src") < F.col("dst"), one).otherwise(0).alias("step"))
    down = edges.where("src < dst").select(F.col("dst").alias("id"), (-one).alias("step"))
    return up.unionByName(down).groupBy("id").agg(F.sum("step").alias("step"), F.count("*").alias("degree"))


def _cuts(nodes: DataFrame, blocks: int) -> list[int]:
    """The first ids of all blocks but the first, near even shares of the edges' ends, where the fewest edges cross."""
    spark = nodes.sparkSession
    ranged = nodes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    # Read twice, the rows might be dealt differently; a written table keeps them where they are.
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "closing-nodes")
    sums = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("id"), F.sum("step"), F.sum("degree")).collect())  # a row for each partition
    before, crossing, mass = {}, 0, 0
    for part, _, step, degree in sums:
        before[part] = (crossing, mass)
        crossing, mass = crossing + step, mass + degree
    width = mass / blocks

    def best(table: pa.Table) -> pa.Table:
        x = table.sort_by("id")
        cross0, mass0 = before[x["part"][0].as_py()]
        ids, step, degree = (x[c].to_numpy() for c in ("id", "step", "degree"))
        cross, at = cross0 + np.cumsum(step) - step, mass0 + np.cumsum(degree) - degree
        target = np.rint(at / width).astype(np.int64)
        inner = (target > 0) & (target < blocks)
        ids, cross, at, target = ids[inner], cross[inner], at[inner], target[inner]
        off = np.abs(at - target * width)
        order = np.lexsort((off, cross, target))
        first = order[np.unique(target[order], return_index=True)[1]]
        return pa.table({"target": target[first], "crossing": cross[first], "off": off[first], "id": ids[first]})

    found = ranged.groupBy("part").applyInArrow(best, "target long, crossing long, off double, id long")
    found = found.groupBy("target").agg(F.min(F.struct("crossing", "off", "id")).alias("x")).select("x.id").collect()  # a row for each block
    return sorted({r["id"] for r in found})


def _block(column: str, cuts: list[int], first: int = 0) -> Column:
    """The number of a node's block, by halves."""
    if not cuts:
        return F.lit(first).cast("long")
    k = len(cuts) // 2
    return F.when(F.col(column) < cuts[k], _block(column, cuts[:k], first)).otherwise(_block(column, cuts[k + 1 :], first + k + 1))


def _tasks(pairs: dict[tuple[int, int], int]) -> dict[tuple[int, int], set[tuple[int, int, int]]]:
    """The tasks that the edges of each pair of blocks go to: where they may be part of a triangle, and (i, j, j) in any case."""
    up: dict[int, set[int]] = {}
    for i, j in pairs:
        up.setdefault(i, set()).add(j)
    out = {p: {(*p, p[1])} for p in pairs}
    for i, j in pairs:
        for k in up[i] & up.get(j, set()):
            for p in ((i, j), (j, k), (i, k)):
                out[p].add((i, j, k))
    return out


def _sent(pairs: dict[tuple[int, int], int]) -> tuple[int, int]:
    """Edges sent altogether, and to the largest task."""
    by: dict[tuple[int, int, int], int] = {}
    for p, tasks in _tasks(pairs).items():
        for t in tasks:
            by[t] = by.get(t, 0) + pairs[p]
    return sum(by.values()), max(by.values(), default=0)


def _pairs(edges: DataFrame, cuts: list[int]) -> dict[tuple[int, int], int]:
    found = edges.groupBy(_block("src", cuts).alias("i"), _block("dst", cuts).alias("j")).agg(F.count("*").alias("n")).collect()  # blocks are few
    return {(r["i"], r["j"]): r["n"] for r in found}


def _merged(pairs: dict[tuple[int, int], int], step: int) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    for (i, j), n in pairs.items():
        p = (i // step, j // step)
        out[p] = out.get(p, 0) + n
    return out


def _close(src: np.ndarray, dst: np.ndarray, kind: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For edges in the order of src and dst, of kinds 1 (from I to J), 2 (J to L), 4 (I to L): how many triangles each is part of in this
    task, and the sums of the third nodes' weights; weights has (from the edge's src, from its dst) for each."""
    n = len(src)
    sums = [np.zeros(n, np.int64), *(np.zeros(n) for _ in weights)]
    ij, jl, il = (np.flatnonzero(kind & k) for k in (1, 2, 4))
    if not (len(ij) and len(jl) and len(il)):
        return sums
    places = np.unique(np.concatenate([dst[jl], dst[il]]))
    wide = len(places)
    w_jl, w_il = (np.searchsorted(places, dst[x]) for x in (jl, il))
    v_at, v_n = (lambda a: (a, np.searchsorted(src[jl], dst[ij], "right") - a))(np.searchsorted(src[jl], dst[ij]))
    u_at, u_n = (lambda a: (a, np.searchsorted(src[il], src[ij], "right") - a))(np.searchsorted(src[il], src[ij]))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> None:
        nonlocal count
        if not held:
            return
        uv, uw, vw = (np.concatenate(x) for x in zip(*held, strict=True))
        for e, third, end in ((uv, uw, 1), (uw, uv, 1), (vw, uv, 0)):  # w is uw's dst, v is uv's dst, u is uv's src
            sums[0] += np.bincount(e, minlength=n)
            for s, w in zip(sums[1:], weights, strict=True):
                s += np.bincount(e, weights=w[end][third], minlength=n)
        held.clear()
        count = 0

    def batches(total: np.ndarray, most: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Ranges of rows with so many candidates, and marks, together."""
        ends, at = np.cumsum(total), 0
        while at < len(total):
            to = np.searchsorted(ends, (ends[at - 1] if at else 0) + _CANDIDATES, "right")
            if most is not None:
                to = min(to, np.searchsorted(most, most[at] + max(1, _MARKS // wide)))
            to = max(int(to), at + 1)
            yield at, to
            at = to

    def spread(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(length)
        return np.repeat(at - ends + length, length) + np.arange(ends[-1] if len(ends) else 0), ends

    # The shorter of both lists is gone through: v's, with u's neighbours marked, or u's where it is much shorter.
    usual = np.flatnonzero((v_n > 0) & (u_n > 0) & (v_n <= 4 * u_n))
    named = np.cumsum(np.r_[0, np.diff(src[ij[usual]]) != 0]) if len(usual) else usual
    marks = np.full(max(1, _MARKS // wide) * wide if len(usual) else 0, -1, np.int32)
    for a, b in batches(v_n[usual], named):
        rows = usual[a:b]
        row = (named[a:b] - named[a]) * wide
        heads = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        mine, _ = spread(u_at[rows[heads]], u_n[rows[heads]])
        spots = np.repeat(row[heads], u_n[rows[heads]]) + w_il[mine]
        marks[spots] = mine
        at, ends = spread(v_at[rows], v_n[rows])
        seen = marks[np.repeat(row, v_n[rows]) + w_jl[at]]
        hit = np.flatnonzero(seen >= 0)
        marks[spots] = -1
        held.append((ij[rows[np.searchsorted(ends, hit, "right")]], il[seen[hit]], jl[at[hit]]))
        count += len(hit)
        if count > _CANDIDATES:
            flush()
    rare = np.flatnonzero((u_n > 0) & (v_n > 4 * u_n))
    if len(rare):
        heads = np.cumsum(np.r_[0, np.diff(src[jl]) != 0])
        keys = heads * wide + w_jl
        for a, b in batches(u_n[rare], None):
            rows = rare[a:b]
            at, ends = spread(u_at[rows], u_n[rows])
            asked = np.repeat(heads[v_at[rows]] * wide, u_n[rows]) + w_il[at]
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == asked)
            held.append((ij[rows[np.searchsorted(ends, hit, "right")]], il[at[hit]], jl[place[hit]]))
            count += len(hit)
            if count > _CANDIDATES:
                flush()
    flush()
    return sums


def closed_edges(g: PropertyGraph, third: bool = False, edges_a_block: int = _EDGES) -> DataFrame:
    """``(src, dst, first, du, dv, score)``: a row for each edge, src <= dst, with the degrees of its ends and its triangles; loops have
    none.  With third also ``aa`` and ``ra``, the sums of 1/ln(degree) and 1/degree over the third nodes.  Of parallel edges each
    has a row, all count as one, and one of them is the first.  Runs jobs; the edges are gone through a few times."""
    if g.directed:
        raise ValueError("an undirected graph is asked for")
    spark = g.edges.sparkSession
    edges = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    total = edges.count()
    blocks = min(max(1, math.ceil(total / edges_a_block)), _MOST_BLOCKS)
    nodes = materialize(_nodes(edges), "closing-degrees")
    cuts = _cuts(nodes, blocks) if blocks > 1 else []
    pairs = _pairs(edges, cuts)
    # Without order in the ids fewer blocks are better, as long as the tasks don't grow.
    few = max(1, math.isqrt(math.ceil(6 * total / edges_a_block)))
    step = max(1, len(cuts) // few)
    if step > 1:
        thin = _merged(pairs, step)
        (sent, most), (fewer, larger) = _sent(pairs), _sent(thin)
        if fewer < sent and larger <= max(most, 2 * edges_a_block):
            pairs, cuts = thin, cuts[step - 1 :: step]
    k = len(cuts) + 1
    tasks = _tasks(pairs)
    code = lambda t: (t[0] * k + t[1]) * k + t[2]
    alone = {i * k + j for (i, j), x in tasks.items() if len(x) == 1}
    to = spark.createDataFrame([(i * k + j, code(t)) for (i, j), x in tasks.items() for t in x], "pair long, task long")
    sent = edges.withColumn("pair", _block("src", cuts) * k + _block("dst", cuts)).join(F.broadcast(to), "pair").select((2 * F.col("task")).alias("key"), "src", "dst")
    of = spark.createDataFrame(sorted({(b, code(t)) for x in tasks.values() for t in x for b in t}), "block long, task long")
    known = nodes.withColumn("block", _block("id", cuts)).join(F.broadcast(of), "block").select((2 * F.col("task") + 1).alias("key"), F.col("id").alias("src"), F.col("degree").alias("dst"))
    bounds = np.array(cuts, np.int64)

    def one(task: int, src: np.ndarray, dst: np.ndarray, ids: np.ndarray, degree: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, m = task // k // k, task // k % k, task % k
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        new = np.r_[True, (np.diff(src) != 0) | (np.diff(dst) != 0)]
        times = np.diff(np.r_[np.flatnonzero(new), len(src)])
        src, dst = src[new], dst[new]
        bs, bd = np.searchsorted(bounds, src, "right"), np.searchsorted(bounds, dst, "right")
        kind = ((bs == i) & (bd == j)) + np.int8(2) * ((bs == j) & (bd == m)) + np.int8(4) * ((bs == i) & (bd == m))
        kind[src == dst] = 0
        by = np.argsort(ids)
        ids, degree = ids[by], degree[by]
        du, dv = degree[np.searchsorted(ids, src)], degree[np.searchsorted(ids, dst)]
        # A third node has two neighbours, so no logarithm of 1 is used.
        weights = [(1 / f(np.maximum(du, 2)), 1 / f(np.maximum(dv, 2))) for f in (np.log, np.float64)] if third else []
        sums = _close(src, dst, kind, weights)
        home = (bs == i) & (bd == j) & (j == m)
        sole = np.isin(bs * k + bd, list(alone))
        kept = np.flatnonzero(home | (sums[0] > 0))
        kept = np.repeat(kept, np.where(sole[kept], times[kept], 1))
        columns = {"src": src, "dst": dst, "du": du, "dv": dv, "score": sums[0], "times": np.where(home, times, 0), "sole": sole}
        columns |= dict(zip(("aa", "ra"), sums[1:], strict=False))
        new = np.r_[True, np.diff(kept) != 0]
        for a in range(0, len(kept), 100_000):
            some = kept[a : a + 100_000]
            yield pa.RecordBatch.from_pydict({c: x[some] for c, x in columns.items()} | {"first": new[a : a + 100_000]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(x) for x in held] if held[0] else []
            for x in held:
                x.clear()
            if whole:
                found = one(now, *whole)
                del whole
                yield from found

        for batch in batches:
            key, src, dst = (batch.column(c).to_numpy() for c in ("key", "src", "dst"))
            edge = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if key[a] // 2 != now:
                    yield from done()
                    now = int(key[a]) // 2
                at = 2 * (int(key[a]) % 2)
                held[at].append(src[a:b].copy())
                held[at + 1].append(dst[a:b].copy())
        yield from done()

    more = ", aa double, ra double" if third else ""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sent.unionByName(known).repartition(parts, F.floor(F.col("key") / 2)).sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(run, f"src long, dst long, du long, dv long, score long, times long, sole boolean{more}, first boolean"), "closed")
    names = ["src", "dst", "first", "du", "dv", "score", *(("aa", "ra") if third else ())]
    if len(alone) == len(pairs):
        return found.select(*names)
    rest = found.where("not sole").groupBy("src", "dst").agg(F.max("du").alias("du"), F.max("dv").alias("dv"), *(F.sum(c).alias(c) for c in names[5:]), F.sum("times").alias("times"))
    rest = rest.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).withColumn("first", F.col("again") == 1).select(*names)
    return found.where("sole").select(*names).unionByName(rest)
