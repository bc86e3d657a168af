"""Exact top-k search by histogram selection.

Every query is scored against every candidate, in blocks.  No list of scores is kept: a pass counts, for each query, how
many scores fall into each bin of that query's current range; summed over the tasks the counts say which bin holds the
kth largest score, and that bin is the next pass's range.  After a few passes the range is one score wide.  A last pass
takes what lies above it, and of what ties with it the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.scratch import materialize

SCALE = 256
#: Where scaled components and scores end: those beyond count as this, so that they fit into a long.
_END = 1 << 62


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` with floor(scale * x) of each component, at most 2**62 in size.  Rows take no part whose id or vector
    is null, or whose vector holds a null or non-finite component."""

    def whole(c):
        x = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(x) < float(_END), F.floor(x)).otherwise(F.when(x > 0, F.lit(_END)).otherwise(F.lit(-_END)))

    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, whole).alias("v"))


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _scores(queries: np.ndarray, block: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products, candidates by queries: in doubles where these hold them exactly, in longs where those do, or else
    (wide) in Python's integers."""
    if wide:
        return block.astype(object) @ queries.astype(object).T if block.shape[1] else np.full((len(block), len(queries)), 0, object)
    if _most(queries) * _most(block) * queries.shape[1] < 2**53:
        return np.rint(block.astype(float) @ queries.astype(float).T).astype(np.int64)
    return block @ queries.T


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id").to_numpy(zero_copy_only=False), flat.reshape(part.num_rows, dim)


def _search(ids: np.ndarray, queries: np.ndarray, table: DataFrame, k: int, bins: int) -> DataFrame:
    """The k best of each of these queries among the table's vectors of their length."""
    spark, (count, dim) = table.sparkSession, queries.shape
    rows = max(1, (1 << 22) // count)
    block = spark.sparkContext.broadcast((ids, queries))
    table = table.where(F.size("v") == dim)
    norms = table.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("m")).first()["m"] or 0
    bound = np.abs(queries.astype(object)).sum(axis=1) * norms + 1 if dim else np.full(count, 1, object)
    wide = max(bound) >= _END
    kind = object if wide else np.int64
    bound = bound.astype(kind)
    low, high, wanted = -bound, bound + 1, np.full(count, k, np.int64)  # the kth score lies in [low, high)

    while True:
        width = np.maximum(1, -(-(high - low) // bins))
        ranges = spark.sparkContext.broadcast((low, high, width))

        def histogram(batches: Iterator[pa.RecordBatch], ranges=ranges) -> Iterator[pa.RecordBatch]:
            (own, q), (low, high, width) = block.value, ranges.value
            counts = np.zeros(count * bins, np.int64)
            for vec_ids, v in _blocks(batches, dim, rows):
                s = _scores(q, v, wide)
                inside = (s >= low) & (s < high) & (vec_ids[:, None] != own)
                cells = ((s - low) // width + np.arange(count) * bins)[inside].astype(np.int64)
                counts += np.bincount(cells, minlength=count * bins)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

        summed = table.mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(count * bins, np.int64)
        counts[summed["cell"]] = summed["n"]
        counts = counts.reshape(count, bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or a higher one
        hit = (above >= wanted[:, None]).sum(axis=1) - 1  # -1: fewer than k candidates, all of which are wanted
        found = hit >= 0
        chosen = np.maximum(hit, 0)
        beyond = np.where(chosen + 1 < bins, np.take_along_axis(above, np.minimum(chosen + 1, bins - 1)[:, None], 1)[:, 0], 0)
        wanted = np.where(found, wanted - beyond, wanted)
        low, high = np.where(found, low + chosen * width, low), np.where(found, low + (chosen + 1) * width, low + 1)
        if (width == 1).all() or not counts.any():
            break
        low, high = low.astype(kind), high.astype(kind)

    limits = spark.sparkContext.broadcast(low)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, q), low = block.value, limits.value
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)]  # query, id, score: this task's best k of each query at most
        for vec_ids, v in _blocks(batches, dim, rows):
            s = _scores(q, v, wide)
            r, c = np.nonzero((s >= low) & (vec_ids[:, None] != own))
            held = [np.r_[x, y] for x, y in zip(held, (c, vec_ids[r], s[r, c]), strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [x[order] for x in held]
            starts = np.r_[True, held[0][1:] != held[0][:-1]] if len(order) else np.empty(0, bool)
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else np.empty(0, int)
            held = [x[place < k] for x in held]
        ends = [max(-_END, min(_END, x)) for x in held[2].tolist()]
        exact = [f"{x:+d}" for x in held[2].tolist()] if wide else [None] * len(ends)
        yield pa.RecordBatch.from_arrays([pa.array(own[held[0]]), pa.array(held[1]), pa.array(ends, pa.int64()), pa.array(exact, pa.string())], ["query_id", "vec_id", "score", "exact"])

    # Beyond a long the exact scores decide, which are compared by sign, length and digits.
    up, size = F.col("exact").startswith("+"), F.length("exact")
    order = [F.desc("score"), F.desc(F.coalesce(F.when(up, size).otherwise(-size), F.lit(0))), F.desc(F.when(up, F.col("exact"))), F.asc(F.when(~up, F.col("exact"))), "vec_id"]
    best = Window.partitionBy("query_id").orderBy(*order)
    ranked = table.mapInArrow(pick, "query_id long, vec_id long, score long, exact string").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, bins: int = 256, block: int = 2048
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id ``every`` divides, its k best others by integer inner
    product, ties to the smaller id; all of them where there are fewer than k.

    Queries are taken ``block`` at a time: a block's vectors and its histograms are all that is broadcast or held, so
    memory doesn't follow the number of queries.  Vectors are compared with those of their own length.  Vectors that
    quantised() leaves out take no part.  Scores beyond 2**62 in size rank by their exact values and are returned as it.  Of queries repeated under one id the smallest vector asks; a query's own id is
    no candidate; other repeated rows are candidates each.  An empty table gives an empty result.
    """
    table = materialize(quantised(vectors, id_col, vector_col, scale), "topk-vectors")
    queries = table.where(F.col("vec_id") % every == 0).groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    least = queries.groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("q")).select("vec_id", "q.v", "q.dim")
    queries = materialize(least.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))), "topk-queries")
    results, spark = [], vectors.sparkSession
    for dim, n in [tuple(r) for r in queries.groupBy("dim").count().orderBy("dim").collect()]:
        own = queries.where(F.col("dim") == dim)
        parts = max(1, -(-n * 5 // (block * 4)))
        for i in range(parts):
            lo, hi = (i << 20) // parts, ((i + 1) << 20) // parts
            asked = own.where((F.col("slot") >= lo) & (F.col("slot") < hi)).orderBy("vec_id").toPandas()
            if len(asked):
                found = _search(asked["vec_id"].to_numpy(np.int64), np.array(asked["v"].tolist(), np.int64).reshape(len(asked), dim), table, k, bins)
                results.append(materialize(found, "topk-block") if parts > 1 else found)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
