"""Hard-negative mining with rotated one-bit codes.

Vectors are rotated at random and stored as one-bit codes, several one after another: each level codes the signs of what
the levels before have left, with the code vector's alignment, its inner product with that rest.  A vector is then the sum of
its aligned code vectors and a rest whose length is stored.

An anchor's inner product with a code vector is estimated by popcounts over the bit planes of the rotated anchor, whose
rounding error is known.  The rest adds at most the product of its length and that of the part of the anchor orthogonal to
the last code vector (Cauchy-Schwarz).  So each candidate has an interval that its score is sure to lie in; only those
whose intervals reach what is wanted are scored, in integers.  Nothing is left to chance: the rotation decides how
many are scored, never the result.

Anchors are taken in blocks, which are broadcast; each task keeps the best few of each anchor.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.vectors import finite, floored
from loomgraph.scratch import materialize, scratch_scope

SCALE, LEVELS, PLANES = 256, 4, 6
_CAP, _LONG = 1 << 56, 1 << 62
_PAIRS = 1 << 20


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    spare = -signs.shape[1] % 64
    return np.packbits(np.pad(signs, ((0, 0), (0, spare))), axis=1, bitorder="little").view(np.uint64)


def codes(rotated: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, rests) of rows: words by level, the alignment of each level, and the length of what is left."""
    rest, words, aligned = rotated.astype(float), [], []
    unit = 1 / np.sqrt(rotated.shape[1])
    for _ in range(levels):
        up = rest >= 0
        aligned.append(np.abs(rest).sum(axis=1) * unit)
        rest = rest - np.where(up, unit, -unit) * aligned[-1][:, None]
        words.append(_packed(up))
    return np.stack(words, axis=1), np.stack(aligned, axis=1), np.linalg.norm(rest, axis=1)


def coded(rows: DataFrame, dim: int, levels: int = LEVELS) -> DataFrame:
    """rows (vec_id, label, v) with code, aligned and rest."""
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            code, aligned, rest = codes(v.astype(float) @ turn, levels)
            lists = pa.array(list(aligned), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), lists, pa.array(rest)], ["vec_id", "label", "v", "code", "aligned", "rest"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<long>, code binary, aligned array<double>, rest double")


@dataclass
class Anchors:
    """A block of anchors: their vectors, and their rotated forms rounded to bit planes."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    low: np.ndarray
    step: np.ndarray
    sums: np.ndarray
    planes: np.ndarray  # plane, anchor, word
    error: np.ndarray  # by how much an inner product with a code vector may be off
    norm: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> Anchors:
        dim = v.shape[1]
        turned = v.astype(float) @ rotation(dim)
        low, top = turned.min(axis=1), turned.max(axis=1)
        step = np.maximum((top - low) / (2**PLANES - 1), np.finfo(float).tiny)
        units = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
        off = np.abs(turned - (low[:, None] + step[:, None] * units)).sum(axis=1) / np.sqrt(dim)
        planes = np.stack([_packed((units >> j & 1).astype(bool)) for j in range(PLANES)])
        return cls(ids, labels, v, low, step, units.sum(axis=1), planes, off, np.linalg.norm(turned, axis=1))

    def intervals(self, code: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the scores of candidates by anchors."""
        dim, n = self.v.shape[1], len(self.ids)
        middle, spread, along = np.zeros((len(code), n)), aligned.sum(axis=1)[:, None] * self.error, None
        for level in range(code.shape[1]):
            units = np.zeros((len(code), n), np.int32)
            for j, plane in enumerate(self.planes):
                for w in range(plane.shape[1]):
                    units += np.bitwise_count(code[:, level, w, None] & plane[None, :, w]).astype(np.int32) << j
            ones = np.bitwise_count(code[:, level]).sum(axis=1, dtype=np.int64)
            along = ((2 * units - self.sums) * self.step + self.low * (2 * ones - dim)[:, None]) / np.sqrt(dim)
            middle += aligned[:, level, None] * along
        across = np.sqrt(np.maximum(self.norm**2 - np.maximum(np.abs(along) - self.error, 0) ** 2, 0))
        rounding = 64 * dim * np.finfo(float).eps * self.norm * (aligned.sum(axis=1) + rest)[:, None]
        spread += across * rest[:, None] + rounding
        return middle - spread, middle + spread


class _Best:
    """The k best (score falling, id rising) of each of n keys."""

    def __init__(self, n: int, k: int, kind: type) -> None:
        self.k, self.key, self.id, self.score, self.kth = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind), np.full(n, -np.inf)

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        key, ids, score = np.r_[self.key, key], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        at = np.arange(len(key))
        place = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        kept = place < self.k
        self.key, self.id, self.score = key[kept], ids[kept], score[kept]
        last = place == self.k - 1
        self.kth[key[last]] = _floor(score[last])


def _floor(score: np.ndarray) -> np.ndarray:
    """Doubles that are below the scores, if only just."""
    x = score.astype(float)
    return x - np.abs(x) * 1e-15 - 0.25


def _scores(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    return (a.astype(object) * b.astype(object)).sum(axis=1) if wide else np.einsum("ij,ij->i", a, b)


def _batches(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            b = whole.slice(i, rows)
            n = b.num_rows
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint64).reshape(n, -1, -(-dim // 64))
            aligned = b.column("aligned").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            yield b.column("vec_id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False), v, code, aligned, b.column("rest").to_numpy(zero_copy_only=False)


def _emitted(best: _Best, wide: bool) -> pa.RecordBatch:
    scores = pa.array([decimal.Decimal(int(s)) for s in best.score], pa.decimal128(38, 0)) if wide else pa.array(best.score)
    return pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.id), scores], ["key", "vec_id", "score"])


def _searched(table: DataFrame, task: Callable, k: int, wide: bool) -> DataFrame:
    """``(key, vec_id, score, rank)``: the k best of each key over what the tasks keep."""
    found = table.mapInArrow(task, f"key long, vec_id long, score {'decimal(38,0)' if wide else 'long'}")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _mined(table: DataFrame, anchors: Anchors, largest: int, k: int, share: tuple[int, int]) -> DataFrame:
    """The hard negatives of one block of anchors."""
    spark, (n, dim) = table.sparkSession, anchors.v.shape
    wide = int(np.abs(anchors.v.astype(object)).sum(axis=1).max(initial=0)) * largest >= 1 << 53
    kind, rows = object if wide else np.int64, max(1, _PAIRS // n)
    block = spark.sparkContext.broadcast(anchors)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = block.value, _Best(n, k, kind)
        for ids, labels, v, code, aligned, rest in _batches(batches, dim, rows):
            low, high = own.intervals(code, aligned, rest)
            alike = (labels[:, None] == own.labels) & (ids[:, None] != own.ids)
            least = best.kth
            if len(ids) > k:  # k scores are at least the kth largest low end
                low[~alike] = -np.inf
                least = np.maximum(least, np.partition(low, len(ids) - k, axis=0)[len(ids) - k])
            r, c = np.nonzero(alike & (high >= least))
            best.add(c, ids[r], _scores(v[r], own.v[c], wide))
        yield _emitted(best, wide)

    chosen = _searched(table, positives, k, wide).orderBy("key", "rank").toPandas()  # k rows an anchor at most
    if not len(chosen):
        return spark.createDataFrame([], _SCHEMA)
    asks, places = chosen["key"].to_numpy(np.int64), (chosen["rank"] - 1).to_numpy(np.int64)
    tops = np.array([int(s) for s in chosen["score"]], kind)
    bottoms = -((-share[0] * tops) // share[1])
    wanted = spark.sparkContext.broadcast((asks, places, tops, bottoms))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (asks, places, tops, bottoms) = block.value, wanted.value
        best, ceiling, floor = _Best(len(asks), k, kind), -_floor(-tops), _floor(bottoms)
        turns = [np.flatnonzero((places == p) & (bottoms <= tops)) for p in range(k)]
        for ids, labels, v, code, aligned, rest in _batches(batches, dim, rows):
            low, high = own.intervals(code, aligned, rest)
            other = (labels[:, None] != own.labels) & (ids[:, None] != own.ids)
            for asking in turns:  # one positive of each anchor at a time
                cols = asks[asking]
                least = np.maximum(floor[asking], best.kth[asking])
                r, c = np.nonzero(other[:, cols] & (high[:, cols] >= least) & (low[:, cols] <= ceiling[asking]))
                scores, which = _scores(v[r], own.v[cols[c]], wide), asking[c]
                fits = ((scores <= tops[which]) & (scores >= bottoms[which])).astype(bool)
                best.add(which[fits], ids[r[fits]], scores[fits])
        yield _emitted(best, wide)

    found = _searched(table, negatives, k, wide)
    named = list(zip(range(len(asks)), anchors.ids[asks].tolist(), chosen["vec_id"].tolist(), [max(-_LONG, min(_LONG, int(t))) for t in tops], strict=True))
    pairs = spark.createDataFrame(named, "key long, anchor_id long, positive_id long, positive_score long")

    def clamped(score: Column) -> Column:
        return F.greatest(F.least(score, F.lit(_LONG)), F.lit(-_LONG)).cast("long")

    return found.join(F.broadcast(pairs), "key").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", clamped(F.col("score")).alias("negative_score"))


_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, k: int = 5,
    share: tuple[int, int] = (80, 100), scale: int = SCALE, block: int = 4096,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor (a row whose id
    ``every`` divides) and each of its positives (its k best other rows of the same label), the k best rows of another label
    that score at least share[0]/share[1] of the positive and at most as much.

    Scores are inner products of floor(scale * x); ties go to the smaller id.  Rows take no part whose id, label or vector is
    null, or whose vector holds a null or non-finite component.  Vectors are compared with those of their own length.
    Of anchors repeated under one id the smallest (label, vector) asks; a row with the anchor's id is no candidate; other repeated
    rows are candidates each.  Components beyond 2**56 in size count as 2**56; scores beyond 2**62 rank by their exact values and
    are returned as it.  An anchor without positives, or a positive without negatives, has no rows; nor has an empty table.

    ``block`` anchors at a time are broadcast, with k positives each: memory doesn't follow the number of anchors.
    """
    spark, results = vectors.sparkSession, []
    with scratch_scope(spark) as kept:
        usable = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(vector_col))
        rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), floored(vector_col, scale, _CAP).alias("v"))
        for dim in sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()):
            if not dim:
                continue
            table = materialize(coded(rows.where(F.size("v") == dim), dim), "hardneg-codes")
            largest = table.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()["m"]
            least = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
            asking = materialize(least.select("vec_id", "a.label", "a.v", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).alias("slot")), "hardneg-anchors")
            parts = max(1, -(-asking.count() * 5 // (block * 4)))
            for i in range(parts):
                own = asking.where((F.col("slot") >= (i << 20) // parts) & (F.col("slot") < ((i + 1) << 20) // parts)).orderBy("vec_id").toPandas()
                if len(own):
                    anchors = Anchors.of(own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), np.array(own["v"].tolist(), np.int64))
                    results.append(materialize(_mined(table, anchors, largest, k, share), "hardneg-block"))
        kept += results
    if not results:
        return spark.createDataFrame([], _SCHEMA)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
