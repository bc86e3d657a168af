"""Embedding whitening by a bidiagonal qd solver.

The distinct vectors are centred exactly at their mean and reduced block by block to one triangular factor: each task
keeps a factor and folds its rows into it, and factors are folded by sixteens until one is left, whose size depends on the
dimension alone.  Householder bidiagonalisation, dqds and twisted factorisations (``bidiagonal``) turn it into the
covariance's eigenvalues and eigenvectors, without the covariance ever being formed.  Every row is then projected.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bidiagonal import right_singular
from loomgraph.llm.vectors import finite, floored
from loomgraph.scratch import materialize, scratch_scope

_END = 1 << 62
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_FAN_IN = 16


def integral(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(vec_id, x)`` with floor(scale * c) + offset of each entry c, the scaled part at most 2**62 in size; without the rows
    whose vector is null or holds null or non-finite entries."""
    kept = vectors.where(finite(vector_col))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(floored(vector_col, scale, _END), lambda x: x + offset).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def _sums(table: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * dim
        for _, x in _matrices(batches, dim):
            rows += len(x)
            part = x.sum(axis=0) if max(abs(int(x.max())), abs(int(x.min()))) < 2**62 // len(x) else x.astype(object).sum(axis=0)
            total = [s + int(p) for s, p in zip(total, part, strict=True)]
        values = pa.array([decimal.Decimal(s) for s in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([rows] * dim, pa.int64()), values], ["at", "n", "s"])

    found = table.mapInArrow(run, "at int, n long, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = {r["at"]: r for r in found.collect()}  # a row for each entry of a vector
    return rows[0]["n"], [int(rows[i]["s"]) for i in range(dim)]


def _centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x to x - S/n, rounded once: the whole part of the mean is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(float) - rest


def _fold(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([held, rows]), mode="r")


def triangular_factor(table: DataFrame, dim: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The factor R of a QR factorisation of the table's centred rows."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = np.empty((0, dim)), max(4 * dim, 256)
        for _, x in _matrices(batches, dim):
            for i in range(0, len(x), step):
                held = _fold(held, centred(x[i : i + step]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, dim))
        for b in batches:
            for r in b.column("r"):
                held = _fold(held, np.frombuffer(r.as_py()).reshape(-1, dim))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    factors = materialize(table.mapInArrow(leaf, "r binary"), "factors")
    while (count := factors.count()) > 1:
        parts = -(-count // _FAN_IN)
        dealt = factors.repartition(parts, F.pmod(F.xxhash64("r"), F.lit(parts))).sortWithinPartitions("r")
        factors = materialize(dealt.mapInArrow(inner, "r binary"), "factors")
    r = np.frombuffer(factors.first()["r"]).reshape(-1, dim)
    return np.concatenate([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def _identity_error(table: DataFrame, dim: int, project: Callable[[np.ndarray], np.ndarray], count: int, n: int) -> float:
    """The largest entry in size of the covariance of the projected rows minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mean, moments = 0, np.zeros(count), np.zeros((count, count))
        for _, x in _matrices(batches, dim):
            y = project(x)
            own = y.mean(axis=0)
            shift = own - mean
            moments += (y - own).T @ (y - own) + np.outer(shift, shift) * (rows * len(y) / (rows + len(y)))
            mean += shift * (len(y) / (rows + len(y)))
            rows += len(y)
        i, j = np.divmod(np.arange(count * count), count)
        columns = [pa.array(i), pa.array(j), pa.array(moments.ravel()), pa.array(rows * mean[i]), pa.array(rows * mean[j]), pa.array(rows * mean[i] * mean[j])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "inside", "si", "sj", "sij"])

    parts = table.mapInArrow(run, "i long, j long, inside double, si double, sj double, sij double")
    # Within the tasks' own means, and between those means and the whole one, which is zero but for rounding.
    summed = parts.groupBy("i", "j").agg(((F.sum("inside") + F.sum("sij") - F.sum("si") * F.sum("sj") / n) / n).alias("c"))
    return summed.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("e")).first()["e"]


def _whitened(rows: DataFrame, dim: int, components: int) -> DataFrame | None:
    """The result for rows, whose vectors all have dim entries."""
    fit = materialize(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit, dim)
    centred = _centring(n, sums)
    r = triangular_factor(fit, dim, centred)
    squares, vectors = right_singular(r, components)
    if not len(squares):
        return None
    total, count = float((r * r).sum()), len(squares)
    weights, explained = vectors / np.sqrt(squares / n), squares / total

    def project(x: np.ndarray) -> np.ndarray:
        return centred(x) @ weights

    error = _identity_error(fit, dim, project, count, n)
    whole, rest = [s // n for s in sums], [s % n for s in sums]

    def deviations(x: np.ndarray) -> list[int | None]:
        apart = x - np.array(whole, np.int64)
        most = n * (max(abs(int(apart.max())), abs(int(apart.min()))) + 1)
        exact = (apart * n - np.array(rest, np.int64)) if most * most * dim < _END else (apart.astype(object) * n - np.array(rest, object))
        return [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                for b, x in _matrices([batch.slice(i, 4096)], dim):
                    k = b.num_rows
                    ids, deviation = b.column("vec_id").take(pa.array(np.repeat(np.arange(k), count))), deviations(x)
                    columns = [
                        ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), k)), pa.array(np.full(k * count, n)),
                        pa.array([v for v in deviation for _ in range(count)], pa.int64()), pa.array(project(x).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * count, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, _SCHEMA)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each row of vectors that
    ``integral`` keeps and each of its first ``components`` principal components, numbered from 1.

    The fit is over the distinct vectors; rows repeated, with repeated ids or without one, get their results each.  A
    component without variance (to double precision) can't be whitened and isn't returned: there are fewer components than asked
    for where the vectors have a lower rank, and no rows where all are equal, empty or missing.  Vectors of different lengths
    are different spaces, each with its own fit.  deviation is null where a long can't hold it.  Other columns play no part.
    """
    rows, results = integral(vectors, id_col, vector_col, scale, offset), []
    with scratch_scope(vectors.sparkSession):
        for size in sorted(r["dim"] for r in rows.select(F.size("x").alias("dim")).distinct().collect()):
            if size and (found := _whitened(rows.where(F.size("x") == size), size, components)) is not None:
                results.append(found)
    if not results:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
