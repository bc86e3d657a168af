"""Sparse matrices as ``(i, j, v)`` and vectors as ``(i, v)``, over semirings of built-in aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """``times`` of two columns, ``plus`` of many rows."""

    times: Callable[[Column, Column], Column]
    plus: Callable[[Column], Column]


ARITHMETIC = Semiring(lambda a, b: a * b, F.sum)
MIN_PLUS = Semiring(lambda a, b: a + b, F.min)
MAX_PLUS = Semiring(lambda a, b: a + b, F.max)
MIN_MAX = Semiring(F.greatest, F.min)
MAX_MIN = Semiring(F.least, F.max)
LOGICAL = Semiring(lambda a, b: ((a != 0) & (b != 0)).cast("int"), F.max)
GALOIS = Semiring(lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), F.bit_xor)


def matrix_vector(m: DataFrame, x: DataFrame, s: Semiring = ARITHMETIC) -> DataFrame:
    return m.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(s.plus(s.times(F.col("v"), F.col("x"))).alias("v"))


def matrix_matrix(a: DataFrame, b: DataFrame, s: Semiring = ARITHMETIC) -> DataFrame:
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(right, "k").groupBy("i", "j").agg(s.plus(s.times(F.col("x"), F.col("y"))).alias("v"))


def element_add(a: DataFrame, b: DataFrame, s: Semiring = ARITHMETIC) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(s.plus(F.col("v")).alias("v"))


def element_multiply(a: DataFrame, b: DataFrame, s: Semiring = ARITHMETIC) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "y"), ["i", "j"]).select("i", "j", s.times(F.col("v"), F.col("y")).alias("v"))


def row_reduce(m: DataFrame, s: Semiring = ARITHMETIC) -> DataFrame:
    return m.groupBy("i").agg(s.plus(F.col("v")).alias("v"))


def column_reduce(m: DataFrame, s: Semiring = ARITHMETIC) -> DataFrame:
    return m.groupBy(F.col("j").alias("i")).agg(s.plus(F.col("v")).alias("v"))


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def adjacency(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("v"))


def laplacian(arcs: DataFrame) -> DataFrame:
    """Weighted degrees on the diagonal, negative weights elsewhere; loops drop out."""
    a = arcs.where("src <> dst")
    off = a.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg((-F.sum("w")).alias("v"))
    return off.unionByName(a.groupBy(F.col("src").alias("i")).agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v"))
