"""Vector columns as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector and its entries are neither null nor, as doubles, non-finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def floored(vector: str, scale: int, most: int) -> Column:
    """floor(scale * entry) of each entry as a long, at most ``most`` in size."""

    def whole(c: Column) -> Column:
        x = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(x) < float(most), F.floor(x)).otherwise(F.when(x > 0, F.lit(most)).otherwise(F.lit(-most)))

    return F.transform(vector, whole)
