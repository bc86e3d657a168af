"""Keys that tell the rows of a table apart, whatever ids they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs by their names, whatever these contain."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def keyed(docs: DataFrame, as_read: bool = False) -> tuple[DataFrame, str]:
    """docs with one more column, struct<file: long, place: long>, that is the same whenever the result is read, and that
    column's name, which no column of docs has.

    as_read says that docs is a Parquet table just as ``spark.read`` gave it: a row's file and its place in it tell it
    apart, and nothing is copied.  Any other DataFrame is written once with a key.
    """
    name = unused(docs, "__row")
    if as_read:
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))), name
    key = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))
    return materialize(docs.withColumn(name, key), "rows"), name
