"""Tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests, notebooks) a local one is made,
and only under a local master, where driver and executors are one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables made inside are deleted at the end, but for those that the caller appends to the list it is given: what is
    read later must not read the others."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        made, names = _open.pop(), [f for df in kept for f in df.inputFiles()]
        for path in made:
            name = path.rsplit("/", 1)[1]
            if any(f"/{name}/" in f for f in names):
                if _open:
                    _open[-1].append(path)
            else:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: what follows doesn't compute df again, and a lost
    executor takes nothing of it along."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
