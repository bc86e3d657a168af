"""A uniform shuffle into shards of exact sizes, through a hypergeometric communication matrix.

How many rows go from each input part to each shard is drawn first, exactly as a uniform permutation would have it: a
multivariate hypergeometric row for each part.  Each part then permutes its own rows and cuts them by its row of the
matrix, the rows are exchanged, and each shard permutes what it got.  That second permutation sorts by random keys, a
range of keys (about ``block_rows`` rows) to a task, so no task gets a whole shard once shards are large; the sizes of
the ranges before it say where a range's slots begin.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.scratch import materialize


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that add up to rows and differ by one at most."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` things, out of good and bad ones without replacement, are good.  numpy has populations below
    1e9; larger ones go by inversion, over probabilities from the ratios of neighbours within 12 standard deviations of
    the mode (what lies beyond is less than a double can tell)."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    share = good / total
    reach = int(12 * math.sqrt(drawn * share * (1 - share) * (1 - drawn / total)) + 40)
    mode = (drawn + 1) * (good + 1) // (total + 2)
    low, high = max(0, drawn - bad, mode - reach), min(drawn, good, mode + reach)
    k = np.arange(low, high, dtype=float)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, len(sums) - 1))


def communication_matrix(parts: list[int], blocks: list[int], seed: int) -> np.ndarray:
    """Rows from each part to each block: margins as given, distributed as under a uniform permutation."""
    rng, left = np.random.default_rng(seed), list(blocks)
    out = np.zeros((len(parts), len(blocks)), np.int64)
    for i, n in enumerate(parts):
        others = sum(left)
        for j, size in enumerate(left):
            others -= size
            out[i, j] = hypergeometric(rng, size, others, n) if n else 0
            left[j] -= int(out[i, j])
            n -= int(out[i, j])
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 42, block_rows: int = 1_000_000) -> DataFrame:
    """df with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard), in a uniformly random order.

    Shard sizes differ by one row at most.  Any columns, nulls and repeated rows are carried along; columns of df named
    shard or slot are replaced.  An empty table gives an empty result.  The rows are written with the number of their
    part and their place in it first, so that a task that runs again finds the counts that the matrix was drawn for.  The
    driver holds ``shards`` counts for each part and one for each range of keys, never rows.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    table = materialize(df.select(F.struct(*columns).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "sharding-rows")
    counts = sorted((r["part"], r["count"]) for r in table.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    ends = np.cumsum(matrix, axis=1)
    cuts = spark.createDataFrame([(p, e) for (p, _), e in zip(counts, ends.tolist(), strict=True)], "part int, ends array<long>")

    # Repeated rows have keys of their own: n is part of them.
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "n"), "n")
    sent = table.withColumn("at", F.row_number().over(local) - 1).join(cuts, "part")
    ranges = max(1, -(-total // (shards * block_rows)))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("at")))
    key = F.xxhash64(F.lit(seed + 1), "n")
    sent = sent.select("row", "n", shard.alias("shard"), F.pmod(F.shiftright(key, 20), F.lit(ranges)).alias("range"), key.alias("key"))
    if ranges == 1:
        firsts = None
    else:
        sent = materialize(sent, "sharding-sent")
        held = {(r["shard"], r["range"]): r["count"] for r in sent.groupBy("shard", "range").count().collect()}
        firsts, at = [], {}
        for s, r in sorted(held):
            firsts.append((s, r, at.get(s, 0)))
            at[s] = at.get(s, 0) + held[s, r]
    inner = Window.partitionBy("shard", "range").orderBy("key", "n")
    placed = sent.withColumn("slot", F.row_number().over(inner).cast("long") - 1)
    if firsts:
        placed = placed.join(spark.createDataFrame(firsts, "shard int, range long, first long"), ["shard", "range"]).withColumn("slot", F.col("slot") + F.col("first"))
    return placed.select("row.*", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``: each document's place under the law ``rows``.
    size is the text's UTF-8 bytes plus 1; a null text has none, and the checksum of an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_into_shards(narrow, shards, **params)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 42, block_rows: int = 1_000_000) -> None:
    """Write df as one folder of Parquet files for each shard, rows in the order of their slots.  Nulls and repeated rows
    are carried along; an empty table writes no shard."""
    placed = shuffle_into_shards(df, shards, seed, block_rows).withColumn("__block", F.floor(F.col("slot") / block_rows))
    placed.repartition("shard", "__block").sortWithinPartitions("shard", "slot").drop("__block").write.partitionBy("shard").parquet(path)
