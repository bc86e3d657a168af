"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

A fingerprint goes to one shard for each block of bits that it could share with a partner: of ``radius + 1`` blocks at
least one agrees when at most ``radius`` bits differ, so every link lies within some shard.  Each shard is a BK-tree
whose children are keyed by their integer Hamming distance to the parent; a search follows only the edges within the
radius.  Fingerprints grow with the corpus, so the shard trees reach their queries by a shuffle: broadcasting them
would need a bound that they don't have.  A shard of more than ``shard_limit`` fingerprints is split again by blocks of
the bits that aren't fixed yet, until the bits left bound its size.  Shards return spanning forests, never all pairs,
and connected components join them.

Equal fingerprints are merged before all this, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import word_blocks
from loomgraph.operators.components import star_components
from loomgraph.scratch import materialize

BITS = 64
_JOIN = b" ".join
_HASH = xxhash.xxh64_intdigest


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned; 0 for a text without words (or null)."""
    if not text:
        return 0
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        n = len(words) - shingle + 1
        if n > 0:
            grams = zip(*(words[i:] for i in range(shingle)), strict=False)
            counts += _bit_counts(np.fromiter((_HASH(_JOIN(g), seed) for g in grams), np.uint64, n))
            total += n
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        if not tail:
            return 0
        return _HASH(_JOIN(tail), seed)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row, fp as a signed long.  Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; each node keeps its children by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """The indices of the values at most radius bits away."""
        if not self.values:
            return []
        found, stack, values, children = [], [0], self.values, self.children
        while stack:
            i = stack.pop()
            d = (value ^ values[i]).bit_count()
            if d <= radius:
                found.append(i)
            for k, child in children[i].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        i = 0
        while i != new:
            i = self.children[i].setdefault((value ^ self.values[i]).bit_count(), new)
        return new


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what lies within the radius in one shard: at most one less than there are values."""
    tree, parent, edges = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for value in values:
        near = tree.within(value, radius)
        new = tree.add(value)
        for i in near:
            if (r := root(i)) != (s := root(new)):
                parent[s] = r
                edges.append((value, tree.values[i]))
    return edges


def _split(fixed: int, parts: int) -> list[int]:
    """The masks that fix one more of ``parts`` runs of the bits that ``fixed`` leaves open."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _shards(distinct: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """``(mask, part, fp)``: each fingerprint in each of its shards."""
    spark = distinct.sparkSession
    masks = _split(0, radius + 1)
    here = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    here, done = here.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), []
    while True:
        small_enough = all(BITS - m.bit_count() <= shard_limit.bit_length() - 1 for m in masks)
        large = None if small_enough else materialize(here.groupBy("mask", "part").count().where(F.col("count") > shard_limit).select("mask", "part", F.lit(True).alias("large")), "simhash-large")
        if large is None or large.isEmpty():
            done.append(here)
            break
        marked = materialize(here.join(large, ["mask", "part"], "left"), "simhash-shards")
        done.append(marked.where("large is null").select(*here.columns))
        wanted = {r["mask"] for r in large.select("mask").distinct().collect()}  # of at most (radius + 1) ** level masks
        finer = {m: _split(m, radius + 1) for m in masks if _signed(m) in wanted}
        masks = sorted({x for xs in finer.values() for x in xs})
        steps = spark.createDataFrame([(_signed(m), _signed(x)) for m, xs in finer.items() for x in xs], "mask long, finer long")
        here = marked.where("large").join(F.broadcast(steps), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("part"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(distinct: DataFrame, radius: int = 3, shard_limit: int = 2048) -> DataFrame:
    """``(u, v)``: edges between distinct fingerprints (column fp) that connect exactly what links at radius bits or
    fewer connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def shards(columns: list[np.ndarray], last: bool) -> Iterator[list[int]]:
            nonlocal held
            mask, part, fp = (np.concatenate([h, c]) for h, c in zip(held, columns, strict=True))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
            n = len(starts) if last else len(starts) - 1
            for i in np.flatnonzero(ends[:n] - starts[:n] > 1):
                yield np.sort(fp[starts[i] : ends[i]].view(np.uint64)).tolist()
            held = [x[starts[-1] :] for x in (mask, part, fp)]

        def edges(columns: list[np.ndarray], last: bool = False) -> pa.RecordBatch:
            found = [e for s in shards(columns, last) for e in _forest(s, radius)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        for b in batches:
            if b.num_rows:
                yield edges([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if len(held[0]):
            yield edges([np.empty(0, np.int64)] * 3, last=True)

    shards = _shards(distinct, radius, shard_limit).select("mask", "part", "fp")
    dealt = shards.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42, shard_limit: int = 2048
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of docs.

    component_id is the smallest doc_id that can be reached over links of at most ``radius`` differing bits, the row's
    own included.  Null and empty texts have fingerprint zero and link like any other.  A row with a null doc_id gets its
    fingerprint and the component's smallest doc_id (null where all are null).  Repeated rows stay repeated.  Columns of
    docs other than the two named play no part.  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = star_components(links(distinct, radius, shard_limit))
    labelled = distinct.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = materialize(labelled.join(least, "component").select("fp", "component_id"), "simhash-groups")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
