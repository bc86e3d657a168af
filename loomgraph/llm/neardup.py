"""Near duplicates at a given Jaccard similarity of word shingles: candidates by wide SimHash fingerprints and BK-trees,
each link confirmed on the whole sets.

The distance of two SimHash fingerprints tells the similarity of their shingle sets the better the wider they are: with
1,024 bits sets of Jaccard 0.8 differ in 155 bits, give or take 11.  Candidates are pairs whose fingerprints differ in at
most the radius that reaches 99 % of the pairs at the wanted similarity (181 bits at 0.8).

At such a radius no block of bits need agree, so shards are made by shingles instead: the smallest values of six hash
functions name a shard, and each document lies in 32 shards.  Two documents at 0.8 share none of them in 6 of 100,000
cases.  Each shard is a BK-tree whose children are keyed by their Hamming distance to the parent, and a search follows
only the edges within the radius.  Shards return spanning forests, never all pairs.

A shard of more than ``shard_limit`` fingerprints is dealt to trees of about that size.  Near copies meet in several
shards, dealt differently in each, so that this alone mostly connects them.  Where it leaves several groups in one shard,
whatever isn't in the largest of these searches all trees of the shard: no link is lost by dealing.

What candidates connect is a crowd.  A link counts only if the Jaccard similarity of the two shingle sets, whole, is the
wanted one; where it isn't, a tree goes on to the next neighbour within the radius.  A crowd of at most ``shard_limit`` sets is one
tree, to which each set is sent once.  In larger crowds each set is first compared with its nearest neighbour; then
those shards whose members are still apart are searched again, with their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.rows import columns_of, keyed
from loomgraph.llm.simhash import BKTree
from loomgraph.llm.words import word_blocks
from loomgraph.operators.components import star_components
from loomgraph.scratch import materialize, scratch_scope

WORDS = 16  # of 64 bits: a fingerprint
BANDS, ROWS = 32, 6
_BROADCAST = 32 << 20  # bytes
_RNG = np.random.default_rng(20240607)
_SALTS = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64)
_FACTORS, _SHIFTS = (_RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def radius_at(similarity: float, bits: int = 64 * WORDS) -> int:
    """The distance that 99 % of the pairs of equally large sets with that Jaccard similarity keep to."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 2.33 * math.sqrt(bits * p * (1 - p)))


class _WordHashes(dict):
    """Hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, shingle: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's shingles, with A-Z in lower case; of fewer words, that of the whole sequence."""
    found, tail = [], np.empty(0, np.uint64)
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        run = np.concatenate([tail, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))])
        n = len(run) - shingle + 1
        if n > 0:
            h = run[:n]
            for i in range(1, shingle):
                h = _mixed(h) + run[i : i + n]
            found.append(np.unique(_mixed(h)))
        tail = run[-(shingle - 1) :] if shingle > 1 else run[:0]
    if found:
        return np.unique(np.concatenate(found))
    h = np.zeros(min(len(tail), 1), np.uint64)
    for x in tail:
        h = _mixed(h) + x
    return _mixed(h + np.uint64(len(tail)))


def wide_simhash(h: np.ndarray) -> bytes:
    """A fingerprint of 1,024 bits: a bit is 1 if it is set in over half the shingles' hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 255):
        bits = np.unpackbits(_mixed(h[i : i + 255, None] ^ _SALTS).view(np.uint8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h)).tobytes()


def band_keys(h: np.ndarray) -> np.ndarray:
    """The names of the shards of a set of shingles, sorted."""
    if not len(h):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 256):
        x = h[i : i + 256, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return np.sort([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]).astype(np.uint64).view(np.int64)


def _texts(docs: DataFrame, row: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"), *more)


def prints(docs: DataFrame, row: str, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(row, doc_id, fp, keys, digest)`` for each row of docs, told apart by its column ``row``.  digest is equal where the
    sets of shingles are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            found = []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), shingle, hashes)
                found.append((wide_simhash(h), band_keys(h), xxhash.xxh3_128_digest(h.tobytes())))
            kinds = {"fp": pa.binary(), "keys": pa.list_(pa.int64()), "digest": pa.binary()}
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("place"), b.column("doc_id"), *made], ["file", "place", "doc_id", *kinds])

    picked = _texts(docs, row, text_col, F.col(id_col).cast("long").alias("doc_id")).select("row.file", "row.place", "doc_id", "text")
    found = picked.mapInArrow(run, "file long, place long, doc_id long, fp binary, keys array<long>, digest binary")
    return found.select(F.struct("file", "place").alias("row"), "doc_id", "fp", "keys", "digest")


def _sets(named: DataFrame, row: str, nodes: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(node, h)``: the sorted shingle hashes of nodes (node, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = pa.array([shingle_hashes(t.as_py(), shingle, hashes).tobytes() for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), found], ["node", "h"])

    asked = nodes.select("node", F.col("row").alias("__of"))
    asked = F.broadcast(asked) if nodes.count() * 48 <= _BROADCAST else asked.hint("shuffle_hash")
    picked = _texts(named, row, text_col)
    return picked.join(asked, picked["row"] == asked["__of"]).select("node", "text").mapInArrow(run, "node long, h binary")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity at least."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _tree_edges(radius: int, similarity: float | None = None):
    """Links from streams of ``(key, part, node, fp, asks, joined, h)`` sorted by key and part: a forest over the nodes of a
    tree, and the links of nodes that only ask.  Nodes of one ``joined`` (if not null) need no link; sets h, if there
    are any, confirm each link."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        tree, held, parent, first = BKTree(), [], list(range(len(rows))), {}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, row in enumerate(rows):
            if row[3] is not None:
                parent[i] = first.setdefault(row[3], i)
        values = [int.from_bytes(r[1], "big") for r in rows]
        sets = [None if r[4] is None else np.frombuffer(r[4], np.uint64) for r in rows]
        for i in sorted(range(len(rows)), key=lambda k: rows[k][2]):
            for d, j in sorted(((values[i] ^ values[held[j]]).bit_count(), held[j]) for j in tree.within(values[i], radius)):
                if root(i) != root(j) and (similarity is None or alike(sets[i], sets[j], similarity)):
                    parent[root(i)] = root(j)
                    yield rows[i][0], rows[j][0], d
            if not rows[i][2]:
                tree.add(values[i])
                held.append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def batch(edges: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(3)], ["u", "v", "d"])

        for b in batches:
            edges: list[tuple[int, int, int]] = []
            for key, part, *row in zip(*(b.column(c).to_pylist() for c in ("key", "part", "node", "fp", "asks", "joined", "h")), strict=True):
                if (key, part) != group:
                    edges += links(rows)
                    group, rows = (key, part), []
                rows.append(row)
            yield batch(edges)
        yield batch(list(links(rows)))

    return run


def _edges(members: DataFrame, distinct: DataFrame, radius: int, sets: DataFrame | None = None, similarity: float | None = None) -> DataFrame:
    """``(u, v, d)``: links, with their distances, within the trees that members (key, part, node, asks, joined) name."""
    rows = members.join(distinct.select("node", "fp"), "node")
    rows = rows.withColumn("h", F.lit(None).cast("binary")) if sets is None else rows.join(sets, "node")
    rows = rows.select("key", "part", "node", "fp", "asks", "joined", "h")
    found = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_tree_edges(radius, similarity), "u long, v long, d long")
    return found.groupBy("u", "v").agg(F.min("d").alias("d"))


def _members(distinct: DataFrame, shard_limit: int) -> DataFrame:
    """``(key, n, node, part)``: the nodes of distinct (node, fp, keys) in their shards of n nodes and these shards' trees."""
    entries = distinct.select("node", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / shard_limit))
    return materialize(entries.join(sizes, "key").select("key", "n", "node", part.alias("part")), "neardup-members")


def _searching(members: DataFrame, joined: DataFrame, shard_limit: int) -> DataFrame:
    """Members for a second search of the shards whose nodes ``joined`` (node, component) leaves apart: all nodes are
    held by their own trees, and those outside a shard's largest component ask all of its trees."""
    placed = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    most = counts.groupBy("key").agg(F.count("*").alias("several"), F.max_by("component", F.struct("c", "component")).alias("most")).where("several > 1")
    apart = F.col("component") != F.col("most")
    open_shards = materialize(placed.join(most, "key").select("key", "n", "node", "part", apart.alias("apart"), F.col("component").alias("joined")), "neardup-open")
    trees = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / shard_limit) - 1)
    ask = open_shards.where("apart").select("key", F.explode(trees).alias("part"), "node", F.lit(True).alias("asks"), "joined")
    return open_shards.select("key", "part", "node", F.lit(False).alias("asks"), "joined").unionByName(ask)


def candidates(members: DataFrame, distinct: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """``(u, v, d)``: pairs within the radius that connect whatever such pairs connect."""
    dealt = members.select("key", "part", "node", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("joined"))
    edges = materialize(_edges(dealt, distinct, radius), "neardup-edges")
    large = members.where(F.col("n") > shard_limit)
    if large.isEmpty():
        return edges
    again = _searching(large, star_components(edges), shard_limit)
    return materialize(edges.unionByName(_edges(again, distinct, radius)), "neardup-edges")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``: the pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(b.column("a"), b.column("b"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    first = sets.select(F.col("node").alias("u"), F.col("h").alias("a"))
    second = sets.select(F.col("node").alias("v"), F.col("h").alias("b"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, named: DataFrame, row: str, text_col: str, shingle: int, similarity: float, shard_limit: int) -> DataFrame:
    """``(u, v)``: pairs of nodes of distinct (node, fp, keys, row), each at that similarity, that connect whatever
    candidates at that similarity connect."""
    radius = radius_at(similarity)
    members = _members(distinct, shard_limit)
    edges = candidates(members, distinct, radius, shard_limit)
    crowds = star_components(edges)
    sizes = crowds.groupBy("component").agg(F.count("*").alias("n"))
    crowds = materialize(crowds.join(sizes, "component").select("node", "component", "n"), "neardup-crowds")
    sets = materialize(_sets(named, row, distinct.join(crowds, "node", "left_semi").select("node", "row"), text_col, shingle), "neardup-sets")
    no, none = F.lit(False).alias("asks"), F.lit(None).cast("long").alias("joined")
    small = crowds.where(F.col("n") <= shard_limit).select(F.col("component").alias("key"), F.lit(0).cast("long").alias("part"), "node", no, none)
    found = materialize(_edges(small, distinct, radius, sets, similarity).select("u", "v"), "neardup-links")
    large = crowds.where(F.col("n") > shard_limit).select("node")
    if large.isEmpty():
        return found
    inside = edges.join(large.withColumnRenamed("node", "u"), "u", "left_semi")
    both = inside.unionByName(inside.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
    nearest = both.groupBy("u").agg(F.min(F.struct("d", "v"))["v"].alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    confirmed = materialize(_confirmed(nearest, sets, similarity), "neardup-nearest")
    again = _searching(members.join(large, "node", "left_semi"), star_components(confirmed), shard_limit)
    return found.unionByName(confirmed).unionByName(materialize(_edges(again, distinct, radius, sets, similarity).select("u", "v"), "neardup-again"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, shard_limit: int = 512, as_read: bool = False
) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates: the one with the smallest doc_id, null last.

    Groups are what links connect: a Jaccard similarity of at least ``similarity`` between the sets of five-word shingles.  No
    link is made below it; of the pairs at it the fingerprints find about 99 %.  Each row is a document: rows that share an id, or
    have none, stay or go by their own texts.  Rows whose shingles are equal, repeated rows and those without words among
    them, are copies of each other.  An empty table gives an empty result.  as_read: see ``rows.keyed``.
    """
    named, row = keyed(docs, as_read)
    with scratch_scope(docs.sparkSession) as kept:
        found = materialize(prints(named, row, id_col, text_col, shingle), "neardup-prints")
        first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
        same = found.groupBy("digest").agg(F.min(first).alias("least"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
        distinct = materialize(same.select(F.monotonically_increasing_id().alias("node"), "least", "fp", "keys", F.col("least.row").alias("row")), "neardup-distinct")
        joined = star_components(links(distinct, named, row, text_col, shingle, similarity, shard_limit))
        placed = distinct.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = materialize(placed.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row)), "neardup-kept")
        kept.append(heads)
    return named.join(heads.hint("shuffle_hash"), row, "left_semi").select(*columns_of(docs))
