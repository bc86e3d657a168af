"""Document fingerprints from improbable features.

Every 8-byte window of a text is a feature.  Its entropy, in 1000 levels, ranks it: the rarer a level is among all
windows of the corpus, the better its rank.  Windows of hardly any entropy, or of nearly all there can be, tell nothing
and have no rank.  A feature that ranks first in 4 or more of the runs of 16 neighbouring windows that hold it is selected
and inserted into a Bloom filter; a full filter is chained to a new one.  Windows are that short so that short texts have
enough of them.  Two texts are as alike as their filters overlap, beyond what filters of their fill share by chance.

Entropies come from integer sums that roll over the text, for a block of many texts at a time.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, RUN, LEVELS = 8, 16, 1000
LOWEST, HIGHEST, POPULAR = 100, 990, 4
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
_UNRANKED = 1 << 20
_BLOCK = 1 << 20
# c * log2(c), scaled to integers, and what a count adds to the sum when it grows by one.
_CLOG = np.rint(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * (1 << 20)).astype(np.int64)
_GAIN = np.diff(_CLOG)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The level of each window of the bytes, from 0 to LEVELS - 1, by the window's start."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int32)
    order = np.argsort(data, kind="stable").astype(np.int64)
    place = data[order].astype(np.int64) << 40 | order  # ascending: by byte, then by position
    t = np.arange(n)
    before = np.empty(n, np.int64)  # how often the byte occurs in the WINDOW - 1 places before it
    after = np.empty(n, np.int64)
    before[order] = t - np.searchsorted(place, place - (WINDOW - 1))
    after[order] = np.searchsorted(place, place + (WINDOW - 1), side="right") - 1 - t
    entering, leaving = _GAIN[before], _GAIN[after]
    # The sum over the window that starts at i, from the one that starts at i - 1.
    first = _CLOG[np.bincount(data[:WINDOW], minlength=256)].sum()
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = first
    np.cumsum(entering[WINDOW:] - leaving[: n - WINDOW], out=sums[1:])
    sums[1:] += first
    bits = np.log2(WINDOW) - sums / (WINDOW * float(1 << 20))
    return np.minimum((bits * (LEVELS / np.log2(WINDOW))).astype(np.int32), LEVELS - 1)


def _levels_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and levels; short texts are taken together, so that little is done for each."""
    held: list[int] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        whole = entropy_levels(np.frombuffer(b"".join(texts[i] for i in held), np.uint8))
        at = 0
        for i in held:
            yield i, whole[at : at + max(0, len(texts[i]) - WINDOW + 1)]
            at += len(texts[i])

    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= _BLOCK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in blocks that have each of its windows once."""
    for lo in range(0, max(1, len(data) - WINDOW + 1), _BLOCK):
        yield data[lo : lo + _BLOCK + WINDOW - 1]


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, 0 for the rarest; levels at either end have none."""
    ranks = np.full(LEVELS, _UNRANKED, np.int64)
    usable = np.arange(LOWEST, HIGHEST)
    ranks[usable[np.lexsort((usable, counts[LOWEST:HIGHEST]))]] = np.arange(len(usable))
    return ranks


def selected(levels: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the features that rank first, of the leftmost such, in POPULAR or more runs of RUN windows."""
    n = len(levels)
    if not n:
        return np.empty(0, np.int64)
    key = ranks[levels] << 32 | np.arange(n)
    pad = np.full(RUN - 1, _UNRANKED << 32, np.int64)  # a text's first and last features belong to fewer runs
    least = np.concatenate([pad, key, pad])
    step = 1
    while step < RUN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    best = least[least < (_UNRANKED << 32)] & ((1 << 32) - 1)
    return np.flatnonzero(np.bincount(best, minlength=n) >= POPULAR)


def _selected_of_long(data: bytes, ranks: np.ndarray) -> np.ndarray:
    """selected(), a block at a time, with enough around each block to have all runs that its features belong to."""
    found, margin = [], 2 * RUN
    for lo in range(0, len(data) - WINDOW + 1, _BLOCK):
        first = max(0, lo - margin)
        levels = entropy_levels(np.frombuffer(data, np.uint8, offset=first, count=min(len(data), lo + _BLOCK + margin + WINDOW - 1) - first))
        starts = selected(levels, ranks) + first
        found.append(starts[(starts >= lo) & (starts < lo + _BLOCK)])
    return np.concatenate(found)


def digest(data: bytes, starts: np.ndarray) -> str:
    """The chained filters as text: the number of features and the filters, in base 64.  A text too short for any has the
    whole of it as its one feature; an empty text has none."""
    features = [data[s : s + WINDOW] for s in starts.tolist()]
    features = features or ([data] if data else [])
    if not features:
        return "0:"
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in features], np.uint64)
    bits = (hashes[:, None] >> (np.arange(HASHES, dtype=np.uint64) * np.uint64(11))).astype(np.int64) & (FILTER_BITS - 1)
    filters = np.zeros((-(-len(features) // PER_FILTER), FILTER_BITS), bool)
    filters[np.arange(len(features))[:, None] // PER_FILTER, bits] = True
    return f"{len(features)}:" + base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def _filters(text: str) -> list[tuple[int, int]]:
    """Each filter as an integer, with its number of bits."""
    raw, size = base64.b64decode(text.partition(":")[2]), FILTER_BITS // 8
    values = [int.from_bytes(raw[i : i + size]) for i in range(0, len(raw), size)]
    return [(v, v.bit_count()) for v in values]


def likeness(a: str, b: str) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap with one of the other, beyond chance, weighted by
    its bits.  Equal fingerprints are fully alike, also those of empty texts; an empty one and another are not at all."""
    if a == b:
        return 1.0
    x, y = _filters(a), _filters(b)
    if not x or not y:
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    total = weight = 0.0
    for v, n in x:
        best = 0.0
        for w, m in y:
            chance, most, shared = n * m / FILTER_BITS, min(n, m), (v & w).bit_count()
            if shared > chance and most > chance:
                best = max(best, (shared - chance) / (most - chance))
        total += n * best
        weight += n
    return total / weight


@dataclass(frozen=True)
class Ranks:
    """Ranks of the entropy levels, as learned from a corpus."""

    values: np.ndarray


def fit(docs: DataFrame, text_col: str = "text") -> Ranks:
    """Count the windows of all texts by level.  What reaches the driver is one count for each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist() if t]
            for _, levels in _levels_of([x for t in texts for x in _pieces(t)]):
                counts += np.bincount(levels, minlength=LEVELS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["level", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in found:
        counts[r["level"]] = r["n"]
    return Ranks(rarity_ranks(counts))


def fingerprint_texts(texts: list[bytes], ranks: np.ndarray) -> list[str]:
    out = [""] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= _BLOCK]
    for k, levels in _levels_of([texts[i] for i in short]):
        out[short[k]] = digest(texts[short[k]], selected(levels, ranks))
    for i, t in enumerate(texts):
        if len(t) > _BLOCK:
            out[i] = digest(t, _selected_of_long(t, ranks))
    return out


def fingerprints(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for each row of docs; null texts count as empty."""
    known = docs.sparkSession.sparkContext.broadcast(ranks.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_texts(texts, known.value), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many code points from the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(rows: list[tuple], ranks: np.ndarray) -> list[tuple]:
    """rows: ``(doc_id, text, fingerprint, next text, next fingerprint)``."""
    edited = [edited_text(r[1], r[3]).encode("utf-8", "surrogatepass") for r in rows]
    prints = fingerprint_texts(edited, ranks)
    return [
        (doc_id, len(text), hashlib.sha256(e).hexdigest(), own, p, likeness(own, p), likeness(own, after))
        for (doc_id, text, own, _, after), e, p in zip(rows, edited, prints, strict=True)
    ]


def _key(doc_id: int | None, hashed: int) -> tuple[bool, int, int]:
    """Rows follow each other by rising keys: by descending id, null ids last, then by the hash of the text."""
    return (doc_id is None, 0 if doc_id is None else ~doc_id, hashed)


def with_edits(docs: DataFrame, ranks: Ranks | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how alike it is to that text and to the next document.

    Documents follow each other by descending doc_id (null ids last; rows of one id by a hash of their text, then by text),
    the first follows the last.  Rows are dealt by ranges of that order, so a document's next one is the next row of its
    task; a copy of the next range's first row ends each task.  The ranges' first keys are found beforehand from ids and
    hashes alone, so whole texts are shuffled once and nothing is written between.  docs is read several times and has to
    give the same rows each time.  Null texts count as empty.  Repeated rows follow each other.  A single document is its
    own next one; an empty table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((ranks or fit(docs, text_col)).values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, closed = None, True
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                ids, texts, tails = (c.to_pylist() for c in piece.columns)
                prints = fingerprint_texts([t.encode("utf-8", "surrogatepass") for t in texts], known.value)
                rows = list(zip(ids, texts, prints, strict=True))
                if last is not None:
                    rows.insert(0, last)
                last, closed = rows[-1], tails[-1]
                found = _compared([(*r, *s[1:]) for r, s in zip(rows, rows[1:], strict=False)], known.value)
                columns = zip(*found, strict=True) if found else [()] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)
        if not closed:
            raise ValueError("the documents changed between two readings: a range's last row has no next one")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("hashed", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hashed")]
    ranges = texts.select("doc_id", "hashed").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    key = F.struct(F.col("doc_id").isNull(), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "hashed", "doc_id")
    least = ranges.groupBy(F.spark_partition_id()).agg(F.min(key).alias("key")).select("key.doc_id", "key.hashed").collect()
    if not least:
        return spark.createDataFrame([], _RESULT)
    firsts = sorted(((r["doc_id"], r["hashed"]) for r in least), key=lambda x: _key(*x))
    bounds = [_key(*x) for x in firsts]

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        keys = map(_key, ids.to_pylist(), hashes.to_pylist())
        return pa.array([bisect.bisect_right(bounds, k) - 1 for k in keys], pa.int32())

    n = len(firsts)
    starts = spark.createDataFrame([(*x, (k - 1) % n) for k, x in enumerate(firsts)], "first_id long, first_hashed long, part int")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hashed") == F.col("first_hashed"))
    tails = texts.join(F.broadcast(starts), is_first).groupBy("part", "doc_id", "hashed").agg(F.min("text").alias("text"))
    rows = texts.withColumn("part", part_of("doc_id", "hashed")).withColumn("tail", F.lit(False))
    dealt = rows.unionByName(tails.withColumn("tail", F.lit(True))).repartitionById(n, "part").sortWithinPartitions("tail", *order, "text")
    return dealt.select("doc_id", "text", "tail").mapInArrow(run, _RESULT)
