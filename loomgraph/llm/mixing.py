"""Mixing sources to target weights by the cube method.

Each source has a target number of words, and with it a factor target/size that holds for all its documents.  The whole
part of the factor is taken of each document; what is left is an inclusion probability, the same for all documents of
the source.  The flight phase of the cube method then moves these probabilities, a few documents at a time, along the
null-space of the balancing constraints (the number of documents and the number of words), so that both totals stay
what they are while one document after the other reaches 0 or 1.

Documents with more than a ``1 / heavy`` share of their source's words (fewer than ``heavy`` in any source) move first: one
that reaches 0 or 1 shifts the probabilities of all lighter documents together, by an amount linear in their sizes, which
keeps both totals.  Left to the end, such a document would find too few others to balance it.  One that the others can't
make up for, whichever way it goes, stays undecided until the landing: its source may miss its target by it.

A flight of the others needs only the few documents that are still undecided, so each task streams its rows through it, and memory
doesn't follow the size of a source.  At most two documents of a source and bucket stay undecided; these fly again
among ever fewer buckets, until one bucket holds the small problem that the landing phase decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.rows import columns_of, keyed, unused
from loomgraph.scratch import materialize, scratch_scope

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
_EPS = 1e-9
_OUT = "doc_id long, source string, size long, copies long, row long, p double, bucket long"


def n_words(text):
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Each source's target: the total shared by weight, weights dealt in turn to the sources by code point (null last);
    none is above cap times its size, and what that frees is shared among the others in the same way."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, out = dict(order), float(sum(n for _, n in order)), {}
    open_sources = list(size)
    while open_sources:
        share = left / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if weight[s] * share > cap * size[s]]
        if not full:
            out |= {s: weight[s] * share for s in open_sources}
            break
        for s in full:
            out[s] = cap * size[s]
            left -= out[s]
        open_sources = [s for s in open_sources if s not in out]
    return out


def _move(pool: list[list], draw: float) -> None:
    """One step of the flight: the undecided documents' probabilities along the null-space until one is 0 or 1."""
    if len(pool) == 3:
        a, b, c = (x[1] for x in pool)
        u = [c - b, a - c, b - a]  # keeps the sum of p and the sum of p * size
        if not any(u):
            u = [1, -1, 0]
    elif pool[0][1] == pool[1][1]:
        u = [1, -1]
    elif pool[0][1] and pool[1][1]:
        u = [pool[1][1], -pool[0][1]]  # keeps the words; only the landing gives up the number of documents
    else:
        u = [1, -1]
    up = min((1 - x[2]) / d if d > 0 else x[2] / -d for x, d in zip(pool, u, strict=True) if d)
    down = min(x[2] / d if d > 0 else (1 - x[2]) / -d for x, d in zip(pool, u, strict=True) if d)
    step = up if draw * (up + down) < down else -down
    for x, d in zip(pool, u, strict=True):
        x[2] += step * d
        x[2] = 0.0 if x[2] < _EPS else 1.0 if x[2] > 1 - _EPS else x[2]


def _flight(seed: int, landing: bool):
    """A streaming flight over rows sorted by bucket and source: ``(row columns..., p)`` with p moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pool, rng, done = None, [], None, []

        def settle(row: list) -> None:
            done.append((*row[0], row[2]))

        def close() -> None:
            nonlocal pool
            while landing and len(pool) > 1:
                _move(pool, rng.random())
                for x in [x for x in pool if x[2] in (0.0, 1.0)]:
                    settle(x)
                pool = [x for x in pool if x[2] not in (0.0, 1.0)]
            for x in pool:
                if landing:
                    x[2] = float(rng.random() < x[2])
                settle(x)
            pool = []

        def batch() -> pa.RecordBatch:
            nonlocal done
            columns = list(zip(*done, strict=True)) if done else [()] * 7
            done = []
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:5], arrays[6], arrays[5]], ["doc_id", "source", "size", "copies", "row", "p", "bucket"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "source", "size", "copies", "row", "bucket", "p")]
            for doc_id, source, size, copies, key, bucket, p in zip(*columns, strict=True):
                if (bucket, source) != group:
                    close()
                    group = (bucket, source)
                    rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}\0{bucket}\0{source}\0{source is None}"))
                row = [(doc_id, source, size, copies, key, bucket), size, p]
                if p in (0.0, 1.0):
                    settle(row)
                    continue
                pool.append(row)
                if len(pool) == 3:
                    _move(pool, rng.random())
                    for x in [x for x in pool if x[2] in (0.0, 1.0)]:
                        settle(x)
                    pool = [x for x in pool if x[2] not in (0.0, 1.0)]
                if len(done) >= 20_000:
                    yield batch()
        close()
        yield batch()

    return run


def _absorb(size: float, n: float, s1: float, s2: float, ends: list[tuple[float, float]], p: float, both: bool) -> tuple[float, float] | None:
    """How much the others' probabilities (a constant, and a part by size) go down for each unit that a heavy document's goes
    up; n, s1, s2 are the others' number and sums of sizes and squared sizes, ``ends`` the smallest and largest of their
    sizes with their probabilities.  None if some probability would leave 0 to 1."""
    if both:
        det = n * s2 - s1 * s1
        if det <= 1e-9 * n * s2:
            return None
        alpha, beta = (size * s1 - s2) / det, (s1 - n * size) / det
    elif s1 > 0:
        alpha, beta = -size / s1, 0.0
    else:
        return None
    for s, q in ends:
        u = alpha + beta * s
        if not (-_EPS <= q + (1 - p) * u <= 1 + _EPS and -_EPS <= q - p * u <= 1 + _EPS):
            return None
    return alpha, beta


def _settle_heavy(seed: int):
    """Heavy documents of one source, largest first: rows with p, and one row with the line ``base + slope * size`` that
    the lighter documents' probabilities lie on afterwards."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["row"] or 0))
        head = rows[0]
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}\0heavy\0{head['source']}\0{head['source'] is None}"))
        base, slope = head["p"], 0.0
        n, s1, s2 = (head[c] + sum(r["size"] ** k for r in rows) for k, c in enumerate(("n", "s1", "s2")))
        for i, r in enumerate(rows):
            size, p = r["size"], min(1.0, max(0.0, base + slope * r["size"]))
            n, s1, s2 = n - 1, s1 - size, s2 - size * size
            lightest = rows[-1]["size"] if head["least"] is None else head["least"]
            heaviest = rows[i + 1]["size"] if i + 1 < len(rows) else head["most"]
            r["p"] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
            if r["p"] in (0.0, 1.0) or n < 1:
                continue
            ends = [(s, base + slope * s) for s in (lightest, heaviest)]
            line = _absorb(size, n, s1, s2, ends, p, True) or _absorb(size, n, s1, s2, ends, p, False)
            if line:
                r["p"] = float(rng.random() < p)
                base, slope = base + (r["p"] - p) * line[0], slope + (r["p"] - p) * line[1]
        out = [(r["doc_id"], r["source"], r["size"], r["copies"], r["row"], r["p"], None, None) for r in rows]
        columns = zip(*out, (None, head["source"], None, None, None, None, base, slope), strict=True)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = ["doc_id", "source", "size", "copies", "row", "p", "base", "slope"]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})

    return run


def _after_heavy(rows: DataFrame, plan: DataFrame, seed: int, heavy: int) -> DataFrame:
    """rows (doc_id, source, size, copies, row, p) after the heavy documents of each source have moved."""
    sized = rows.join(F.broadcast(plan.select(F.col("source").alias("__source"), "source_size")), F.col("source").eqNullSafe(F.col("__source")))
    is_heavy = F.col("size") * heavy > F.col("source_size")
    light, large = sized.where(~is_heavy).select(*rows.columns), sized.where(is_heavy).select(*rows.columns)
    x = F.col("size").cast("double")
    rest = light.groupBy(F.col("source").alias("__source")).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.min("size").alias("least"), F.max("size").alias("most"))
    known = large.join(rest, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").fillna(0.0, ["n", "s1", "s2"])
    moved = materialize(known.groupBy("source").applyInArrow(_settle_heavy(seed), "doc_id long, source string, size long, copies long, row long, p double, base double, slope double"), "mixing-heavy")
    lines = moved.where("base is not null").select(F.col("source").alias("__source"), "base", "slope")
    p = F.coalesce(F.col("base") + F.col("slope") * F.col("size"), F.col("p"))
    light = light.join(F.broadcast(lines), F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("p", p)
    light = light.withColumn("p", F.when(F.col("p") < _EPS, 0.0).when(F.col("p") > 1 - _EPS, 1.0).otherwise(F.col("p")))
    return light.select(*rows.columns).unionByName(moved.where("base is null").select(*rows.columns))


def _fly(rows: DataFrame, seed: int, landing: bool) -> DataFrame:
    """Large documents first: what stays undecided at the end is small."""
    order = ["bucket", "source", F.desc("size"), "doc_id", "copies", "p", "row"]
    dealt = rows.repartition("bucket", "source").sortWithinPartitions(*order)
    return dealt.select("doc_id", "source", "size", "copies", "row", "bucket", "p").mapInArrow(_flight(seed, landing), _OUT)


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target, factor)``.  A mix is stated per source, so the list of sources (not their
    documents) is held by the driver."""
    spark = sizes.sparkSession
    totals = [(r["source"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(totals, weights, cap)
    rows = [(s, n, goal[s], goal[s] / n if n else 0.0) for s, n in totals]
    return spark.createDataFrame(rows, "source string, source_size long, target double, factor double")


def balanced_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str | None = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    seed: int = 42,
    bucket_rows: int = 20_000,
    fan_in: int = 64,
    heavy: int = 256,
    row_col: str | None = None,
    size_col: str | None = None,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for each row of docs; taken = copies * size.

    Null texts have size 0.  A null source is a source of its own, last in order.  A source without words has target 0
    and none of its documents is taken.  Rows repeated under one id are documents each.  The draw follows from the rows
    and the seed alone, so reruns agree.  A column ``row`` follows where row_col names a long that tells rows apart; it
    orders rows that id and size leave equal.  Sizes may come in a column of their own (size_col).  An empty table gives an empty result; other columns play no part.
    """
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.col(size_col).cast("long") if size_col else n_words(F.col(text_col))).alias("size"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    sizes = materialize(sizes, "mixing-sizes")
    plan = source_plan(sizes, weights, cap)
    buckets = max(1, -(-sizes.count() // bucket_rows))
    whole = F.floor(F.col("factor") + _EPS)
    part = F.greatest(F.col("factor") - whole, F.lit(0.0))
    rows = (
        sizes.join(plan, sizes["source"].eqNullSafe(plan["source"]))
        .select("doc_id", sizes["source"], "size", whole.cast("long").alias("copies"), "row", F.when(part < _EPS, 0.0).otherwise(part).alias("p"))
    )
    rows = _after_heavy(rows, plan, seed, heavy).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets)))
    settled = []
    while True:
        flown = materialize(_fly(rows, seed, landing=buckets == 1), "mixing-flight")
        settled.append(flown.where("p in (0, 1)") if buckets > 1 else flown)
        if buckets == 1:
            break
        rows = flown.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        buckets, seed = -(-buckets // fan_in), seed + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", F.col("copies") + F.col("p").cast("long")).select("doc_id", "source", "size", "copies", "row")
    mixed = out.join(plan, out["source"].eqNullSafe(plan["source"]))
    return mixed.select("doc_id", out["source"], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row_col else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", as_read: bool = False, **params) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns.  Rows are told apart by a written key: rows repeated
    under one id, or under none, keep the copies drawn for each.  An empty table gives an empty result.  as_read: see
    ``rows.keyed``."""
    named, row = keyed(docs, as_read)
    copies, copy = unused(named, "__copies"), unused(named, "__copy")
    with scratch_scope(docs.sparkSession) as kept:
        counted = named.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("n"), F.col(row).alias("key"))
        counted = materialize(counted, "mixing-rows")
        taken = balanced_mix(counted, "doc_id", None, "source", row_col="n", size_col="size", **params).where("copies > 0")
        taken = materialize(counted.select("n", F.col("key").alias(row)).join(taken.select(F.col("row").alias("n"), F.col("copies").alias(copies)), "n").drop("n"), "mixing-taken")
        kept.append(taken)
    drawn = named.join(taken.hint("shuffle_hash"), row)
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns_of(docs))
