"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, adjacent word pairs, pairs with one word between them and truncated stems (the first three to eight letters of a
word, for languages that inflect and compound) are hashed to 64 bits, so that features hardly ever collide; a document
has a feature or hasn't.  FTRL-proximal gives each coordinate its own learning rate and sets weights to exactly zero
where the accumulated gradient stays within the L1 term.  Training rows are dealt to shards of a fixed expected size,
each shard trains by itself, and the sparse models are averaged; the weights that are left are few enough to broadcast,
which fit() checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.words import word_blocks
from loomgraph.scratch import materialize, scratch_scope

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEFT, _RIGHT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Weights:
    """A trained model: sorted feature hashes, their weights, and the intercept."""

    features: np.ndarray
    values: np.ndarray
    intercept: float


#: Lengths of the truncated stems, in letters.
STEMS = range(3, 9)
_MARKS = b".,;:!?\"'()[]{}*#$%&"


class _WordHashes(dict):
    """Hashes of words without the punctuation around them; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.strip(_MARKS), 7)
        return h


def stem_hashes(words: set[bytes]) -> np.ndarray:
    """Hashes (FNV-1a over the letters) of the stems of words, repeats included."""
    bare = b" ".join([w.strip(_MARKS) for w in words]).decode("utf-8", "replace").split(" ")
    letters = np.array(bare, f"U{STEMS.stop - 1}").view(np.uint32).reshape(len(bare), -1)
    h, out = np.full(len(bare), 0xCBF29CE484222325, np.uint64), [np.empty(0, np.uint64)]
    for k in range(1, STEMS.stop):
        c = letters[:, k - 1]
        h = (h ^ c) * np.uint64(0x100000001B3)
        if k >= STEMS.start:
            out.append(h[c != 0])
    return np.concatenate(out)


def _mixed(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> np.ndarray:
    x = (a * _LEFT + (b ^ kind)) * _RIGHT
    return x ^ (x >> np.uint64(29))


def grams(text: str | None, hashes: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The features of a text, repeats included, in arrays for a block of words each."""
    tail = np.empty(0, np.uint64)
    for words in word_blocks((text or "").lower().encode("utf-8", "surrogatepass")):
        new = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        yield new
        yield stem_hashes(set(words))
        run = np.concatenate([tail, new])
        if len(run) > 1:
            yield _mixed(run[:-1], run[1:], _PAIR)
        if len(run) > 2:
            yield _mixed(run[:-2], run[2:], _SKIP)
        tail = run[-2:]


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows in their order; features, weights, intercept.  A row moves the gradient of
    a feature without weight by less than 1 in each epoch: features of too few rows to pass the L1 term are left out unseen."""
    keys, counts = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_counts=True)
    keys = keys[counts * epochs > l1]
    local = [np.searchsorted(keys, r[np.isin(r, keys, assume_unique=True)]).astype(np.int32) for r in rows]
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for idx, y in zip(local, labels, strict=True):
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g2
            bias_z += g - ((bias_n + g2) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g2
    w = weight(z, n)
    kept = w != 0
    return keys[kept], w[kept], -bias_z / ((beta + bias_n**0.5) / alpha)


def common_features(texts: list, features: Callable[[object], np.ndarray], least: int) -> list[np.ndarray]:
    """features(text) of each text, without most of those that fewer than ``least`` texts have: counts of 2**24 slots,
    which are never too small, tell what can go.  Features are made twice, so that all of them are never held."""
    slots, low = np.zeros(1 << 24, np.uint8), np.uint64((1 << 24) - 1)
    for t in texts:
        at = np.unique(features(t) & low)
        slots[at] += slots[at] < 255
    return [(f := features(t))[slots[f & low] >= least] for t in texts]


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """``(doc_id, y)`` of at most max_rows labelled documents outside the held-out fold: those whose ids hash lowest.
    Of several labels of one document the largest counts; rows with a null id or label are no labels."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    own = own.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def held_out(id_col: str):
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20_000,
    shard_rows: int = 4_000,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    epochs: int = 4,
    max_weights: int = 1_000_000,
) -> Weights:
    """Train on at most max_rows labelled documents (a documented bound: the model's classes are far simpler than it);
    without any, all scores are those of an intercept of -3.  l1 is the same for a shard of any size: by it alone a feature
    needs more than l1 / epochs rows of some shard (three) to have a weight.

    An id that repeats with several texts gives one row, the text that hashes lowest, so that shards keep their size.
    A model of more than max_weights weights isn't broadcast: fit() raises an error that names l1, the term to raise."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = _WordHashes()
        pdf = pdf.assign(order=[xxhash.xxh64_intdigest(str(i)) for i in pdf["doc_id"]]).sort_values(["order", "doc_id"])
        texts, y = pdf["text"].tolist(), pdf["y"].to_numpy()
        del pdf
        features = common_features(texts, lambda t: np.unique(np.concatenate([np.empty(0, np.uint64), *grams(t, hashes)])), int(l1 // epochs) + 1)
        hashes.clear(), texts.clear()
        keys, w, bias = train_ftrl(features, y, alpha, beta, l1, l2, epochs)
        features.clear()
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks
        keys, w = np.r_[keys.view(np.int64), 0], np.r_[w, bias]
        return pd.DataFrame({"feature": keys, "w": w, "bias": np.r_[np.zeros(len(keys) - 1, bool), True]})

    with scratch_scope(docs.sparkSession):
        chosen = materialize(training_rows(labels, max_rows=max_rows), "toxicity-rows")  # max_rows bounds the broadcast
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        shards = max(1, -(-chosen.count() // shard_rows))
        rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
        dealt = rows.groupBy(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shards)).alias("shard"))
        parts = materialize(dealt.applyInPandas(train, "feature long, w double, bias boolean"), "toxicity-models")
        used = parts.where("bias").count()
        if not used:
            return Weights(np.empty(0, np.uint64), np.empty(0), -3.0)
        mean = parts.groupBy("bias", "feature").agg((F.sum("w") / used).alias("w")).where("w <> 0")
        found = mean.limit(max_weights + 2).toPandas()
    if len(found) > max_weights + 1:
        raise ValueError(f"more than {max_weights} weights: raise l1 ({l1}) or max_weights")
    bias, weights = found[found["bias"]], found[~found["bias"]]
    keys = weights["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Weights(keys[order], weights["w"].to_numpy(float)[order], float(bias["w"].sum()))


def _score_of(spark: SparkSession, weights: Weights):
    """A column function from texts to scores."""
    model, low = spark.sparkContext.broadcast(weights), np.uint64((1 << 20) - 1)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, m = _WordHashes(), model.value
        sieve = np.zeros(1 << 20, bool)
        sieve[m.features & low] = True

        def logit(text: str | None) -> float:
            g = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[sieve[x & low]] for x in grams(text, hashes))]))
            if not len(g):
                return m.intercept
            at = np.minimum(np.searchsorted(m.features, g), len(m.features) - 1)
            return m.intercept + float(m.values[at][m.features[at] == g].sum())

        for texts in batches:
            z = np.fromiter(map(logit, texts), float, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return scores


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row, from the text alone; null and empty texts have the intercept's score."""
    scores = _score_of(docs.sparkSession, weights)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scores(F.col(text_col).cast("string")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of docs.

    held_out: crc32 of the id as text is divisible by 5 (false for a null id); labels of such rows aren't learned from.
    predicted is 1 where score >= 0.5.  Equal texts have equal scores; only the text is scored.  Repeated rows stay
    repeated, an empty table gives an empty result, other columns play no part.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, **params), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **params) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold.  A document that repeats under its id goes
    or stays by each row's own text."""
    scores = _score_of(docs.sparkSession, fit(docs, labels, id_col, text_col, **params))
    return docs.where(scores(F.col(text_col).cast("string")) < threshold)
