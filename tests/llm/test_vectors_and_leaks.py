"""Hard negatives, whitening and decontamination against brute force and on awkward tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bidiagonal, decontamination, hardneg, whitening

# -- 11 ---------------------------------------------------------------------------------------------------------------


def slow_negatives(rows, every=100, k=5):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, vector, label), in plain Python."""
    usable = []
    for i, x, label in rows:
        if None not in (i, x, label) and all(c is not None and np.isfinite(c) for c in x):
            usable.append((i, [int(np.floor(256 * float(c))) for c in x], label))
    anchors = {}
    for i, x, label in sorted(usable, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (x, label))
    out = []
    for a, (x, label) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, y, other in usable if i != a and len(y) == len(x))
        for top, p, _ in [s for s in scored if s[2] == label][:k]:
            fits = [(s, i) for s, i, other in scored if other != label and 80 * -top <= 100 * -s <= 100 * -top][:k]
            out += [(a, p, r + 1, i, -top, -s) for r, (s, i) in enumerate(fits)]
    return sorted(out)


def vector_rows(dim, n=260, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((4, dim))
    x = (middles[rng.integers(0, 4, n)] + 0.6 * rng.standard_normal((n, dim))) * scale
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(300 + i, rows[7][1], i % 3) for i in range(40)]  # ties
    rows += [(0, rows[3][1], 1), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]  # ids repeated, rows repeated
    bad = [None, float("nan"), float("inf")]
    return rows + [(None, rows[0][1], 1), (400, None, 1), (500, rows[1][1], None), *((600 + i, [b] + rows[1][1][1:], 1) for i, b in enumerate(bad))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, code int").repartition(3)


@pytest.mark.parametrize("dim", [1, 5, 70])
def test_hard_negatives_equal_brute_force(spark, dim):
    rows = vector_rows(dim)
    found = hardneg.hard_negatives(frame(spark, rows)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = slow_negatives(rows)
    assert sorted(map(tuple, found.collect())) == want
    assert dim == 1 or len(want) > 20


def test_hard_negatives_of_huge_components_and_in_blocks(spark):
    rows = vector_rows(6, scale=1e13)
    found = hardneg.hard_negatives(frame(spark, rows), block=1).select("anchor_id", "positive_id", "rank", "negative_id").collect()
    assert sorted(map(tuple, found)) == [r[:4] for r in slow_negatives(rows)]


def test_hard_negatives_of_nothing(spark):
    assert hardneg.hard_negatives(frame(spark, vector_rows(4)).where("false")).count() == 0
    assert hardneg.hard_negatives(frame(spark, [(0, [1.0], 1), (100, [], 1), (200, [2.0, 1.0], 2)])).count() == 0


def test_intervals_hold_every_score():
    rng = np.random.default_rng(3)
    for dim in (3, 64, 100):
        v = rng.integers(-400, 400, (300, dim)) + 50
        anchors = hardneg.Anchors.of(np.arange(20), np.zeros(20, int), v[:20])
        low, high = anchors.intervals(*hardneg.codes(v.astype(float) @ hardneg.rotation(dim)))
        scores = v @ v[:20].T
        assert ((low <= scores) & (scores <= high)).all()
        spread = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v[:20], axis=1)
        assert ((high - low) / spread).mean() < 0.7  # else the codes would tell nothing


# -- 12 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "x",
    [
        np.random.default_rng(0).standard_normal((90, 24)),
        np.random.default_rng(1).standard_normal((90, 24)) * np.logspace(0, -9, 24),
        np.eye(12),
        np.repeat(np.random.default_rng(2).standard_normal((50, 4)), 3, axis=1),
        np.random.default_rng(3).standard_normal((5, 12)),
        np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1),
        np.linalg.qr(np.random.default_rng(4).standard_normal((40, 20)))[0] * np.r_[[1.0] * 8, [0.5] * 12],
        np.array([[3.0]]),
        np.array([[3.0, 1.0], [0.0, 0.0]]),
        np.zeros((4, 4)),
    ],
    ids=["random", "graded", "identity", "repeated", "few", "wilkinson", "clusters", "one", "two", "zero"],
)
def test_singular_vectors(x):
    r = np.linalg.qr(np.concatenate([x, np.zeros((max(0, x.shape[1] - len(x)), x.shape[1]))]), mode="r")
    squares, v = bidiagonal.right_singular(r, 16)
    true = np.linalg.svd(x, compute_uv=False)
    assert len(squares) == min(16, int((true > 1e-13 * max(true[0], 1e-300)).sum()))
    assert np.allclose(np.sqrt(squares), true[: len(squares)], rtol=1e-11)
    if len(squares):
        assert np.abs(x.T @ (x @ v) - v * squares).max() < 1e-11 * squares[0]
        assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-9


def test_small_singular_values_keep_their_digits():
    a, b = np.logspace(0, -14, 15), np.full(14, 1e-3) * np.logspace(0, -14, 15)[:-1]
    found = np.sqrt(bidiagonal.dqds(a, b))
    assert abs(np.prod(found) / np.prod(a) - 1) < 1e-12  # the determinant
    assert np.allclose(found, a, rtol=1e-5)


def whitened_by_numpy(rows, count=16):
    x = np.array([np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    return n, ((x * n - s) ** 2).sum(axis=1), ((x * n - s) / n) @ w[:, :count] / np.sqrt(e[:count]), e[:count] / e.sum()


def test_whitening_equals_numpy(spark):
    rows = [r for r in vector_rows(20) if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    found = whitening.whiten(frame(spark, vector_rows(20))).toPandas()
    n, deviation, white, explained = whitened_by_numpy(rows)
    assert len(found) == 16 * len(rows) and (found["n"] == n).all() and found["identity_error"].max() < 1e-9
    keyed = {(None if np.isnan(i) else int(i), c): g for (i, c), g in found.groupby(["vec_id", "component"], dropna=False)}
    for c in range(1, 17):
        mine = np.array([keyed[r[0], c]["whitened"].iloc[0] for r in rows if r[0] not in (0, 5)])
        true = np.array([white[k, c - 1] for k, r in enumerate(rows) if r[0] not in (0, 5)])
        assert np.abs(mine * np.sign(mine @ true) - true).max() < 1e-8
    for k, r in enumerate(rows):
        assert deviation[k] in keyed[r[0], 1]["deviation"].tolist()
    assert np.allclose(found.drop_duplicates("component").sort_values("component")["explained"], explained)


def test_whitening_of_other_lengths_low_ranks_and_nothing(spark):
    assert whitening.whiten(frame(spark, [(1, None, 0)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [], 0)])).count() == 0
    line = [(i, [float(i), 2.0 * i, 3.0], 0) for i in range(9)]
    plane = [(100 + i, [float(i % 3), float(i // 3)], 0) for i in range(9)]
    found = whitening.whiten(frame(spark, line + plane)).groupBy(F.col("vec_id") >= 100).agg(F.max("component").alias("c"), F.count("*").alias("n"), F.max("identity_error").alias("e")).collect()
    assert sorted((r["c"], r["n"]) for r in found) == [(1, 9), (2, 18)] and max(r["e"] for r in found) < 1e-9
    far = whitening.whiten(frame(spark, [(1, [1e30, 0.0], 0), (2, [-1e30, 0.0], 0), (3, [0.0, 1.0], 0)])).collect()
    assert {r["vec_id"]: r["deviation"] for r in far} == {1: None, 2: None, 3: 128 * 128}


# -- 13 ---------------------------------------------------------------------------------------------------------------

_SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _SPLIT.findall((text or "").translate(_LOWER))


def windows_of(items, size=10):
    out = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - size + 1)) if w else ():
            out.setdefault(tuple(w[at : at + size]), set()).add(None if i is None else str(i))
    return out


def slow_contamination(docs, items, size=10, slop=2):
    windows = windows_of(items, size)
    texts = [words(t) for _, t in docs]
    counts = Counter(w for t in texts for w in t)
    rows = []
    for (doc, _), text in zip(docs, texts, strict=True):
        hit, exact, near = set(), set(), set()
        for window, ids in windows.items():
            if any(not counts[w] for w in window):
                continue
            rare = min(range(len(window)), key=lambda k: (counts[window[k]], k))
            for at in (p for p, w in enumerate(text) if w == window[rare]):
                start = at - rare
                misses = [min((abs(p - start - k) for p in range(max(0, start + k - slop), min(len(text), start + k + slop + 1)) if text[p] == w), default=99) for k, w in enumerate(window)]
                if max(misses) <= slop:
                    near |= ids
                if max(misses) == 0:
                    exact |= ids
                    hit |= set(range(start, start + len(window)))
        exact, near = exact - {None}, near - {None}
        rows.append((doc, len(text), len(hit), len(exact), hashlib.sha256(",".join(sorted(exact)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(rows, key=str)


PASSAGE = "the quick Brown fox number 7 jumps over one Élan dog while ñandú birds sing of the sea and the sea answers"
ITEMS = [(1, PASSAGE), (10, PASSAGE.upper()), (2, "SHORT item, here!"), (2, "another text under that id"), (3, ""), (4, None), (5, "  ... "), (None, "an item that has no id but ten words and more"), (6, "the the the the the the the the the the the"), (7, "absent words nowhere seen")]
FILLER = " ".join(f"w{i % 97}" for i in range(3000))
DOCS = [
    (1, None), (2, ""), (3, PASSAGE), (3, "x " + PASSAGE + " y"), (None, "so: " + PASSAGE[:70]), (4, PASSAGE.replace("jumps over", "jumps right over")),
    (5, "a SHORT item here, short Item here"), (6, FILLER + " " + PASSAGE + " " + FILLER), (7, "the " * 400), (8, "an item that has no id but ten words and more"), (9, "short item\x00here"),
    (10, "birds sing of the sea and the sea answers"), (11, "the quick brown fox number 7 jumps over one élan"), (12, "the quick brown fox number 7 jumps over one Élan"), (13, PASSAGE.replace(" ", "\n")), (13, PASSAGE.replace(" ", "\n")),
]


@pytest.fixture(scope="module")
def leaks(spark):
    docs = spark.createDataFrame([(*d, 1, 2, "x") for d in DOCS], "doc_id long, text string, row int, term int, word string").repartition(3)
    return docs, spark.createDataFrame([(*i, 1, "x") for i in ITEMS], "item_id long, text string, window int, words string")


def test_contamination_equals_brute_force(leaks):
    found = sorted(map(tuple, decontamination.contamination(*leaks).collect()), key=str)
    assert found == slow_contamination(DOCS, ITEMS)
    assert sum(r[5] for r in found) >= 8 and any(r[6] > r[3] for r in found)


def test_contamination_without_broadcasts(leaks, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST", -1)
    found = decontamination.contamination(*leaks, size=4, slop=0).collect()
    assert sorted(map(tuple, found), key=str) == slow_contamination(DOCS, ITEMS, 4, 0)


def test_contamination_of_empty_tables(leaks):
    docs, items = leaks
    assert decontamination.contamination(docs.where("false"), items).count() == 0
    for none in (items.where("false"), items.where("item_id in (3, 4, 5)")):
        rows = decontamination.contamination(docs, none).collect()
        assert len(rows) == len(DOCS) and not any(r["contaminated"] or r["n_near_items"] for r in rows) and max(r["n_words"] for r in rows) > 6000


def test_phrase_matches_tell_places(spark, leaks):
    docs, items = leaks
    windows, _ = decontamination.item_windows(items.where("item_id = 2"))
    vocabulary = decontamination.vocabulary_of(windows)
    index = decontamination.postings(docs.where("doc_id in (5, 9)"), vocabulary).cache()
    found = decontamination.phrase_matches(index, decontamination.by_rarity(windows, vocabulary, index)).where("exact")
    ids = index.where("term = 0").select("row", "doc_id")
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in found.join(ids, "row").collect()) == [(5, 2, 3), (5, 5, 3), (9, 1, 3)]
