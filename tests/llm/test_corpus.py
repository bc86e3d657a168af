"""Corpus operators against brute force and on awkward tables."""

import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.llm import archives, bpe, fingerprint, licenses, mixing, neardup, pii, sharding, simhash, topk, toxicity

WORDS = "the of river stone under light seven walks green window paper quiet over about mountain letters found along road".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


LONG = " ".join(f"word{i}" for i in range(30_000))
TEXTS = [None, "", "  \t\n", "one", "two words", prose(1), prose(1), prose(1)[:-4] + "x end", prose(2), LONG, "é" * 300 + " ñandú", "a" * 5000, prose(3) + " mail me at jo.doe+x@mail.example.com or +1 (377) 555-0271", "\U0001f600 smile <|endoftext|> done"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, repeats, a row with a null id, and columns whose names operators use inside."""
    rows = [(i, t, "src0" if i % 3 else None, 7, i, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, prose(4), "src1", 7, 0, "x"), (5, prose(1), "src0", 7, 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, slot int, fp string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- 1 ----------------------------------------------------------------------------------------------------------------


def slow_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS) + 2
    prints = {i: slow_simhash(t) for i, t in enumerate(TEXTS)}
    reach = {i: min(j for j in prints if _linked(prints, i, j)) for i in prints}
    for r in found:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == reach[r["doc_id"]]
        else:
            assert r["fingerprint"] == f"{slow_simhash(prose(4)):016x}"
    assert simhash.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def _linked(prints, i, j):
    seen, todo = {i}, [i]
    while todo:
        x = todo.pop()
        for y in prints:
            if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 3:
                seen.add(y)
                todo.append(y)
    return j in seen


def test_keep_one_keeps_one(docs):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 0 in ids and 1 not in ids and None in ids


def test_keep_one_goes_by_rows(spark):
    """Copies without an id go; unrelated texts under one id stay; a copy under a shared id goes."""
    a, b, c, d = (prose(k) for k in (11, 12, 13, 14))
    rows = [(None, a), (None, a), (None, a), (1, b), (1, c), (1, d), (0, d), (None, c)]
    kept = [tuple(r) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (1, b), (1, c), (0, d)], key=str)


def _shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("limit", [3, 512])
def test_near_copies_at_the_wanted_similarity(spark, limit):
    """Groups of edited copies, among them a crowd with a common head, against all pairs by exact Jaccard."""
    rng, rows = random.Random(9), []
    for g in range(30):
        base = prose(1000 + g, 300).split()
        for c in range(12 if g == 0 else 3):
            words = list(base)
            for _ in range(rng.randint(0, 14)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(prose(1000, 300).split()[:100]) + " " + prose(2000 + i, 200)) for i in range(10)]
    sets = [_shingle_set(t) for _, t in rows]
    kept = {r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), shard_limit=limit).collect()}
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 20
    assert sum(i in kept and j in kept for i, j in near) <= 0.02 * len(near)
    group = _components(len(rows), near)
    assert {group[i] for i in kept} == set(group)  # no group goes whole: whatever goes is linked to what stays


@pytest.mark.parametrize(("own", "limit"), [(40, 512), (40, 64), (52, 512)])
def test_pages_of_a_template_stay(spark, own, limit):
    """300 common words and some of their own: similar, but no two at 0.8."""
    head = prose(77, 300)
    rows = [(i, head + " " + " ".join(f"q{i}x{k}" for k in range(own))) for i in range(200)]
    x = [_shingle_set(t) for _, t in rows[:2]]
    assert 0.7 < len(x[0] & x[1]) / len(x[0] | x[1]) < 0.8 - 1e-6
    near = [(200 + i, rows[3][1] + f" end{i}") for i in range(3)]
    kept = {r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows + near, "doc_id long, text string").repartition(4), shard_limit=limit).collect()}
    assert kept == set(range(200))


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, prose(1), "a", 7, 8, 9, 1.5), (2, prose(1), "a", 7, 8, 9, 1.5), (3, prose(2), "b", 7, 8, 9, 2.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row int, __copies int, __copy int, `a.b` double")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)


def test_wide_simhash_tells_similarity():
    rng = np.random.default_rng(2)
    common, own = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    a, b = np.r_[common, own[:50]], np.r_[common, own[50:]]  # Jaccard 0.8
    d = (int.from_bytes(neardup.wide_simhash(a), "big") ^ int.from_bytes(neardup.wide_simhash(b), "big")).bit_count()
    assert abs(d - 155) < 45 and neardup.radius_at(0.8) == 181
    assert set(neardup.band_keys(a)) & set(neardup.band_keys(b))


def test_links_when_all_shards_are_split(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    values = set(base)
    for b in base:
        for _ in range(16):
            x = b
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            values.add(x)
    prints = {i: v for i, v in enumerate(sorted(values))}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints.values()]
    df = spark.createDataFrame(signed, "fp long")

    def groups(edges):
        parent = {v[0]: v[0] for v in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return {x: root(x) for x in parent}

    brute = groups((a[0], b[0]) for a in signed for b in signed if ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= 3)
    for limit in (12, 2048):
        own = groups((r["u"], r["v"]) for r in simhash.links(df, 3, limit).collect())
        pairs = {}
        assert all(pairs.setdefault(own[x], brute[x]) == brute[x] for x in own) and len(set(own.values())) == len(set(brute.values()))


# -- 2 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    big = "<html>" + "payload WARC/1.1\r\n\r\nhttp://x 0 0 0 5\n" * 60
    rows = [(1, "http://a b", big), (2, None, big), (2, "http://c", big), (3, "http://d", None), (4, "http://e", ""), (5, "http://f", "small"), (6, "http://g", "small"), (None, "http://h", big), (7, "http://i", "é" * 900)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, at int, digest string")
    found = archives.archive_pages(pages, version=version).collect()
    assert len(found) == len(rows)
    big_rows = [r for r in found if r["payload_bytes"] == len(big.encode())]
    assert sorted(r["record_type"] for r in big_rows) == ["response", "revisit", "revisit", "revisit"]
    assert all(r["refers_to"] == (2 if r["record_type"] == "revisit" else None) for r in big_rows)
    by = {r["page_id"]: r for r in found}
    assert by[3]["payload_bytes"] == 0 and by[3]["payload_digest"] == hashlib.sha1(b"").hexdigest() and by[5]["record_type"] == by[6]["record_type"] == "response"
    assert by[7]["payload_bytes"] == 1800 and by[7]["payload_digest"] == hashlib.sha1(("é" * 900).encode()).hexdigest()
    assert archives.archive_pages(pages.where("false"), version=version).count() == 0


def test_converter_records():
    opening = archives.arc_opening(1, b"x.arc", b"20240102030405")
    data = archives.member(opening) + archives.member(archives.arc_record(1, b"dns:a", b"1.2.3.4", b"20240102030405", b"text/dns", b"a block\n\n", b"-"))
    (at0, f0, b0), (at1, f1, b1) = archives.parse_arc(data)
    assert at0 == 0 and b1 == b"a block\n\n" and f1[b"URL"] == b"dns:a"
    out = b"".join(archives.member(archives.warc_record("x", a, f, b, None)) for a, f, b in archives.parse_arc(data))
    (h0, _), (h1, block) = archives.parse_warc(out)
    assert h0["WARC-Type"] == "warcinfo" and h1["WARC-Type"] == "resource" and h1["WARC-Date"] == "2024-01-02T03:04:05Z" and block == b1
    with pytest.raises(ValueError):
        list(archives.parse_arc(archives.member(b"filedesc://x 0 0 0 20\n9 0 x\nURL\n")))
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-30]))


# -- 3 ----------------------------------------------------------------------------------------------------------------


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(docs, empty):
    t = _library()
    found = bpe.encode_documents(docs, with_ids=True).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = (prose(4) if r["doc_id"] is None else TEXTS[r["doc_id"]]) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = rows_of(bpe.decode_documents(bpe.encode_documents(docs, with_ids=True).where("doc_id = 9")))
    assert back[9]["text"] == LONG
    assert bpe.encode_documents(empty).count() == 0


def test_joins_are_repaired():
    t, c = _library(), bpe.codec(bpe.default_path())
    rng = np.random.default_rng(3)
    pool = list("ab c'd'll s  \n\t1é日本\x1c!?") + ["<|endoftext|>", " the", "re"]
    for _ in range(400):
        text = "".join(rng.choice(pool, 60))
        cuts = sorted(rng.integers(0, len(text) + 1, 4).tolist())
        ids: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            bpe.extend(ids, c.encode(text[a:b]), c)
        assert ids == t.encode(text, add_special_tokens=False).ids


def test_joins_in_texts_without_white_space():
    """Wherever a text is cut, the joined ids are those of the whole; long texts without white space join in linear time."""
    c, rng = bpe.codec(bpe.default_path()), random.Random(4)
    pools = ["\u4e00\u4e8c\u4eba\u5927\u5b66\u65e5\u672c", "abcdeest'srenghl", "\u00e9\u00e8aun'|<>", "\uac00\ub098\ub2e41", "a're've'll<|endoftext|>b "]
    for k in range(400):
        text = "".join(rng.choice(pools[k % len(pools)]) for _ in range(rng.randint(2, 120)))
        if k % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + "<|endoftext|>" + text[at:]
        cut = sorted(rng.randint(0, len(text)) for _ in range(3))
        ids = []
        for part in (text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] : cut[2]], text[cut[2] :]):
            bpe.extend(ids, c.encode(part), c)
        assert ids == c.tokenizer.encode(text, add_special_tokens=False).ids, text
    passages = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900)) for _ in range(20)]
    text = "".join(rng.choice(passages) for _ in range(370))  # 1 MB
    began, ids = time.perf_counter(), []
    for x in bpe.chunks(text):
        bpe.extend(ids, c.encode(x.decode()), c)
    assert time.perf_counter() - began < 30
    assert ids == c.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_pre_tokenizers_are_an_error(tmp_path):
    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(str(tmp_path / "other.json"))


def test_chunks_are_found_again_and_lose_nothing():
    a, shared = prose(11, 3000), prose(12, 3000)
    x, y = list(bpe.chunks(a + shared)), list(bpe.chunks("zz" + shared + a[:500]))
    assert b"".join(x).decode() == a + shared and len(set(x) & set(y)) >= 3
    assert all(p.decode() for p in bpe.chunks("日本語" * 20_000))


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, empty):
    found = fingerprint.with_edits(docs).collect()
    assert len(found) == len(TEXTS) + 2
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (5, 6)}) == 1
    order = [*range(len(TEXTS) - 1, 5, -1)]
    by = {r["doc_id"]: r for r in found}
    for i, j in zip(order, order[1:], strict=False):
        text, following = TEXTS[i] or "", TEXTS[j] or ""
        e = fingerprint.edited_text(text, following)
        assert by[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and by[i]["n_chars"] == len(text)
    assert by[8]["near_edited"] > 0.4 and by[9]["near_edited"] > 0.4 and 0 <= by[9]["near_next"] < 0.2
    assert fingerprint.with_edits(empty).count() == 0
    one = fingerprint.with_edits(docs.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_the_next_document_is_the_same_however_rows_are_dealt(spark, partitions):
    """Against plain Python: repeated and null ids, the smallest and the largest id, ranges of one row, more ranges than rows."""
    rows = [(i, prose(40 + i, 30 + i)) for i in range(12)] + [(5, prose(k, 40)) for k in range(60, 66)] + [(None, prose(k, 40)) for k in range(70, 76)]
    rows += [(None, None), (None, ""), (5, prose(60, 40)), (-(2**63), prose(80)), (2**63 - 1, prose(81)), (3, None)]
    signed = [(h + 2**63) % 2**64 - 2**63 for h in (xxhash.xxh64_intdigest((t or "").encode(), 42) for _, t in rows)]
    ordered = sorted((i is None, -(i or 0), h, t or "") for h, (i, t) in zip(signed, rows, strict=True))
    order = [(None if null else -i, t) for null, i, _, t in ordered]
    expected = [(i, len(t), hashlib.sha256(fingerprint.edited_text(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = fingerprint.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r[:3] for r in found), key=repr) == sorted(expected, key=repr)


def test_edits_write_no_table_between(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    assert fingerprint.with_edits(docs).count() == len(TEXTS) + 2
    assert not list(tmp_path.rglob("*.parquet"))


def test_documents_that_change_between_readings_are_an_error(spark):
    changing = F.udf(lambda: random.SystemRandom().randbytes(40).hex()).asNondeterministic()
    with pytest.raises(Exception, match="changed between two readings"):
        fingerprint.with_edits(spark.range(20).select(F.col("id").alias("doc_id"), changing().alias("text"))).collect()


def test_features_are_windows_that_rank_first(spark):
    """Against all runs, one by one; and the shortest texts that have a window have a feature."""
    text = prose(21, 300).encode()
    levels = fingerprint.entropy_levels(np.frombuffer(text, np.uint8))
    ranks = fingerprint.rarity_ranks(np.bincount(levels, minlength=fingerprint.LEVELS))
    n, wins = len(levels), [0] * len(levels)
    for first in range(1 - fingerprint.RUN, n):
        run = [(ranks[levels[i]], i) for i in range(max(0, first), min(n, first + fingerprint.RUN)) if ranks[levels[i]] < fingerprint.LEVELS]
        if run:
            wins[min(run)[1]] += 1
    assert fingerprint.selected(levels, ranks).tolist() == [i for i in range(n) if wins[i] >= fingerprint.POPULAR]
    assert fingerprint.digest(text, fingerprint.selected(levels, ranks)).startswith(f"{sum(w >= fingerprint.POPULAR for w in wins)}:")


def test_entropy_levels_equal_brute_force(monkeypatch):
    data = np.random.default_rng(1).choice(np.frombuffer(b"abcdefgh  ", np.uint8), 500)
    levels = fingerprint.entropy_levels(data)
    for i in range(0, len(levels), 7):
        _, n = np.unique(data[i : i + fingerprint.WINDOW], return_counts=True)
        p = n / fingerprint.WINDOW
        assert abs(levels[i] - -(p * np.log2(p)).sum() / np.log2(fingerprint.WINDOW) * fingerprint.LEVELS) <= 1.01
    ranks = fingerprint.rarity_ranks(np.bincount(levels, minlength=fingerprint.LEVELS))
    text = prose(9, 2000).encode()
    whole = fingerprint.selected(fingerprint.entropy_levels(np.frombuffer(text, np.uint8)), ranks)
    monkeypatch.setattr(fingerprint, "_BLOCK", 700)
    assert np.array_equal(fingerprint._selected_of_long(text, ranks), whole)


# -- 5 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, prose(i, 60) + (" you vile grunk" if i % 4 == 0 else ""), 1 if i % 4 == 0 else 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = rows_of(toxicity.toxicity(docs, labels))
    for i, _, y in rows:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert found[i]["predicted"] == (1 if found[i]["score"] >= 0.5 else 0)
    held = [(found[i]["predicted"], y) for i, _, y in rows if found[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 450) < 12


def test_toxicity_learns_words_of_few_rows(spark):
    """Forty words mark the toxic rows; none of them is in 1 % of the rows."""

    def marks(i):
        return " ".join(f"{(i // 16 * 5 + 8 * k) % 40:02d}zorn" for k in range(5)) if i % 16 == 0 else ""

    rows = [(i, prose(i, 40) + " " + marks(i), int(i % 16 == 0)) for i in range(2000)]
    counts = [sum(f"{k:02d}zorn" in t.split() for _, t, _ in rows) for k in range(40)]
    assert 3 <= min(counts) and max(counts) < 20
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = rows_of(toxicity.toxicity(frame.drop("toxic"), frame.drop("text")))
    held = [(found[i]["predicted"], y) for i, _, y in rows if found[i]["held_out"]]
    assert sum(p for p, y in held if y) > 0.8 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) < 0.02 * len(held)


def _slow_ftrl(rows, labels, alpha, beta, l1, l2, epochs):
    """FTRL-proximal as published, a coordinate at a time."""
    z, n = {}, {}

    def weight(i, l1):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i, l1) for i in row}
            b = -z.get("bias", 0.0) / ((beta + n.get("bias", 0.0) ** 0.5) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i, wi in [*w.items(), ("bias", b)]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * wi
                n[i] = old + g * g
    return {i: w for i in z if i != "bias" and (w := weight(i, l1))}, -z["bias"] / ((beta + n["bias"] ** 0.5) / alpha)


def test_ftrl_equals_brute_force():
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(40), rng.randint(0, 9))) for _ in range(300)]
    labels = [float(7 in r or 8 in r or rng.random() < 0.05) for r in rows]
    for l1, epochs in ((0.5, 1), (2.0, 3), (8.0, 4)):
        keys, w, bias = toxicity.train_ftrl([np.array(r, np.uint64) for r in rows], np.array(labels), 1.0, 1.0, l1, 0.1, epochs)
        want, slow_bias = _slow_ftrl(rows, labels, 1.0, 1.0, l1, 0.1, epochs)
        assert dict(zip(keys.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(slow_bias)


def test_common_features_loses_none_that_counts():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.zipf(1.3, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(300)]
    keys, counts = np.unique(np.concatenate(rows), return_counts=True)
    kept = toxicity.common_features(rows, lambda r: r, 3)
    assert len(kept) == len(rows)
    often = set(keys[counts >= 3].tolist())
    for before, after in zip(rows, kept, strict=True):
        assert often & set(before.tolist()) <= set(after.tolist()) <= set(before.tolist())
    assert sum(map(len, kept)) < sum(map(len, rows))
    for l1, epochs in ((8.0, 4), (16.0, 6)):
        labels = np.array([float(i % 7 == 0) for i in range(300)])
        a, b = (toxicity.train_ftrl(x, labels, 1.0, 1.0, l1, 0.0, epochs) for x in (rows, kept))
        assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1]) and np.isclose(a[2], b[2])


def test_trained_toxicity_on_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns; the model is a trained one."""
    rows = [(i, prose(i) + (" vile wretch" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    odd = [(900, None), (901, ""), (902, prose(1, 60_000) + " vile wretch"), (903, "vile wretch"), (903, "vile wretch"), (None, prose(2)), (0, prose(3))]
    frame = spark.createDataFrame([(i, t, 0.5, 7) for i, t in [*((i, t) for i, t, _ in rows), *odd]], "doc_id long, text string, score double, y int")
    weights = toxicity.fit(frame, labels)
    assert 0 < len(weights.features) < 1000
    found = toxicity.score(frame, weights).collect()
    assert len(found) == len(rows) + len(odd)
    of = {r["doc_id"]: r["score"] for r in found if r["doc_id"] is not None and r["doc_id"] >= 900}
    assert of[900] == of[901] and of[903] > 0.5 and of[902] > of[901]
    kept = toxicity.drop_toxic(frame, labels)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 903 not in ids and 900 in ids and 901 in ids and None in ids and ids.count(0) == 1
    assert toxicity.drop_toxic(frame.limit(0), labels).count() == 0


def test_too_many_weights_are_an_error(spark):
    rows = [(i, prose(i) + (" vile wretch" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    with pytest.raises(ValueError, match="l1"):
        toxicity.fit(frame, frame, max_weights=1)


def test_toxicity_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, none).collect()
    assert len(found) == len(TEXTS) + 2 and all(0 <= r["score"] < 0.5 for r in found)
    assert toxicity.toxicity(empty, none).count() == 0


# -- 6 ----------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("furnished", "given").replace("copies", "issues", 1)
    texts = [prose(1) + " " + mit + " " + prose(2), edited, "Released under the MIT License. " + prose(5, 3000) + " Released under the MIT License.", prose(6), None, mit[: len(mit) // 2]]
    found = rows_of(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert found[0]["license"] == "MIT" and found[0]["coverage"] == 1.0 and found[0]["end_word"] - found[0]["start_word"] == len(licenses.words_of(mit))
    assert found[1]["license"] == "MIT" and 0.9 < found[1]["coverage"] < 1
    assert found[2]["license"] == "MIT-line" and found[2]["start_word"] == 0
    assert all(found[i]["license"] is None and found[i]["coverage"] == 0 for i in (3, 4, 5))
    assert licenses.license_scan(docs).count() == len(TEXTS) + 2 and licenses.license_scan(empty).count() == 0


def test_all_licenses_of_a_text_are_named(spark):
    mit = licenses.TEMPLATES["MIT"].replace("furnished", "given")
    texts = [
        mit + " Licensed under CC BY-NC 4.0.",
        "It is released under the BSD License.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
        licenses.TEMPLATES["LGPL-3.0"],
        licenses.TEMPLATES["BSD-2-Clause"],
    ]
    found = rows_of(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    names = {i: [x["license"] for x in r["licenses"]] for i, r in found.items()}
    assert names[0] == ["CC-BY-NC-4.0-line", "MIT"] and found[0]["n_licenses"] == 2
    assert names[1] == names[2] == names[3] == []
    assert names[4] == ["Apache-2.0-line", "MIT-line", "CC-BY-NC-4.0-line"]  # all at 1: the longest first
    assert names[5][0] == "LGPL-3.0" and "GPL-3.0" not in names[5] and names[6] == ["BSD-2-Clause"]


def test_coverage_near_the_longest_common_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(6)
    for name, text in licenses.TEMPLATES.items():
        template = licenses.words_of(text)
        words = [w for w in template if rng.random() > 0.05]
        for _ in range(len(words) // 20):
            words.insert(rng.randrange(len(words)), "word")
        found, best = licenses.align(words, template), lcs(words, template)
        assert all(words[i] == template[j] for i, j in found) and 0.9 * best <= len(found) <= best, name


def test_whole_license_texts_are_found_in_long_documents(spark):
    rng, whole = random.Random(16), licenses.whole_texts()
    assert {"Apache-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "MPL-2.0-text"} <= set(whole)
    texts = []
    for name, text in whole.items():
        words = [w if rng.random() > 0.02 else "changed" for w in text.split()]
        texts.append((name, prose(len(texts), 900) + " " + " ".join(words) + " " + prose(90 + len(texts), 900)))
    half = whole["GPL-3.0-text"]
    texts.append(("none", half[: len(half) // 2]))
    found = rows_of(licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")))
    for i, (name, text) in enumerate(texts):
        got = {x["license"]: x for x in found[i]["licenses"] if x["license"].endswith("-text")}
        assert list(got) == ([] if name == "none" else [name]), (name, list(got))
        for x in got.values():
            before = len(licenses.words_of(prose(i, 900)))
            assert x["coverage"] > 0.9 and abs(x["start_word"] - before) < 40 and x["end_word"] <= len(licenses.words_of(text))


def test_no_alignment_has_more_than_the_shared_words():
    scanner = licenses.Scanner(licenses.TEMPLATES | licenses.whole_texts(), 0.8, licenses.NAMING)
    rng = random.Random(26)
    for k, (name, template, _) in enumerate(scanner.templates):
        for other in (template, scanner.templates[k - 1][1]):
            ids = np.array([x if rng.random() > 0.2 else 0 for x in other], np.int32)
            assert len(licenses.align(ids.tolist(), template)) <= scanner._shared(ids, k), name


def test_alignment():
    assert licenses.align(list("xabcdy"), list("abcd")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert licenses.align(list("aXbaYb"), list("aXbaZb")) == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 5)]
    assert licenses.align([], list("a")) == []


# -- 7 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block,bins", [(2048, 256), (3, 4)])
def test_top_k_equals_brute_force(spark, block, bins):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:180] = v[7]
    rows = [(i, v[i].tolist(), 1) for i in range(300)] + [(400, None, 1), (450, [float("nan")] * 8, 1), (401, [1.0, None] * 4, 1), (500, [1.0, 2.0], 1), (501, [3.0, 1.0], 1), (None, v[3].tolist(), 1), (50, v[50].tolist(), 1)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), block=block, bins=bins).collect()
    q = np.floor(256 * v.astype(float)).astype(np.int64)
    ids = [*range(300), 50]
    m = np.vstack([q, q[50:51]])
    for query in range(0, 300, 50):
        s = m @ q[query]
        want = sorted((-int(s[k]), ids[k]) for k in range(len(ids)) if ids[k] != query)[:5]
        got = sorted((r["rank"], -r["score"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert [(a, b) for _, a, b in got] == want and [r for r, _, _ in got] == [1, 2, 3, 4, 5]
    short = [r for r in found if r["query_id"] == 500]
    assert [(r["vec_id"], r["score"]) for r in short] == [(501, 256 * 256 * 5)]
    assert {r["query_id"] for r in found} == {0, 50, 100, 150, 200, 250, 500}


def test_top_k_of_large_components(spark):
    """On both sides of what doubles and longs hold, beside empty vectors and a component beyond a long."""
    rng = random.Random(8)
    for size in (2.0**17, 2.0**19, 2.0**24, 2.0**40, 2.0**80):
        rows = [(i, [rng.uniform(-size, size) for _ in range(3)]) for i in range(60)] + [(100, []), (101, []), (102, [float("inf"), 0.0, 1.0])]
        q = {i: [max(-(1 << 62), min(1 << 62, math.floor(256 * x))) for x in v] for i, v in rows if i != 102}
        want = set()
        for i in q:
            if i % 50 == 0:
                near = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
                want |= {(i, r + 1, j, max(-(1 << 62), min(1 << 62, -x))) for r, (x, j) in enumerate(near)}
        found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert {tuple(r) for r in found.collect()} == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- 8 ----------------------------------------------------------------------------------------------------------------


def test_targets():
    t = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert t["a"] == 30 and t["b"] == pytest.approx(130 * 2 / 3) and t[None] == pytest.approx(130 / 3)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mix_is_balanced_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(i, int(rng.integers(1, 80))), ["a", "b", "c", None][i % 4]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    first = mixing.balanced_mix(docs, bucket_rows=300, fan_in=4)
    again = mixing.balanced_mix(docs.repartition(3), bucket_rows=300, fan_in=4)
    assert sorted(map(tuple, first.select("doc_id", "taken").collect())) == sorted(map(tuple, again.select("doc_id", "taken").collect()))
    for r in first.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.sum("copies").alias("n"), F.max(F.col("taken") / F.col("size")).alias("m"), F.first("source_size").alias("s")).collect():
        assert abs(r["t"] - r["goal"]) < 100 and r["m"] <= 3
        assert abs(r["n"] - 1000 * r["goal"] / r["s"]) < 4
    assert abs(mixing.mix(docs, bucket_rows=300).count() - first.agg(F.sum("copies")).first()[0]) <= 40


def test_mix_keeps_the_copies_of_rows_without_an_id(spark):
    rows = [(None if i % 3 else i // 6, f"w{i} " + "w " * (i % 7), "ab"[i % 2]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.balanced_mix(docs).agg(F.sum("copies"), F.max("copies")).first()
    copies = [r["count"] for r in mixing.mix(docs).groupBy("text").count().collect()]
    assert sum(copies) == drawn[0] and max(copies) <= drawn[1] <= 3
    assert mixing.mix(docs).columns == docs.columns


def test_mix_meets_targets_with_heavy_documents(spark):
    """Documents with a twentieth to a sixth of their source's words: the lighter ones make up for them."""
    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 30, 600).tolist(), 250, 250, 400, 120]
    docs = spark.createDataFrame([(i, "w " * n, "abcd"[i % 4]) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in range(3):
        for r in mixing.balanced_mix(docs, seed=seed).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.count("*").alias("n")).collect():
            assert r["n"] == 151 and abs(r["t"] - r["goal"]) <= 30


def test_heavy_documents_keep_both_totals():
    n, s1, s2 = 100.0, 1500.0, 30000.0
    alpha, beta = mixing._absorb(60, n, s1, s2, [(1, 0.5), (40, 0.5)], 0.5, True)
    assert n * alpha + s1 * beta == pytest.approx(-1) and s1 * alpha + s2 * beta == pytest.approx(-60)
    assert mixing._absorb(60, n, s1, s2, [(1, 0.001), (40, 0.001)], 0.001, False) is None
    assert mixing._absorb(60, n, 0.0, 0.0, [(0, 0.5), (0, 0.5)], 0.5, False) is None


def test_mix_of_awkward_rows(docs, empty):
    found = mixing.balanced_mix(docs).collect()
    assert len(found) == len(TEXTS) + 2 and all(r["size"] == 0 for r in found if r["doc_id"] in (0, 1, 2))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in found)
    assert mixing.balanced_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii_equals_brute_force(spark, docs, empty):
    rng = np.random.default_rng(8)
    pool = ["a@b.com", "x.y@z-1.co.uk", "@", ".", "_x@y.org", "10.0.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.4", "4539 1488 0343 6467", "4539-1488-0343-6468", "4539148803436467", "+1 (377) 555-0271", "+49 30 1234", "+1((", " ", " the ", "é", "", "", "-", "5", "jo (at) site (dot) com", "call (212) 555-0199"]
    texts = ["".join(rng.choice(pool, 12)) for _ in range(300)] + [None, "", "a" * 200_000 + "@", "1." * 2_000, "12 34, " * 20_000]
    rows = list(enumerate(texts))
    found = rows_of(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        want = [(k, m.start(), m.end()) for k in BASE for m in (re.finditer(BASE[k], t or "") if len(t or "") < 10_000 else ()) if _passes(k, m[0])]
        if len(t or "") < 10_000:
            assert found[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
            assert [found[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
            spans = found[i]["spans"].split(",")
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(spans)
    assert pii.personal_data(docs).count() == len(TEXTS) + 2 and pii.personal_data(empty).count() == 0


def test_pii_of_a_text_full_of_it(spark):
    """Fifty thousand passing matches, and as many wide ones, in one text."""
    text = "a1@b.com (212) 555-0199 " * 50_000
    began = time.perf_counter()
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == 50_000 and row["spans"].startswith("email:0:8,email:24:32") and time.perf_counter() - began < 60
    want = ",".join(f"email:{24 * i}:{24 * i + 8}" for i in range(50_000))
    assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_votes_have_both_sides(spark):
    """Cards that fail the check digits are misses, on which the strict labeler says no; what reaches the classifier is
    told apart as planted."""
    good, bad = "card 4539 1488 0343 6467 now", "order 4539 1488 0343 6468 now"
    rows = [(i, good if i % 3 else bad) for i in range(300)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.selectExpr("sum(size(base_card))", "sum(size(miss_card))").first()[:] == (200, 100)
    rates = pii.em({(1, 1, 1, 1): 200.0, (0, 0, 1, -1): 100.0})
    assert rates[0][(1, 1, 1, 1)] > 0.9 and rates[0][(0, 0, 1, -1)] < 0.1
    assert rates[1][0][0] > 0.9 and rates[1][0][1] < 0.2


def test_redaction(spark, docs):
    rows = [(1, "write jo@x.com, +1 (377) 555-0271 now", 5), (2, None, 0), (3, "clean", 5)]
    out = rows_of(pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")))
    assert out[1]["text"] == "write [EMAIL], [PHONE] now" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "clean"
    assert pii.redact(docs).columns == docs.columns


def test_em_finds_reliable_labelers():
    counts = {(1, 1): 80.0, (0, 0): 60.0, (1, 0): 10.0, (-1, 1): 5.0}
    p, rates, _ = pii.em(counts)
    assert p[(1, 1)] > 0.9 > 0.5 > p[(0, 0)] and all(a > b for a, b in rates)


# -- 10 ---------------------------------------------------------------------------------------------------------------


def test_shards_are_exact_and_gapless(spark, docs, empty):
    df = spark.range(1003).select("id", F.lit(9).alias("shard"), F.lit("q").alias("slot")).repartition(5)
    placed = sharding.shuffle_into_shards(df, 8, block_rows=50)
    by = {r["shard"]: sorted(r["s"]) for r in placed.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect()}
    assert all(s == list(range(len(s))) for s in by.values()) and sorted(map(len, by.values())) == [125] * 5 + [126] * 3
    assert sorted(r["id"] for r in placed.collect()) == list(range(1003))
    found = sharding.sharded_documents(docs)
    assert found.count() == len(TEXTS) + 2
    r = rows_of(found)
    assert r[0]["size"] == 1 and r[0]["text_crc32"] == 0 and r[10]["size"] == len(TEXTS[10].encode()) + 1 and r[10]["text_crc32"] == zlib.crc32(TEXTS[10].encode())
    assert sharding.sharded_documents(empty).count() == 0


def test_repeated_rows_spread_over_shards(spark):
    """Equal rows are dealt like any others, also where a shard is permuted in ranges."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("x")).repartition(4)
    for block_rows in (50, 10_000):
        placed = sharding.shuffle_into_shards(df, 6, block_rows=block_rows)
        for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("x") == -1).cast("int")).alias("same"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
            assert r["n"] == r["d"] == r["m"] + 1 == 1000 and 250 < r["same"] < 420


def test_matrix_margins_and_mean():
    parts, blocks = [30, 50, 20], [60, 40]
    total = np.zeros((3, 2))
    for seed in range(400):
        m = sharding.communication_matrix(parts, blocks, seed)
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == blocks
        total += m
    assert np.allclose(total / 400, np.outer(parts, blocks) / 100, atol=0.6)


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_matrix_of_a_huge_table():
    parts, blocks = [10**11 // 7 + i for i in range(7)], sharding.shard_sizes(sum(10**11 // 7 + i for i in range(7)), 8)
    m = sharding.communication_matrix(parts, blocks, 1)
    assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == blocks
    assert np.abs(m / np.outer(np.array(parts, float), blocks) * sum(parts) - 1).max() < 1e-3


def test_hypergeometric_by_inversion(monkeypatch):
    """The inversion, on a population that numpy has too: equal means and spreads."""
    rng, good, bad, drawn = np.random.default_rng(4), 600_000_000, 700_000_000, 5_000
    x = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000)])
    y = rng.hypergeometric(6_000_000, 7_000_000, drawn, 4000)
    assert abs(x.mean() - y.mean()) < 4 * y.std() / 30 and abs(x.std() / y.std() - 1) < 0.08


def test_written_shards(spark, tmp_path):
    rows = [(i % 7, None if i % 5 == 0 else f"t{i}") for i in range(100)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(rows, key=str)
    assert sorted((r["shard"], r["slot"]) for r in back) == [(s, i) for s, n in enumerate((34, 33, 33)) for i in range(n)]
    sharding.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(i % 50, 80), "en", f"s{i % 3}", 1) for i in range(150)] + [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(100)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(out.columns)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "mixing", "bpe"]
    json.dumps([n for n, _ in pipeline.STAGES])
