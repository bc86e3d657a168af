"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it where the hash has a given pattern, so equal passages of different
documents fall into equal chunks.  A first pass counts the chunks of all documents; those that occur more than once are
shared.  A second pass encodes whatever isn't shared where it lies.  Shared chunks are brought together by their 128-bit
hash and encoded once each, and their ids go to the documents that have them.  There the pieces are joined: around each
join a few tokens on either side are turned back into text and encoded again, ever more of them, until they agree with
what was there on both sides.  From there on the ids are those of the whole text.

A window may end between a character that isn't white space and one that is: the pre-tokenizer's pattern takes white space
only at a token's start, looks no further back, and special tokens hold none.  It may also end amid a run of letters, if
its outermost token is the one that was there before.

Which chunks are shared is told by a sieve of fixed size (``sieve_bits``).  It has every shared chunk; the fuller it is,
the more other chunks it takes for shared, which costs shuffled bytes and changes no result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize

#: Bytes of a chunk: at least, about, and at most (at most only where the hash gives no cut).
LEAST, MOST, MASK = 512, 8192, (1 << 11) - 1
_WINDOW = 32
_GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes that are encoded at a time; longer stretches are cut where no token crosses.
PIECE = 1 << 16

#: Where no token crosses: before white space that follows something else.  Python's white space is a little more than
#: the pre-tokenizer's, so what follows must be one of four that are white space to both.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Letters of old blocks, on which all versions of Unicode agree.
_LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
_LETTER, _THREE = re.compile(_LETTERS), re.compile(_LETTERS + "{3}$")


def default_path() -> str:
    """The public byte-level vocabulary of 50k tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """A byte-level BPE tokenizer, with the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: joins are known for byte-level BPE with its own pattern only, without a prefix space or normalizer")
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        size = 1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0)
        self.bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in token if c in byte_of)
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self.decimal = [str(i).encode() for i in range(size)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, a piece at a time."""
        if len(text) <= PIECE:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        at = 0
        while at < len(text):
            cut = _SAFE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            out += self.tokenizer.encode(text[at:end], add_special_tokens=False).ids
            at = end
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
        out = [None if len(t) <= PIECE else self.encode(t) for t in texts]
        for i, e in zip(short, self.tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cuts(data: bytes) -> list[int]:
    """The ends of a text's chunks.  A cut depends on the bytes of the window before it and on the cuts before; it lies
    between code points."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    out, start, block = [], 0, 1 << 20
    for lo in range(0, n, block):
        first = max(0, lo - _WINDOW)
        h = _GEAR[raw[first : lo + block]]
        step = 1
        while step < _WINDOW:  # h[i]: the sum of gear[i - j] << j over the window
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        for i in (np.flatnonzero((h[lo - first :] >> np.uint32(16)) & np.uint32(MASK) == MASK) + lo + 1).tolist():
            while i - start > MOST:
                start = _boundary(data, start + MOST)
                out.append(start)
            i = _boundary(data, i)
            if i - start >= LEAST and i < n:
                out.append(i)
                start = i
    while n - start > MOST:
        start = _boundary(data, start + MOST)
        out.append(start)
    return [*out, n] if start < n else out


def _boundary(data: bytes, i: int) -> int:
    while i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    return i


def chunks(text: str) -> Iterator[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def _no_crossing(ids: list[int], i: int, c: Codec) -> bool:
    """Whether no token of any text can cross the start of token i."""
    if c.bytes[ids[i]][:1] not in (b" ", b"\t", b"\n", b"\r"):
        return False
    before = c.decode_bytes(ids[max(0, i - 4) : i]).decode("utf-8", "replace")
    return bool(before) and not before[-1].isspace()


def _in_letters(ids: list[int], i: int, c: Codec) -> bool:
    """Whether token i starts amid a run of letters that the pre-tokenizer takes whole: three letters before it (an
    apostrophe takes up to two along), one after, and nothing of a special token near."""
    before = c.decode_bytes(ids[max(0, i - 16) : i]).decode("utf-8", "replace")[-16:]
    after = c.decode_bytes(ids[i : i + 16]).decode("utf-8", "replace")[:16]
    return bool(_THREE.search(before)) and bool(_LETTER.match(after)) and "|" not in before + after


def extend(ids: list[int], more: list[int], c: Codec) -> None:
    """Make ids, of a text, those of that text and the one of ``more`` together.  The tokens around the join are encoded
    again.  The window grows on either side until it ends where no token crosses, or where the text does, or amid letters
    with the very token that was there before: a sequence in which each two neighbours are what BPE makes of their text
    is what it makes of the whole, so from there on the ids agree."""

    def place(side: list[int], i: int, by: int) -> int:
        """The next place from i on at which a window may end, ``by`` tokens on at least."""
        i += by
        step = 1 if by > 0 else -1
        while 0 < i < len(side) and not (_no_crossing(side, i, c) or _in_letters(side, i, c)):
            i += step
        return min(max(i, 0), len(side))

    a, b, by = place(ids, len(ids), -1), place(more, 0, 1), 1
    while True:
        new = c.encode((c.decode_bytes(ids[a:]) + c.decode_bytes(more[:b])).decode("utf-8", "surrogatepass"))
        left = a == 0 or _no_crossing(ids, a, c) or new[0] == ids[a]
        right = b == len(more) or _no_crossing(more, b, c) or new[-1] == more[b - 1]
        if left and right:
            break
        by *= 2
        a, b = a if left else place(ids, a, -by), b if right else place(more, b, by)
    ids[a:] = new
    ids += more[b:]


def _digest(doc_id, ids: list[int], c: Codec) -> tuple:
    decoded = c.decode_bytes(ids).decode("utf-8", "replace").encode()
    return doc_id, len(ids), hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _packed_ids(ids: list[int]) -> bytes:
    return np.asarray(ids, np.uint32).tobytes()


def _unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, np.uint32).tolist()


def shared_sieve(texts: DataFrame, sieve_bits: int) -> np.ndarray:
    """A bit for each chunk hash that occurs more than once (and for what shares its place): 2**sieve_bits bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [xxhash.xxh3_64_intdigest(x) for t in b.column(0) if t.is_valid for x in chunks(t.as_py())]
            hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["h", "n"])

    repeated = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.col("h").bitwiseAND(F.lit((1 << sieve_bits) - 1))
    words = repeated.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()
    sieve = np.zeros(1 << (sieve_bits - 6), np.int64)
    sieve[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return sieve


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sieve_bits: int = 27, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and ``ids array<int>`` if asked for, a row for each row of docs.

    The ids are those of the tokenizers library for the whole text, without special tokens added; text that spells a
    special token becomes that token, as the library has it.  decoded_sha256 is of the text that the ids decode to.  Null
    texts are empty: no ids.  Repeated rows and rows with a null id are encoded each for itself; an empty table gives an
    empty result; other columns play no part.
    """
    spark, path = docs.sparkSession, path or default_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sieve = spark.sparkContext.broadcast(shared_sieve(texts.select("text"), sieve_bits))
    low = (1 << sieve_bits) - 1
    result = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(found: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A finished row for a document without shared chunks; of others a row for each shared chunk, with its text where
        the task meets it first, and for each stretch between these, with its ids."""
        c, bits, n = codec(path), sieve.value, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        piece_names, piece_kinds = ["row", "at", "key", *names], [pa.int64(), pa.int64(), pa.binary(), *kinds]

        seen: set[bytes] = set()

        def text_of(key: bytes, data: bytes) -> bytes | None:
            if key in seen:
                return None
            if len(seen) >= 50_000:
                seen.clear()
            seen.add(key)
            return data

        def shared(x: bytes) -> bool:
            h = xxhash.xxh3_64_intdigest(x)
            return bool(int(bits[(h & low) >> 6]) >> (h & 63) & 1)

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, out, plain = b.slice(lo, 64), [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n += 1
                    runs: list[tuple[bool, list[bytes]]] = []
                    for x in chunks(text):
                        if shared(x):
                            runs.append((True, [x]))
                        elif runs and not runs[-1][0]:
                            runs[-1][1].append(x)
                        else:
                            runs.append((False, [x]))
                    if not any(is_shared for is_shared, _ in runs):
                        plain.append((n, 0, doc_id, text, True))
                        continue
                    for at, (is_shared, xs) in enumerate(runs):
                        data = b"".join(xs)
                        if is_shared:
                            key = xxhash.xxh3_128_digest(data)
                            out.append((n, at, key, doc_id, None, None, None, text_of(key, data)))
                        else:
                            plain.append((n, at, doc_id, data.decode("utf-8", "surrogatepass"), False))
                for (row, at, doc_id, _, whole), ids in zip(plain, c.encode_batch([p[3] for p in plain]), strict=True):
                    if whole:
                        out.append((row, None, None, *_digest(doc_id, ids, c), _packed_ids(ids) if with_ids else None))
                    else:
                        out.append((row, at, None, doc_id, None, None, None, _packed_ids(ids)))
                yield rows(out, piece_kinds, piece_names)

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = c.encode_batch([x.as_py().decode("utf-8", "surrogatepass") for x in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(map(_packed_ids, ids)), pa.binary())], ["key", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = []
            for doc_id, parts in zip(b.column("doc_id").to_pylist(), b.column("parts"), strict=True):
                ids: list[int] = []
                for p in sorted(parts.as_py(), key=lambda p: p["at"]):
                    extend(ids, _unpacked(p["ids"]), c)
                out.append((*_digest(doc_id, ids, c), _packed_ids(ids) if with_ids else None))
            yield rows(out, kinds, names)

    found = materialize(texts.mapInArrow(pieces, f"row long, at long, key binary, {result}"), "bpe-pieces")
    done = found.where("at is null").select(*names)
    refs = found.where("key is not null")
    dictionary = refs.where("ids is not null").groupBy("key").agg(F.first("ids").alias("text")).mapInArrow(encode_chunks, "key binary, ids binary")
    given = refs.select("row", "at", "doc_id", "key").join(dictionary, "key").select("row", "at", "doc_id", "ids")
    own = found.where("at is not null and key is null").select("row", "at", "doc_id", "ids")
    whole = given.unionByName(own).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "ids")).alias("parts"))
    joined = whole.select("doc_id", "parts")
    if not with_ids:
        return done.drop("ids").unionByName(joined.mapInArrow(assemble, result).drop("ids"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([np.frombuffer(x.as_py(), np.uint32).astype(np.int32) for x in b.column("ids")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], ids], names)

    def assemble_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # one Python worker for both steps
        yield from listed(assemble(batches))

    shown = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return done.mapInArrow(listed, shown).unionByName(joined.mapInArrow(assemble_lists, shown))


def decode_documents(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from lists of ids; null lists and empty ones decode to an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode_bytes(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
