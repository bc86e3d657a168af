"""WARC from legacy ARC archives.

An ARC file opens with a version block whose first line names the file and whose second line gives the version; the
third line lists the header fields of the records that follow.  Version 1 has five fields, version 2 ten.  A record is
one header line, as many bytes as its last field declares, and a newline.  The converter goes by the declared lengths
alone, so payloads may hold anything, header lines of either format included.  For every record it makes the WARC
equivalent: an identifier that follows from the record, the timestamp in ISO form, the type, and SHA-1 digests.

Archives are files of bounded size, compressed a record at a time.  Spark's own writer and reader put them into the
shared folder and take them out again, so any file system that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize, scratch_path

# Fixed values of the two formats.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGE_HEADER = b"X-Page-Id: "
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")
#: Compressed bytes after which an archive is closed; a larger record makes a larger archive.
ARCHIVE_BYTES = 4 << 20


def member(data: bytes) -> bytes:
    """data as gzip, ending in a zero byte: the last byte holds the highest bits of the length, and an empty member
    follows where these aren't zero."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if not out[-1] else out + zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and contents of each gzip member that isn't empty."""
    view, at, step = memoryview(data), 0, 1 << 16
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        z, out, end = zlib.decompressobj(31), [], at
        while not z.eof and end < len(view):
            out.append(z.decompress(view[end : end + step]))
            end = min(end + step, len(view))
        if not z.eof:
            raise ValueError(f"the archive is cut off in the record at {at}")
        if body := b"".join(out):
            yield at, body
        at = end - len(z.unused_data)


def _packed(records: Iterator[bytes], opening: Callable[[int], bytes]) -> Iterator[bytes]:
    """Archives of about ARCHIVE_BYTES, each opened by a member of its own."""
    held, size, n = [], 0, 0
    for r in records:
        if not held:
            held.append(member(opening(n)))
            n += 1
        held.append(member(r))
        size += len(held[-1])
        if size >= ARCHIVE_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _one_line(text: str | None, default: str) -> bytes:
    """text as one field of a header line."""
    out = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text or default)
    return out.encode("utf-8", "surrogatepass")


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_record(version: int, url: bytes, ip: bytes, date: bytes, kind: bytes, block: bytes, name: bytes) -> bytes:
    """One ARC record in the fields of its version."""
    middle = b"" if version == 1 else b" 200 " + base64.b32encode(hashlib.sha1(block).digest()) + b" - 0 " + name
    return b" ".join((url, ip, date, kind)) + middle + b" %d\n" % len(block) + block + b"\n"


def arc_opening(version: int, name: bytes, date: bytes) -> bytes:
    block = b"%d 0 loomgraph\n" % version + ARC_FIELDS[version] + b"\n"
    head = b"filedesc://" + name + b" 0.0.0.0 " + date + b" text/plain"
    return head + (b"" if version == 1 else b" 200 - - 0 " + name) + b" %d\n" % len(block) + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """``(offset, fields, block)`` of each record of a compressed ARC file, the version block first."""
    names: list[bytes] = []
    for at, record in members(data):
        line, _, rest = record.partition(b"\n")
        values = line.split(b" ")
        if not names:
            version = int(rest.split(b" ", 1)[0])
            if version not in ARC_FIELDS or not line.startswith(b"filedesc://"):
                raise ValueError("the archive doesn't open with a version block of a known version")
            names = ARC_FIELDS[version].split(b" ")
        if len(values) != len(names):
            raise ValueError(f"{len(values)} header fields at {at}; the version has {len(names)}")
        fields = dict(zip(names, values, strict=True))
        length = int(fields[b"Archive-length"])
        if len(rest) < length:
            raise ValueError(f"the record at {at} declares {length} bytes and has {len(rest)}")
        yield at, fields, rest[:length]


def pages_to_arc(pages: DataFrame, version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """``(content)``: the rows of pages as ARC files, an HTTP response each.  A null page has an empty payload, a null
    url is written as ``about:blank``, the id goes into an HTTP header (none for a null id)."""
    stamp = date.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
                    body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    own = b"" if page.as_py() is None else PAGE_HEADER + str(page.as_py()).encode() + b"\r\n"
                    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"\r\n" + body
                    yield arc_record(version, _one_line(url.as_py(), "about:blank"), b"0.0.0.0", stamp, b"text/html", block, b"pages.arc")

        for archive in _packed(records(), lambda n: arc_opening(version, b"pages-%05d.arc.gz" % n, stamp)):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["content"])

    picked = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return picked.mapInArrow(run, "content binary")


# --- WARC --------------------------------------------------------------------------------------------------------


def _http(block: bytes) -> tuple[bytes, bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head + gap, body) if head.startswith(b"HTTP/") and gap else (b"", block)


def _page(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        if line.startswith(PAGE_HEADER):
            return int(line[len(PAGE_HEADER) :])
    return None


def record_id(name: str, at: int) -> str:
    """The identifier of the record at an offset of an archive."""
    return f"urn:uuid:{uuid.uuid5(_IDS, f'{name}#{at}')}"


def _iso(date: bytes) -> str:
    d = date.decode()
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(name: str, at: int, fields: dict[bytes, bytes], block: bytes, refers_to: str | None) -> bytes:
    """The WARC equivalent of an ARC record: warcinfo for the version block, response for HTTP, resource for anything
    else; a revisit, without payload, where refers_to names an equal one."""
    head, body = _http(block)
    uri, kind = fields[b"URL"].decode("utf-8", "surrogateescape"), "response" if head else "resource"
    if uri.startswith("filedesc://"):
        kind, block = "warcinfo", b"software: loomgraph\r\nformat: WARC File Format 1.1\r\nconformsTo: " + uri.encode("utf-8", "surrogateescape") + b"\r\n"
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(name, at)}>"), ("WARC-Date", _iso(fields[b"Archive-date"]))]
    if kind == "warcinfo":
        lines.append(("Content-Type", "application/warc-fields"))
    else:
        lines += [("WARC-Target-URI", uri), ("WARC-IP-Address", fields[b"IP-address"].decode()), ("WARC-Payload-Digest", _sha1(body))]
        lines.append(("Content-Type", "application/http; msgtype=response" if head else fields[b"Content-type"].decode("utf-8", "surrogateescape")))
        if refers_to:
            lines[0], block = ("WARC-Type", "revisit"), head
            lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    lines += [("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return top.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header, block)`` of each record of a compressed WARC file."""
    for at, record in members(data):
        top, _, rest = record.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        yield header, rest[: int(header["Content-Length"])]


# --- Spark -------------------------------------------------------------------------------------------------------


def write_archives(archives: DataFrame, name: str) -> str:
    """Write the content of each row, which ends in a zero byte, as a file of its own; the folder."""
    path = scratch_path(archives.sparkSession, name)
    text = F.expr("cast(substring(content, 1, octet_length(content) - 1) as string)").alias("value")
    archives.select(text).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)
    return path


def read_archives(spark, path: str) -> DataFrame:
    """``(name, content)`` of the archives in a folder; name is the file's own name."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 1)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "content")


def survey_arc(archives: DataFrame) -> DataFrame:
    """``(name, at, page_id, payload_bytes, digest)`` of each HTTP record of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name"), b.column("content"), strict=True):
                rows = [(name.as_py(), at, *(lambda h: (_page(h[0]), len(h[1]), hashlib.sha1(h[1]).digest()))(_http(block))) for at, f, block in parse_arc(content.as_py()) if not f[b"URL"].startswith(b"filedesc://")]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "at", "page_id", "payload_bytes", "digest"])

    return archives.mapInArrow(run, "name string, at long, page_id long, payload_bytes long, digest binary")


def revisits(survey: DataFrame, least_bytes: int) -> DataFrame:
    """``(name, refers)``: for each archive its records that revisit another, as ``[(at, name and offset of that
    one)]``.  Of records with equal payloads of least_bytes or more, the one with the largest page id stays a response
    (of these the last in the archives; a null id is smaller than any)."""
    large = survey.where(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "name", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = large.join(groups.drop("n"), ["digest", "payload_bytes"]).where("name <> first.name or at <> first.at")
    return found.groupBy("name").agg(F.collect_list(F.struct("at", F.col("first.name").alias("to_name"), F.col("first.at").alias("to_at"))).alias("refers"))


def arc_to_warc(archives: DataFrame, refers: DataFrame) -> DataFrame:
    """``(content)``: each ARC file as a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, refers in zip(b.column("name"), b.column("content"), b.column("refers"), strict=True):
                own, to = name.as_py(), {r["at"]: record_id(r["to_name"], r["to_at"]) for r in refers.as_py() or []}
                out = b"".join(member(warc_record(own, at, f, block, to.get(at))) for at, f, block in parse_arc(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["content"])

    return archives.join(refers, "name", "left").select("name", "content", "refers").mapInArrow(run, "content binary")


def survey_warc(archives: DataFrame) -> DataFrame:
    """``(record, page_id, payload_bytes, payload_digest, record_type, refers)`` of each response and revisit.  Length and
    digest of a response are those of the payload that is there; of a revisit, the digest is the one that it states."""

    def row(header: dict[str, str], block: bytes) -> tuple:
        head, body = _http(block)
        digest, length = hashlib.sha1(body).hexdigest(), len(body)
        if header["WARC-Type"] == "revisit":
            digest, length = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), None
        return header["WARC-Record-ID"].strip("<>"), _page(head), length, digest, header["WARC-Type"], header.get("WARC-Refers-To", "").strip("<>") or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "page_id", "payload_bytes", "payload_digest", "record_type", "refers"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for content in b.column("content"):
                rows = [row(h, x) for h, x in parse_warc(content.as_py()) if h["WARC-Type"] in ("response", "revisit")]
                columns = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return archives.select("content").mapInArrow(run, "record string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string")


def resolved(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: revisits by the page they refer to, with the
    length of its payload."""
    first = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers")
    target: Column = F.col("refers") == F.col("record")
    known = first.select("record", F.col("page_id").alias("refers_to"), "payload_bytes")
    return first.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.join(known, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def archive_pages(pages: DataFrame, least_bytes: int = 1000, version: int = 1, **columns) -> DataFrame:
    """One row for each row of pages, as read back from the WARC archives that it went to.

    pages are written as ARC files of the given version, these are converted to WARC, and the WARC files are read.
    Repeated rows have records of their own.  An empty table gives an empty result; columns of pages other than those
    named play no part.
    """
    spark = pages.sparkSession
    arcs = read_archives(spark, write_archives(pages_to_arc(pages, version, **columns), "arc"))
    refers = materialize(revisits(materialize(survey_arc(arcs), "arc-survey"), least_bytes), "arc-revisits")
    warcs = read_archives(spark, write_archives(arc_to_warc(arcs, refers), "warc"))
    return resolved(materialize(survey_warc(warcs), "warc-survey"))
