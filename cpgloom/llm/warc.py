"""WARC writer and splittable reader.

Writer: one gzip member per record.  Records with equal payloads of at least ``least`` bytes are one response
(the largest page_id) and revisits that refer to it.  Spark's text writer commits the files, so a lost or
repeated task leaves no half file: a record goes out as a row of raw bytes without its last byte, and that
byte, always zero, is the line separator.  (The last byte of a gzip member is the high byte of the
size; a record of 16 MB or more is followed by an empty member, which ends in zero as well.)

Reader: files are cut into byte ranges.  A task looks for gzip magic in its range, takes a place for a record
when the first line of a WARC record can be decoded there, and owns the records that start inside its range,
reading on beyond its end for the last one.  So each record belongs to one task whatever the ranges.  Headers
may be of any length.  A record whose member is damaged or cut off, or whose header does not end, is a row of
type ``broken`` with its place and nothing else; the search goes on behind its magic.  Files are opened through
``pyarrow.fs``: local paths and the object stores it knows; others raise.

Nulls: a null page is an empty payload, a null page_id is always a response and has no id in the archive;
rows that repeat both page_id and payload are all what that page is.  Very long pages are one record each.  An empty
table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.llm.common import bounded, slices
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

RANGE_BYTES = 8 << 20
# How much is read at once beyond a range's end.
AHEAD_BYTES = 1 << 20

_MAGIC, _FIRST = b"\x1f\x8b\x08", b"WARC/1."
_SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, refers_to_id string, "
    "payload binary, payload_bytes long, payload_digest string"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member (two for records of 16 MB or more)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    head.append(f"WARC-Target-URI: {' '.join((url or '').split())}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def member(data: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    out = member(raw)
    return out if out[-1] == 0 else out + member(b"")


def write(pages: DataFrame, path: str, least: int = 0, html: str = "html", files: int | None = None) -> None:
    """Write an archive of ``pages`` (page_id, url, html) to the folder ``path``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            raw = [(t or "").encode() for t in batch.column("t").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), pa.array(map(sha1_base32, raw), pa.string()), pa.array(map(len, raw), pa.int64())],
                ["page_id", "digest", "size"],
            )

    pages = bounded(pages).select("page_id", "url", F.col(html).alias("t"))
    seen = pages.select("page_id", "t").mapInArrow(digest, "page_id long, digest string, size long").where(F.col("size") >= least)
    seen = materialize(seen.where("page_id is not null"), "digests")
    first = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # An id may come with several payloads, so a revisit is known by both.
    later = seen.join(first, "digest").where("page_id < refers_to").select(F.col("page_id").alias("_id"), "digest", "refers_to").distinct()
    later = later.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "refers_to"))).alias("revisits"))
    later = sized(later)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "t", "revisits"))
            for page_id, url, text, revisits in zip(*columns, strict=True):
                payload = (text or "").encode()
                by = dict(revisits) if revisits else {}
                out.append(_record(page_id, url, payload, by.get(sha1_base32(payload)) if by else None)[:-1])
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    rows = pages.join(later, pages["page_id"] == later["_id"], "left").select("page_id", "url", "t", "revisits")
    made = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    (made if files is None else made.coalesce(files)).write.option("lineSep", "\0").text(path)


class _Window:
    """A file seen from some offset on, read further as needed."""

    def __init__(self, file: pa.NativeFile, start: int, size: int, end: int):
        self.file, self.start, self.end = file, start, end
        file.seek(start)
        self.data = file.read(size)

    def more(self) -> bool:
        self.file.seek(self.start + len(self.data))
        piece = self.file.read(min(AHEAD_BYTES, self.end - self.start - len(self.data)))
        self.data += piece
        return bool(piece)


def _is_record(win: _Window, at: int) -> bool:
    """Whether the member at ``at`` begins like a WARC record."""
    z, out, here, step = zlib.decompressobj(31), b"", at, 64
    try:
        while len(out) < len(_FIRST) and not z.eof:
            while here >= len(win.data):
                if not win.more():
                    return False
            out += z.decompress(win.data[here : here + step], 64)
            # What the limit on the output left over comes first next time.
            here = min(here + step, len(win.data)) - len(z.unconsumed_tail)
    except zlib.error:
        return False
    return out.startswith(_FIRST)


def _member(win: _Window, at: int) -> tuple[bytes, int] | None:
    """Content of the member at ``at`` and where the next one begins; None if it is broken."""
    z, out, here = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            while here >= len(win.data):
                if not win.more():
                    return None
            out.append(z.decompress(win.data[here : here + AHEAD_BYTES]))
            here = min(here + AHEAD_BYTES, len(win.data))
    except zlib.error:
        return None
    return b"".join(out), here - len(z.unused_data)


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields.get("content-length", 0))]


def _scan(path: str, start: int, stop: int, end: int) -> Iterator[tuple]:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        win = _Window(file, start, stop - start + len(_MAGIC), end)
        at = 0
        while (at := win.data.find(_MAGIC, at)) >= 0 and start + at < stop:
            if not _is_record(win, at):
                at += 1
                continue
            found = _member(win, at)
            if found is None or b"\r\n\r\n" not in found[0]:
                yield path, start + at, None, "broken", None, None, None, None, None
                at += 1
                continue
            fields, block = _parse(found[0])
            http, _, payload = block.partition(b"\r\n\r\n")
            kind = fields.get("warc-type")
            size, digest = len(payload), sha1_base32(payload)
            if kind == "revisit":
                lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                size, digest = int(lengths[0]) if lengths else 0, fields.get("warc-payload-digest", "").removeprefix("sha1:")
            yield (
                path,
                start + at,
                fields.get("warc-record-id"),
                kind,
                fields.get("warc-target-uri"),
                fields.get("warc-refers-to"),
                payload,
                size,
                digest,
            )
            at = found[1]


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all files in the folder ``path``; of revisits size and digest are those of the full payload."""
    # Only names and sizes are read here.
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    size = F.lit(range_bytes)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size.cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("stop"), "length")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                some: list[tuple] = []
                held = 0
                for record in _scan(row["path"], row["start"], row["stop"], row["length"]):
                    some.append(record)
                    held += len(record[6] or b"")
                    if held > (4 << 20):
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
                        some, held = [], 0
                if some:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    # One range to a task, as far as tasks reach.
    n = max(1, int(files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(1))).first()[0]))
    return ranges.repartition(min(n, 20_000)).mapInArrow(scan, _SCHEMA)


def page_of(record_id):
    """The page_id in a record id of this writer."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
