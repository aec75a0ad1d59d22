"""WARC archives: writer with revisit records, and a splittable reader of record-wise compressed files.

Writing. Every record is a gzip member of its own, so files can be read from any record on. Of equal payloads the row with
the largest id is written in full as a response; the others become revisit records that name it and carry no payload.

Reading. Files are dealt to tasks as byte ranges that know nothing of records. A task scans its range for the gzip magic,
validates each candidate member by decoding its start and looking for a WARC version line (compressed data holds the
magic by chance now and then), and owns the records whose member starts inside its range, however far they reach beyond
it. A failed candidate costs one short decode.

Scale. Who is a revisit is decided on ids, lengths and digests: html moves once, to meet that decision. Tasks write their
own files under names no other attempt uses and report them; the manifest of the successful attempts says what belongs
to the archive, so lost executors and repeated tasks leave no half files in it. Records stream through both sides.
The archive folder is a URI that pyarrow's file systems open (file, hdfs, s3, gs) and that all executors see.

Defined results. Null html is an empty payload; payloads under ``least`` bytes are never revisits. Rows that tie on the
largest id are all responses. A row with a null id is a response and is never referred to. Repeated rows are records of
their own. Characters that a URI can't hold are percent-encoded, and read back so. An empty table gives an empty archive. Extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, shuffle_partitions

LEAST = 1000
MAGIC, HEAD = b"\x1f\x8b\x08", b"WARC/"
RANGE_BYTES = 16 << 20
STEP = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, which gives the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    text = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode()
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(text + block + b"\r\n\r\n") + c.flush()


def _plan(pages: DataFrame, least: int, space: Workspace) -> DataFrame:
    """pages as (page_id, url, payload, sha1, refers_to)."""
    rows = pages.select(F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    large = rows.filter((F.length("payload") >= least) & F.col("page_id").isNotNull())
    # Payloads that occur more than once, by a digest far stronger than the archive's own.
    first = large.groupBy("key").agg(F.max("page_id").alias("full"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("r_key"), "full")
    repeated = broadcast_if_small(space.save(first, "repeated"))
    joined = rows.join(repeated, F.col("key") == F.col("r_key"), "left")
    refers = F.when((F.length("payload") >= least) & (F.col("page_id") != F.col("full")), F.col("full"))
    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", F.sha1("payload").alias("sha1"), refers.cast("long").alias("refers_to"))


def write(pages: DataFrame, space: Workspace, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as archive files; returns the written manifest (file, bytes, records)."""
    folder = space.path("archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        n = size = 0
        for b in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)  # records are compressed one by one
                data = record(page_id, url, payload, sha1, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return space.save(_plan(pages, least, space).mapInArrow(run, "file string, bytes long, records long"), "manifest")


class _File:
    """Reads of a file at any place, through one block kept in memory."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.block = 0, b""

    def read(self, start: int, n: int) -> bytes:
        """Up to n bytes from start; fewer at the end of the file or of the block."""
        if not self.at <= start < self.at + len(self.block):
            self.at, self.block = start, self.file.read_at(min(STEP, max(0, self.size - start)), start)
        i = start - self.at
        return self.block[i : i + n]


def _member(f: _File, start: int, only_head: bool = False) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at start, or None if there is none. With only_head: at least HEAD bytes of its content, if it has as many."""
    d, out, at = zlib.decompressobj(31), [], start
    while not d.eof:
        data = f.read(at, 512 if only_head else STEP)
        if not data:
            return None
        try:
            out.append(d.decompress(data, 64) if only_head else d.decompress(data))
        except zlib.error:
            return None
        if only_head and sum(map(len, out)) >= len(HEAD):  # a read may end early, at the end of a block
            break
        at += len(data) - len(d.unused_data)
    return b"".join(out), at


def scan(uri: str, start: int, end: int) -> Iterator[bytes]:
    """Contents of the records whose members start in [start, end) of a file."""
    f, at = _File(uri), start
    while at < end:
        window = f.read(at, STEP)
        if len(window) < len(MAGIC) and at + len(window) < f.size:  # the magic may lie across two blocks
            f.at, f.block = at, f.file.read_at(min(STEP, f.size - at), at)
            window = f.block
        if not window:
            return
        i = window.find(MAGIC)
        if i < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += i
        if at >= end:
            return
        head = _member(f, at, only_head=True)
        whole = _member(f, at) if head and head[0].startswith(HEAD) else None
        if whole is None:
            at += 1
            continue
        yield whole[0]
        at = whole[1]


def parse(content: bytes) -> dict:
    """Fields of a record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (None in a revisit)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if name is None or name == _name(None) else int(name[len("<urn:page:") : -1])
    revisit = fields["WARC-Type"] == "revisit"
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))) if revisit else len(payload)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have the digest its header gives")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To")), "payload": None if revisit else payload}


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of archive files (columns file, bytes), by ranges of range_bytes each. Without payloads, that column is null."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.filter("bytes > 0").select("file", starts).repartition(max(shuffle_partitions(files.sparkSession), 1), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for uri, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for content in scan(uri, start, start + range_bytes):
                    row = parse(content)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _TYPES)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TYPES)

    return ranges.mapInArrow(run, RECORDS)
