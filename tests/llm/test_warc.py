"""WARC: records owned once whatever the ranges, false and cut magic, revisits, odd rows, empty tables."""

import gzip
import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.common import Workspace

NOISE = random.Random(5)
BIG = "<p>" + "x" * 1200
MAGIC_TEXT = "\x1f\x8b\x08" * 50  # the magic inside a payload
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, "http://a/7", BIG), (3, "u 3", None), (4, "u\r\nWARC-Type: x", ""), (5, None, "short"), (6, "u6", "short"), (8, "http://é/", "é" * 700), (9, "u9", "é" * 700),
    (None, "none", BIG), (10, "u10", MAGIC_TEXT + "y" * 900), (11, "u11", "".join(NOISE.choice("abcdefgh\x1f") for _ in range(3 << 20))), (12, "u12", "z" * 999), (13, "u13", "z" * 999), (14, "u14", "w" * 1000), (14, "u14", "w" * 1000), (15, "u15", "w" * 1000),
]
SCHEMA = "page_id long, url string, html string, payload string, key int, full long"


def plain():
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        full = max((j for j, _, h in ROWS if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and i is not None and i != full
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", full if revisit else None))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def files(spark):
    pages = spark.createDataFrame([(*r, "clash", 1, 2) for r in ROWS], SCHEMA).repartition(3)
    return warc.write(pages, Workspace(spark, "warc-test")).collect()


@pytest.mark.parametrize("range_bytes", [1000, 65_537, 16 << 20])
def test_every_record_once_whatever_the_ranges(spark, files, range_bytes):
    df = spark.createDataFrame(files)
    got = sorted((tuple(r)[:5] for r in warc.read(df, range_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=key)
    assert got == sorted(plain(), key=key) and sum(f["records"] for f in files) == len(ROWS)


def test_payloads_and_urls_come_back(spark, files):
    of = {i: (h or "").encode() for i, _, h in ROWS}
    for r in warc.read(spark.createDataFrame(files), 100_000).collect():
        assert r["payload"] == (of[r["page_id"]] if r["record_type"] == "response" else None)
        assert "\r" not in r["url"] and " " not in r["url"]


def test_ranges_cut_anywhere(tmp_path):
    """Every cut of a small file in two: also inside the magic, at record ends, and in a stored member that holds the magic and a false head."""
    false = b"\x1f\x8b\x08 WARC/1.1 " + gzip.compress(b"no record at all")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(false)
    parts = [warc.record(1, "u", b"one", "0", None), stored.compress(head + false + b"\r\n\r\n") + stored.flush(), warc.record(2, "u", b"two" * 30, "0", 1)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts) + b"\x1f\x8b")
    uri, size = path.as_uri(), path.stat().st_size
    whole = list(warc.scan(uri, 0, size))
    assert [w[:8] for w in whole] == [b"WARC/1.1"] * 3
    for cut in range(size + 1):
        assert list(warc.scan(uri, 0, cut)) + list(warc.scan(uri, cut, size)) == whole, cut


def test_magic_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STEP", 700)
    path = tmp_path / "x.warc.gz"
    records = [warc.record(i, "u" * (i % 40), bytes(NOISE.randrange(256) for _ in range(400 + i)), "0", None) for i in range(40)]
    path.write_bytes(b"".join(records))
    assert len(list(warc.scan(path.as_uri(), 0, path.stat().st_size))) == 40


def test_broken_payload_is_an_error():
    content = gzip.decompress(warc.record(1, "u", b"abc", "0" * 40, None))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(content)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = warc.write(none, Workspace(spark, "warc-none"))
    assert found.collect() == [] and warc.read(found).collect() == []
