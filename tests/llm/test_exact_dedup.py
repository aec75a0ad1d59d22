"""Exact deduplication: batch and stream against a plain grouping, forced collisions, restarts."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, file long, row long"
ROWS = [
    (1, "a b", 0, 0), (2, "ab ", 0, 0), (3, "ab", 0, 0), (4, None, 0, 0), (5, " \n", 0, 0), (6, "", 0, 0), (None, "ab", 0, 0), (7, "ba", 0, 0), (7, "ba", 0, 0), (7, "ba", 0, 0),
    (8, "x" * 200_000, 0, 0), (9, "x" * 100_000 + "\t" + "x" * 100_000, 0, 0), (10, "é ", 0, 0), (11, "é", 0, 0),
]


def weak(text):
    """A digest of two values: almost everything collides."""
    return F.pmod(F.length(text), F.lit(2)).cast("string")


def expected(rows):
    """{normalised text: (kept id, size)}"""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    return {t: (min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0], len(g)) for t, g in groups.items()}


def check(found, rows):
    want = expected(rows)
    text = {}
    for r in rows:
        text.setdefault(r[0], set()).add(re.sub(r"[\x20\x09-\x0d]", "", r[1] or ""))
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["keeper"]["id"], r["copies"]) in [want[t] for t in text[r["id"]]]
    assert sum(r["kept"] for r in got) == len(want)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_batch(spark, digest):
    check(exact_dedup.dedup(spark.createDataFrame(ROWS, SCHEMA), digest=digest), ROWS)


def test_keep_carries_all_columns(spark):
    got = exact_dedup.keep(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "file", "row"] and got.count() == len(expected(ROWS))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_stream_in_several_batches_with_restarts(spark, tmp_path, digest):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = spark.createDataFrame([], SCHEMA).schema
    so_far = []
    for part in (ROWS[:5], ROWS[5:9], ROWS[9:]):
        so_far += part
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        # Every call starts the streams anew from their checkpoints; a byte a trigger makes each index file a batch.
        found = exact_dedup.ingest(spark, source, schema, folder, digest=digest, max_bytes_per_trigger=1)
        check(found, so_far)
    assert len([p for p in (tmp_path / "state/state/groups").iterdir() if p.name.startswith("batch=")]) > 3
    check(exact_dedup.ingest(spark, source, schema, folder, digest=digest), so_far)


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.dedup(empty).collect() == [] and exact_dedup.keep(empty).collect() == []
    empty.write.parquet(str(tmp_path / "in"))
    assert exact_dedup.ingest(spark, str(tmp_path / "in"), empty.schema, str(tmp_path / "state")).collect() == []
