"""Rows before and behind the tables of bank files: caps, short and odd files, patterns by layout."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import edges as op

FULL, THIN = ["1/2/2024", "pane", "3,50"], ["Conto", "", None]
SCHEMA = "file string, row_num long, cells array<string>, layout string, skipped int, known string"


def table(spark, files):
    """File -> (layout, rows)."""
    return spark.createDataFrame([(f, i * 3, c, layout, 1, "clash") for f, (layout, rows) in files.items() for i, c in enumerate(rows)], SCHEMA)


FILES = {
    "none": ("x", [FULL] * 8), "two": ("x", [THIN] * 2 + [FULL] * 30), "edge": ("x", [THIN] * 2 + [FULL] * 18), "share": ("x", [THIN] * 2 + [FULL] * 17), "many": ("x", [THIN] * 21 + [FULL] * 400), "most": ("x", [THIN] * 20 + [FULL] * 400),
    "short": ("x", [THIN] * 2 + [FULL] * 2), "inside": ("x", [FULL] * 9 + [THIN] + [FULL] * 9), "blank": ("x", [["", None]] * 9), "null": ("x", [None] * 6), "thin": ("x", [THIN] * 9), "long": ("x", [THIN] + [["a" * 100_000, "b", "c"]] * 12),
}


def test_before(spark):
    got = {r["file"]: (r["rows"], r["skipped"], r["refused"]) for r in op.before(table(spark, FILES)).collect()}
    want = {"two": (32, 2, False), "edge": (20, 2, False), "share": (19, 0, True), "many": (421, 0, True), "most": (420, 20, False), "long": (13, 1, False)}
    assert got == {f: want.get(f, (len(rows), 0, False)) for f, (_, rows) in FILES.items()}


def test_strip_before(spark):
    t = table(spark, FILES)
    left = op.strip_before(t)
    assert left.columns[0] == "file" and set(left.columns) == set(t.columns)
    n = {r["file"]: (r["count"], r["first"]) for r in left.groupBy("file").agg(F.count("*").alias("count"), F.min("row_num").alias("first")).collect()}
    skipped = {"two": 2, "edge": 2, "most": 20, "long": 1}
    assert n == {f: (len(rows) - skipped.get(f, 0), skipped.get(f, 0) * 3) for f, (_, rows) in FILES.items() if f not in ("share", "many")}


TAILS = {
    "one": ("x", [FULL] * 9 + [["", "Saldo 12,00", ""]]), "capped": ("x", [FULL] * 9 + [THIN] * 3), "five": ("x", [FULL] * 200 + [THIN] * 7), "whole": ("x", [FULL] * 30), "two": ("x", [FULL, THIN]), "all": ("y", [THIN] * 4), "inside": ("x", [FULL, THIN, FULL, FULL]), "wide": ("x", [FULL] * 40 + [["1/1/24"], None]),
}


@pytest.mark.parametrize(("mandatory", "want"), [([0, 1, 2], {"one": [9], "capped": [11], "five": [202, 203, 204, 205, 206], "all": [3], "wide": [40, 41]}), ([0], {"one": [9], "wide": [41]}), ([], {})])
def test_incomplete_tail(spark, mandatory, want):
    t = table(spark, TAILS)
    positions = F.array(*map(F.lit, mandatory)).cast("array<int>")
    got = {}
    for r in op.incomplete_tail(t, positions).orderBy("row_num").collect():
        got.setdefault(r["file"], []).append(r["row_num"] // 3)
    assert got == want


def test_patterns_of_earlier_files(spark):
    said = F.get("cells", 1)
    first = table(spark, {"a": ("x", [FULL] * 9 + [["", "Saldo finale 12,00 al 31/12/2023", ""]]), "b": ("y", [FULL] * 9 + [["", "12", ""]]), "c": ("z", [FULL] * 9 + [["", None, ""]])})
    taught = op.learn(op.incomplete_tail(first, F.array(F.lit(0))), "layout", said)
    assert [tuple(r) for r in taught.collect()] == [("x", "saldo finale al")]
    late = [["31/12/24", "SALDO FINALE 99,10 al 31/12/2024", "9"], ["1/1/24", "Totale carburante", "1"], ["1/1/24", None, "1"], FULL, None]
    second = table(spark, {"d": ("x", [late[0]] + [FULL] * 9 + late), "e": ("y", [FULL] * 3 + late), "f": ("x", late[:1] * 12)})
    got = sorted((r["file"], r["row_num"] // 3, r["known"]) for r in op.known_tail(second, taught, "layout", said).collect())
    assert got == [("d", 10, True), ("d", 11, False), *[("f", i, True) for i in range(2, 12)]]


def test_no_rows(spark):
    t = table(spark, FILES)
    none = t.limit(0)
    assert op.before(none).collect() == op.strip_before(none).collect() == op.incomplete_tail(none, F.array(F.lit(0))).collect() == []
    assert op.known_tail(t, op.learn(none, "layout", F.get("cells", 1)), "layout", F.get("cells", 1)).collect() == []
