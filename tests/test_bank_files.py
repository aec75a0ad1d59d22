"""Bank files: empty and odd contents, quoted separators, footers and their cap, empty columns."""

from pyspark.sql import functions as F

from ledgerloom.sources import bank_files as src


def probed(spark, *texts, charset="utf-8"):
    return src.probe(spark.createDataFrame([(i, t.encode(charset)) for i, t in enumerate(texts)], "file int, content binary"))


def test_empty_and_single_line(spark):
    got = {r.file: r for r in probed(spark, "", "a;b;c").collect()}
    assert (got[0].lines, got[0].sep, tuple(got[0].header)) == ([], ",", (0, False))
    assert (got[1].lines, got[1].sep, tuple(got[1].header)) == (["a;b;c"], ";", (0, True))


def test_line_ends_and_marks(spark):
    got = probed(spark, "﻿x,y\r\n1,2\r3,4\n").first()
    assert got.lines == ["x,y", "1,2", "3,4"]
    assert probed(spark, "è,y\n1,2", charset="latin-1").first().lines == ["è,y", "1,2"]
    wide = probed(spark, "è,y\n1,2", charset="utf-16").first()
    assert (wide.encoding, wide.lines) == ("utf-16", ["è,y", "1,2"])


def test_cells(spark):
    cases = {'1,"a, b",c': ["1", "a, b", "c"], '"say ""hi"", now",x': ['say "hi", now', "x"], "": [""], "a,,": ["a", "", ""], ' x , "y" ': ["x", "y"], 'a"b,c': ['a"b', "c"]}
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r.line: r.cells for r in df.select("line", src.cells(F.col("line"), F.lit(",")).alias("cells")).collect()}
    assert got == cases


def test_header_prefers_words(spark):
    got = probed(spark, "Report;;\n1;2;3\nDay;Amount;Text\n4;5;6").first()
    assert tuple(got.header) == (2, True)
    assert src.rows(probed(spark, "Day;Amount\n\n1;2\n"), ["file"]).select("row_num", "cells").collect() == [(2, ["1", "2"])]


def brute_footer(rows):
    """Rows of one file, row by row from its end."""
    if len(rows) < 5:
        return rows
    d = [sum(c != "" for c in r) / len(r) for r in rows]
    s, n = sorted(d), len(rows)
    fence = s[n // 4] - 1.5 * (s[3 * n // 4] - s[n // 4])
    k = 0
    while k < n and d[n - 1 - k] < fence:
        k += 1
    return rows[: n - min(k, max(min(5, int(n * 0.05)), 1))]


def test_footer_as_brute_force(spark):
    full, half, bare = ["a", "b", "c"], ["a", "b", ""], ["t", "", ""]
    files = [[full] * 3 + [bare], [full] * 9 + [bare] * 3, [full] * 60 + [bare] * 2, [full] * 200 + [bare] * 9, [full, half] * 5 + [bare], [bare] * 6, [full] * 8 + [bare] + [full]]
    df = spark.createDataFrame([(f, i, r) for f, rows in enumerate(files) for i, r in enumerate(rows)], "file int, row_num int, cells array<string>")
    got = src.strip_footer(df, "file").groupBy("file").count().collect()
    assert {r[0]: r[1] for r in got} == {f: len(brute_footer(rows)) for f, rows in enumerate(files)}
    assert src.strip_footer(df.limit(0), "file").count() == 0


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "a int, b int, `c.d` int")
    assert src.drop_empty_columns(df).columns == ["a", "c.d"]
    assert src.drop_empty_columns(df.limit(1)).columns == df.columns
