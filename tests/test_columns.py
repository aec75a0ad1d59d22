"""Column profiling on layouts written out by hand."""

import pytest

from ledgerloom.sources import bank_files
from ledgerloom.storage import Workspace
from ledgerloom.sources import columns as op

N = 40
FILES = {
    # dates first, a code, a description, one signed amount
    1: [[f"{k % 28 + 1:02}/03/2024", f"AB{k:06}", f"Shop number {k}", f"-{k}.234,56" if k % 4 else "10,00"] for k in range(N)],
    # two columns that complete one another, both positive; the fuller one is the debit
    2: [["2024-03-01 10:00", "" if k % 5 == 0 else f"{k},10", f"{k},99" if k % 5 == 0 else None, f"paid to {k}"] for k in range(N)],
    # the fuller one is positive: the other, with negative numbers, is the debit
    3: [["1 gennaio 2024" if k % 2 else "2 febbraio 2024", "" if k % 5 == 0 else f"{k}.10", f"-{k}.5" if k % 5 == 0 else "", f"note {k}", "EUR"] for k in range(N)],
    # an amount and a fee on the same rows; a card number and a reference that look like amounts
    4: [["4111111111111111", str(20_000_000 + k), f"{k}.50", "1.00" if k % 3 else "1.50", f"seller {k}"] for k in range(N)],
    # nothing but a flag; short rows
    5: [["x"], ["y", ""], ["x", None]],
    # two movements: no majority
    6: [["2024-01-01", "5.00", "first one"], ["2024-01-02", "-7.00", "second one"]],
    7: [["", ""], [None, None]],
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f, n, c) for f, lines in FILES.items() for n, c in enumerate(lines, 1)], "file long, row_num long, cells array<string>").cache()


@pytest.fixture(scope="module")
def profile(rows):
    shape, cells = op.shape(rows), op.unpivot(rows)
    return op.figures(cells, shape).join(op.types(cells, shape), ["file", "col"]).cache()


def test_types(profile):
    got = {}
    for r in profile.orderBy("file", "col").collect():
        got.setdefault(r["file"], []).append(r["type"])
    assert got == {1: ["date", "text", "text", "amount"], 2: ["text", "amount", "amount", "text"], 3: ["date", "amount", "amount", "text", "text"], 4: ["text", "text", "amount", "amount", "text"], 5: ["text", "text"], 6: ["date", "amount", "text"], 7: ["text", "text"]}


def test_figures(profile):
    r = profile.filter("file = 1 and col = 1").first()
    assert (r["filled"], r["k"], r["code"], r["negative"], r["letters"]) == (N, N, True, False, 0.25)
    assert profile.filter("file = 1 and col = 3").first()["negative"] is False  # two dots: no number to this rule
    assert profile.filter("file = 7").selectExpr("sum(filled)").first()[0] == 0


def test_descriptions(profile):
    assert {r["file"]: r["cols"] for r in op.description_columns(profile).collect()} == {1: [2], 2: [3], 3: [3], 4: [4]}


def test_amounts(rows, profile):
    got = {r["file"]: (r["amount"], r["debit"], r["credit"], r["semantics"]) for r in op.amount_columns(rows, profile).collect()}
    assert got == {1: (3, None, None, "signed_single"), 2: (None, 1, 2, "debit_positive"), 3: (None, 2, 1, "debit_credit_signed"), 4: (2, None, None, "neutral"), 5: (None, None, None, "unclear"), 6: (1, None, None, "signed_single"), 7: (None, None, None, "unclear")}


def test_signs(rows, profile):
    got = {r["file"]: (r["positive"], r["negative"], r["invert"], r["conclusive"]) for r in op.sign(rows, op.amount_columns(rows, profile)).collect()}
    assert got == {1: (10, 30, False, True), 4: (40, 0, True, True), 6: (1, 1, True, False)}


def test_dates_by_position_and_by_name(spark):
    p = spark.createDataFrame([(f, c, "date") for f in (1, 2, 3) for c in (0, 3)] + [(4, 1, "text")], "file long, col int, type string")
    assert {r["file"]: (r["date"], r["booking"]) for r in op.date_columns(p).collect()} == {f: (0, 3) for f in (1, 2, 3)}
    names = spark.createDataFrame([(1, 0, "Booked"), (1, 3, "Made"), (2, 0, "BOOKED on"), (2, 3, "?"), (3, 0, "a"), (3, 3, "made on")], "file long, col int, name string")
    assert {r["file"]: (r["date"], r["booking"]) for r in op.date_columns(p, names=names, operation="made", booking="booked").collect()} == {1: (3, 0), 2: (0, None), 3: (3, 0)}


def test_files_of_the_query_are_rows_of_few_tables(spark, monkeypatch):
    """Three files with quotes and blanks come back as they went; storage doesn't hold an object a file."""
    lines = [(f, n, v) for f in range(3) for n, v in ((2, "b; c ;"), (1, '"x;y";"say ""hi""";z'))]
    files = bank_files.joined(spark.createDataFrame(lines, "file long, row_num int, value string"), "file", "A;B;C")
    got = bank_files.rows(bank_files.probe(Workspace(spark, "t").save(files, "in")), ["file"]).orderBy("file", "row_num").collect()
    assert [(r["file"], r["cells"]) for r in got] == [(f, c) for f in range(3) for c in (["x;y", 'say "hi"', "z"], ["b", "c", ""])]
    monkeypatch.setattr(bank_files, "read", None)  # a listing with one object a bank file
    from ledgerloom.queries import columns

    assert columns._table(spark, "/root/testdata/sf0.001").select("file").distinct().count() == 3
