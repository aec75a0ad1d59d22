"""Imports as commits: crashes at every step, two writers, repeats, nulls, empty inputs, clashing columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.store import SCHEMAS, Store, Taken, persist
from ledgerloom.storage import Workspace

D = datetime.date
ROWS = "id string, date date, amount int, source_file string, account_label string, sha256 string"


def today():
    return F.lit("2024-06-01").cast("date")


def ledger(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["transactions"].fields if f.name not in df.columns]
    return df.select("*", *more, F.lit("x").alias("m_id"), F.lit("y").alias("reason"))


def links(spark, moved=(), settled=()):
    return (
        spark.createDataFrame(list(moved), "sha256 string, out_id string, in_id string, confidence string"),
        spark.createDataFrame(list(settled), "sha256 string, settlement_id string, detail_id string, delta double, method string"),
    )


FIRST = [("a", D(2024, 1, 1), 1, "f1", "A", "s1"), ("b", D(2024, 1, 2), -1, "f1", "A", "s1"), ("b", D(2024, 1, 2), -2, "f2", "A", "s2"), ("late", D(2025, 1, 1), 5, "f1", "A", "s1"), (None, D(2024, 1, 1), 3, "f1", "A", "s1"), ("nodate", None, 4, "f2", "B", "s2")]
SECOND = [("a", D(2024, 1, 1), 9, "f3", "A", "s3"), ("c", D(2024, 2, 1), 7, "f3", "A", "s3"), ("z", D(2024, 2, 1), 7, "f1", "A", "s1")]
MOVED = [("s1", "b", "a", "low"), ("s1", "b", "late", "low"), ("s1", "b", "a", "high")]
SETTLED = [("s1", "a", "b", 0.0, "sum"), ("s1", "late", "b", 0.0, "sum")]


@pytest.fixture
def store(spark):
    return Store(spark, Workspace(spark, "store").root)


def state(store):
    rows = sorted((r["id"], float(r["amount"]), r["reconciled"]) for r in store.ledger().collect())
    return rows, *(sorted(map(tuple, store.read(n).select(*c).collect()), key=str) for n, c in {"held": ("id", "reason"), "transfers": ("out_id", "in_id", "confidence"), "settlements": ("settlement_id", "detail_id"), "batches": ("sha256", "n_transactions")}.items())


BEFORE = ([("a", 1.0, True), ("b", -1.0, True), ("nodate", 4.0, False)], [("late", "date_future"), (None, "no_id")], [("b", "a", "high")], [("a", "b")], [("s1", 4), ("s2", 2)])
AFTER = ([("a", 1.0, True), ("b", -1.0, True), ("c", 7.0, False), ("nodate", 4.0, False)], *BEFORE[1:4], [("s1", 4), ("s2", 2), ("s3", 2)])


def test_imports_first_write_wins_and_stored_files_are_left_out(spark, store):
    assert state(store) == ([], [], [], [], [])
    assert persist(store, ledger(spark, FIRST), *links(spark, MOVED, SETTLED), today()) == "0000000001"
    assert state(store) == BEFORE
    assert persist(store, ledger(spark, FIRST), *links(spark, MOVED, SETTLED), today()) is None
    assert persist(store, ledger(spark, []), *links(spark), today()) is None
    assert persist(store, ledger(spark, SECOND), *links(spark, MOVED), today()) == "0000000002"
    assert state(store) == AFTER


@pytest.mark.parametrize("dies_at", [0, 3, 5, 6])
def test_a_crash_between_any_two_writes_is_not_seen(spark, store, monkeypatch, dies_at):
    persist(store, ledger(spark, FIRST), *links(spark, MOVED, SETTLED), today())
    done = []
    stage = Store.stage

    def dying(self, folder, name, df):
        if len(done) == dies_at:
            raise KeyboardInterrupt
        stage(self, folder, name, df)
        done.append(name)

    def no_rename(self, folder, after):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "stage", dying)
        m.setattr(Store, "publish", no_rename)
        with pytest.raises(KeyboardInterrupt):
            persist(store, ledger(spark, SECOND), *links(spark), today())
    assert state(store) == BEFORE
    assert len(store.repair()) == (dies_at > 0) and store.repair() == []
    persist(store, ledger(spark, SECOND), *links(spark), today())
    assert state(store) == AFTER


def test_of_two_writers_the_later_decides_again(spark, store, monkeypatch):
    """Another import of the same file commits just before the rename: nothing is stored twice."""
    publish, met = Store.publish, []

    def raced(self, folder, after):
        if not met:
            met.append(folder)
            persist(store, ledger(spark, FIRST), *links(spark, MOVED, SETTLED), today())
            with pytest.raises(Taken):
                publish(self, folder, after)
            raise Taken("first")
        return publish(self, folder, after)

    monkeypatch.setattr(Store, "publish", raced)
    persist(store, ledger(spark, FIRST + SECOND), *links(spark, MOVED, SETTLED), today())
    assert store.commits() == ["0000000001", "0000000002"] and state(store) == AFTER
