"""Streams of ledger rows: restarts, a batch that runs again, repeats, nulls, empty arrivals; pairs against the batch join."""

import datetime
import os

from pyspark.sql import functions as F

from ledgerloom.operators import matching
from ledgerloom.storage import Workspace
from ledgerloom.streaming import events
from ledgerloom.streaming import ledger as streams

ROWS = "id string, date date, amount int, account_label string, tx_type string"
DAY = datetime.date(2024, 1, 1)


def today():
    return F.lit("2024-06-01").cast("date")


def rows(spark, data):
    return spark.createDataFrame([(i, None if d is None else DAY + datetime.timedelta(days=d - 1), a, acc, t) for i, d, a, acc, t in data], ROWS).withColumn("amount", F.col("amount").cast("decimal(18,4)"))


def ids(df):
    return sorted((r["id"] or "", float(r["amount"])) for r in df.collect())


def test_ingest_over_restarts_and_a_batch_that_runs_again(spark):
    space = Workspace(spark, "ingest")
    one = rows(spark, [("a", 1, 1, "A", None), ("a", 1, 2, "A", None), ("b", 300, 1, "A", None), (None, 1, 5, "A", None), (None, 1, 5, "A", None), ("n", None, 1, "A", None)])
    inbox = streams.Inbox(space, one)
    kept, held = streams.ingest(inbox.stream(), space, today())
    assert ids(kept) == ids(held) == []
    inbox.land(one)
    kept, held = streams.ingest(inbox.stream(), space, today())
    first = [("", 5.0), ("", 5.0), ("a", 1.0), ("n", 1.0)]
    assert ids(kept) == first and ids(held) == [("b", 1.0)]
    inbox.land(rows(spark, [("a", 1, 7, "A", None), ("b", 2, 7, "A", None), ("c", 3, 7, "A", None)]))
    kept, held = streams.ingest(inbox.stream(), space, today())
    after = [*first[:3], ("c", 7.0), ("n", 1.0)]
    assert ids(kept) == after and ids(held) == [("b", 1.0)]
    # A crash after the write and before the commit: the last batch runs again.
    commits = space.path("ingest").removeprefix("file://") + "/commits"
    last = max(f for f in os.listdir(commits) if f.isdigit())
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    kept, held = streams.ingest(inbox.stream(), space, today())
    assert ids(kept) == after and ids(held) == [("b", 1.0)]


def test_pairs_of_many_turns_equal_the_batch_join(spark):
    data = []
    for n in range(120):
        kind = (None, "internal_out", "expense", "card_settlement")[n % 4]
        data += [(f"o{n}", n * 3 % 200, -(n % 5) - 1, "A", kind), (f"i{n}", n * 7 % 200, n % 5 + 1, ("B", "A")[n % 6 == 0], (None, "internal_in")[n % 3 == 0])]
    data += [("cent-o", 50, -70, "A", "internal_out"), ("cent-i", 54, 70, "B", None), ("no-day", None, 70, "B", None), ("zero", 54, 0, "B", None)]
    df = rows(spark, data)
    space, turns = Workspace(spark, "pairs"), []
    inbox = streams.Inbox(space, df)
    for low in range(0, 210, 70):
        inbox.land(df.filter(F.datediff("date", F.lit(DAY)).between(low - 1 if low == 0 else low, low + 69)))
        got = events.run(streams.pair_candidates(inbox.stream(), inbox.stream()), "pairs", space=space)
        turns.append(got.count())
    expected = sorted(map(tuple, matching.transfer_candidates(df).collect()))
    assert sorted(map(tuple, got.collect())) == expected
    assert 0 < turns[0] < turns[1] < turns[2] == len(expected)
    assert ("cent-o", "cent-i", "medium", 4) in expected


def test_pairs_of_arrivals_lose_no_late_row(spark):
    data = [("o1", 10, -50, "A", "internal_out"), ("i1", 12, 50, "B", None), ("o2", 150, -7, "A", None), ("i2", 151, 7, "B", None), ("i3", 149, 7, "A", None), ("none", None, 7, "B", None)]
    df, space = rows(spark, data), Workspace(spark, "arrivals")
    inbox, seen = streams.Inbox(space, df), []
    assert streams.pair_arrivals(inbox.stream(), space).count() == 0
    for some in (["o1", "i2", "none"], ["o2"], ["i1", "i3"]):  # i1 comes behind rows 138 days newer
        inbox.land(df.filter(F.col("id").isin(some)))
        seen.append(sorted(tuple(r) for r in streams.pair_arrivals(inbox.stream(), space).collect()))
    assert seen == [[], [("o2", "i2", "low", 1)], sorted(map(tuple, matching.transfer_candidates(df).collect()))]
    assert ("o1", "i1", "medium", 2) in seen[-1]
