"""Windows over a stream in several batches: last update counts, state is dropped, late rows, restarts, empty streams."""

import json
from datetime import datetime, timedelta

import pytest

from ledgerloom.storage import Workspace
from ledgerloom.streaming import events as op

SCHEMA = "ts timestamp, user_id long, event_type string, value double, start string"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


#: Each list lands as one file and is a batch of its own.
BATCHES = [
    [(at(0.2), 1, "a", 1.0, ""), (at(0.9), 1, "a", 2.0, ""), (None, 1, "a", 9.0, ""), (at(0.5), 2, None, 1.0, "")],
    [(at(0.7), 1, "a", 4.0, ""), (at(1.5), 1, "b", None, ""), (at(1.5), 1, "b", None, "")],
    [(at(30), 3, "a", 1.0, "")],
    [(at(30.2), 3, "a", 1.0, "")],
    [(at(0.3), 1, "a", 100.0, ""), (at(29.5), 1, "a", 7.0, "")],
]
#: The row at 0.3 comes 29 hours behind the watermark, two batches after it moved; the one at 29.5 is late but not beyond it.
WANT = {(at(0), "a"): (3, 7.0), (at(0), None): (1, 1.0), (at(1), "b"): (2, None), (at(30), "a"): (2, 2.0), (at(29), "a"): (1, 7.0)}


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def result(df):
    return {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in df.collect()}


def drain(spark, space, path):
    return op.run(op.tumbling(stream(spark, path)), "windows", "update", space, ["start", "event_type"])


@pytest.mark.parametrize("restarts", [False, True])
def test_updates_over_batches(spark, restarts):
    space = Workspace(spark, "event-stream")
    path = space.path("in")
    for batch in BATCHES:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        if restarts:
            drain(spark, space, path)
    assert result(drain(spark, space, path)) == WANT


def test_state_is_dropped(spark):
    space = Workspace(spark, "event-state")
    for batch in BATCHES:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(space.path("in"))
    query = op.tumbling(stream(spark, space.path("in"))).writeStream.outputMode("update").option("checkpointLocation", space.path("cp")).trigger(availableNow=True).format("noop").start()
    query.awaitTermination()
    kept = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(kept) >= 3 and kept[-1] == 2


def test_no_rows(spark):
    space = Workspace(spark, "event-none")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(space.path("in"))
    assert drain(spark, space, space.path("in")).collect() == []
