"""Queries: streams over ``events``, drained and checked against the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as op
from .common import query

S, D = SparkSession, DataFrame


def _local(df: D) -> D:
    """Starts as the tables have them, without a time zone."""
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: S, sf: str) -> D:
    return _local(op.run(op.tumbling(op.source(spark, sf, "events")), "tumbling", "update", keys=["start", "event_type"]))


@query("SELECT min(ts) AS start, user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: S, sf: str) -> D:
    return _local(op.run(op.sessions(op.source(spark, sf, "events")), "sessions", "complete"))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_monthly(spark: S, sf: str) -> D:
    return op.run(op.monthly_totals(op.source(spark, sf, "events")), "monthly", "complete")
