"""Structured Streaming forms: windowed and session aggregates, deduplication, monthly totals. All run with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Workspace

LATE = "1 hour"


def run(stream: DataFrame, name: str, mode: str = "append", space: Workspace | None = None, keys: list[str] | None = None) -> DataFrame:
    """Drain a stream into the shared folder; returns what it wrote. A batch that runs again overwrites its own output.

    In complete mode the last batch holds the whole result, in append mode all batches together do. In update mode, which lets
    a watermark drop state, a batch holds the results that it changed, and of each of ``keys`` the last one counts. Run again over
    the same ``space``, a stream goes on from its checkpoint.
    """
    space = space or Workspace(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(space.path(f"out/batch={0 if mode == 'complete' else number}"))

    stream.writeStream.outputMode(mode).option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = stream.sparkSession.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).option("basePath", space.path("out")).parquet(space.path("out"))
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        found = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return found.select(*stream.columns)


def source(spark: SparkSession, sf_dir: str, name: str, time: str = "ts") -> DataFrame:
    """A table's files as a stream; its event time becomes a timestamp, which watermarks need.

    All files that are there make one batch, so none of their rows is late, whatever the files' order.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*").withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Windows in update mode: state holds those that the watermark hasn't passed, ``LATE`` behind the newest row. Rows of a later
    batch that belong to windows it has passed are left out; rows without a time belong to none."""
    w = F.window("ts", width)
    return events.withWatermark("ts", LATE).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows; Spark has no update mode for them, so either they come once closed (append) or all at once (complete)."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", LATE).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def monthly_totals(events: DataFrame) -> DataFrame:
    """State is keyed by the month column: no calendar-month window exists."""
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))
