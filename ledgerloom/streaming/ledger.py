"""Ledger rows as a stream: re-ingest by id with held rows set aside, and transfers paired as their sides arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matching import meeting, transfer_key, transfer_reach
from ..operators.mutations import is_late
from ..storage import Workspace, spread
from ..types import ALWAYS_DROPPED


class Inbox:
    """A folder below the shared one that files of rows land in."""

    def __init__(self, space: Workspace, like: DataFrame):
        self.spark, self.path, self.schema = space.spark, space.path("inbox"), like.schema
        like.limit(0).write.mode("append").parquet(self.path)

    def land(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def ingest(arrivals: DataFrame, space: Workspace, today: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, held rows) after all that has arrived; run again over the same space, it goes on from its checkpoint.

    The first arrival of an id wins, however long ago: what earlier batches wrote is the memory, so no state grows and none
    expires. A batch writes only folders of its own number and reads those of smaller ones, so one that runs again after a
    crash puts the same rows in the same place. Rows dated after today are held, rows without a date are not; rows without
    an id can't be told apart and are all kept. Of repeats inside a batch the one that sorts first stays.
    """
    columns = arrivals.columns

    def stored() -> DataFrame:
        schema = T.StructType([*arrivals.schema, T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])
        return space.spark.read.schema(schema).option("basePath", space.path("stored")).parquet(space.path("stored"))

    def write(batch: DataFrame, number: int) -> None:
        # Dealt by id before rows are compared, so rows move once and no task sorts more than its part.
        dealt = spread(batch.filter("id is not null"), batch.count(), "id")
        named = dealt.groupBy("id").agg(F.min(F.struct(*[c for c in columns if c != "id"])).alias("r")).select("id", "r.*")
        if number:
            named = named.join(stored().filter(F.col("batch") < number).select("id"), "id", "left_anti")
        fresh = named.unionByName(batch.filter("id is null").select(*named.columns)).select(*columns, is_late(today).alias("late"))
        # Both kinds in one pass.
        fresh.write.mode("overwrite").partitionBy("late").parquet(space.path(f"stored/batch={number}"))

    arrivals.writeStream.option("checkpointLocation", space.path("ingest")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return tuple(stored().filter(on).select(*columns) for on in ("not late", "late"))


def pair_candidates(outs: DataFrame, ins: DataFrame, tolerance: int = 1, days: int = 5, strict_days: int = 1, late: str = "6 days") -> DataFrame:
    """(out_id, in_id, confidence, days) as ``matching.transfer_candidates``, each pair once its second side arrives.

    ``outs`` and ``ins`` are two readings of one stream of ledger rows. Either side is kept until no row within ``days`` of it can
    come, by the watermark of the slower side; rows that come more than ``late`` behind it can be missed. The keys are those of the batch
    join: an outflow is one row of state, an inflow 2.2 on average, without columns that the result doesn't need.
    """
    counted = ~F.coalesce(F.col("tx_type").isin(*ALWAYS_DROPPED), F.lit(False)) & F.col("date").isNotNull()

    def side(rows: DataFrame, p: str, sign: Column, kind: str) -> DataFrame:
        marked = F.coalesce(F.col("tx_type") == kind, F.lit(False))
        kept = rows.filter(counted & sign).select(F.col("date").cast("timestamp").alias(f"{p}_at"), F.col("id").alias(f"{p}_id"), F.abs("amount").alias(f"{p}_amount"), F.col("account_label").alias(f"{p}_account"), marked.alias(f"{p}_marked"))
        return kept.withWatermark(f"{p}_at", late)

    o = side(outs, "out", F.col("amount") < 0, "internal_out").withColumns(transfer_key(F.col("out_amount"), F.to_date("out_at"), tolerance, days))
    i = transfer_reach(side(ins, "in", F.col("amount") > 0, "internal_in"), F.col("in_amount"), F.to_date("in_at"), tolerance, days)
    near = F.expr(f"in_at >= out_at - INTERVAL {days} DAYS AND in_at <= out_at + INTERVAL {days} DAYS")
    met = o.join(i, (F.col("c") == F.col("in_c")) & (F.col("w") == F.col("in_w")) & near & (F.col("out_account") != F.col("in_account")) & (F.abs(F.col("out_amount") - F.col("in_amount")) <= tolerance / 100))
    gap = F.abs(F.datediff("out_at", "in_at"))
    a, b = F.col("out_marked"), F.col("in_marked")
    return met.select("out_id", "in_id", F.when(a & b, "high").when(a | b, "medium").when(gap <= strict_days, "low").alias("confidence"), gap.alias("days")).filter("confidence is not null")


def pair_arrivals(arrivals: DataFrame, space: Workspace, tolerance: int = 1, days: int = 5, strict_days: int = 1) -> DataFrame:
    """(out_id, in_id, confidence, days) of all that has arrived, each pair once its second side has; goes on from its checkpoint.

    What earlier batches wrote is the memory, as in ``ingest``: a batch meets itself and the stored rows within ``days`` of its
    dates. So no row is too late, and no state store holds the rows. A batch that runs again writes the same folders.
    """
    slim = arrivals.select("id", "date", "amount", "account_label", "tx_type")

    def stored(name: str, fields: list[T.StructField]) -> DataFrame:
        return space.spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).option("basePath", space.path(name)).parquet(space.path(name))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(space.path(f"arrived/batch={number}"))
        known = stored("arrived", slim.schema.fields)
        mine = known.filter(F.col("batch") == number)
        low, high = mine.agg(F.min("date"), F.max("date")).first()
        near = (F.col("date") >= F.date_sub(F.lit(low).cast("date"), days)) & (F.col("date") <= F.date_add(F.lit(high).cast("date"), days))
        rows = mine.unionByName(known.filter((F.col("batch") < number) & near))
        meeting(rows, F.col("batch") == number, tolerance, days, strict_days).write.mode("overwrite").parquet(space.path(f"pairs/batch={number}"))

    slim.writeStream.option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = [T.StructField("out_id", T.StringType()), T.StructField("in_id", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("days", T.IntegerType())]
    return stored("pairs", found).drop("batch")
