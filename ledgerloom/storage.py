"""Shared folder, written tables and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows that ``spread`` gives a task.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where that is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_ledger_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark._ledger_shared = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return base.rstrip("/")


class Workspace:
    """A fresh folder below the shared one. Tables written here cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else df as it is. Meant for dimensions and written tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of ``rows`` rows dealt by keys over so many tasks that none gets much more than ``TASK_ROWS``; small ones as they are.

    Narrow rows compress well, so partitions cut by their bytes hold ever more rows until the bytes reach their limit, and a sort holds all of a task's.
    """
    return df if rows <= TASK_ROWS else df.repartition(rows // TASK_ROWS + 1, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal_both(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Sides of a join by equal keys, of at most ``rows`` rows each, for a merge that deals both over so many tasks that none gets much more than ``TASK_ROWS``.

    Left to itself Spark broadcasts a side by the bytes of its files, and small files can hold millions of rows; a broadcast is built whole on the driver.
    """
    if rows > TASK_ROWS:
        n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)
        a, b = a.repartition(n, *a_keys), b.repartition(n, *b_keys)
    return a, b.hint("merge")
