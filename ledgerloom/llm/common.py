"""Helpers shared by the training-data operators: shared folder, written tables, size-checked broadcast, row locators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A side of a join is broadcast up to this size; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master without that."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or getattr(spark, "_ledgerloom_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark._ledgerloom_shared = base
    return base.rstrip("/")


class Workspace:
    """A fresh folder below the shared one. Tables written here cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet below the folder and read it back with the schema it had."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


    def close(self) -> None:
        """Remove the folder. For callers that have written what they made of its tables."""
        self.drop("")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else df itself. df should be a written table of columns of bounded width: its
    rows are counted, at their schema's size and what a hash table adds."""
    rows = most_bytes // (df._jdf.schema().defaultSize() + 16)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, side_key: str, count: str, total: int, most: int = 50_000, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with side, which has one row a key and, in ``count``, how many of the ``total`` rows have it.

    Keys of more than a ``most``-th of all rows, of which there are at most as many, are broadcast, so that a hot key's rows
    stay in the tasks they are in; the rest is a shuffled join without a hot key.
    """
    hot = side.filter(F.col(count) > total // most + 1_000)
    cold = side.filter(F.col(count) <= total // most + 1_000)
    keys = F.broadcast(hot.select(F.col(side_key).alias("__hot_key")))
    meets = F.col(key) == F.col(side_key)
    return rows.join(F.broadcast(hot), meets).unionByName(rows.join(keys, F.col(key) == F.col("__hot_key"), "left_anti").join(cold, meets, how))


def with_locator(docs: DataFrame, space: Workspace, file: str = "__ll_file", row: str = "__ll_row") -> DataFrame:
    """docs plus the content locator of each row: a 64-bit hash of its data file's path, and the row's index in that file.

    A locator stays the same however often the table is read. A DataFrame that isn't a scan of files has none, so it is
    written to the workspace first.
    """

    def add(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))

    try:
        return add(docs)
    except AnalysisException:
        return add(space.save(docs, "input"))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI that pyarrow opens (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
