"""The ledger as stored tables: every import is one folder that holds all its tables, and one rename makes it visible.

Readers list the folders below ``commits`` and nothing else, so an import that dies halfway leaves a folder below ``staging``
that no reader sees; ``repair`` removes it. Two writers that reach for the same number can't both get it: the rename fails where
the folder exists, and the later one decides again on what is stored by then. The file system must rename folders atomically.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mutations import hold
from ..storage import Workspace, spread
from ..types import LEDGER

_S = T.StringType()
SCHEMAS = {
    "batches": T.StructType([T.StructField("sha256", _S), T.StructField("filename", _S), T.StructField("account_label", _S), T.StructField("n_transactions", T.LongType())]),
    "transactions": LEDGER,
    "held": T.StructType([*LEDGER.fields, T.StructField("reason", _S)]),
    "transfers": T.StructType([T.StructField("out_id", _S), T.StructField("in_id", _S), T.StructField("confidence", _S)]),
    "settlements": T.StructType([T.StructField("settlement_id", _S), T.StructField("detail_id", _S), T.StructField("delta", T.DoubleType()), T.StructField("method", _S)]),
    "marks": T.StructType([T.StructField("id", _S)]),
}
TRIES = 5


class Taken(Exception):
    """Another writer committed under the number first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def commits(self) -> list[str]:
        return self._names("commits")

    def read(self, name: str, commits: list[str] | None = None) -> DataFrame:
        """A table's rows of all commits (or those named)."""
        known = self.commits() if commits is None else commits
        if not known:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/commits/{c}/{name}" for c in known])

    def ledger(self) -> DataFrame:
        """Stored rows; those of a stored settlement are reconciled."""
        known = self.commits()
        marked = self.read("marks", known).distinct().select(F.col("id").alias("m_id"))
        rows = self.read("transactions", known)
        met = rows.join(marked, F.col("id") == F.col("m_id"), "left")
        return met.select(*[(F.coalesce("reconciled", F.lit(False)) | F.col("m_id").isNotNull()).alias(c) if c == "reconciled" else F.col(c) for c in rows.columns])

    def stage(self, folder: str, name: str, df: DataFrame) -> None:
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
        df.select(*cast).write.parquet(f"{self.root}/staging/{folder}/{name}")

    def publish(self, folder: str, after: list[str]) -> str:
        """The staged folder becomes the commit after ``after``: all its tables at once, or Taken."""
        jvm, number = self.spark._jvm, f"{int(after[-1]) + 1 if after else 1:010d}"
        self._fs().mkdirs(self._path("commits"))
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        target = self._path(f"commits/{number}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(f"staging/{folder}"), target, never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Taken(number) from e
            raise
        return number

    def repair(self) -> list[str]:
        """Remove what imports that died have staged; to be run while no import does."""
        left = self._names("staging")
        for name in left:
            self._fs().delete(self._path(f"staging/{name}"), True)
        return left


def persist(store: Store, rows: DataFrame, transfers: DataFrame, settlements: DataFrame, today: Column) -> str | None:
    """Store imported files with their links in one commit; returns its number, or None where all files are stored already.

    ``rows`` are ledger rows with the sha256 of their file; links carry the sha256 of the file whose import found them.
    Files that are stored are left out with their links. Rows dated after today, and rows without an id, are held with the
    reason, and links that touch a row held by the same file are dropped. The first write of an id wins: against what is
    stored, and inside an import the row of the first file name. Rows without a date are stored. Settlements mark those of
    their rows that the import brought as reconciled. Extra columns of the inputs are ignored.
    """
    for _ in range(TRIES):
        try:
            return _persist(store, rows, transfers, settlements, today)
        except Taken:
            continue
    raise Taken("other writers were always first")


def _persist(store: Store, rows: DataFrame, transfers: DataFrame, settlements: DataFrame, today: Column) -> str | None:
    known = store.commits()
    files = store.read("batches", known).select("sha256")
    space = Workspace(store.spark, "persist")
    fresh = space.save(rows.select(*LEDGER.names, "sha256").join(files, "sha256", "left_anti"), "fresh")
    if fresh.isEmpty():
        return None
    on_time, late = hold(fresh, today)
    held = late.withColumn("reason", F.lit("date_future")).unionByName(on_time.filter("id is null").withColumn("reason", F.lit("no_id")))
    others = [c for c in LEDGER.names if c not in ("id", "source_file")]
    first = spread(on_time.filter("id is not null"), fresh.count(), "id").groupBy("id").agg(F.min(F.struct("source_file", *others)).alias("r")).select("id", "r.*")
    stays = lambda links, *ends: _without(links.join(files, "sha256", "left_anti"), held, ends)
    moved = stays(transfers, "out_id", "in_id").select("out_id", "in_id", "confidence")
    settled = space.save(stays(settlements, "settlement_id", "detail_id").select("settlement_id", "detail_id", "delta", "method"), "settled")
    ends = settled.select(F.explode(F.array("settlement_id", "detail_id")).alias("id")).distinct()
    tables = {
        "transactions": first.join(store.read("transactions", known).select("id"), "id", "left_anti"),
        "held": held,
        "transfers": moved.groupBy("out_id", "in_id").agg(F.min("confidence").alias("confidence")).join(store.read("transfers", known), ["out_id", "in_id"], "left_anti"),
        "settlements": settled.groupBy("settlement_id", "detail_id").agg(F.min("delta").alias("delta"), F.min("method").alias("method")).join(store.read("settlements", known), ["settlement_id", "detail_id"], "left_anti"),
        "marks": ends.join(first.select("id"), "id", "left_semi"),
        "batches": fresh.groupBy("sha256").agg(F.min("source_file").alias("filename"), F.min_by("account_label", "id").alias("account_label"), F.count("*").alias("n_transactions")),
    }
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        store.stage(folder, name, df)
    return store.publish(folder, known)


def _without(links: DataFrame, held: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """Links of which no end is held by the same file."""
    gone = held.select(F.col("sha256").alias("h_sha"), F.col("id").alias("h_id"))
    for end in ends:
        links = links.join(gone, (F.col("sha256") == F.col("h_sha")) & (F.col(end) == F.col("h_id")), "left_anti")
    return links
