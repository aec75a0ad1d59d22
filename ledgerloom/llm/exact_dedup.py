"""Exact deduplication as a stateful stream.

Method. Every document becomes an index row: digest of its normalised text, stable identifier, length and content
locator (data file and row index in it). Index rows stream through a keyed aggregation whose state lives in a RocksDB
store (disk-backed, checkpointed to the shared folder, no watermark and so no expiry): per digest the row that stays and
the number of copies. Each micro-batch writes the groups it changed; a later batch with the same keys replaces them. A
digest seen more than once is a hit, and for hits the full bytes are read again through their locators and compared:
texts that share a digest but differ are split into groups of their own. ``ingest`` compares inside each micro-batch what has
arrived with the row that stays; ``dedup``, for a table that is all there, compares once, after the stream has ended.

Scale. Text is never shuffled to find copies: only index rows move, after map-side partial aggregation, so a text with a
third of all rows is one row per task. The byte check reads hits only and groups them by (digest, whole text), again
with partial aggregation. Groups of many copies meet their rows by a bounded broadcast, the others by a shuffled join.

Defined results. Null text counts as empty; all empty or blank texts are one group. Of equal texts the row with the most
code points stays, then the smallest id (null ids last), then the first by locator, so exactly one of fully repeated rows
stays. Very long texts are digested whole. An empty table gives an empty result. Extra columns are ignored or carried
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import SPACE, Workspace, broadcast_if_small, join_hot, settings, with_locator

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # A store is closed once its task has committed: a worker keeps as many open as it runs tasks, not one for each partition.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(id_col: str = "id") -> Column:
    """Orders the rows of a group: the least stays."""
    return F.struct((-F.col("n_points")).alias("shorter"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("file"), F.col("row"))


def index(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """Index rows of a DataFrame that has locator columns ``__ll_file`` and ``__ll_row``; works on streams as well."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), digest(normalised(text)).alias("digest"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"), F.col("__ll_file").alias("file"), F.col("__ll_row").alias("row")
    )


def track(spark: SparkSession, index_path: str, schema: StructType, state: str, max_bytes_per_trigger: int = 1 << 36, check=None) -> DataFrame:
    """Run the stream over index files that it hasn't seen yet; returns (digest, keeper, copies) as of the last batch.

    ``state`` is a folder that holds the stream's checkpoint and output; calling again with the same folder continues.
    ``check`` is called in each micro-batch with the groups it changed and its number.
    """
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(index_path)
    groups = rows.groupBy("digest").agg(F.min(_rank()).alias("keeper"), F.count("*").alias("copies"))
    out = f"{state}/groups"

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure overwrites what it wrote.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if check:
            check(spark.read.schema(groups.schema).parquet(f"{out}/batch={number}"), number)

    with settings(spark, _STORE):
        query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    found = _read(spark, out, groups.schema.add("batch", "long"))
    return found.groupBy("digest").agg(F.max_by(F.struct("keeper", "copies"), "batch").alias("g")).select("digest", "g.keeper", "g.copies")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A partitioned table below path, empty if nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(schema).option("basePath", path).parquet(path) if there else spark.createDataFrame([], schema)


def _texts(located: DataFrame, rows: DataFrame, digest) -> DataFrame:
    """(digest, bytes, file, row): whole normalised texts of index rows, read again by locator."""
    spots = broadcast_if_small(rows.select(F.col("file").alias("h_file"), F.col("row").alias("h_row")))
    bytes_ = normalised(F.col("__ll_text").cast("string"))
    hits = located.join(spots, (F.col("__ll_file") == F.col("h_file")) & (F.col("__ll_row") == F.col("h_row")))
    return hits.select(digest(bytes_).alias("digest"), bytes_.alias("bytes"), F.col("h_file").alias("file"), F.col("h_row").alias("row"))


def _mixed(texts: DataFrame) -> DataFrame:
    """Digests under which texts differ."""
    return texts.groupBy("digest", "bytes").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")


def _resolve(rows: DataFrame, groups: DataFrame, mixed: DataFrame, located: DataFrame, digest, space: Workspace) -> DataFrame:
    """(id, file, row, digest, keeper, copies, kept) of all index rows; groups of mixed digests are formed anew by their bytes."""
    total = groups.agg(F.sum("copies")).first()[0] or 0
    g = groups.select(F.col("digest").alias("g_digest"), "keeper", "copies")
    if not mixed.isEmpty():
        of_mixed = space.save(rows.join(mixed, "digest", "left_semi"), "of-mixed")
        again = of_mixed.join(_texts(located, of_mixed, digest).drop("digest"), ["file", "row"])
        regrouped = again.groupBy("digest", "bytes").agg(F.min(_rank()).alias("keeper"), F.count("*").alias("copies"))
        split = again.join(regrouped, ["digest", "bytes"]).select(*rows.columns, "keeper", "copies")
        rows, g = rows.join(mixed, "digest", "left_anti"), g.join(mixed.withColumnRenamed("digest", "g_digest"), "g_digest", "left_anti")
    parts = join_hot(rows, g, "digest", "g_digest", "copies", total).select(*rows.columns, "keeper", "copies")
    if not mixed.isEmpty():
        parts = parts.unionByName(split)
    kept = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return parts.select("id", "file", "row", "digest", "keeper", "copies", kept.alias("kept"))


def ingest(spark: SparkSession, source: str, schema: StructType, folder: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, **options) -> DataFrame:
    """Index what has newly arrived in a folder of Parquet files and bring the groups up to date; returns what ``dedup`` does,
    for all documents so far.

    ``folder`` holds all state; a later call with the same folder goes on where the last one ended, also after a failure. In
    each micro-batch, arrivals under a digest that has more than one row are compared byte by byte with the row that stays.
    """
    located = lambda df: with_locator(df.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("__ll_text")), Workspace(spark, "none"))
    everything = located(spark.read.schema(schema).parquet(source))
    arrivals = index(located(spark.readStream.schema(schema).parquet(source)), "__ll_id", "__ll_text", digest)
    wanted, space = arrivals.schema, Workspace(spark, "ingest")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/index/arrival={number:09}")

    arrivals.writeStream.option("checkpointLocation", f"{folder}/index-checkpoint").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    rows = _read(spark, f"{folder}/index", StructType([*wanted, StructField("arrival", LongType())]))
    marks = StructType([StructField("digest", StringType()), StructField("upto", LongType()), StructField("batch", LongType())])

    def check(changed: DataFrame, number: int) -> None:
        seen = _read(spark, f"{folder}/checked", marks)
        upto = seen.filter(F.col("batch") < number).agg(F.max("upto")).first()[0]
        hits = changed.filter("copies > 1").select("digest", "keeper.file", "keeper.row")
        # An arrival may be cut between two batches; what is read twice is only compared twice.
        fresh = rows.filter(F.col("arrival") >= (-1 if upto is None else upto)).join(hits.select("digest"), "digest", "left_semi")
        spots = space.save(fresh.select("file", "row").unionByName(hits.select("file", "row")).distinct(), f"hits{number}")
        last = rows.agg(F.max("arrival")).first()[0]
        found = _mixed(_texts(everything, spots, digest)).unionByName(spark.createDataFrame([(None,)], "digest string"))
        found.withColumn("upto", F.lit(last).cast("long")).write.mode("overwrite").parquet(f"{folder}/checked/batch={number}")

    if rows.isEmpty():
        groups = spark.createDataFrame([], "digest string").select("digest", F.lit(None).cast(index_keeper(wanted)).alias("keeper"), F.lit(0).cast("long").alias("copies"))
    else:
        groups = track(spark, f"{folder}/index", rows.schema, f"{folder}/state", check=check, **options)
    groups = space.save(groups, "groups")
    mixed = space.save(_read(spark, f"{folder}/checked", marks).filter("digest is not null").select("digest").distinct(), "mixed")
    return _resolve(rows.drop("arrival"), groups, mixed, everything, digest, space)


def index_keeper(schema: StructType) -> StructType:
    """Type of a keeper, by the type of the identifier."""
    return StructType([StructField("shorter", LongType()), StructField("no_id", BooleanType()), StructField("id", schema["id"].dataType), StructField("file", LongType()), StructField("row", LongType())])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None, digest=sha256) -> DataFrame:
    """One row per document: id, file, row, digest, keeper (struct), copies, kept.

    ``digest`` maps normalised text to a key; rows that collide under it are told apart by their full bytes.
    """
    space = space or Workspace(docs.sparkSession, "exact-dedup")
    return _dedup(with_locator(docs.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("__ll_text")), space), space, digest)


def _dedup(located: DataFrame, space: Workspace, digest=sha256) -> DataFrame:
    spark = located.sparkSession
    rows = space.save(index(located, "__ll_id", "__ll_text", digest), "index")
    groups = space.save(track(spark, space.path("index"), rows.schema, space.path("state")), "groups")
    copies = groups.filter("copies > 1")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hits = space.save(join_hot(rows, copies.select(F.col("digest").alias("c_digest"), "copies"), "digest", "c_digest", "copies", total).select("file", "row"), "hits")
    mixed = space.save(_mixed(_texts(located, hits, digest)), "mixed")
    return _resolve(rows, groups, mixed, located, digest, space)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that go; the columns of docs."""
    space = Workspace(docs.sparkSession, "exact-dedup")
    located = with_locator(docs, space)
    marked = _dedup(located.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("__ll_text"), "__ll_file", "__ll_row"), space)
    gone = space.save(marked.filter(~F.col("kept")).select(F.col("file").alias("__ll_gone_file"), F.col("row").alias("__ll_gone_row")), "gone")
    left = located.join(broadcast_if_small(gone), (F.col("__ll_file") == F.col("__ll_gone_file")) & (F.col("__ll_row") == F.col("__ll_gone_row")), "left_anti")
    return left.select(*[left[f"`{c}`"] for c in docs.columns])
