"""Quality rules: plain text measures, then a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Method. Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted: one over all documents (raw), one over a trusted target. A document's score is the mean over its n-grams of
``log(p_target(bucket) / p_raw(bucket))``, that is the log-likelihood ratio normalised by length. A document is kept if
its score is at least the threshold. Weights are fixed-point integers, so that a score doesn't depend on the order of
additions and the verdict is the same on every run.

Scale. Counting is one explode with map-side partial aggregation into at most ``buckets`` rows: what is shuffled doesn't
grow with the corpus. The weights come back as one array of ``buckets`` integers through an uncorrelated scalar subquery.
Scoring explodes words again and sums by row: rows of a document are in one task, so partial aggregation leaves one row a
document to shuffle. Exploding rather than folding arrays in place keeps hashing and look-ups in generated code. The
target is at most ``target_rows`` documents (lowest hashes of their ids), so the join that marks them has a proven
broadcast bound.

Defined results. Null text counts as empty: no words, base_failed true. A document without n-grams scores 0. Without any
target document all weights are 0 and only the base rules decide. Repeated rows are measured one by one and count as
often as they occur. Extra input columns are ignored (``measures``) or carried (``keep``) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, with_locator, words

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
#: Added to every bucket's count in both multinomials, so that a bucket the target lacks stays finite.
SMOOTHING = 0.5
#: Log-ratio units of the fixed-point weights.
UNIT = 10_000
THRESHOLD = -0.25
MIN_WORDS = 50
#: Up to so many repeated window hashes of a document are looked up one by one.
FEW = 32

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(df: DataFrame) -> DataFrame:
    """df (with column ``ws``) plus n_repeat_words: words inside 3-word windows that occur at least twice.

    Windows whose hash is unique in the document are done with. The others, sorted as text with their positions, have equal
    ones as neighbours; the repeated windows' positions, in order, each cover 3 words less the overlap with the next.
    """
    ws = F.col("ws")
    hashes = F.transform(F.slice(ws, 3, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), w))
    df = df.withColumn("h", hashes)
    some = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("ordered", F.when(some, F.sort_array("h")))
    ordered = F.col("ordered")
    df = df.withColumn("twice", F.array_distinct(F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k - 1) == x, F.lit(False)))))

    def neighbours(o: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(o, k)["v"] == x["v"], F.lit(False))
        return F.transform(F.filter(o, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    # A few repeated hashes are looked up one by one, many by sorting.
    few = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("twice", F.get(F.col("h"), i)))
    df = df.withColumn("by_hash", F.when(some & (F.size("twice") > FEW), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("v"), i.alias("i"))))))
    df = df.withColumn("found", F.when(some & (F.size("twice") <= FEW), few).when(some, neighbours(F.col("by_hash"))))
    window = lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    df = df.withColumn("by_text", F.sort_array(F.transform("found", lambda i: F.struct(window(i).alias("v"), i.alias("i")))))
    df = df.withColumn("at", F.sort_array(neighbours(F.col("by_text"))))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "ordered", "twice", "by_hash", "found", "by_text", "at")


def _base(docs: DataFrame) -> DataFrame:
    """docs has columns ``text`` and whatever is carried; adds ``ws`` and the base measures."""
    df = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("ws", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "n_words": F.size("ws").cast("long"),
        "word_chars": F.length(F.array_join("ws", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    return _repeat_words(df).drop("lines", "text")


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _grams(df: DataFrame, keep: list[str], buckets: int, outer: bool) -> DataFrame:
    """A row for each word of ``ws``: ``one``, its bucket, and ``two``, that of it and the next word (null for the last)."""
    pairs = F.arrays_zip(F.col("ws"), F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))).alias("following"))
    rows = df.select(*keep, (F.explode_outer if outer else F.explode)(pairs).alias("g")).select(*keep, F.col("g.ws").alias("a"), F.col("g.following").alias("b"))
    number = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return rows.select(*keep, F.when(F.col("a").isNotNull(), number("a")).alias("one"), F.when(F.col("b").isNotNull(), number("a", "b")).alias("two"))


def weights(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row, column ``w``: array of ``buckets`` fixed-point log ratios.

    ``target_ids`` has a column of the same name as ``id_col`` and a bounded number of rows (see ``trusted``).
    """
    spark = docs.sparkSession
    marked = target_ids.select(F.col(id_col).alias("t_id"), F.lit(1).alias("t")).dropDuplicates()
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    df = read.join(F.broadcast(marked), F.col("id") == F.col("t_id"), "left").select(F.coalesce("t", F.lit(0)).alias("t"), words(F.col("text")).alias("ws"))
    grams = _grams(df, ["t"], buckets, outer=False).select("t", F.explode(F.array("one", "two")).alias("b")).filter("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    full = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = full.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    flat = SMOOTHING * buckets
    ratio = lambda c: F.log((c["target"] + SMOOTHING) / (F.col("n_target") + flat)) - F.log((c["raw"] + SMOOTHING) / (F.col("n_raw") + flat))
    value = lambda c: F.when(F.col("n_target") == 0, F.lit(0)).otherwise(F.round(ratio(c) * UNIT).cast("int"))
    return one.select(F.transform("c", value).alias("w"))


def trusted(labels: DataFrame, rows: int = TARGET_ROWS, id_col: str = "doc_id") -> DataFrame:
    """Ids of at most ``rows`` documents labelled as good, those with the lowest id hashes."""
    good = labels.filter(F.col("quality") == 1).select(F.col(id_col)).dropDuplicates()
    return good.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def judge(docs: DataFrame, target_ids: DataFrame, keys: list[str], id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the columns named in keys (which together name a row), the base measures, base_failed, llr, kept."""
    w = weights(docs, target_ids, id_col, text_col, buckets).scalar()
    based = _base(docs.select(*keys, F.col(f"`{text_col}`").alias("text")))
    carried = [*keys, *_BASE]
    weight = lambda c: F.coalesce(F.get(w, F.col(c)), F.lit(0)).cast("long")
    rows = _grams(based, carried, buckets, outer=True).select(*carried, (weight("one") + weight("two")).alias("s"), F.col("one").isNotNull().cast("long").alias("n1"), F.col("two").isNotNull().cast("long").alias("n2"))
    # A measure is the same on all rows of a document.
    one = rows.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum(F.col("n1") + F.col("n2")).alias("n"), *[F.max(c).alias(c) for c in _BASE])
    # Compared as integers; the score itself is for reading.
    passes = F.col("total") >= F.floor(F.col("n") * F.lit(threshold * UNIT))
    score = F.when(F.col("n") > 0, F.col("total") / (F.col("n") * UNIT)).otherwise(0.0)
    return one.select(*keys, *_BASE, _failed().alias("base_failed"), score.alias("llr"), (~_failed() & passes).alias("kept"))


def measures(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, the base measures, base_failed, llr (the score) and kept."""
    located = with_locator(docs.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("__ll_text")), Workspace(docs.sparkSession, "quality"))
    judged = judge(located, target_ids.select(F.col(id_col).alias("__ll_id")), ["__ll_file", "__ll_row", "__ll_id"], "__ll_id", "__ll_text", **options)
    return judged.select(F.col("__ll_id").alias(id_col), *_BASE, "base_failed", "llr", "kept")


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures alone."""
    return _base(docs.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("text"))).select(F.col("__ll_id").alias(id_col), *_BASE, _failed().alias("base_failed"))


def keep(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    space = Workspace(docs.sparkSession, "quality")
    located = with_locator(docs, space)
    thin = located.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("__ll_text"), "__ll_file", "__ll_row")
    judged = judge(thin, target_ids.select(F.col(id_col).alias("__ll_id")), ["__ll_file", "__ll_row"], "__ll_id", "__ll_text", **options)
    gone = space.save(judged.filter("not kept").select(F.col("__ll_file").alias("__ll_g_file"), F.col("__ll_row").alias("__ll_g_row")), "gone")
    left = located.join(broadcast_if_small(gone), (F.col("__ll_file") == F.col("__ll_g_file")) & (F.col("__ll_row") == F.col("__ll_g_row")), "left_anti")
    return left.select(*[left[f"`{c}`"] for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return keep(docs, trusted(labels))
