"""Filter interaction audit: what each of five filters removes, in every order in which they could run.

Method. One narrow pass turns each document into a mask of the filters it fails. For every part and every group of documents
(all, good, toxic) the 32 signed parity sums S(w) = sum over documents of (-1)^popcount(mask & w) are aggregated. They are
the Walsh-Hadamard transform of the histogram of masks, so the inverse transform gives the 32 cells exactly, in integers:
n(m) = sum over w of (-1)^popcount(m & w) S(w) / 32. All 120 orders are read off the cells: a filter at some step removes the cells
that fail it and none of the filters before it. A filter's Shapley sum over the orders needs no orders at all: of the 120
orders of a document with k failed filters, each of the k comes first of them in 120 / k.

Scale. Text is read once and never moves. Whether a text has an equal of a smaller id is decided on digests: per-digest minima with
partial aggregation, of which only those that occur more than once go back to the documents (see ``join_hot``). Labels meet
masks, not texts. The sums are a partial aggregation, 32 rows per part and task, so a part with a third of all rows is no
hot key. What follows has 32 rows per part.

Defined results. Null text is the empty text, null language the empty part; so an empty text and a null one are equal texts.
A document without an id is equal to no smaller one and makes none of the others larger; it has no labels. Rows that repeat
an id are documents of their own, and equal texts of one id are not told apart. A label counts if any of its rows says 1.
An empty table has no parts and gives no rows. Extra columns are ignored whatever their names. Very long texts are read whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot, words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)
LEAST_WORDS = 100
#: In hundredths: least share of distinct words, greatest share of capitals.
DISTINCT, CAPITALS = 80, 10
SIGNS = r"[#$%&*|]"
#: Groups of documents whose cells are kept apart: column prefix and the condition.
GROUPS = {"n": None, "good": "quality", "toxic": "toxic"}


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    found = words(text)

    def fails(w: Column) -> Column:
        rules = {
            "A": F.size(w) < LEAST_WORDS,
            "B": 100 * F.size(F.array_distinct(w)) < DISTINCT * F.size(w),
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS * F.length(text),
            "D": text.rlike(SIGNS),
        }
        return sum((F.when(rule, _bit(letter)).otherwise(0) for letter, rule in rules.items()), F.lit(0))

    return F.transform(F.array(found), fails)[0]  # the words are split once


def masks(docs: DataFrame, space: Workspace) -> DataFrame:
    """Written table of (doc_id, part, mask), one row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), own_mask(text).alias("own"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))
    rows = space.save(rows, "own-masks")
    equals = space.save(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1").withColumnRenamed("digest", "e_digest"), "equals")
    total = rows.count()
    met = join_hot(rows, equals, "digest", "e_digest", "copies", total, how="left")
    later = F.when(F.col("doc_id") > F.col("least"), _bit("E")).otherwise(0)
    return space.save(met.select("doc_id", "part", (F.col("own") + later).alias("mask")), "masks")


def parity(bits: Column) -> Column:
    """(-1) to the number of bits."""
    return 1 - 2 * (F.bit_count(bits) % 2)


def parity_sums(marked: DataFrame) -> DataFrame:
    """(part, w, n, good, toxic): 32 signed sums per part and group. ``marked``: part, mask, quality, toxic."""
    rows = marked.select("part", "mask", "quality", "toxic", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("w"))
    rows = rows.withColumn("sign", parity(F.col("mask").bitwiseAND(F.col("w"))))
    sums = {name: F.sum("sign" if label is None else F.when(F.col(label) == 1, F.col("sign")).otherwise(0)) for name, label in GROUPS.items()}
    return rows.groupBy("part", "w").agg(*[total.alias(name) for name, total in sums.items()])


def invert(sums: DataFrame) -> DataFrame:
    """One row per part: arrays n, good and toxic of 32 cells each, by mask, from the parity sums."""
    rows = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("m"))
    sign = parity(F.col("m").bitwiseAND(F.col("w")))
    cells = rows.groupBy("part", "m").agg(*[F.shiftright(F.sum(sign * F.col(name)), CELLS.bit_length() - 1).alias(name) for name in GROUPS])  # divisible by 32
    ordered = F.array_sort(F.collect_list(F.struct("m", *GROUPS)))  # 32 entries
    return cells.groupBy("part").agg(ordered.alias("c")).select("part", *[F.col(f"c.{name}").alias(name) for name in GROUPS])


def orders(cells: DataFrame) -> DataFrame:
    """One row per part, order and step, from the cells."""
    steps = [(order, step, f, _bit(f), sum(map(_bit, order[: step - 1]))) for order in ORDERS for step, f in enumerate(order, 1)]
    spark = cells.sparkSession
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter string, bit int, before int")
    every = cells.select("*", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order"))
    rows = every.join(F.broadcast(plan), "filter_order")  # 600 rows, fixed

    def over(name: str, keep) -> Column:
        """Sum of the cells of which keep(mask) holds."""
        picked = F.transform(F.col(name), lambda n, m: F.when(keep(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & passed(m)
    shares = F.transform(F.col("n"), lambda n, m: F.when(fails(m), n * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        over("n", lambda m: m == bit).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """The audit of docs (doc_id, text, lang) with labels (doc_id, quality, toxic)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("l_doc_id")).agg(one("quality"), one("toxic"))
    rows = masks(docs, space)
    marked = rows.join(known, F.col("doc_id") == F.col("l_doc_id"), "left")
    # The transform is linear and its result a row per part: written, so that 120 orders don't repeat the aggregation.
    return orders(invert(space.save(parity_sums(marked), "parity-sums")))
