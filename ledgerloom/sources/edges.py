"""Rows of bank files that aren't movements: sparse ones before the table, incomplete ones behind it, and footers met in earlier files.

Tables are (file, row_num, cells), as ``bank_files.rows`` gives them, of any number of files at once; an empty or null cell is not
filled. Per file only counts, a median over counts of filled cells (a few values) and its last ten rows are kept, so a file
of any length is one row after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small
from .bank_files import FOOTER_ROWS, FOOTER_SHARE, residual

#: A row is sparse below this share of the median; a file with more sparse rows, or a larger share of them, is refused.
SPARSE, BEFORE_ROWS, BEFORE_SHARE = 0.5, 20, 0.10
#: Rows in which known footers are looked for, the shortest pattern, words that make a row suspect.
TAIL_ROWS, PATTERN_CHARS = 10, 3
SUSPECT = (
    "totale totali total totaux saldo saldi balance solde firma firme signature unterschrift "
    "timbro stamp cachet pagina page seite estratto extract extrait riepilogo summary résumé zusammenfassung"
).split()


def _filled(cells: Column) -> Column:
    return F.coalesce(F.size(F.filter(cells, lambda c: F.coalesce(c != "", F.lit(False)))), F.lit(0))


def before(table: DataFrame, file: str = "file") -> DataFrame:
    """(file, rows, skipped, refused): sparse rows before a file's first full one, which is its header.

    Files under five rows skip none. A file with more to skip than allowed is refused: it doesn't start with a table.
    """
    t = table.select(file, "row_num", _filled(F.col("cells")).alias("filled"))
    counts = t.groupBy(file, "filled").agg(F.count("*").alias("k"), F.min("row_num").alias("first"))
    one = counts.groupBy(file).agg(F.sum("k").alias("rows"), F.expr("percentile(filled, 0.5, k)").alias("median"), F.collect_list(F.struct("filled", "first")).alias("levels"))
    full = F.array_min(F.transform(F.filter("levels", lambda x: x["filled"] >= F.col("median") * SPARSE), lambda x: x["first"]))
    start = one.select(file, "rows", full.alias("start"))
    # How many rows come before the first full one: row numbers may have gaps.
    early = t.join(start, file).groupBy(file).agg(F.first("rows").alias("rows"), F.count_if(F.col("start").isNull() | (F.col("row_num") < F.col("start"))).alias("sparse"))
    over = (F.col("sparse") > BEFORE_ROWS) | (F.col("sparse") > F.col("rows") * BEFORE_SHARE)
    small = F.col("rows") < 5
    return early.select(file, "rows", F.when(small | over, 0).otherwise(F.col("sparse")).cast("bigint").alias("skipped"), (~small & over).alias("refused"))


def strip_before(table: DataFrame, file: str = "file") -> DataFrame:
    """table without the sparse rows before each file's header, and without refused files; the header is each file's first row."""
    edge = before(table, file).filter(~F.col("refused")).select(file, "skipped")
    n = F.row_number().over(Window.partitionBy(file).orderBy("row_num"))
    skip = edge.filter("skipped > 0").withColumnRenamed("skipped", "__skip")
    # A rank limit keeps few rows a file before the exchange: none is skipped beyond BEFORE_ROWS.
    first = table.select(file, "row_num").join(skip, file).withColumn("__n", n).filter(F.col("__n") <= BEFORE_ROWS).filter(F.col("__n") <= F.col("__skip")).select(file, "row_num")
    return table.join(edge.select(file), file, "left_semi").join(first, [file, "row_num"], "left_anti")


def incomplete_tail(table: DataFrame, mandatory: Column, file: str = "file") -> DataFrame:
    """The rows (with the columns of table) that end a file and lack one of the cells that ``mandatory``, an array of positions, names.

    As many as ``FOOTER_ROWS`` and ``FOOTER_SHARE`` allow, the last ones, but one always; none of files under three rows. Without
    mandatory positions no row is incomplete.
    """
    lacks = F.exists(mandatory, lambda i: F.coalesce(F.get(F.col("cells"), i) == "", F.lit(True)))
    last = table.groupBy(file).agg(F.count("*").alias("__rows"), F.max(F.when(~F.coalesce(lacks, F.lit(False)), F.col("row_num"))).alias("__last"))
    behind = table.join(last.filter("__rows >= 3"), file).filter(F.col("row_num") > F.coalesce("__last", F.lit(-1)))
    allowed = F.greatest(F.lit(1), F.least(F.lit(FOOTER_ROWS), F.floor(F.col("__rows") * FOOTER_SHARE)))
    n = F.row_number().over(Window.partitionBy(file).orderBy(F.desc("row_num")))
    return behind.withColumn("__n", n).filter(F.col("__n") <= FOOTER_ROWS).filter(F.col("__n") <= allowed).select(*table.columns)


def learn(footers: DataFrame, layout: str, text: Column) -> DataFrame:
    """(layout, pattern): what footer rows leave without their dates and numbers, each once; too short ones are no pattern."""
    return footers.select(layout, residual(F.coalesce(text, F.lit(""))).alias("pattern")).filter(F.length("pattern") >= PATTERN_CHARS).distinct()


def known_tail(table: DataFrame, patterns: DataFrame, layout: str, text: Column, file: str = "file") -> DataFrame:
    """(file, row_num, known) of rows among each file's last ``TAIL_ROWS``: known ones hold a pattern of their layout, the others a
    suspect word. Rows of layouts without patterns aren't judged, as there is nothing to compare with."""
    n = F.row_number().over(Window.partitionBy(file).orderBy(F.desc("row_num")))
    tail = table.select(file, "row_num", layout, F.coalesce(text, F.lit("")).alias("__text")).withColumn("__n", n).filter(F.col("__n") <= TAIL_ROWS)
    stored = broadcast_if_small(patterns.groupBy(layout).agg(F.collect_set("pattern").alias("__patterns")))
    known = F.exists("__patterns", lambda p: F.contains(residual(F.col("__text")), p))
    suspect = F.exists(F.array(*[F.lit(w) for w in SUSPECT]), lambda w: F.contains(F.lower("__text"), w))
    return tail.join(stored, layout).select(file, "row_num", known.alias("known"), suspect.alias("__suspect")).filter("known or __suspect").drop("__suspect")
