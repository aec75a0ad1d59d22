"""What the columns of bank files hold, told from their cells alone: type, description, dates, amounts and their signs.

Everything takes rows of (file, row_num, cells), of any number of files at once, and gives a row per file or per file and column.
Cells that are null or blank are not filled.

Scale. Cells are unpivoted once into (file, col, row_num, value). The samples of a column are its first filled cells, cut by a
ranked limit before the shuffle; whole-column figures come from counts by value, so a value with many rows is one row
per task. How often two amount columns are filled together is counted on the rows themselves. No file is held in one place, and
only tables with a row per file and column are joined.

Defined results. A column without filled cells is text and says nothing; a file without rows gives no rows. Rows may be shorter
than others: missing cells aren't filled. Rows of one file that share a row number are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date

#: A date and an amount as cells write them, cells that a type is told from, share of them that must fit, median
#: above which numbers are references.
DATE_CELL = r"^\s*\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4}(\s+\d{1,2}:\d{2}(:\d{2})?)?\s*$"
AMOUNT_CELL = r"(?U)^\s*[€$£¥₹+\-]?\s*\d[\d\s]*([.,]\d{3})*([.,]\d{1,2})?\s*[€$£¥₹]?\s*$"
SAMPLES, FIT, CAP = 30, 0.6, 1_000_000.0
#: Few distinct values (number, share of all), least share of letters, bounds of a pair of columns that complete one another.
FEW, FEW_SHARE, LETTERS = 5, 0.03, 0.3
COMPLETE, OVERLAP = 0.85, 0.05


def unpivot(rows: DataFrame, file: str = "file") -> DataFrame:
    """(file, col, row_num, value): the filled cells."""
    return rows.select(file, "row_num", F.posexplode("cells").alias("col", "value")).withColumn("value", F.trim("value")).filter("value <> ''")


def shape(rows: DataFrame, file: str = "file") -> DataFrame:
    """(file, col, rows): every column of every file."""
    return rows.groupBy(file).agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("width")).filter("width > 0").select(file, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"), "rows")


def _number(cell: Column) -> Column:
    """The number in a cell that looks like an amount."""
    s = F.regexp_replace(cell, r"(?U)[€$£¥₹\s]", "")
    dot, comma = F.length(s) - F.locate(".", F.reverse(s)), F.length(s) - F.locate(",", F.reverse(s))
    both = s.contains(".") & s.contains(",")
    one = s.rlike(r"^[^,]*,[^,]{0,2}$")
    plain = F.when(both & (dot < comma), F.replace(F.replace(s, F.lit(".")), F.lit(","), F.lit("."))).when(~both & one, F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(",")))
    return plain.try_cast("double")


def types(cells: DataFrame, columns: DataFrame, file: str = "file", cap: float = CAP) -> DataFrame:
    """(file, col, type): date, amount or text, by the first filled cells of a column.

    At least 60 % of them must fit. A column of five or more equal samples is an identifier, one of numbers with an upper median above
    ``cap`` a reference: both text.
    """
    order = Window.partitionBy(file, "col").orderBy("row_num", "value")
    some = cells.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLES)
    amount = F.col("value").rlike(AMOUNT_CELL)
    date = F.col("value").rlike(DATE_CELL) | parse_date(F.col("value")).isNotNull()
    numbers = F.array_sort(F.collect_list(F.when(amount, F.abs(_number(F.col("value"))))))  # at most SAMPLES
    told = some.groupBy(file, "col").agg(F.count("*").alias("n"), F.count_distinct("value").alias("k"), F.count_if(date).alias("dates"), F.count_if(amount).alias("amounts"), numbers.alias("numbers"))
    median = F.get("numbers", F.floor(F.size("numbers") / 2).cast("int"))
    kind = (
        F.when((F.col("n") >= 5) & (F.col("k") == 1), "text")
        .when(F.col("dates") / F.col("n") >= FIT, "date")
        .when((F.col("amounts") / F.col("n") >= FIT) & (F.coalesce(median, F.lit(0.0)) <= cap), "amount")
        .otherwise("text")
    )
    return columns.select(file, "col").join(told.select(file, "col", kind.alias("type")), [file, "col"], "left").fillna("text", ["type"])


def figures(cells: DataFrame, columns: DataFrame, file: str = "file") -> DataFrame:
    """(file, col, rows, filled, k, letters, code, negative): per column, its filled and distinct cells, the median share of letters,
    whether it is a code (no two cells equal, no blanks, one length) and whether a number in it is negative."""
    values = cells.groupBy(file, "col", "value").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("value", r"(?U)\s", "")
    share = F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) / F.greatest(F.length(bare), F.lit(1))
    plain = F.replace(F.regexp_replace("value", r"(?U)[€$£\s]", ""), F.lit(","), F.lit("."))
    below = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (plain.try_cast("double") < 0)
    marked = values.withColumns({"share": share, "blank": F.col("value").rlike(r"(?U)\s"), "length": F.length("value"), "below": F.coalesce(below, F.lit(False))})
    found = marked.groupBy(file, "col").agg(F.sum("n").alias("filled"), F.count("*").alias("k"), F.expr("percentile(share, 0.5, n)").alias("letters"), F.bool_or("blank").alias("blank"), F.min("length").alias("short"), F.max("length").alias("long"), F.bool_or("below").alias("negative"))
    code = (F.col("filled") >= 2) & (F.col("k") == F.col("filled")) & ~F.col("blank") & (F.col("short") == F.col("long"))
    whole = columns.join(found.withColumn("code", code), [file, "col"], "left").fillna({"filled": 0, "k": 0, "letters": 0.0}).fillna(False, ["code", "negative"])
    return whole.select(file, "col", "rows", "filled", "k", "letters", "code", "negative")


def description_columns(profile: DataFrame, file: str = "file") -> DataFrame:
    """(file, cols): the columns that make up the description, in order. ``profile``: figures with type.

    Text columns with more than a few distinct values; of these the worded ones that aren't codes, if any, and of those the ones with at
    least half as many distinct values as the richest.
    """
    few = (F.col("k") <= FEW) | (F.col("k") / F.greatest("filled", F.lit(1)) <= FEW_SHARE)
    free = profile.filter((F.col("type") == "text") & ~few).withColumn("worded", (F.col("letters") >= LETTERS) & ~F.col("code"))
    of_file = Window.partitionBy(file)  # a file's columns
    ranked = free.withColumns({"any_worded": F.max("worded").over(of_file), "richest": F.max(F.when(F.col("worded"), F.col("k"))).over(of_file)})
    kept = ranked.filter(~F.col("any_worded") | (F.col("worded") & (2 * F.col("k") >= F.col("richest"))))
    return kept.groupBy(file).agg(F.array_sort(F.collect_list("col")).alias("cols"))


def amount_columns(rows: DataFrame, profile: DataFrame, file: str = "file") -> DataFrame:
    """(file, amount, debit, credit, semantics) of every file.

    Two amount columns complete one another if together they are filled on more than 85 % of the rows, neither on all and on
    fewer than 5 % both; the fullest such pair is debit and credit. The one with negative numbers is the debit, else the fuller one. Without a pair
    the fullest column is the amount.
    """
    amounts = profile.filter("type = 'amount'").withColumn("d", F.col("filled") / F.col("rows"))
    listed = amounts.groupBy(file).agg(F.array_sort(F.collect_list("col")).alias("cols"))
    filled = rows.join(listed, file).select(file, F.filter("cols", lambda c: F.trim(F.coalesce(F.get("cells", c), F.lit(""))) != "").alias("on")).filter(F.size("on") > 1)
    both = filled.select(file, F.explode("on").alias("c1"), "on").select(file, "c1", F.explode("on").alias("c2")).filter("c1 < c2").groupBy(file, "c1", "c2").agg(F.count("*").alias("both"))
    side = lambda n: amounts.select(file, F.col("col").alias(f"c{n}"), F.col("d").alias(f"d{n}"), F.col("negative").alias(f"neg{n}"), F.col("rows").alias(f"rows{n}"))
    pairs = side(1).join(side(2), file).filter("c1 < c2").join(both, [file, "c1", "c2"], "left")
    fits = pairs.filter((F.col("d1") + F.col("d2") > COMPLETE) & (F.greatest("d1", "d2") < 1) & (F.coalesce("both", F.lit(0)) / F.col("rows1") < OVERLAP))
    first = (F.col("neg1") & ~F.col("neg2")) | ((F.col("neg1") == F.col("neg2")) & (F.col("d1") >= F.col("d2")))
    roles = fits.withColumns({"debit": F.when(first, F.col("c1")).otherwise(F.col("c2")), "credit": F.when(first, F.col("c2")).otherwise(F.col("c1")), "how": F.when(F.col("neg1") | F.col("neg2"), "debit_credit_signed").otherwise("debit_positive")})
    pair = roles.groupBy(file).agg(F.max_by(F.struct("debit", "credit", "how"), F.struct(F.col("d1") + F.col("d2"), -F.col("c1"), -F.col("c2"))).alias("p"))
    fullest = amounts.groupBy(file).agg(F.max_by("col", F.struct("d", -F.col("col"))).alias("col"), F.count("*").alias("n"))
    each = profile.select(file).distinct().join(fullest, file, "left").join(pair, file, "left")
    semantics = F.when(F.col("p").isNotNull(), F.col("p.how")).when(F.col("n").isNull(), "unclear").when(F.col("n") == 1, "signed_single").otherwise("neutral")
    return each.select(file, F.when(F.col("p").isNull(), F.col("col")).alias("amount"), F.col("p.debit").alias("debit"), F.col("p.credit").alias("credit"), semantics.alias("semantics"))


def sign(rows: DataFrame, layout: DataFrame, file: str = "file") -> DataFrame:
    """(file, positive, negative, invert, conclusive) of the files with one amount column: the more frequent sign is spending;
    with fewer than three movements or a tie it is the first movement's, and the measure is not conclusive."""
    one = layout.filter("amount IS NOT NULL AND debit IS NULL").select(file, "amount")
    values = rows.join(one, file).select(file, "row_num", parse_amount(F.get("cells", F.col("amount"))).alias("v")).filter("v <> 0")
    g = values.groupBy(file).agg(F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") < 0).alias("negative"), F.min_by(F.col("v") > 0, F.struct("row_num", "v")).alias("first"))
    sure = (F.col("positive") + F.col("negative") >= 3) & (F.col("positive") != F.col("negative"))
    return g.select(file, "positive", "negative", F.when(sure, F.col("positive") > F.col("negative")).otherwise(F.col("first")).alias("invert"), sure.alias("conclusive"))


def date_columns(profile: DataFrame, file: str = "file", names: DataFrame | None = None, operation: str = "", booking: str = "") -> DataFrame:
    """(file, date, booking): the first date column is the movement's, the second the booking's. With ``names`` (file, col, name) and
    patterns of the words that tell the two apart, a name decides before the position."""
    dates = profile.filter("type = 'date'").select(file, "col")
    if names is None:
        hinted = dates.withColumns({"op": F.lit(False), "book": F.lit(False)})
    else:
        low = F.lower(F.coalesce("name", F.lit("")))
        hinted = dates.join(names, [file, "col"], "left").select(file, "col", low.rlike(operation).alias("op"), low.rlike(booking).alias("book"))
    g = hinted.groupBy(file).agg(F.array_sort(F.collect_list("col")).alias("cols"), F.min(F.when(F.col("op"), F.col("col"))).alias("op"), F.min(F.when(F.col("book"), F.col("col"))).alias("book"))
    date = F.coalesce("op", "book", F.get("cols", F.lit(0)))
    other = F.get(F.filter("cols", lambda c: c != date), F.lit(0))
    # A lone booking date is the movement's, and then no other is the booking's.
    second = F.when(F.col("op").isNotNull() & F.col("book").isNotNull(), F.col("book")).when(F.col("op").isNull() & F.col("book").isNotNull(), F.lit(None)).otherwise(other)
    return g.select(file, date.alias("date"), second.alias("booking"))
