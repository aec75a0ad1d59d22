"""Bank exports: bytes to lines and cells, thousands of files in one job, without a loop over files on the driver.

A file is one row of Spark's ``binaryFile`` source and so below 2 GB; an export of a bank is some megabytes. Probing is expressions on
that row: an empty file has no lines, the delimiter ``,`` and no header. Cells are split one line a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
#: Lines in which a header is looked for, and lines that a layout's digest covers.
HEADER_LINES, DIGEST_LINES = 50, 30
#: A footer has at most so many rows, and at most this share of a file's rows, but one row is always allowed.
FOOTER_ROWS, FOOTER_SHARE = 5, 0.05

#: What a cell without words looks like, and what leaves a residual text.
NUMERIC = r"^[\d\.\,\-\+\s€$£%]+$"
DATE, NUMBER = r"\d{1,4}[/\-\.]\d{1,2}[/\-\.]\d{1,4}", r"[\d.,]+"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a folder, and its partition columns."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).drop("modificationTime", "length")


def joined(lines: DataFrame, file: str, head: str) -> DataFrame:
    """(file, content) of lines (file, row_num, value): one file a row, as ``read`` gives them, a head line first."""
    ordered = F.array_sort(F.collect_list(F.struct("row_num", "value")))
    text = F.concat(F.lit(head + "\n"), F.array_join(F.transform(ordered, lambda x: x["value"]), "\n"), F.lit("\n"))
    return lines.groupBy(file).agg(text.cast("binary").alias("content"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def encoding(content: Column) -> Column:
    """utf-16 with its mark, utf-8 where all bytes are valid, else latin-1, which has no invalid bytes. Whole contents decide, not a head."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), "utf-16").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")


def decoded(content: Column) -> Column:
    """The text, without a leading mark."""
    kind = encoding(content)
    text = F.when(kind == "utf-16", F.decode(content, "UTF-16")).when(kind == "utf-8", F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def lines(text: Column) -> Column:
    """Lines of a text; a line end at its end starts no further line."""
    found = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<string>"))


def delimiter(text: Column) -> Column:
    """The most frequent of the delimiters; of equals the first listed."""
    count = [F.length(text) - F.length(F.replace(text, F.lit(d))) for d in DELIMITERS]
    best = F.greatest(*count)
    found = F.lit(DELIMITERS[-1])
    for d, n in reversed(list(zip(DELIMITERS, count, strict=True))):
        found = F.when(n == best, d).otherwise(found)
    return found


def cells(line: Column, sep: Column) -> Column:
    """Trimmed cells of a line. Separators inside double quotes don't split; quotes around a cell go, doubled ones become one."""
    split = lambda text: F.split(text, F.concat(F.lit("\\Q"), sep, F.lit("\\E")))
    # Quoted parts carry their separators as a control character through the split; most lines have neither.
    quoted = F.regexp_extract_all(line, F.lit(r'"(?:[^"]|"")*"|[^"]+|"'), F.lit(0))
    hidden = F.transform(quoted, lambda part: F.when(part.rlike('^".*"$'), F.replace(part, sep, F.lit("\u0001"))).otherwise(part))
    parts = split(F.array_join(hidden, ""))
    bare = lambda c: F.replace(F.regexp_replace(F.trim(F.replace(c, F.lit("\u0001"), sep)), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.when(line.contains('"') | line.contains("\u0001"), F.transform(parts, bare)).otherwise(F.transform(split(line), lambda c: F.trim(c)))


def header(rows: Column, sep: Column) -> Column:
    """(row, certain): the fullest of the first lines, of equals the one with more cells that hold words, then the first; (0, false) without lines."""

    def rank(line: Column, i: Column) -> Column:
        found = cells(line, sep)
        worded = F.size(F.filter(found, lambda c: (c != "") & ~c.rlike(NUMERIC)))
        return F.struct((F.size(F.filter(found, lambda c: c != "")) / F.size(found)).alias("density"), worded.alias("words"), (-i).alias("back"))

    best = F.array_max(F.transform(F.slice(rows, 1, HEADER_LINES), rank))
    # A text without any filled cell keeps the first line.
    row = F.when(best["density"] > 0, -best["back"]).otherwise(0)
    return F.struct(F.coalesce(row, F.lit(0)).alias("row"), F.coalesce((best["density"] >= 0.5) & (best["words"] >= 2), F.lit(False)).alias("certain"))


def header_hash(rows: Column) -> Column:
    return F.sha2(F.array_join(F.slice(rows, 1, DIGEST_LINES), "\n"), 256)


def columns_key(names: Column) -> Column:
    """Key of a layout, whatever the order of its columns."""
    return F.concat(F.lit("cols:"), F.substring(F.sha2(F.array_join(F.array_sort(F.transform(names, lambda n: F.trim(n))), "|"), 256), 1, 16))


def probe(files: DataFrame) -> DataFrame:
    """files with file_hash, encoding, sep, lines, header (row, certain) and header_hash; content goes."""
    text = files.withColumn("__text", decoded(F.col("content"))).withColumn("lines", lines(F.col("__text"))).withColumn("sep", delimiter(F.col("__text")))
    found = text.withColumns({"file_hash": file_hash(F.col("content")), "encoding": encoding(F.col("content")), "header": header(F.col("lines"), F.col("sep")), "header_hash": header_hash(F.col("lines"))})
    return found.drop("content", "__text")


def rows(probed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, row_num, cells): the lines below each header, those without text left out; row_num counts lines from 0."""
    out = probed.select(*keep, "sep", "header", F.posexplode("lines").alias("row_num", "line"))
    return out.filter((F.col("row_num") > F.col("header.row")) & (F.trim("line") != "")).select(*keep, "row_num", cells(F.col("line"), F.col("sep")).alias("cells"))


def strip_footer(table: DataFrame, file: str) -> DataFrame:
    """Rows of (file, row_num, cells) without sparse ones at each file's end: filled shares below Q1 - 1.5 IQR; files under five rows stay.

    Quartiles come from counts by share, so no file's rows are sorted for them.
    """
    density = F.size(F.filter("cells", lambda c: c != "")) / F.size("cells")
    t = table.withColumn("__d", density)
    counts = t.groupBy(file, "__d").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(file).orderBy("__d")
    ranked = counts.withColumns({"upto": F.sum("k").over(upto), "n": F.sum("k").over(Window.partitionBy(file))})
    at = lambda q: F.min(F.when(F.col("upto") > q, F.col("__d")))
    fence = ranked.groupBy(file).agg(F.first("n").alias("__n"), at(F.floor(F.col("n") / 4)).alias("q1"), at(F.floor(F.col("n") * 3 / 4)).alias("q3"))
    fence = fence.select(file, "__n", F.when(F.col("__n") >= 5, F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("__fence"))
    j = t.join(fence, file)
    # The last full row ends what stays; rows behind it go, up to the allowed number.
    dense = j.groupBy(file).agg(F.max(F.when(F.col("__fence").isNull() | (F.col("__d") >= F.col("__fence")), F.col("row_num"))).alias("__last"))
    allowed = F.greatest(F.lit(1), F.least(F.lit(FOOTER_ROWS), F.floor(F.col("__n") * FOOTER_SHARE)))
    tail = j.join(dense, file).filter(F.col("row_num") > F.coalesce("__last", F.lit(-1)))
    gone = tail.withColumn("__k", F.row_number().over(Window.partitionBy(file).orderBy(F.desc("row_num")))).filter(F.col("__k") <= allowed)
    return table.join(gone.select(file, "row_num"), [file, "row_num"], "left_anti")


def residual(text: Column) -> Column:
    """A text without dates, numbers and wide spaces, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(text, DATE, ""), NUMBER, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without columns that hold nothing, two columns at least kept; one pass over the table, one row of counts to the driver."""
    if len(df.columns) <= 2:
        return df
    counts = df.agg(F.count("*").alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(df.columns)]).first()
    empty = [c for i, c in enumerate(df.columns) if counts[f"__{i}"] == 0][: len(df.columns) - 2]
    return df.drop(*empty) if counts["__n"] >= 2 else df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns as CSV parts with a header each, written by the executors."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
