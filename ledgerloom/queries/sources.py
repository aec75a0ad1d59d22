"""Queries: bank files. Each writes one file a nation first (a title, a header, its customers, a total), every other one in latin-1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bank_files as src
from ..storage import Workspace
from .common import ledger, oracle, query, table

S, D = SparkSession, DataFrame
_SEP = "CASE c_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"
_FILES_SQL = f"""body AS (SELECT c_nationkey AS file, {_SEP} AS sep, string_agg(concat_ws({_SEP}, CAST(c_custkey AS VARCHAR), concat('"', c_name, {_SEP}, ' x"'), c_mktsegment), chr(10) ORDER BY c_custkey) AS b, count(*) AS n FROM customer GROUP BY 1, 2),
files AS (SELECT file, sep, n, concat('Società ', CAST(file AS VARCHAR), sep, sep, chr(10), 'Key', sep, 'Name', sep, 'Segment', chr(10), b, chr(10), 'Total', sep, sep) AS t FROM body)"""


def _files(spark: S, sf: str) -> D:
    """Written as text, one row a file, then read back as bytes."""
    k = F.col("c_nationkey") % 4
    sep = F.when(k == 0, ",").when(k == 1, ";").when(k == 2, "\t").otherwise("|")
    line = F.concat(F.col("c_custkey").cast("string"), sep, F.lit('"'), "c_name", sep, F.lit(' x"'), sep, "c_mktsegment")
    body = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("file"), sep.alias("sep")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("b"))
    s = F.col("sep")
    text = F.concat(F.lit("Società "), F.col("file").cast("string"), s, s, F.lit("\nKey"), s, F.lit("Name"), s, F.lit("Segment\n"), F.array_join("b.line", "\n"), F.lit("\nTotal"), s, s)
    whole, at = body.select("file", text.alias("value")), Workspace(spark, "bank-files")
    whole.repartition("file").write.partitionBy("file").text(at.path("in"))
    # The text writer knows UTF-8 only, so the bytes of every other file are changed after reading.
    latin = F.encode(F.decode("content", "UTF-8"), "ISO-8859-1")
    return src.read(spark, at.path("in")).withColumn("content", F.when(F.col("file") % 2 == 1, latin).otherwise(F.col("content")))


def _probe(spark: S, sf: str) -> D:
    return src.probe(_files(spark, sf)).withColumn("file", F.col("file").cast("bigint"))


def _sql(select: str) -> str:
    return f"WITH {_FILES_SQL} {select}"


@query(_sql("SELECT CAST(file AS BIGINT) AS file, CASE WHEN file % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END AS encoding FROM files"))
def src_encoding(spark: S, sf: str) -> D:
    return _probe(spark, sf).select("file", "encoding")


@query(_sql("SELECT CAST(file AS BIGINT) AS file, sep FROM files"))
def src_delimiter(spark: S, sf: str) -> D:
    return _probe(spark, sf).select("file", "sep")


@query(_sql("SELECT CAST(file AS BIGINT) AS file, CAST(1 AS BIGINT) AS header_row, TRUE AS certain FROM files"))
def src_header_csv(spark: S, sf: str) -> D:
    return _probe(spark, sf).select("file", F.col("header.row").cast("bigint").alias("header_row"), "header.certain")


@query(_sql("SELECT CAST(file AS BIGINT) AS file, sha256(array_to_string(string_split(t, chr(10))[1:30], chr(10))) AS header_hash FROM files"))
def src_header_hash(spark: S, sf: str) -> D:
    return _probe(spark, sf).select("file", "header_hash")


@query(_sql("SELECT CAST(file AS BIGINT) AS file, sha256(unhex(CASE WHEN file % 2 = 0 THEN h ELSE replace(h, 'C3A0', 'E0') END)) AS file_hash FROM (SELECT file, hex(encode(concat(t, chr(10)))) AS h FROM files)"))
def src_file_hash(spark: S, sf: str) -> D:
    return _probe(spark, sf).select("file", "file_hash")


@query(_sql("SELECT CAST(file AS BIGINT) AS file, concat('cols:', substr(sha256('Key|Name|Segment'), 1, 16)) AS columns_key FROM files"))
def src_columns_key(spark: S, sf: str) -> D:
    at = F.get("lines", F.col("header.row"))
    return _probe(spark, sf).select("file", src.columns_key(src.cells(at, F.col("sep"))).alias("columns_key"))


@query(_sql("SELECT CAST(file AS BIGINT) AS file, CAST(i AS BIGINT) AS row_num, string_split(t, chr(10))[i + 1] AS line FROM files, unnest([0, 1, 2]) u(i)"))
def src_raw_head(spark: S, sf: str) -> D:
    """The first three lines of each file, which is what the operator shows."""
    return _probe(spark, sf).select("file", F.posexplode(F.slice("lines", 1, 3)).alias("row_num", "line")).withColumn("row_num", F.col("row_num").cast("bigint"))


_LOADED = f"SELECT CAST(c_nationkey AS BIGINT) AS file, CAST(c_custkey AS VARCHAR) AS a, concat(c_name, {_SEP}, ' x') AS b, c_mktsegment AS c FROM customer"


@query(_sql(f"{_LOADED} UNION ALL SELECT CAST(file AS BIGINT), 'Total', '', '' FROM files"))
def src_load(spark: S, sf: str) -> D:
    return src.rows(_probe(spark, sf), ["file"]).select("file", *[F.get("cells", i).alias(c) for i, c in enumerate("abc")])


@query(_sql(f"{_LOADED} UNION ALL SELECT CAST(file AS BIGINT), 'Total', '', '' FROM files WHERE n < 4"))
def src_footer_iqr(spark: S, sf: str) -> D:
    """Total lines go, but from files under five rows."""
    kept = src.strip_footer(src.rows(_probe(spark, sf), ["file"]), "file")
    return kept.select("file", *[F.get("cells", i).alias(c) for i, c in enumerate("abc")])


@query(oracle(r"SELECT id, lower(trim(regexp_replace(regexp_replace(concat(raw_description, ' 12/03/2024 1.234,50'), '[0-9]{1,4}[/\-\.][0-9]{1,2}[/\-\.][0-9]{1,4}', '', 'g').regexp_replace('[0-9.,]+', '', 'g'), '\s+', ' ', 'g'))) AS residual FROM ledger"))
def src_residual_text(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", src.residual(F.concat("raw_description", F.lit(" 12/03/2024 1.234,50"))).alias("residual"))


@query(oracle("SELECT id, context FROM ledger"))
def src_drop_empty_cols(spark: S, sf: str) -> D:
    df = ledger(spark, sf).select("id", "context", "transfer_pair_id", F.lit(None).cast("date").alias("closed"))
    return src.drop_empty_columns(df)


_CSV = ["id", "date", "amount", "currency", "description", "source_file", "doc_type", "account_label", "tx_type", "category", "subcategory", "category_source", "reconciled", "to_review"]


@query(oracle("SELECT id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, currency, description, source_file, doc_type, account_label, tx_type, category, subcategory, category_source, reconciled, to_review FROM ledger"))
def snk_csv(spark: S, sf: str) -> D:
    """Written by the executors, read back."""
    at = Workspace(spark, "export").path("ledger")
    src.write_csv(ledger(spark, sf), at, _CSV)
    back = spark.read.option("header", True).option("escape", '"').csv(at)
    return back.withColumns({"amount": F.col("amount").cast("double"), "reconciled": F.col("reconciled").cast("boolean"), "to_review": F.col("to_review").cast("boolean")})
