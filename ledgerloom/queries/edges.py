"""Queries: rows before and behind the tables of bank files. Forty customers make a file, so files grow in number with the table.

Files have up to six sparse lines before their header (every seventh too many), and footers that even files write without
a date, later ones (the odd files) as whole rows, which only what the even files taught can tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import edges as op
from ..storage import Workspace
from .common import query, table

_ROWS = """SELECT file, layout, CAST(row_num AS BIGINT) AS row_num, a, b, c FROM (
  SELECT c_custkey / 40 AS f, c_custkey % 40 + 10 AS row_num, '03/05/2024' AS a, CASE WHEN c_custkey % 97 = 38 THEN 'Totale carburante' ELSE c_name END AS b, CASE WHEN c_custkey % 61 = 7 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END AS c FROM {customer}
  UNION ALL SELECT DISTINCT floor(c_custkey / 40), 9, 'Data', 'Descrizione', 'Importo' FROM {customer}
  UNION ALL SELECT DISTINCT floor(c_custkey / 40), c_custkey % 6, 'Conto', '', '' FROM {customer} WHERE c_custkey % 6 < CASE WHEN floor(c_custkey / 40) % 7 = 6 THEN 6 ELSE floor(c_custkey / 40) % 4 END
  UNION ALL SELECT DISTINCT floor(c_custkey / 40), 60, CASE WHEN floor(c_custkey / 40) % 2 = 0 THEN '' ELSE '31/12/2024' END, concat('Saldo al 31/12/2024 conto ', CASE WHEN floor(c_custkey / 40) % 3 = 0 THEN 'corrente' ELSE 'carta' END), '1.234,50' FROM {customer}
  UNION ALL SELECT DISTINCT floor(c_custkey / 40), 61, '', '', 'pagina 1' FROM {customer} WHERE floor(c_custkey / 40) % 4 = 2
) x CROSS JOIN LATERAL (SELECT CAST(floor(f) AS BIGINT) AS file, CAST(floor(f) AS BIGINT) % 3 AS layout) y"""
_SQL = f"rows_ AS ({_ROWS.format(customer='customer')}), counted AS (SELECT *, CAST(a <> '' AS INT) + CAST(b <> '' AS INT) + CAST(c <> '' AS INT) AS filled, row_number() OVER (PARTITION BY file ORDER BY row_num) AS up, row_number() OVER (PARTITION BY file ORDER BY row_num DESC) AS down, count(*) OVER (PARTITION BY file) AS n FROM rows_)"
_BEFORE = f"""{_SQL}, med AS (SELECT file, median(filled) AS m FROM counted GROUP BY file),
first_ AS (SELECT file, n, min(up) FILTER (filled >= m * 0.5) - 1 AS sparse FROM counted JOIN med USING (file) GROUP BY file, n),
before_ AS (SELECT file, n, CASE WHEN n < 5 OR sparse > 20 OR sparse > n * 0.1 THEN 0 ELSE sparse END AS skipped, n >= 5 AND (sparse > 20 OR sparse > n * 0.1) AS refused FROM first_)"""
_TAIL = f"""{_SQL}, last_ AS (SELECT file, coalesce(min(down) FILTER (a <> '' AND b <> '' AND c <> '') - 1, max(n)) AS behind FROM counted GROUP BY file),
struct_ AS (SELECT c.* FROM counted c JOIN last_ USING (file) WHERE n >= 3 AND down <= behind AND down <= greatest(1, least(5, floor(n * 0.05))))"""
_RESIDUAL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({}, '[0-9]{{1,4}}[/\-\.][0-9]{{1,2}}[/\-\.][0-9]{{1,4}}', '', 'g'), '[0-9.,]+', '', 'g'), '\s+', ' ', 'g')))"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_ROWS, customer=table(spark, sf, "customer")).select("file", "layout", "row_num", F.array("a", "b", "c").alias("cells"))


@query(f"WITH {_BEFORE} SELECT file, n AS rows, CAST(skipped AS BIGINT) AS skipped, refused FROM before_")
def src_preheader(spark: SparkSession, sf: str) -> DataFrame:
    return op.before(_rows(spark, sf))


@query(f"WITH {_BEFORE} SELECT file, row_num, a, b, c FROM counted JOIN before_ USING (file) WHERE NOT refused AND up > skipped")
def src_strip_preheader(spark: SparkSession, sf: str) -> DataFrame:
    return op.strip_before(_rows(spark, sf)).select("file", "row_num", *[F.get("cells", i).alias(c) for i, c in enumerate("abc")])


@query(f"WITH {_TAIL} SELECT file, row_num FROM rows_ EXCEPT SELECT file, row_num FROM struct_")
def src_footer_struct(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that stay where date, description and amount are all mandatory."""
    rows = _rows(spark, sf)
    return rows.join(op.incomplete_tail(rows, F.array(*map(F.lit, range(3)))), ["file", "row_num"], "left_anti").select("file", "row_num")


@query(f"""WITH {_TAIL}, pat AS (SELECT DISTINCT layout, {_RESIDUAL.format("b")} AS pattern FROM struct_ WHERE file % 2 = 0 AND length({_RESIDUAL.format("b")}) >= 3),
late AS (SELECT file, row_num, bool_or(contains({_RESIDUAL.format("b")}, pattern)) AS known, lower(any_value(b)) AS said FROM counted JOIN pat USING (layout) WHERE file % 2 = 1 AND down <= 10 GROUP BY file, row_num)
SELECT file, row_num, known FROM late WHERE known OR regexp_matches(said, '{'|'.join(op.SUSPECT)}')""")
def src_footer_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What the even files' incomplete footers teach, by layout, met in the tails of the odd ones; suspect rows that nothing taught."""
    rows, said = _rows(spark, sf), F.get("cells", 1)
    taught = op.learn(op.incomplete_tail(rows.filter("file % 2 = 0"), F.array(*map(F.lit, range(3)))), "layout", said)
    return op.known_tail(rows.filter("file % 2 = 1"), Workspace(spark, "footers").save(taught, "patterns"), "layout", said)
