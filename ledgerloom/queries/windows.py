"""Queries: window-like operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..operators import windows as op
from ..operators.aggregates import share
from ..storage import Workspace, broadcast_if_small
from .common import dimension, ledger, oracle, query

S, D = SparkSession, DataFrame
_MI = "CAST(year(date) * 12 + month(date) - 1 AS INT)"
_TODAY = "2001-09-15"
#: An account each for what an account spends on a category: months without rows are common among these.
_FINE = "SELECT concat(account_label, '/', coalesce(category, '')) AS account_label, date FROM ledger"


def _fine(spark: S, sf: str) -> D:
    return ledger(spark, sf).select(F.concat("account_label", F.lit("/"), F.coalesce("category", F.lit(""))).alias("account_label"), "date")


@query(oracle("SELECT date, CAST(t AS DOUBLE) AS total, CAST(sum(t) OVER (ORDER BY date) AS DOUBLE) AS running FROM (SELECT date, sum(amount) AS t FROM ledger GROUP BY date)"))
def win_cumulative(spark: S, sf: str) -> D:
    return op.daily_cumulative(ledger(spark, sf))


@query(oracle("SELECT CAST(max(v) AS DOUBLE) AS \"limit\" FROM a WHERE v < coalesce((SELECT min(v) FROM u WHERE upto >= (SELECT sum(-amount) * 0.01 FROM ledger WHERE amount < 0)), 1e18)", "t AS (SELECT raw_description AS k, count(*) AS n, sum(-amount) AS v FROM ledger WHERE amount < 0 GROUP BY 1), a AS (SELECT v, count(*) AS m FROM t WHERE n = 1 GROUP BY 1), u AS (SELECT v, sum(v * m) OVER (ORDER BY v) AS upto FROM a)"))
def win_small_single(spark: S, sf: str) -> D:
    df = ledger(spark, sf).filter("amount < 0").select("raw_description", (-F.col("amount")).alias("v_in"))
    return op.small_singles(df, "raw_description", "v_in", 0.01)


_TOTALS = "t AS (SELECT lower(description) AS key, sum(abs(amount)) AS v, bool_or(coalesce(category_source IN ('manual', 'rule'), FALSE) AND l_even) AS decided FROM (SELECT *, length(description) % 2 = 0 AS l_even FROM ledger WHERE amount < 0) GROUP BY 1)"


@query(oracle("SELECT CAST(count(*) FILTER (done + before < all_v * 0.8) AS BIGINT) AS to_go FROM (SELECT *, coalesce(sum(v) OVER (ORDER BY v DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE NOT decided), (SELECT sum(v) AS all_v, coalesce(sum(v) FILTER (decided), 0) AS done FROM t)", _TOTALS))
def win_check_progress(spark: S, sf: str) -> D:
    df = ledger(spark, sf).filter("amount < 0").select(exact_key("description").alias("key"), F.abs("amount").alias("v_in"), (F.coalesce(F.col("category_source").isin("manual", "rule"), F.lit(False)) & (F.length("description") % 2 == 0)).alias("decided"))
    return op.check_progress(df, "key", "v_in")


@query(oracle(f"SELECT a.account_label, CASE WHEN last IS NULL THEN 'never' WHEN k = 0 THEN 'dormant' WHEN last < now - 1 THEN 'behind' WHEN last - first_in + 1 > k THEN 'gap' ELSE 'up_to_date' END AS kind FROM (SELECT DISTINCT account_label FROM ({_FINE})) a LEFT JOIN (SELECT account_label, max(m) AS last, count(*) FILTER (m >= now - 4) AS k, min(m) FILTER (m >= now - 4) AS first_in, any_value(now) AS now FROM (SELECT DISTINCT account_label, {_MI} AS m, 2001 * 12 + 8 AS now FROM ({_FINE})) WHERE m < now GROUP BY 1) g USING (account_label)"))
def win_gaps(spark: S, sf: str) -> D:
    return op.gap_status(_fine(spark, sf), _TODAY)


_HOLES = f"p AS (SELECT DISTINCT account_label, {_MI} AS m FROM ({_FINE})), h AS (SELECT account_label, m + 1 AS first_missing, nx - 1 AS last_missing FROM (SELECT *, lead(m) OVER (PARTITION BY account_label ORDER BY m) AS nx FROM p) WHERE nx > m + 1)"


@query(oracle("SELECT * FROM h WHERE last_missing < 2001 * 12 + 8 - 4", _HOLES))
def win_old_holes(spark: S, sf: str) -> D:
    """Holes that end before the window of the last four months."""
    return op.holes(op.months_present(_fine(spark, sf))).filter("last_missing < 2001 * 12 + 8 - 4")


@query(oracle("SELECT h.* FROM h JOIN closed_accounts c ON split_part(h.account_label, '/', 1) = c.account_label WHERE first_missing <= year(closed_on) * 12 + month(closed_on) - 1", _HOLES, ("closed_accounts",)))
def win_closed_holes(spark: S, sf: str) -> D:
    """Holes of closed accounts up to their closing month."""
    h = op.holes(op.months_present(_fine(spark, sf)))
    closed = dimension(spark, "closed_accounts").withColumnRenamed("account_label", "label")
    return h.join(F.broadcast(closed), F.substring_index("account_label", "/", 1) == F.col("label")).filter("first_missing <= year(closed_on) * 12 + month(closed_on) - 1").select("account_label", "first_missing", "last_missing")


@query(oracle("SELECT id, CAST(date - lag(date) OVER (PARTITION BY account_label, description ORDER BY date, id) AS INT) AS gap FROM ledger WHERE tx_type = 'card_tx'"))
def win_date_gap(spark: S, sf: str) -> D:
    w = Window.partitionBy("account_label", "description").orderBy("date", "id")
    return ledger(spark, sf).filter("tx_type = 'card_tx'").select("id", F.datediff("date", F.lag("date").over(w)).alias("gap"))


@query(oracle("SELECT source_file, CAST(count(*) AS BIGINT) AS tail FROM (SELECT source_file, min(CASE WHEN amount < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY date DESC, id DESC) AS ok FROM ledger) WHERE ok = 1 GROUP BY 1"))
def win_contig_tail(spark: S, sf: str) -> D:
    """Rows at a file's end for which a condition holds without a break: those after the last row that breaks it."""
    df = ledger(spark, sf).select("source_file", "date", "id", "amount")
    last = df.filter(~(F.col("amount") < 0)).groupBy("source_file").agg(F.max(F.struct("date", "id")).alias("b"))
    last = broadcast_if_small(Workspace(spark, "contig-tail").save(last, "last"))  # a row per file
    tail = df.join(last, "source_file", "left").filter(F.col("b").isNull() | (F.struct("date", "id") > F.col("b")))
    return tail.groupBy("source_file").agg(F.count("*").alias("tail"))


@query(oracle("SELECT lower(description) AS key, amount < 0 AS out, min(struct_pack(d := date, i := id)).i AS first_id FROM ledger GROUP BY 1, 2"))
def win_first_per_key(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy(exact_key("description").alias("key"), (F.col("amount") < 0).alias("out")).agg(F.min_by("id", F.struct("date", "id")).alias("first_id"))


@query(oracle("SELECT account_label, category, round(100 * t / sum(t) OVER (PARTITION BY account_label), 6) AS pct FROM (SELECT account_label, category, CAST(sum(abs(amount)) AS DOUBLE) AS t FROM ledger GROUP BY ALL)"))
def win_share(spark: S, sf: str) -> D:
    g = ledger(spark, sf).groupBy("account_label", "category").agg(F.sum(F.abs("amount")).cast("double").alias("t"))
    return g.select("account_label", "category", F.round(share(F.col("t"), "account_label"), 6).alias("pct"))


@query(oracle("SELECT source_file, round(CAST(sum(n) OVER (ORDER BY source_file) AS DOUBLE) / sum(n) OVER (), 9) AS upto FROM (SELECT source_file, count(*) AS n FROM ledger GROUP BY 1)"))
def win_file_spans(spark: S, sf: str) -> D:
    g = ledger(spark, sf).groupBy("source_file").agg(F.count("*").alias("n"))
    return g.select("source_file", F.round(F.sum("n").over(Window.orderBy("source_file")) / F.sum("n").over(Window.partitionBy(F.lit(1))), 9).alias("upto"))


@query(oracle("SELECT source_file, CAST(CASE WHEN neg + pos >= 3 AND neg <> pos THEN CASE WHEN neg > pos THEN -1 ELSE 1 END ELSE f END AS INT) AS sign, NOT (neg + pos >= 3 AND neg <> pos) AS inconclusive FROM (SELECT source_file, count(*) FILTER (amount < 0) AS neg, count(*) FILTER (amount > 0) AS pos, arg_min(sign(amount), struct_pack(z := amount = 0, d := date, i := id)) AS f FROM ledger GROUP BY 1)"))
def win_majority_sign(spark: S, sf: str) -> D:
    return op.majority_sign(ledger(spark, sf), "source_file")
