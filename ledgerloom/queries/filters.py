"""Queries: projections, filters, sorts, limits, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.amounts import amount_range
from ..functions.text import exact_key
from ..operators import filters as op
from ..types import NEVER_COUNTED
from .common import FROM, TO, ledger, oracle, query, table

S, D = SparkSession, DataFrame
_ROW = "id, date, CAST(amount AS DOUBLE) AS amount"
_NEVER = "('internal_out', 'internal_in', 'card_settlement', 'aggregate_debit')"


def _row(df: D, *more: str) -> D:
    return df.select("id", "date", F.col("amount").cast("double").alias("amount"), *more)


_ALL_FILTERS = f"""date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND coalesce(to_review, FALSE) AND account_label = 'ACC-3' AND description ILIKE '%ring%' AND category IN ('ECONOMY', 'LARGE')
  AND (context IN ('HIGH', 'LOW') OR context IS NULL) AND tx_type NOT IN ('card_settlement')"""


@query(oracle(f"SELECT {_ROW}, context, tx_type FROM ledger WHERE {_ALL_FILTERS}"))
def flt_ledger(spark: S, sf: str) -> D:
    f = op.Filters(date_from=FROM, date_to=TO, to_review=True, account_label="ACC-3", description="ring", categories=("ECONOMY", "LARGE"), contexts=("HIGH", "LOW", None), exclude_tx_types=("card_settlement",))
    return _row(op.where(ledger(spark, sf), f), "context", "tx_type")


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE description ILIKE '%anvil%' OR raw_description ILIKE '%anvil%' OR abs(amount) BETWEEN 22999.995 AND 23000.995"))
def flt_search(spark: S, sf: str) -> D:
    return _row(op.search(ledger(spark, sf), "anvil", "23000.00", "23000.99"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS low, CAST(floor(o_totalprice) AS DOUBLE) + 0.99 AS high, CAST(o_totalprice AS DOUBLE) AS point FROM orders")
def flt_amount_range(spark: S, sf: str) -> D:
    whole, exact = F.floor("o_totalprice").cast("string"), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    found = table(spark, sf, "orders").select("o_orderkey", amount_range(whole).alias("w"), amount_range(exact).alias("e"))
    return found.select("o_orderkey", F.col("w.low").cast("double").alias("low"), F.round(F.col("w.high").cast("double"), 2).alias("high"), F.when(F.col("e.low") == F.col("e.high"), F.col("e.low")).cast("double").alias("point"))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE lower(description) LIKE '%gizmo brand 1%' OR lower(raw_description) LIKE '%gizmo brand 1%'"))
def flt_text_match(spark: S, sf: str) -> D:
    return _row(op.text_match(ledger(spark, sf), "GIZMO, Brand-1"))


@query(oracle(f"SELECT {_ROW}, 'starts_with' AS how FROM ledger WHERE lower(description) LIKE 'small ring%' AND amount < 0 UNION ALL SELECT {_ROW}, 'regex' FROM ledger WHERE regexp_matches(description, '^(?i)(old|new) g')"))
def flt_rule_pattern(spark: S, sf: str) -> D:
    df, d = ledger(spark, sf), F.col("description")
    a = df.filter(op.pattern_matches(d, "small ring", "starts_with") & (op.direction(F.col("amount")) == "out"))
    b = df.filter(op.pattern_matches(d, "^(old|new) g", "regex"))
    return _row(a.withColumn("how", F.lit("starts_with")), "how").unionByName(_row(b.withColumn("how", F.lit("regex")), "how"))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE regexp_matches(raw_description, '(?i)card 1[0-4]$')"))
def flt_raw_pattern(spark: S, sf: str) -> D:
    return _row(ledger(spark, sf).filter(op.pattern_matches(F.col("raw_description"), "card 1[0-4]$", "regex")))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE NOT coalesce(tx_type IN {_NEVER}, FALSE)"))
def flt_uncounted(spark: S, sf: str) -> D:
    return _row(op.counted(ledger(spark, sf)))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE account_label = 'ACC-2' AND date >= DATE '{FROM}' AND NOT coalesce(human_validated, FALSE)"))
def flt_unchecked(spark: S, sf: str) -> D:
    return _row(op.unchecked(op.where(ledger(spark, sf), op.Filters(account_label="ACC-2", date_from=FROM)))).orderBy("date", "id")


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE transfer_pair_id IS NULL AND NOT coalesce(tx_type = 'card_tx', FALSE) AND date BETWEEN DATE '{FROM}' AND DATE '{TO}'"))
def flt_unpaired(spark: S, sf: str) -> D:
    return _row(op.unpaired(op.where(ledger(spark, sf), op.Filters(date_from=FROM, date_to=TO))))


@query(oracle(f"SELECT {_ROW}, tx_type FROM ledger WHERE tx_type IN ('internal_out', 'internal_in') AND transfer_pair_id IS NULL"))
def flt_one_sided(spark: S, sf: str) -> D:
    return _row(op.one_sided(ledger(spark, sf)), "tx_type")


@query(oracle("SELECT account_label, CAST(count(*) AS BIGINT) AS n FROM ledger WHERE to_review AND tx_type IN ('expense', 'income', 'card_tx', 'unknown') GROUP BY account_label"))
def flt_review(spark: S, sf: str) -> D:
    return op.review_queue(ledger(spark, sf)).groupBy("account_label").agg(F.count("*").alias("n"))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE lower(description) = 'blue rod brand 7' AND (category_source IS NULL OR category_source = 'llm')"))
def flt_similar_uncat(spark: S, sf: str) -> D:
    df = ledger(spark, sf).filter((exact_key("description") == exact_key(F.lit("Blue Rod, Brand-7"))) & (F.col("category_source").isNull() | (F.col("category_source") == "llm")))
    return _row(df).orderBy(F.col("date").desc(), "id")


@query(oracle("SELECT CASE WHEN amount > 0 AND NOT coalesce(category IN ('Income HOUSEHOLD', 'LARGE'), FALSE) THEN 'income' ELSE 'expense' END AS kind, CAST(sum(CASE WHEN amount > 0 AND NOT coalesce(category IN ('Income HOUSEHOLD', 'LARGE'), FALSE) THEN amount ELSE -amount END) AS DOUBLE) AS value FROM ledger GROUP BY 1"))
def flt_refund_split(spark: S, sf: str) -> D:
    return op.refund_split(ledger(spark, sf), ["Income HOUSEHOLD", "LARGE"]).groupBy("kind").agg(F.sum("value").cast("double").alias("value"))


@query(oracle("SELECT account_label, date_trunc('quarter', max(date))::DATE AS q_start, (date_trunc('quarter', max(date)) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS q_end, date_trunc('year', max(date))::DATE AS y_start, last_day(max(date)) AS m_end FROM ledger GROUP BY account_label"))
def flt_period_bounds(spark: S, sf: str) -> D:
    last = ledger(spark, sf).groupBy("account_label").agg(F.max("date").alias("last"))
    q, y, m = (dates.period_bounds(F.col("last"), p) for p in ("quarter", "year", "month"))
    return last.select("account_label", q[0].alias("q_start"), q[1].alias("q_end"), y[0].alias("y_start"), m[1].alias("m_end"))


@query(oracle("SELECT tx_type, CAST(count(*) AS BIGINT) AS n FROM ledger, (SELECT max(date) AS last FROM ledger) WHERE date BETWEEN (date_trunc('month', last) - INTERVAL 2 MONTH)::DATE AND last_day(last) GROUP BY tx_type"))
def flt_period(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    start, end = dates.reference_period(df.agg(F.max("date")).scalar())
    return df.filter(F.col("date").between(start, end)).groupBy("tx_type").agg(F.count("*").alias("n"))


@query(oracle("SELECT id, CASE WHEN lower(raw_description) LIKE '%transfer to%' THEN CASE WHEN amount < 0 THEN 'internal_out' ELSE 'internal_in' END WHEN doc_type IN ('credit_card', 'debit_card', 'prepaid_card') THEN 'card_tx' WHEN amount > 0 THEN 'income' ELSE 'expense' END AS inferred FROM ledger"))
def prj_tx_type(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return df.select("id", op.infer_type(df, ("TRANSFER TO",)).alias("inferred"))


@query(oracle("SELECT id, CASE WHEN batch_id % 2 = 0 THEN CAST(-amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS amount FROM ledger"))
def prj_invert(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", F.when(F.col("batch_id") % 2 == 0, -F.col("amount")).otherwise(F.col("amount")).cast("double").alias("amount"))


@query(oracle("SELECT id, CASE WHEN contains(lower(raw_description), lower(description)) THEN raw_description ELSE concat(raw_description, ' ', description) END || CASE WHEN context IS NULL THEN '' WHEN contains(lower(CASE WHEN contains(lower(raw_description), lower(description)) THEN raw_description ELSE concat(raw_description, ' ', description) END), lower(context)) THEN '' ELSE ' ' || context END AS text FROM ledger"))
def prj_desc_concat(spark: S, sf: str) -> D:
    parts = [F.col("raw_description"), F.lit("nan"), F.col("description"), F.lit("123e4567-e89b-12d3-a456-426614174000"), F.col("context")]
    return ledger(spark, sf).select("id", op.concat_descriptions(*parts).alias("text"))


_PAGE = f"SELECT {_ROW} FROM ledger ORDER BY date DESC, id LIMIT 50 OFFSET 100"


@query(oracle(_PAGE))
def srt_date_desc(spark: S, sf: str) -> D:
    return _row(op.page(ledger(spark, sf), 100, 50))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE account_label = 'ACC-1' ORDER BY date DESC, id LIMIT 25 OFFSET 25"))
def srt_page(spark: S, sf: str) -> D:
    return _row(op.page(op.where(ledger(spark, sf), op.Filters(account_label="ACC-1")), 25, 25))


@query(oracle("SELECT lower(description) AS key, CAST(count(*) AS BIGINT) AS n, CAST(sum(abs(amount)) AS DOUBLE) AS total FROM ledger GROUP BY 1 ORDER BY n DESC, total DESC, key LIMIT 20"))
def srt_multi(spark: S, sf: str) -> D:
    g = ledger(spark, sf).groupBy(exact_key("description").alias("key")).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("t"))
    return g.orderBy(F.desc("n"), F.desc("t"), "key").limit(20).select("key", "n", F.col("t").cast("double").alias("total"))


@query(oracle("SELECT category, CAST(sum(amount) AS DOUBLE) AS total FROM (SELECT category, amount FROM ledger WHERE tx_type = 'expense' UNION ALL SELECT category, -amount FROM ledger WHERE tx_type = 'card_tx') GROUP BY category"))
def set_union_all(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    a, b = df.filter("tx_type = 'expense'").select("category", "amount"), df.filter("tx_type = 'card_tx'").select("category", (-F.col("amount")).alias("amount"))
    return a.unionByName(b).groupBy("category").agg(F.sum("amount").cast("double").alias("total"))


@query(oracle("SELECT category FROM budget UNION SELECT category FROM ledger WHERE category IS NOT NULL", dims=("budget",)))
def set_union(spark: S, sf: str) -> D:
    from .common import dimension

    return dimension(spark, "budget").select("category").union(ledger(spark, sf).filter("category is not null").select("category")).distinct()


@query(oracle("SELECT description FROM ledger WHERE account_label = 'ACC-0' INTERSECT SELECT description FROM ledger WHERE account_label = 'ACC-1'"))
def set_intersect(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return df.filter("account_label = 'ACC-0'").select("description").intersect(df.filter("account_label = 'ACC-1'").select("description"))


@query(oracle("SELECT raw_description FROM ledger WHERE account_label = 'ACC-0' EXCEPT SELECT raw_description FROM ledger WHERE account_label = 'ACC-1'"))
def set_except(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return df.filter("account_label = 'ACC-0'").select("raw_description").subtract(df.filter("account_label = 'ACC-1'").select("raw_description"))


@query(oracle("SELECT description, min(struct_pack(d := date, i := id)).i AS first_id FROM ledger GROUP BY description"))
def set_dedup_order(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy("description").agg(F.min_by("id", F.struct("date", "id")).alias("first_id"))


@query(oracle(f"SELECT CAST(sum(CASE WHEN NOT coalesce(tx_type IN {_NEVER}, FALSE) THEN amount END) AS DOUBLE) AS net, CAST(sum(CASE WHEN amount > 0 AND NOT coalesce(tx_type IN {_NEVER}, FALSE) THEN amount END) AS DOUBLE) AS income, CAST(sum(CASE WHEN amount < 0 AND NOT coalesce(tx_type IN {_NEVER}, FALSE) THEN -amount END) AS DOUBLE) AS expense FROM ledger WHERE account_label = 'ACC-4'"))
def op_registry_totals(spark: S, sf: str) -> D:
    df = op.counted(op.where(ledger(spark, sf), op.Filters(account_label="ACC-4")))
    a = F.col("amount")
    return df.agg(F.sum("amount").cast("double").alias("net"), F.sum(F.when(a > 0, a)).cast("double").alias("income"), F.sum(F.when(a < 0, -a)).cast("double").alias("expense"))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE account_label = 'ACC-4' ORDER BY abs(amount) DESC, id LIMIT 40"))
def op_registry_sort(spark: S, sf: str) -> D:
    return _row(op.where(ledger(spark, sf), op.Filters(account_label="ACC-4")).orderBy(F.abs("amount").desc(), "id").limit(40))


@query(oracle(f"SELECT date, description, CAST(abs(amount) AS DOUBLE) AS spent FROM ledger WHERE tx_type IN ('expense', 'card_tx') AND amount < 0 AND date >= DATE '{FROM}'"))
def op_spending_since(spark: S, sf: str) -> D:
    return ledger(spark, sf).filter(F.col("tx_type").isin("expense", "card_tx") & (F.col("amount") < 0) & (F.col("date") >= FROM)).select("date", "description", F.abs("amount").cast("double").alias("spent"))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE account_label IN ('ACC-1', 'ACC-2') ORDER BY date DESC, id LIMIT 50000"))
def op_export_rows(spark: S, sf: str) -> D:
    """The account filter goes before the limit, so that an export is never short."""
    return _row(op.page(ledger(spark, sf).filter(F.col("account_label").isin("ACC-1", "ACC-2")), 0, 50_000))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE to_review AND category IS NULL ORDER BY date DESC, id LIMIT 500"))
def op_review_batches(spark: S, sf: str) -> D:
    return _row(op.page(ledger(spark, sf).filter("to_review and category is null"), 0, 500))


@query(oracle(f"SELECT {_ROW} FROM ledger WHERE lower(description) = 'salary building' AND date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND NOT coalesce(human_validated, FALSE) AND coalesce(category_source, '') NOT IN ('manual', 'rule')"))
def op_counterpart_movs(spark: S, sf: str) -> D:
    df = op.unchecked(op.where(ledger(spark, sf), op.Filters(date_from=FROM, date_to=TO)))
    undecided = ~F.coalesce("category_source", F.lit("")).isin("manual", "rule")
    return _row(df.filter((exact_key("description") == "salary building") & undecided)).orderBy("date", "id")


@query(oracle("SELECT id, CAST(count(*) OVER (PARTITION BY lower(description)) - 1 AS BIGINT) AS same_counterpart, CAST(count(*) OVER (PARTITION BY raw_description) - 1 AS BIGINT) AS same_text FROM ledger"))
def op_counts_desc(spark: S, sf: str) -> D:
    """How many other rows have the same counterpart, and the same bank text. Counted per key, then joined back."""
    df = ledger(spark, sf).select("id", exact_key("description").alias("key"), "raw_description")
    by_key = df.groupBy("key").agg((F.count("*") - 1).alias("same_counterpart"))
    by_text = df.groupBy("raw_description").agg((F.count("*") - 1).alias("same_text"))
    return df.join(by_key, "key").join(by_text, "raw_description").select("id", "same_counterpart", "same_text")


assert len(NEVER_COUNTED) == 4
