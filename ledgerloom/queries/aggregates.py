"""Queries: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..operators import aggregates as op
from ..operators import filters as flt
from ..storage import Workspace, broadcast_if_small
from .common import FROM, TO, derived, derived_oracle, dimension, ledger, oracle, query, table

S, D = SparkSession, DataFrame
_SCOPE = "tx_type NOT IN ('card_settlement', 'aggregate_debit', 'internal_out', 'internal_in')"
_PERIOD = f"date BETWEEN DATE '{FROM}' AND DATE '{TO}'"
_SUM = "CAST(sum(amount) AS DOUBLE)"
_ABS = "CAST(sum(abs(amount)) AS DOUBLE)"
_N = "CAST(count(*) AS BIGINT)"


def _period(spark: S, sf: str) -> D:
    return flt.where(ledger(spark, sf), flt.Filters(date_from=FROM, date_to=TO))


@query(oracle(f"SELECT coalesce(context, '—') AS context, coalesce(category, 'Altro') AS category, coalesce(subcategory, '') AS subcategory, {_SUM} AS total, {_N} AS n FROM ledger WHERE {_SCOPE} AND {_PERIOD} GROUP BY ALL"))
def agg_spending(spark: S, sf: str) -> D:
    return op.spending(_period(spark, sf))


@query(oracle(f"SELECT strftime(date, '%Y-%m') AS month, category, {_SUM} AS total FROM ledger WHERE {_SCOPE} GROUP BY ALL"))
def agg_monthly(spark: S, sf: str) -> D:
    return op.monthly(ledger(spark, sf), "category")


@query(oracle(f"SELECT CAST(sum(amount) FILTER (amount > 0) AS DOUBLE) AS income, CAST(-sum(amount) FILTER (amount < 0) AS DOUBLE) AS expense FROM ledger WHERE {_SCOPE} AND {_PERIOD}"))
def agg_period_totals(spark: S, sf: str) -> D:
    return op.period_totals(_period(spark, sf))


_BUDGET = f"""
x AS (SELECT coalesce(category, 'Altro') AS category, {_ABS} AS spent FROM ledger WHERE {_SCOPE} AND amount < 0 AND {_PERIOD} GROUP BY 1),
i AS (SELECT CAST(sum(amount) FILTER (amount > 0) AS DOUBLE) AS income, CAST(-sum(amount) FILTER (amount < 0) AS DOUBLE) AS expense FROM ledger WHERE {_SCOPE} AND {_PERIOD}),
r AS (SELECT coalesce(x.category, b.category) AS category, CAST(target_pct AS DOUBLE) AS target_pct, 100 * coalesce(spent, 0) / income AS actual_pct FROM x FULL JOIN budget b ON x.category = b.category, i
  UNION ALL SELECT '(liquidity)', 100 - (SELECT CAST(sum(target_pct) AS DOUBLE) FROM budget), 100 - 100 * expense / income FROM i)"""


@query(oracle("SELECT category, target_pct, round(actual_pct, 4) AS actual_pct, round(actual_pct - target_pct, 4) AS deviation, CASE WHEN target_pct IS NULL THEN 'none' WHEN abs(actual_pct - target_pct) <= 5 THEN 'green' WHEN abs(actual_pct - target_pct) <= 10 THEN 'yellow' ELSE 'red' END AS status FROM r", _BUDGET, ("budget",)))
def agg_budget(spark: S, sf: str) -> D:
    df = _period(spark, sf)
    totals = op.expense_by_category(df).join(F.broadcast(op.period_totals(df).select("income")), how="cross")
    return op.budget(totals, dimension(spark, "budget"))


query(oracle("SELECT category, target_pct, round(actual_pct, 4) AS actual_pct FROM r WHERE category <> '(liquidity)'", _BUDGET, ("budget",)), "jn_budget_full")(
    lambda spark, sf: agg_budget(spark, sf).filter("category <> '(liquidity)'").select("category", "target_pct", "actual_pct")
)

_COUNTERPART = f"""
k AS (SELECT lower(description) AS key, * FROM ledger),
b AS (SELECT key, {_N} AS n, {_ABS} AS total, {_ABS} / count(*) AS mean, CASE count(DISTINCT category_source) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single' ELSE 'mixed' END AS source_mode,
  CASE WHEN max(amount) < 0 THEN 'expense' WHEN min(amount) >= 0 THEN 'income' ELSE 'mixed' END AS direction, CAST(count(*) FILTER (category IS NULL) AS BIGINT) AS uncategorized,
  coalesce(bool_or(category_source IN ('manual', 'rule')), FALSE) AS by_user, 2 * count(*) FILTER (tx_type IN ('internal_out', 'internal_in')) > count(*) AS mostly_internal, CAST(count(*) FILTER (category_source = 'multi') AS BIGINT) AS n_multi FROM k GROUP BY key),
c AS (SELECT key, category, count(*) AS n FROM k WHERE category IS NOT NULL GROUP BY ALL),
t AS (SELECT key, category, n AS category_n, (SELECT count(*) FROM c c2 WHERE c2.key = c.key) AS categories FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, category) = 1),
s AS (SELECT k.key, k.subcategory FROM k JOIN t ON k.key = t.key AND k.category = t.category GROUP BY k.key, k.subcategory QUALIFY row_number() OVER (PARTITION BY k.key ORDER BY count(*) DESC, k.subcategory) = 1)"""


@query(oracle("SELECT b.*, t.category, CAST(category_n AS BIGINT) AS category_n, CAST(categories AS BIGINT) AS categories, s.subcategory FROM b LEFT JOIN t USING (key) LEFT JOIN s USING (key)", _COUNTERPART))
def agg_counterpart(spark: S, sf: str) -> D:
    return op.counterparts(ledger(spark, sf))


@query(oracle("SELECT key, n, total, mean, source_mode, direction FROM b WHERE source_mode = 'mixed' AND uncategorized > 0 AND direction = 'expense' ORDER BY total DESC, key LIMIT 30", _COUNTERPART))
def flt_counterparts(spark: S, sf: str) -> D:
    f = op.counterparts(ledger(spark, sf)).filter("source_mode = 'mixed' and uncategorized > 0 and direction = 'expense'")
    return f.orderBy(F.desc("total"), "key").limit(30).select("key", "n", "total", "mean", "source_mode", "direction")


@query(oracle("SELECT key, n, categories FROM (SELECT b.key, b.n, CAST(categories AS BIGINT) AS categories, by_user, n_multi FROM b JOIN t USING (key)) WHERE (categories > 1 AND NOT by_user) OR (categories > 1 AND n_multi > 0)", _COUNTERPART))
def op_mixed(spark: S, sf: str) -> D:
    return op.counterparts(ledger(spark, sf)).filter("categories > 1 and (not by_user or n_multi > 0)").select("key", "n", "categories")


@query(oracle(f"SELECT lower(description) AS key, CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction, coalesce(tx_type IN ('internal_out', 'internal_in'), FALSE) AS internal, {_N} AS n, {_ABS} AS total, max(struct_pack(d := date, i := id)).i AS latest FROM (SELECT * FROM ledger WHERE coalesce(category_source, '') <> 'multi' ORDER BY date DESC, id LIMIT 500) GROUP BY 1, 2, 3"))
def agg_groups(spark: S, sf: str) -> D:
    """Groups of the 500 newest rows: the cut is what the operator is for, and comes before grouping."""
    newest = flt.page(ledger(spark, sf).filter(F.coalesce("category_source", F.lit("")) != "multi"), 0, 500)
    g = newest.groupBy(exact_key("description").alias("key"), flt.direction(F.col("amount")).alias("direction"), F.coalesce(F.col("tx_type").isin("internal_out", "internal_in"), F.lit(False)).alias("internal"))
    return g.agg(F.count("*").alias("n"), F.sum(F.abs("amount")).cast("double").alias("total"), F.max_by("id", F.struct("date", "id")).alias("latest"))


_CHECK = "SELECT account_label, max(date) FILTER (coalesce(human_validated, FALSE)) AS last_checked, min(date) FILTER (NOT coalesce(human_validated, FALSE)) AS first_unchecked, CAST(count(*) FILTER (NOT coalesce(human_validated, FALSE)) AS BIGINT) AS n_unchecked FROM ledger GROUP BY account_label"


@query(oracle(_CHECK))
def agg_account_check(spark: S, sf: str) -> D:
    return op.account_check(ledger(spark, sf))


@query(oracle(f"SELECT account_label, first_unchecked, n_unchecked FROM ({_CHECK}) WHERE first_unchecked IS NOT NULL ORDER BY first_unchecked, n_unchecked DESC, account_label LIMIT 1"))
def agg_account_next(spark: S, sf: str) -> D:
    return op.account_check(ledger(spark, sf)).filter("first_unchecked is not null").orderBy("first_unchecked", F.desc("n_unchecked"), "account_label").limit(1).select("account_label", "first_unchecked", "n_unchecked")


@query(oracle(f"SELECT strftime(date, '%Y-%m') AS month, account_label, {_N} AS n FROM ledger GROUP BY ALL"))
def agg_month_counts(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "account_label").agg(F.count("*").alias("n"))


_ACCOUNTS = [f"ACC-{i}" for i in range(7)]


@query(oracle("SELECT strftime(m, '%Y-%m') AS month, " + ", ".join(f"""CAST(count(*) FILTER (account_label = '{a}') AS BIGINT) AS "{a}\"""" for a in _ACCOUNTS) + " FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM ledger) LEFT JOIN ledger ON date_trunc('month', date) = m GROUP BY m"))
def agg_month_pivot(spark: S, sf: str) -> D:
    return op.month_pivot(ledger(spark, sf), _ACCOUNTS)


@query(oracle(f"SELECT batch_id, min(date) AS first_day, max(date) AS last_day, {_N} AS n FROM ledger GROUP BY batch_id"))
def agg_dates(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy("batch_id").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n"))


@query(oracle("SELECT DISTINCT 'account' AS kind, account_label AS value FROM ledger UNION SELECT DISTINCT 'context', context FROM ledger WHERE context <> ''"))
def agg_distinct(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return df.select(F.lit("account").alias("kind"), F.col("account_label").alias("value")).union(df.filter("context <> ''").select(F.lit("context"), "context")).distinct()


_ASSOC = f"a AS (SELECT lower(description) AS key, category, subcategory, {_N} AS n FROM ledger WHERE (category_source IN ('manual', 'rule') OR coalesce(human_validated, FALSE)) AND category IS NOT NULL GROUP BY ALL)"
_PROFILES = f"""{_ASSOC}, bc AS (SELECT key, category, sum(n) AS n FROM a GROUP BY ALL), tot AS (SELECT key, sum(n) AS total, count(*) AS k FROM bc GROUP BY key),
h AS (SELECT key, total, k, -sum(n / total * log2(n / total)) AS h FROM bc JOIN tot USING (key) GROUP BY ALL),
tp AS (SELECT key, category, subcategory FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, category, subcategory) = 1),
p AS (SELECT key, category, subcategory, CAST(total AS BIGINT) AS n, CASE WHEN k <= 1 THEN 1.0 ELSE 1 - h / log2(k) END AS hom FROM h JOIN tp USING (key)),
profiles AS (SELECT key, category, subcategory, n, round(CAST(hom AS DOUBLE), 9) AS homogeneity, round(CAST(hom AS DOUBLE) * least(1.0, n / 5), 9) AS confidence FROM p)"""


@query(oracle("SELECT * FROM a", _ASSOC))
def agg_associations(spark: S, sf: str) -> D:
    return op.associations(ledger(spark, sf))


@query(oracle("SELECT * FROM profiles", _PROFILES))
def agg_profiles(spark: S, sf: str) -> D:
    return op.profiles(op.associations(ledger(spark, sf)))


@query(oracle("SELECT CAST(count(*) FILTER (confidence >= 0.9) AS BIGINT) AS auto, CAST(count(*) FILTER (confidence >= 0.5 AND confidence < 0.9) AS BIGINT) AS suggest, CAST(count(*) FILTER (confidence < 0.5) AS BIGINT) AS low FROM profiles", _PROFILES))
def agg_homog_buckets(spark: S, sf: str) -> D:
    c = F.col("confidence")
    return agg_profiles(spark, sf).agg(F.count_if(c >= 0.9).alias("auto"), F.count_if((c >= 0.5) & (c < 0.9)).alias("suggest"), F.count_if(c < 0.5).alias("low"))


@query(oracle("SELECT key, category, n, confidence FROM profiles WHERE confidence >= 0.5 AND n >= 3 ORDER BY n DESC, key LIMIT 50", _PROFILES))
def topk_history(spark: S, sf: str) -> D:
    return agg_profiles(spark, sf).filter("confidence >= 0.5 and n >= 3").orderBy(F.desc("n"), "key").limit(50).select("key", "category", "n", "confidence")


@query(oracle(f"SELECT lower(description) AS key, CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction, category, subcategory FROM ledger WHERE category IS NOT NULL AND category <> 'Altro' AND coalesce(category_source, '') <> 'manual' GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY lower(description), CASE WHEN amount < 0 THEN 'out' ELSE 'in' END ORDER BY count(*) FILTER (coalesce(human_validated, FALSE)) > 0 DESC, CASE WHEN count(*) FILTER (coalesce(human_validated, FALSE)) > 0 THEN count(*) FILTER (coalesce(human_validated, FALSE)) ELSE count(*) END DESC, category, subcategory) = 1"))
def agg_known_cat(spark: S, sf: str) -> D:
    """Modal category per counterpart and direction; checked rows alone decide where there are any."""
    df = ledger(spark, sf).filter((F.col("category") != "Altro") & (F.coalesce("category_source", F.lit("")) != "manual"))
    counts = df.groupBy(exact_key("description").alias("key"), flt.direction(F.col("amount")).alias("direction"), "category", "subcategory").agg(F.count("*").alias("n"), F.count_if(F.coalesce("human_validated", F.lit(False))).alias("c"))
    best = counts.groupBy("key", "direction").agg(F.min_by(F.struct("category", "subcategory"), F.struct(F.col("c") == 0, -F.when(F.col("c") > 0, F.col("c")).otherwise(F.col("n")), "category", "subcategory")).alias("b"))
    return best.select("key", "direction", "b.category", "b.subcategory")


@query(oracle("SELECT trim(regexp_replace(lower(raw_description), '\\S*[0-9]\\S*\\s*', '', 'g')) AS signature, min(struct_pack(c := created_at, i := id, d := description)).d AS description FROM ledger GROUP BY 1"))
def agg_known_sig(spark: S, sf: str) -> D:
    from ..functions.text import raw_signature

    df = ledger(spark, sf)
    return df.groupBy(raw_signature("raw_description").alias("signature")).agg(F.min_by("description", F.struct("created_at", "id")).alias("description"))


@query(oracle("SELECT lower(description) AS key, round(100.0 * max(n) / sum(n), 1) AS consistency FROM (SELECT lower(description) AS description, category, count(*) AS n FROM ledger WHERE category IS NOT NULL GROUP BY ALL) GROUP BY 1"))
def agg_consistency(spark: S, sf: str) -> D:
    m = op.modal(ledger(spark, sf).filter("category is not null").withColumn("key", exact_key("description")), ["key"], ["category"])
    return m.select("key", F.round(100 * F.col("n") / F.col("rows"), 1).alias("consistency"))


_CORRECTIONS = "corr AS (SELECT CASE batch_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'nsi' WHEN 2 THEN 'history' ELSE 'other' END AS old_source FROM ledger WHERE category_source = 'manual')"


@query(oracle("SELECT coalesce(s, old_source) AS source, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(corrected, 0) AS BIGINT) AS corrected, round(100.0 * coalesce(kept, 0) / (coalesce(kept, 0) + coalesce(corrected, 0)), 1) AS accuracy FROM (SELECT category_source AS s, count(*) AS kept FROM ledger WHERE category_source IN ('llm', 'nsi', 'history') GROUP BY 1) FULL JOIN (SELECT old_source, count(*) AS corrected FROM corr GROUP BY 1) ON s = old_source", _CORRECTIONS))
def agg_correction(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    old = F.element_at(F.array(F.lit("llm"), F.lit("nsi"), F.lit("history"), F.lit("other")), (F.col("batch_id") % 4 + 1).cast("int"))
    return op.correction_stats(df, df.filter("category_source = 'manual'").select(old.alias("old_source")))


_STATS = "SELECT {k}, metric, CAST(count(*) AS BIGINT) AS n, round(avg(v), 1) AS mean, round(stddev_pop(v), 1) AS std, round(list_sort(list(v))[count(*) // 2 + 1], 1) AS p50, round(CASE WHEN count(*) >= 20 THEN list_sort(list(v))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] ELSE max(v) END, 1) AS p95, round(CASE WHEN count(*) >= 100 THEN list_sort(list(v))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] ELSE max(v) END, 1) AS p99, round(avg(v) - 1.96 * stddev_pop(v) / sqrt(count(*)), 1) AS ci_low, round(avg(v) + 1.96 * stddev_pop(v) / sqrt(count(*)), 1) AS ci_high FROM {t} GROUP BY {k}, metric"


@query(f"WITH m AS (SELECT event_type, CAST(user_id % 3 AS BIGINT) AS model, unnest(['value', 'size']) AS metric, unnest([value, CAST(user_id AS DOUBLE)]) AS v FROM events) {_STATS.format(k='event_type, model', t='m')}")
def agg_tokens(spark: S, sf: str) -> D:
    df = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("model"), "value", F.col("user_id").cast("double").alias("size"))
    return op.order_statistics(df, ["event_type", "model"], ["value", "size"])


@query("SELECT CAST(greatest(2048, ceil(coalesce(max(u), 0) / 1024) * 1024) AS BIGINT) AS cap FROM (SELECT avg(value * 40) + 1.96 * stddev_pop(value * 40) / sqrt(count(*)) AS u FROM events GROUP BY event_type HAVING count(*) >= 1000)")
def agg_ctx_cap(spark: S, sf: str) -> D:
    v = F.col("value") * 40
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.avg(v) + 1.96 * F.stddev_pop(v) / F.sqrt(F.count("*"))).alias("u")).filter("n >= 1000")
    return g.agg(F.greatest(F.lit(2048), F.ceil(F.coalesce(F.max("u"), F.lit(0.0)) / 1024) * 1024).cast("long").alias("cap"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS calls, list_sort(list(value))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS median, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def agg_llm_observed(spark: S, sf: str) -> D:
    return op.nearest_rank(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", {"median": 0.5, "p95": 0.95})


@query(oracle("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT category) AS BIGINT) AS categories, CAST(count(DISTINCT (category, subcategory)) FILTER (category IS NOT NULL AND subcategory IS NOT NULL) AS BIGINT) AS pairs, CAST(count(*) FILTER (category IS NULL) AS BIGINT) AS without, CAST(count(*) FILTER (human_validated) AS BIGINT) AS validated, CAST(count(*) FILTER (category_source = 'llm') AS BIGINT) AS by_llm FROM ledger"))
def agg_categorization(spark: S, sf: str) -> D:
    c = F.col
    return ledger(spark, sf).agg(F.count("*").alias("n_rows"), F.count_distinct("category").alias("categories"), F.count_distinct("category", "subcategory").alias("pairs"), F.count_if(c("category").isNull()).alias("without"), F.count_if(c("human_validated")).alias("validated"), F.count_if(c("category_source") == "llm").alias("by_llm"))


@query("SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer")
def agg_counts(spark: S, sf: str) -> D:
    out = None
    for name in ("orders", "lineitem", "part", "customer"):
        one = table(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(oracle(f"SELECT coalesce(category, 'Altro') AS category, {_SUM} AS net, CAST(sum(amount) FILTER (amount > 0) AS DOUBLE) AS income, CAST(-sum(amount) FILTER (amount < 0) AS DOUBLE) AS expense FROM ledger WHERE NOT coalesce(tx_type IN ('internal_out', 'internal_in', 'card_settlement', 'aggregate_debit'), FALSE) GROUP BY 1"))
def agg_summary(spark: S, sf: str) -> D:
    a = F.col("amount")
    return flt.counted(ledger(spark, sf)).groupBy(F.coalesce("category", F.lit("Altro")).alias("category")).agg(F.sum(a).cast("double").alias("net"), F.sum(F.when(a > 0, a)).cast("double").alias("income"), F.sum(F.when(a < 0, -a)).cast("double").alias("expense"))


@query(oracle(f"SELECT {_N} AS n, CAST(sum(amount) FILTER (amount < 0) AS DOUBLE) AS total_out, CAST(sum(amount) FILTER (amount >= 0) AS DOUBLE) AS total_in FROM ledger WHERE tx_type IN ('internal_out', 'internal_in', 'card_settlement', 'aggregate_debit')"))
def agg_excluded(spark: S, sf: str) -> D:
    a = F.col("amount")
    return ledger(spark, sf).filter(F.col("tx_type").isin("internal_out", "internal_in", "card_settlement", "aggregate_debit")).agg(F.count("*").alias("n"), F.sum(F.when(a < 0, a)).cast("double").alias("total_out"), F.sum(F.when(a >= 0, a)).cast("double").alias("total_in"))


@query(oracle(f"SELECT strftime(date, '%Y-%m') AS month, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS kind, {_ABS} AS total FROM ledger GROUP BY ALL"))
def agg_monthly_sign(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month"), F.when(F.col("amount") > 0, "income").otherwise("expense").alias("kind")).agg(F.sum(F.abs("amount")).cast("double").alias("total"))


@query(oracle(f"SELECT direction, category, subcategory, total, round(100 * total / sum(total) OVER (PARTITION BY direction), 6) AS share FROM (SELECT CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction, category, subcategory, {_ABS} AS total FROM ledger GROUP BY ALL)"))
def agg_cat_dist(spark: S, sf: str) -> D:
    return op.distribution(ledger(spark, sf), ["category", "subcategory"])


@query(oracle(f"SELECT subcategory, strftime(date, '%Y-%m') AS month, {_ABS} AS total FROM ledger WHERE category = 'PROMO' GROUP BY ALL"))
def agg_drill(spark: S, sf: str) -> D:
    return ledger(spark, sf).filter("category = 'PROMO'").groupBy("subcategory", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.abs("amount")).cast("double").alias("total"))


@query(oracle(f"SELECT context, strftime(date, '%Y-%m') AS month, {_ABS} AS total, {_N} AS n FROM ledger WHERE context IS NOT NULL GROUP BY ALL"))
def agg_context(spark: S, sf: str) -> D:
    return ledger(spark, sf).filter("context is not null").groupBy("context", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.abs("amount")).cast("double").alias("total"), F.count("*").alias("n"))


@query(oracle(f"SELECT b.category, round(100 * b / tb, 4) AS expected, round(100 * coalesce(spent, 0) / t, 4) AS actual, CASE WHEN coalesce(spent, 0) = 0 THEN 'absent' WHEN (coalesce(spent, 0) / t) / (b / tb) > 1.5 THEN 'high' WHEN (coalesce(spent, 0) / t) / (b / tb) < 0.5 THEN 'low' ELSE 'normal' END AS level FROM b, (SELECT sum(b) AS tb FROM b), (SELECT sum(spent) AS t FROM x) LEFT JOIN x ON b.category = x.category", f"b AS (SELECT category, CAST(share AS DOUBLE) * CASE WHEN per_capita THEN 1.5 ELSE 1 END AS b FROM benchmark_shares), x AS (SELECT coalesce(category, 'Altro') AS category, {_ABS} AS spent FROM ledger WHERE {_SCOPE} AND amount < 0 GROUP BY 1)", ("benchmark_shares",)))
def agg_anomaly(spark: S, sf: str) -> D:
    return op.anomaly(ledger(spark, sf), dimension(spark, "benchmark_shares"), household=3)


@query(oracle(f"SELECT strftime(date, '%Y-%m') AS month, account_label, {_ABS} AS total FROM ledger GROUP BY ALL"))
def agg_account_month(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "account_label").agg(F.sum(F.abs("amount")).cast("double").alias("total"))


_ROLL = """g AS (SELECT coalesce(context, '—') AS context, coalesce(category, 'Altro') AS category, coalesce(subcategory, '') AS subcategory, sum(amount) AS t FROM ledger GROUP BY ALL),
s AS (SELECT *, CASE WHEN t < 0 THEN 'out' ELSE 'in' END AS sign FROM g WHERE t <> 0), l AS (SELECT sign, context, category, subcategory, CAST(sum(t) AS DOUBLE) AS total FROM s GROUP BY GROUPING SETS ((sign, context, category, subcategory), (sign, context), (sign)))"""


@query(oracle("SELECT l.*, round(100 * abs(total) / g.grand, 6) AS pct FROM l JOIN (SELECT sign, abs(CAST(sum(t) AS DOUBLE)) AS grand FROM s GROUP BY sign) g USING (sign)", _ROLL))
def agg_report_rollup(spark: S, sf: str) -> D:
    return op.rollup_report(ledger(spark, sf))


_FLOW = """c AS (SELECT strftime(date, '%Y-%m') AS month, coalesce(category, 'Altro') AS category, greatest(-sum(amount), 0) AS v FROM ledger GROUP BY ALL),
t AS (SELECT category AS top FROM c GROUP BY 1 HAVING sum(v) > 0 ORDER BY sum(v) DESC, category LIMIT 4)"""


@query(oracle("SELECT month, coalesce(top, 'other') AS category, CAST(sum(v) AS DOUBLE) AS value FROM c LEFT JOIN t ON category = top GROUP BY ALL HAVING sum(v) > 0", _FLOW))
def agg_flow(spark: S, sf: str) -> D:
    return op.flow(ledger(spark, sf), top=4)


_SANKEY = """c AS (SELECT coalesce(category, 'Altro') AS category, sum(amount) AS t FROM ledger WHERE amount < 100000 GROUP BY 1), s AS (SELECT coalesce(category, 'Altro') AS category, subcategory, sum(amount) AS t FROM ledger WHERE amount < 100000 AND subcategory <> '' GROUP BY ALL)"""


@query(oracle("SELECT 'in:' || category AS source, 'total' AS target, CAST(t AS DOUBLE) AS value FROM c WHERE t > 0 UNION ALL SELECT 'total', 'out:' || category, CAST(-t AS DOUBLE) FROM c WHERE t < 0 UNION ALL SELECT 'out:' || category, category || '/' || subcategory, CAST(-t AS DOUBLE) FROM s WHERE t < 0 AND category IN (SELECT category FROM c WHERE t < 0) UNION ALL SELECT CASE WHEN sum(t) > 0 THEN 'total' ELSE 'deficit' END, CASE WHEN sum(t) > 0 THEN 'surplus' ELSE 'total' END, CAST(abs(sum(t)) AS DOUBLE) FROM c", _SANKEY))
def agg_sankey(spark: S, sf: str) -> D:
    return op.sankey(ledger(spark, sf).filter("amount < 100000"))


@query(oracle(f"SELECT {_N} AS n, {_ABS} AS total FROM ledger WHERE category_source = 'rule' AND amount < 0"))
def agg_rule_spend(spark: S, sf: str) -> D:
    return ledger(spark, sf).filter("category_source = 'rule' and amount < 0").agg(F.count("*").alias("n"), F.sum(F.abs("amount")).cast("double").alias("total"))


_JOBS = "jobs AS (SELECT batch_id AS job, count(*) AS n, CAST(count(*) * 3 + batch_id AS DOUBLE) AS seconds, CAST(sum(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM ledger GROUP BY batch_id)"


def _jobs(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy(F.col("batch_id").alias("job")).agg(F.count("*").alias("n"), F.count_if(F.col("category").isNull()).alias("unknown")).withColumn("seconds", (F.col("n") * 3 + F.col("job")).cast("double"))


@query(oracle("SELECT round(sum(seconds) / sum(n), 6) AS rate FROM (SELECT * FROM jobs ORDER BY job DESC LIMIT 10)", _JOBS))
def agg_import_rate(spark: S, sf: str) -> D:
    return _jobs(spark, sf).orderBy(F.desc("job")).limit(10).agg(F.round(F.sum("seconds") / F.sum("n"), 6).alias("rate"))


@query(oracle("SELECT CAST(count(*) AS BIGINT) AS jobs, CAST(sum(n) AS BIGINT) AS n_rows, round(1000 * sum(seconds) / sum(n), 3) AS ms_per_row, CAST(max(job) AS BIGINT) AS last_job FROM (SELECT * FROM jobs ORDER BY job DESC LIMIT 20)", _JOBS))
def agg_import_perf(spark: S, sf: str) -> D:
    return _jobs(spark, sf).orderBy(F.desc("job")).limit(20).agg(F.count("*").alias("jobs"), F.sum("n").alias("n_rows"), F.round(1000 * F.sum("seconds") / F.sum("n"), 3).alias("ms_per_row"), F.max("job").alias("last_job"))


@query(oracle("SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(unknown) AS BIGINT) AS unknown, CAST(sum(n - unknown) AS BIGINT) AS known FROM (SELECT * FROM jobs ORDER BY job DESC LIMIT 20)", _JOBS))
def agg_seal(spark: S, sf: str) -> D:
    return _jobs(spark, sf).orderBy(F.desc("job")).limit(20).agg(F.sum("n").alias("n_rows"), F.sum("unknown").alias("unknown"), F.sum(F.col("n") - F.col("unknown")).alias("known"))


@query(oracle("SELECT job, n FROM jobs ORDER BY job DESC LIMIT 5", _JOBS))
def topk_jobs(spark: S, sf: str) -> D:
    return _jobs(spark, sf).orderBy(F.desc("job")).limit(5).select("job", "n")


@query("SELECT split_part(upper(p_name), ' ', 1) AS prefix, CAST(count(DISTINCT split_part(upper(p_name), ' ', 2)) AS BIGINT) AS names FROM part WHERE length(split_part(p_name, ' ', 2)) >= 4 GROUP BY 1 HAVING count(DISTINCT split_part(upper(p_name), ' ', 2)) >= 2")
def agg_intermed_learn(spark: S, sf: str) -> D:
    from ..operators.intermediaries import learn

    raw = table(spark, sf, "part").select(F.concat(F.split("p_name", " ")[0], F.lit(" *"), F.split("p_name", " ")[1], F.lit(" 1234")).alias("raw"))
    return learn(raw, "raw").select("prefix", "names")


@query(oracle(f"SELECT lower(description) AS key, category, subcategory, CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction, {_N} AS n FROM ledger WHERE category_source = 'manual' AND category IS NOT NULL AND lower(description) NOT IN (SELECT lower(description) FROM declined) AND lower(description) NOT IN (SELECT lower(pattern) FROM rules WHERE match_type = 'exact') GROUP BY ALL HAVING count(*) >= 3", dims=("declined", "rules")))
def agg_always(spark: S, sf: str) -> D:
    """Hand choices that repeat and have no rule yet."""
    df = ledger(spark, sf).filter("category_source = 'manual' and category is not null")
    g = df.groupBy(exact_key("description").alias("key"), "category", "subcategory", flt.direction(F.col("amount")).alias("direction")).agg(F.count("*").alias("n")).filter("n >= 3")
    no = dimension(spark, "declined").select(exact_key("description").alias("key")).union(dimension(spark, "rules").filter("match_type = 'exact'").select(exact_key("pattern").alias("key")))
    return g.join(F.broadcast(no), "key", "left_anti")


@query(oracle("SELECT source_file, first(id ORDER BY id) AS balance_id FROM (SELECT *, sum(amount) OVER (PARTITION BY source_file) AS t, count(*) OVER (PARTITION BY source_file) AS n FROM ledger) WHERE n >= 3 AND abs(abs(amount) - abs(t - amount)) <= 0.01 GROUP BY source_file"))
def agg_balance_row(spark: S, sf: str) -> D:
    """First row of a file whose amount is the sum of all others. Sums per file are grouped, then joined back."""
    df = ledger(spark, sf).select("source_file", "id", "amount")
    sums = df.groupBy("source_file").agg(F.sum("amount").alias("t"), F.count("*").alias("n")).filter("n >= 3")
    sums = broadcast_if_small(Workspace(spark, "balance-row").save(sums, "sums"))  # a row per file
    hit = df.join(sums, "source_file").filter("abs(abs(amount) - abs(t - amount)) <= 0.01")
    return hit.groupBy("source_file").agg(F.min("id").alias("balance_id"))


@query(oracle(f"SELECT substr(sha256(concat_ws('|', account_label, CAST(date AS VARCHAR), CAST(sum(amount) AS VARCHAR), raw_description)), 1, 24) AS id, account_label, date, raw_description, {_SUM} AS amount, {_N} AS copies FROM ledger GROUP BY account_label, date, raw_description, abs(amount), amount"))
def agg_merge_dups(spark: S, sf: str) -> D:
    """Identical rows become one whose amount is their sum and whose identifier is that of the sum."""
    from ..functions.amounts import transaction_id

    g = ledger(spark, sf).groupBy("account_label", "date", "raw_description", "amount").agg(F.sum("amount").alias("total"), F.count("*").alias("copies"))
    new_id = transaction_id(F.col("account_label"), F.lit(None).cast("string"), F.col("date").cast("string"), F.col("total").cast("string"), F.col("raw_description"))
    return g.select(new_id.alias("id"), "account_label", "date", "raw_description", F.col("total").cast("double").alias("amount"), "copies")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.95), 6) AS p95, round(100 * stddev_samp(value) / avg(value), 4) AS cv FROM events GROUP BY event_type")
def agg_bench_stats(spark: S, sf: str) -> D:
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(100 * F.stddev_samp(v) / F.avg(v), 4).alias("cv"))


@query("SELECT event_type, CAST(user_id % 5 AS BIGINT) AS config, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std FROM events GROUP BY ALL")
def agg_bench_median(spark: S, sf: str) -> D:
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("config")).agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.round(F.stddev_samp(v), 4).alias("std"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem")
def agg_ols(spark: S, sf: str) -> D:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 9).alias("r2"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT CAST(user_id % 7 AS BIGINT) AS model, " + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {k}" for k in _KINDS) + " FROM events GROUP BY 1")
def agg_matrix(spark: S, sf: str) -> D:
    g = table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("model")).pivot("event_type", list(_KINDS)).agg(F.round(F.avg("value"), 6))
    return g


@query("SELECT event_type, CAST(user_id AS BIGINT) AS best_user, round(avg(value), 6) AS mean FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(avg(value), 6) DESC, user_id) = 1")
def agg_best(spark: S, sf: str) -> D:
    g = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    best = g.groupBy("event_type").agg(F.max_by(F.struct("user_id", "mean"), F.struct("mean", -F.col("user_id"))).alias("b"))
    return best.select("event_type", F.col("b.user_id").alias("best_user"), "b.mean")


@query("SELECT event_type, round(avg(value) * 1000, 3) AS mean_ms, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY event_type")
def agg_latency(spark: S, sf: str) -> D:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value") * 1000, 3).alias("mean_ms"), F.count("*").alias("calls"), F.sum(k).alias("tokens"))


@query(oracle("SELECT year, month, category, total, total > 1000000 AS over_limit FROM m QUALIFY row_number() OVER (PARTITION BY category ORDER BY year DESC, month DESC) = 1", f"m AS (SELECT CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, category, {_ABS} AS total FROM ledger WHERE amount < 0 GROUP BY 1, 2, 3)"))
def agg_monthly_legacy(spark: S, sf: str) -> D:
    """Latest month of each category against a limit."""
    g = ledger(spark, sf).filter("amount < 0").groupBy(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"), "category").agg(F.sum(F.abs("amount")).cast("double").alias("total"))
    latest = g.groupBy("category").agg(F.max_by(F.struct("year", "month", "total"), F.struct("year", "month")).alias("m"))
    return latest.select("m.year", "m.month", "category", "m.total", (F.col("m.total") > 1_000_000).alias("over_limit"))


@query(derived_oracle("SELECT country, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(countries, ',')) AS country FROM supplier_brands) GROUP BY 1 ORDER BY n DESC, country LIMIT 10", "supplier_brands"))
def agg_nsi_stats(spark: S, sf: str) -> D:
    return derived(spark, sf, "supplier_brands").select(F.explode(F.split("countries", ",")).alias("country")).groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10)


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_type, max(struct_pack(t := ts, e := event_id)).e AS event_id FROM events GROUP BY ALL")
def agg_compat(spark: S, sf: str) -> D:
    """Latest report per configuration."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_TOP = f"SELECT lower(description) AS key, {_ABS} AS total FROM ledger WHERE amount < 0 GROUP BY 1 ORDER BY total DESC, key LIMIT 10"


@query(oracle("SELECT t.key, total, mode_c AS category FROM t JOIN (SELECT lower(description) AS key, category AS mode_c FROM ledger WHERE amount < 0 AND category IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lower(description) ORDER BY count(*) DESC, category) = 1) USING (key)", f"t AS ({_TOP})"))
def topk_merchants(spark: S, sf: str) -> D:
    df = ledger(spark, sf).filter("amount < 0").withColumn("key", exact_key("description"))
    top = df.groupBy("key").agg(F.sum(F.abs("amount")).cast("double").alias("total")).orderBy(F.desc("total"), "key").limit(10)
    mode = op.modal(df.filter("category is not null").join(F.broadcast(top.select("key")), "key", "left_semi"), ["key"], ["category"])
    return top.join(mode.select("key", "category"), "key")


@query(oracle(f"SELECT category, strftime(date, '%Y-%m') AS month, {_ABS} AS total FROM ledger WHERE amount < 0 AND category IN (SELECT category FROM ledger WHERE amount < 0 AND category IS NOT NULL GROUP BY 1 ORDER BY sum(abs(amount)) DESC, category LIMIT 3) GROUP BY ALL"))
def topk_categories(spark: S, sf: str) -> D:
    df = ledger(spark, sf).filter("amount < 0 and category is not null")
    top = df.groupBy("category").agg(F.sum(F.abs("amount")).alias("t")).orderBy(F.desc("t"), "category").limit(3).select("category")
    return df.join(F.broadcast(top), "category", "left_semi").groupBy("category", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.abs("amount")).cast("double").alias("total"))


@query(oracle("SELECT category, CASE WHEN bool_or(amount < 0) AND bool_or(amount >= 0) THEN 'both' WHEN bool_or(amount < 0) THEN 'out' ELSE 'in' END AS direction FROM ledger WHERE category IS NOT NULL GROUP BY category"))
def op_category_direction(spark: S, sf: str) -> D:
    a = F.col("amount")
    return ledger(spark, sf).filter("category is not null").groupBy("category").agg(F.when(F.bool_or(a < 0) & F.bool_or(a >= 0), "both").when(F.bool_or(a < 0), "out").otherwise("in").alias("direction"))


@query(oracle("SELECT account_label, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source_file) AS BIGINT) AS files, max(date) AS last_day, bool_or(c.closed_on IS NOT NULL) AS closed FROM ledger LEFT JOIN closed_accounts c USING (account_label) GROUP BY account_label", dims=("closed_accounts",)))
def op_accounts(spark: S, sf: str) -> D:
    g = ledger(spark, sf).groupBy("account_label").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"), F.max("date").alias("last_day"))
    return g.join(F.broadcast(dimension(spark, "closed_accounts")), "account_label", "left").select("account_label", "n", "files", "last_day", F.col("closed_on").isNotNull().alias("closed"))


@query(derived_oracle("SELECT direction, category, list(subcategory ORDER BY sort_order) AS subcategories FROM part_taxonomy GROUP BY ALL", "part_taxonomy"))
def op_taxonomy_cfg(spark: S, sf: str) -> D:
    g = derived(spark, sf, "part_taxonomy").groupBy("direction", "category").agg(F.array_sort(F.collect_list(F.struct("sort_order", "subcategory"))).alias("s"))
    return g.select("direction", "category", F.transform("s", lambda x: x["subcategory"]).alias("subcategories"))


@query(derived_oracle("SELECT direction, category, subcategory FROM part_taxonomy WHERE is_fallback QUALIFY row_number() OVER (PARTITION BY direction ORDER BY sort_order DESC) = 1", "part_taxonomy"))
def op_fallbacks(spark: S, sf: str) -> D:
    return op.fallbacks(derived(spark, sf, "part_taxonomy"))


query("SELECT 'events' AS name, CAST(count(*) AS BIGINT) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders", "op_db_info")(
    lambda spark, sf: table(spark, sf, "events").agg(F.count("*").alias("n")).select(F.lit("events").alias("name"), "n").unionByName(table(spark, sf, "orders").agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n"))
)
