"""Aggregations over the ledger. All are grouped aggregates that combine before the shuffle; shares come from windows over group results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..storage import Workspace
from ..types import ALWAYS_DROPPED, AUTOMATIC_SOURCES, INTERNAL, NO_CATEGORY, NO_CONTEXT, NO_SUBCATEGORY, USER_SOURCES
from .filters import direction


def absolute() -> Column:
    return F.abs("amount")


def double(c: Column) -> Column:
    return c.cast("double")


def in_scope(df: DataFrame, exclude_internal: bool = True) -> DataFrame:
    """Rows that aggregations see; rows without a type are left out, as SQL's NOT IN leaves them out."""
    return df.filter(~F.col("tx_type").isin(*ALWAYS_DROPPED, *(INTERNAL if exclude_internal else ())))


def spending(df: DataFrame, exclude_internal: bool = True) -> DataFrame:
    """Sum and count by context, category, subcategory, with labels for missing values."""
    keys = [F.coalesce(c, F.lit(d)).alias(c) for c, d in (("context", NO_CONTEXT), ("category", NO_CATEGORY), ("subcategory", NO_SUBCATEGORY))]
    return in_scope(df, exclude_internal).groupBy(*keys).agg(double(F.sum("amount")).alias("total"), F.count("*").alias("n"))


def monthly(df: DataFrame, *keys: str, exclude_internal: bool = True) -> DataFrame:
    return in_scope(df, exclude_internal).groupBy(F.date_format("date", "yyyy-MM").alias("month"), *keys).agg(double(F.sum("amount")).alias("total"))


def period_totals(df: DataFrame) -> DataFrame:
    """Income and expense of a period."""
    a = F.col("amount")
    return in_scope(df).agg(double(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0))).alias("income"), double(F.coalesce(F.sum(F.when(a < 0, -a)), F.lit(0))).alias("expense"))


def expense_by_category(df: DataFrame) -> DataFrame:
    return in_scope(df).filter("amount < 0").groupBy(F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(double(F.sum(absolute())).alias("spent"))


def share(value: Column, *by: str) -> Column:
    """Percent of the group's total, over the few rows of a grouped result."""
    return 100 * value / F.sum(value).over(Window.partitionBy(*by))


def distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute sums by direction and keys, with each one's share of its direction."""
    g = df.groupBy(direction(F.col("amount")).alias("direction"), *keys).agg(double(F.sum(absolute())).alias("total"))
    return g.withColumn("share", F.round(share(F.col("total"), "direction"), 6))


def budget(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual against target percent by category; the last row is liquidity.

    Status: green within 5 points, yellow within 10, red beyond, none without a target.
    """
    spent, all_spent, income = F.col("spent"), F.col("all_spent"), F.col("income")
    rows = totals.select("category", "spent").join(targets.withColumnRenamed("category", "t_category"), F.col("category") == F.col("t_category"), "full")
    sums = totals.agg(F.sum("spent").alias("all_spent"), F.max("income").alias("income"))
    rows = rows.select(F.coalesce("category", "t_category").alias("category"), F.coalesce("spent", F.lit(0.0)).alias("spent"), F.col("target_pct").cast("double").alias("target_pct")).join(F.broadcast(sums), how="cross")
    rows = rows.select("category", "target_pct", F.when(income > 0, 100 * spent / income).otherwise(0.0).alias("actual_pct"))
    rest = sums.join(F.broadcast(targets.agg(F.sum(F.col("target_pct").cast("double")).alias("targets"))), how="cross")
    rest = rest.select(F.lit("(liquidity)").alias("category"), (100 - F.col("targets")).alias("target_pct"), F.when(income > 0, 100 - 100 * all_spent / income).otherwise(100.0).alias("actual_pct"))
    deviation = F.col("actual_pct") - F.col("target_pct")
    status = F.when(deviation.isNull(), "none").when(F.abs(deviation) <= 5, "green").when(F.abs(deviation) <= 10, "yellow").otherwise("red")
    return rows.unionByName(rest).select("category", "target_pct", F.round("actual_pct", 4).alias("actual_pct"), F.round(deviation, 4).alias("deviation"), status.alias("status"))


def modal(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: Column | None = None, count: Column | None = None) -> DataFrame:
    """Most frequent values per key (then the largest weight, then the smallest values), with its count: two grouped aggregates.

    count: how many rows a row of df stands for, one if not given.
    """
    counts = df.groupBy(*keys, *values).agg((F.count("*") if count is None else F.sum(count)).alias("n"), F.sum(F.lit(0) if weight is None else weight).alias("w"))
    order = F.struct(-F.col("n"), -F.col("w"), *values)
    best = counts.groupBy(*keys).agg(F.min_by(F.struct("n", *values), order).alias("m"), F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    return best.select(*keys, *[F.col(f"m.{v}").alias(v) for v in values], F.col("m.n").alias("n"), "rows", "kinds")


def counterparts(df: DataFrame) -> DataFrame:
    """Per counterpart: counts, totals, modal category and subcategory, how it was categorised, its direction.

    Rows are counted by what they say first, on a written table, so df is read once and only distinct texts get a key.
    """
    a, n = F.col("amount"), F.sum("rows")
    counted = df.groupBy("description", "category", "subcategory", "category_source").agg(
        F.count("*").alias("rows"), F.sum(absolute()).alias("total"), F.count_if(a < 0).alias("spent"), F.count_if(a >= 0).alias("earned"), F.count_if(F.col("tx_type").isin(*INTERNAL)).alias("internal"),
    )
    keyed = Workspace(df.sparkSession, "counterparts").save(counted.withColumn("key", exact_key("description")).filter("key <> ''"), "counted")
    kinds = F.collect_set("category_source")
    rows_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("rows"))), F.lit(0))
    base = keyed.groupBy("key").agg(
        n.alias("n"), double(F.sum("total")).alias("total"), (double(F.sum("total")) / n).alias("mean"),
        F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) == 1, "single").otherwise("mixed").alias("source_mode"),
        F.when(F.sum("spent") == n, "expense").when(F.sum("earned") == n, "income").otherwise("mixed").alias("direction"),
        rows_if(F.col("category").isNull()).alias("uncategorized"), F.coalesce(F.bool_or(F.col("category_source").isin(*USER_SOURCES)), F.lit(False)).alias("by_user"),
        (2 * F.sum("internal") > n).alias("mostly_internal"), rows_if(F.col("category_source") == "multi").alias("n_multi"),
    )
    known = keyed.filter("category is not null")
    top = modal(known, ["key"], ["category"], count=F.col("rows")).select("key", "category", F.col("n").alias("category_n"), F.col("kinds").alias("categories"))
    inside = known.join(top.select("key", "category"), ["key", "category"])
    sub = modal(inside, ["key"], ["subcategory"], count=F.col("rows")).select("key", "subcategory")
    return base.join(top, "key", "left").join(sub, "key", "left")


def associations(df: DataFrame) -> DataFrame:
    """Decisions of the user by counterpart, category, subcategory."""
    decided = df.filter((F.col("category_source").isin(*USER_SOURCES) | F.coalesce("human_validated", F.lit(False))) & F.col("category").isNotNull())
    return decided.groupBy(exact_key("description").alias("key"), "category", "subcategory").agg(F.count("*").alias("n")).filter("key <> ''")


def profiles(assoc: DataFrame) -> DataFrame:
    """Per counterpart: top category, homogeneity (1 less normalised entropy), confidence (homogeneity times min(1, n/5))."""
    by_cat = assoc.groupBy("key", "category").agg(F.sum("n").alias("n"))
    top = assoc.groupBy("key").agg(F.min_by(F.struct("category", "subcategory"), F.struct(-F.col("n"), "category", "subcategory")).alias("top"))
    total = by_cat.groupBy("key").agg(F.sum("n").alias("rows"), F.count("*").alias("k"))
    p = F.col("n") / F.col("rows")
    entropy = by_cat.join(total, "key").groupBy("key", "rows", "k").agg((-F.sum(p * F.log2(p))).alias("h"))
    homogeneity = F.when(F.col("k") <= 1, 1.0).otherwise(1 - F.col("h") / F.log2("k"))
    out = entropy.join(top, "key").select("key", "top.category", "top.subcategory", F.col("rows").alias("n"), homogeneity.alias("homogeneity"))
    return out.withColumn("confidence", F.round(F.col("homogeneity") * F.least(F.lit(1.0), F.col("n") / 5), 9)).withColumn("homogeneity", F.round("homogeneity", 9))


def order_statistics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per key and metric: n, mean, population deviation, the value at n//2, at int(.95 n) from 20 values on, at int(.99 n)
    from 100 on (the maximum before), a 95 % interval of the mean. Values are ranked with a window, not collected."""
    long = df.select(*keys, F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metric", "v")).filter("v is not null")
    w = Window.partitionBy(*keys, "metric")
    ranked = long.withColumn("i", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("v")))
    g = ranked.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), at(F.expr("n div 2")).alias("p50"), F.max("v").alias("top"),
        at(F.floor(F.col("n") * 0.95)).alias("q95"), at(F.floor(F.col("n") * 0.99)).alias("q99"),
    )
    half = 1.96 * F.col("s") / F.sqrt("n")
    r = lambda c: F.round(c, 1)
    return g.select(
        *keys, "metric", "n", r(F.col("m")).alias("mean"), r(F.col("s")).alias("std"), r(F.col("p50")).alias("p50"), r(F.when(F.col("n") >= 20, F.col("q95")).otherwise(F.col("top"))).alias("p95"),
        r(F.when(F.col("n") >= 100, F.col("q99")).otherwise(F.col("top"))).alias("p99"), r(F.col("m") - half).alias("ci_low"), r(F.col("m") + half).alias("ci_high"),
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key: calls and, for each named share, the value at index round(share * (n - 1)), half to even."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    at = lambda f: F.max(F.when(F.col("i") == F.bround(F.lit(f) * (F.col("n") - 1), 0), F.col(value)))
    return ranked.groupBy(*keys).agg(F.count("*").alias("calls"), *[at(f).alias(name) for name, f in shares.items()])


def account_check(df: DataFrame) -> DataFrame:
    """Per account: last checked day, first unchecked day, number of unchecked rows. A missing flag is unchecked."""
    done = F.coalesce("human_validated", F.lit(False))
    return df.groupBy("account_label").agg(F.max(F.when(done, F.col("date"))).alias("last_checked"), F.min(F.when(~done, F.col("date"))).alias("first_unchecked"), F.count_if(~done).alias("n_unchecked"))


def month_pivot(df: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """Months by accounts, zero-filled over the whole range of months. ``accounts`` names the columns."""
    month = F.trunc("date", "month")
    span = df.agg(F.min(month).alias("a"), F.max(month).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    counts = df.groupBy(month.alias("c_m")).agg(*[F.count_if(F.col("account_label") == a).alias(a) for a in accounts])
    return span.join(counts, F.col("m") == F.col("c_m"), "left").select(F.date_format("m", "yyyy-MM").alias("month"), *[F.coalesce(F.col(f"`{a}`"), F.lit(0)).alias(a) for a in accounts])


def rollup_report(df: DataFrame) -> DataFrame:
    """Totals by context, category, subcategory with subtotals by context and the grand total, split by the sign of each group's
    total; percent of the sign's grand total."""
    g = df.groupBy(F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"), F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory")).agg(F.sum("amount").alias("t"))
    signed = g.filter("t <> 0").withColumn("sign", F.when(F.col("t") < 0, "out").otherwise("in"))
    levels = signed.groupingSets([["sign", "context", "category", "subcategory"], ["sign", "context"], ["sign"]], "sign", "context", "category", "subcategory").agg(F.sum("t").alias("t"), F.grouping_id().alias("level"))
    grand = F.max(F.when(F.col("level") == 7, F.abs("t"))).over(Window.partitionBy("sign"))
    return levels.select("sign", "context", "category", "subcategory", double(F.col("t")).alias("total"), F.round(100 * double(F.abs("t")) / double(grand), 6).alias("pct"))


def flow(df: DataFrame, top: int = 8, other: str = "other") -> DataFrame:
    """Month by category: the ``top`` categories by their clipped totals, the rest as ``other``. Negative cells count as 0."""
    cells = df.groupBy(F.date_format("date", "yyyy-MM").alias("month"), F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(F.greatest(-F.sum("amount"), F.lit(0)).alias("v"))
    best = cells.groupBy("category").agg(F.sum("v").alias("t")).filter("t > 0").orderBy(F.desc("t"), "category").limit(top).select(F.col("category").alias("top_category"))
    named = cells.join(F.broadcast(best), F.col("category") == F.col("top_category"), "left")
    return named.groupBy("month", F.coalesce("top_category", F.lit(other)).alias("category")).agg(double(F.sum("v")).alias("value")).filter("value > 0")


def sankey(df: DataFrame) -> DataFrame:
    """Links (source, target, value): income categories to the total, the total to expense categories and those to their
    subcategories, and one link that balances both sides. Refunds are netted; nodes that aren't positive go."""
    kind = F.when(F.col("amount") > 0, "in").otherwise("out")
    cats = df.groupBy(F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(F.sum("amount").alias("t"), F.sum(F.when(kind == "in", F.col("amount"))).alias("i"))
    income = cats.filter("t > 0").select(F.concat(F.lit("in:"), "category").alias("source"), F.lit("total").alias("target"), double(F.col("t")).alias("value"))
    expense = cats.filter("t < 0").select(F.lit("total").alias("source"), F.concat(F.lit("out:"), "category").alias("target"), double(-F.col("t")).alias("value"))
    subs = df.groupBy(F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory")).agg(F.sum("amount").alias("t")).filter("t < 0 and subcategory <> ''")
    subs = subs.join(F.broadcast(cats.filter("t < 0").select("category")), "category", "left_semi").select(F.concat(F.lit("out:"), "category").alias("source"), F.concat("category", F.lit("/"), "subcategory").alias("target"), double(-F.col("t")).alias("value"))
    net = cats.agg(F.sum("t").alias("t")).filter("t <> 0")
    balance = net.select(F.when(F.col("t") > 0, "total").otherwise("deficit").alias("source"), F.when(F.col("t") > 0, "surplus").otherwise("total").alias("target"), double(F.abs("t")).alias("value"))
    return income.unionByName(expense).unionByName(subs).unionByName(balance)


def anomaly(df: DataFrame, shares: DataFrame, household: int = 2) -> DataFrame:
    """Share of spending by category against a benchmark scaled to the household (per-head categories times n/2, renormalised
    to 100): high over 1.5 times, low under half, absent at 0."""
    bench = shares.select(F.col("category").alias("b_category"), (F.col("share").cast("double") * F.when(F.col("per_capita"), household / 2).otherwise(1.0)).alias("b"))
    total_b = bench.agg(F.sum("b").alias("tb"))
    spent = expense_by_category(df)
    total = spent.agg(F.sum("spent").alias("t"))
    rows = bench.join(F.broadcast(total_b), how="cross").join(F.broadcast(total), how="cross").join(spent, F.col("b_category") == F.col("category"), "left")
    expected, actual = 100 * F.col("b") / F.col("tb"), 100 * F.coalesce("spent", F.lit(0.0)) / F.col("t")
    ratio = actual / expected
    level = F.when(actual == 0, "absent").when(ratio > 1.5, "high").when(ratio < 0.5, "low").otherwise("normal")
    return rows.select(F.col("b_category").alias("category"), F.round(expected, 4).alias("expected"), F.round(actual, 4).alias("actual"), level.alias("level"))


def correction_stats(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per model source: rows still as the model left them, rows the user corrected, accuracy in percent."""
    still = df.filter(F.col("category_source").isin(*AUTOMATIC_SOURCES)).groupBy("category_source").agg(F.count("*").alias("kept"))
    fixed = corrections.groupBy(F.col("old_source").alias("o")).agg(F.count("*").alias("corrected"))
    rows = still.join(fixed, F.col("category_source") == F.col("o"), "full")
    k, c = F.coalesce("kept", F.lit(0)), F.coalesce("corrected", F.lit(0))
    return rows.select(F.coalesce("category_source", "o").alias("source"), k.alias("kept"), c.alias("corrected"), F.round(100 * k / (k + c), 1).alias("accuracy"))


def fallbacks(taxonomy: DataFrame) -> DataFrame:
    """(direction, category, subcategory): each direction's last fallback of a taxonomy (direction, category, subcategory, sort_order, is_fallback)."""
    g = taxonomy.filter("is_fallback").groupBy("direction").agg(F.max_by(F.struct("category", "subcategory"), "sort_order").alias("f"))
    return g.select("direction", "f.category", "f.subcategory")
