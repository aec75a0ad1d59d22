"""Running sums, month gaps, holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index


def daily_cumulative(df: DataFrame) -> DataFrame:
    """(date, total, running): running sum by day. Days are summed first, so the one ordered window sees days, not rows."""
    days = df.groupBy("date").agg(F.sum("amount").alias("t"))
    return days.select("date", F.col("t").cast("double").alias("total"), F.sum("t").over(Window.orderBy("date")).cast("double").alias("running"))


def log_bucket(v: Column) -> Column:
    """A number that never falls as v grows, of which there are some thousands at most: 64 to each doubling."""
    return F.when(v > 0, F.floor(F.log2(v.cast("double")) * 64)).otherwise(-100_000).cast("int")


def running_sum(df: DataFrame, bucket: Column, order: list, add: Column) -> DataFrame:
    """df plus ``upto``: the running sum of ``add`` in the given order, along which buckets must not fall.

    Sums per bucket are run over first (a row per bucket), then rows inside their bucket only, so no task sees all rows.
    """
    rows = df.withColumns({"__b": bucket, "__add": add})
    sums = rows.groupBy(F.col("__b").alias("__k")).agg(F.sum("__add").alias("__s"))
    before = sums.select("__k", (F.sum("__s").over(Window.orderBy("__k")) - F.col("__s")).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(before), F.col("__b") == F.col("__k"))
    return joined.withColumn("upto", F.col("__before") + F.sum("__add").over(inside)).drop("__b", "__k", "__before", "__add")


def small_singles(df: DataFrame, key: str, value: str, share: float = 0.05) -> DataFrame:
    """One row, ``limit``: the largest amount v so that all single items up to v stay under ``share`` of all spending.

    Equal amounts are never split. The running sum is over distinct amounts, grouped first."""
    totals = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    bound = df.agg((F.sum(value) * share).alias("bound"))
    amounts = totals.filter("n = 1").groupBy("v").agg(F.count("*").alias("m"))
    running = running_sum(amounts, log_bucket(F.col("v")), ["v"], F.col("v") * F.col("m")).join(F.broadcast(bound), how="cross")
    breach = running.agg(F.min(F.when(F.col("upto") >= F.col("bound"), F.col("v"))).alias("b"))
    return amounts.join(F.broadcast(breach), how="cross").agg(F.max(F.when(F.col("b").isNull() | (F.col("v") < F.col("b")), F.col("v"))).cast("double").alias("limit"))


def months_present(df: DataFrame) -> DataFrame:
    return df.select("account_label", month_index(F.col("date")).alias("m")).distinct()


def holes(present: DataFrame) -> DataFrame:
    """(account_label, first_missing, last_missing): runs of missing months between an account's months."""
    w = Window.partitionBy("account_label").orderBy("m")
    return present.withColumn("next", F.lead("m").over(w)).filter("next > m + 1").select("account_label", (F.col("m") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"))


def gap_status(df: DataFrame, today: str, months: int = 4) -> DataFrame:
    """(account_label, kind): never, behind (last month missing), dormant (nothing in the window), gap, up_to_date.

    The window is the last ``months`` complete months before the month of ``today``; later months don't count.
    """
    now = month_index(F.lit(today).cast("date"))
    seen = months_present(df).filter(F.col("m") < now)
    inside = F.col("m") >= now - months
    g = seen.groupBy("account_label").agg(F.max("m").alias("last"), F.count_if(inside).alias("k"), F.min(F.when(inside, F.col("m"))).alias("first_in"))
    accounts = df.select("account_label").distinct().join(g, "account_label", "left")
    kind = F.when(F.col("last").isNull(), "never").when(F.col("k") == 0, "dormant").when(F.col("last") < now - 1, "behind").when(F.col("last") - F.col("first_in") + 1 > F.col("k"), "gap").otherwise("up_to_date")
    return accounts.select("account_label", kind.alias("kind"))


def check_progress(df: DataFrame, key: str, value: str, goal: float = 0.8) -> DataFrame:
    """One row: how many of the heaviest undecided keys are left until ``goal`` of all spending is decided."""
    totals = df.groupBy(key).agg(F.sum(value).alias("v"), F.bool_or("decided").alias("decided"))
    total = totals.agg(F.sum("v").alias("all_v"), F.coalesce(F.sum(F.when(F.col("decided"), F.col("v"))), F.lit(0)).alias("done"))
    running = running_sum(totals.filter(~F.col("decided")), -log_bucket(F.col("v")), [F.desc("v"), key], F.col("v"))
    open_keys = running.withColumn("before", F.col("upto") - F.col("v")).join(F.broadcast(total), how="cross")
    return open_keys.agg(F.count_if(F.col("done") + F.col("before") < F.col("all_v") * goal).alias("to_go"))


def majority_sign(df: DataFrame, by: str) -> DataFrame:
    """Per column (or file): the majority sign; with fewer than 3 rows or a tie the first non-zero decides, inconclusive."""
    a = F.col("amount")
    g = df.groupBy(by).agg(F.count_if(a < 0).alias("neg"), F.count_if(a > 0).alias("pos"), F.min_by(F.signum(a), F.struct(a == 0, "date", "id")).alias("first"))
    sure = (F.col("neg") + F.col("pos") >= 3) & (F.col("neg") != F.col("pos"))
    return g.select(by, F.when(sure, F.when(F.col("neg") > F.col("pos"), -1).otherwise(1)).otherwise(F.col("first")).cast("int").alias("sign"), (~sure).alias("inconclusive"))
