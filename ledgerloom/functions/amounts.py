"""Amounts: parsing, sign conventions, ranges, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def parse_amount(text: Column) -> Column:
    """Amount in a bank's text, null if there is none.

    Currency signs and blanks go. With both separators the last one is the decimal; a single comma before at most two
    digits is the decimal, other commas group thousands; a lone dot is the decimal.
    """
    s = F.regexp_replace(text, r"[€$£\s]", "")
    dot, comma = F.locate(".", s), F.locate(",", s)
    last = lambda c: F.length(s) - F.locate(c, F.reverse(s))
    no_commas, no_dots = F.replace(s, F.lit(",")), F.replace(s, F.lit("."))
    point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    number = (
        F.when((dot > 0) & (comma > 0), F.when(last(".") < last(","), point(no_dots)).otherwise(no_commas))
        .when(s.rlike(r"^[^,]*,[^,]{0,2}$"), point(s))
        .otherwise(no_commas)
    )
    return number.try_cast(MONEY)


def signed(convention: Column, amount: Column, debit: Column, credit: Column) -> Column:
    """Amount with its sign (negative: money out) under a layout's convention; both debit and credit null: ``amount``."""
    none = debit.isNull() & credit.isNull()
    zero = F.lit(0).cast(MONEY)
    by_name = F.abs(F.coalesce(credit, zero)) - F.abs(F.coalesce(debit, zero))
    credit_first = F.when(credit > 0, credit).when(F.coalesce(debit, zero) != 0, -F.abs(debit)).otherwise(amount)
    return (
        F.when(convention == "signed_single", amount)
        .when(none, amount)
        .when(convention == "debit_positive", by_name)
        .when(convention == "debit_credit_signed", F.coalesce(debit, credit))
        .when(convention == "credit_negative", credit_first)
        .cast(MONEY)
    )


def amount_range(query: Column) -> Column:
    """(low, high) of amounts that a typed number means: ``23`` is 23.00 to 23.99, ``23,40`` itself; null if it is no number."""
    q = F.replace(F.regexp_replace(query, r"[€\s]", ""), F.lit("."))
    whole = q.rlike(r"^\d+$")
    exact = q.rlike(r"^\d+,\d{1,2}$")
    value = F.replace(q, F.lit(","), F.lit(".")).try_cast("decimal(18,2)")
    return F.when(whole | exact, F.struct(value.alias("low"), F.when(whole, value + F.lit("0.99").cast("decimal(3,2)")).otherwise(value).cast("decimal(18,2)").alias("high")))


def transaction_id(account: Column, source_file: Column, raw_date: Column, raw_amount: Column, raw_description: Column) -> Column:
    """24 hex digits of the SHA-256 of account (or file), date, amount and text as the bank wrote them."""
    key = F.coalesce(F.nullif(F.trim(account), F.lit("")), source_file, F.lit(""))
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", key, part(raw_date), part(raw_amount), part(raw_description)), 256), 1, 24)


def cents(amount: Column) -> Column:
    return F.round(amount * 100, 0).cast("long")


def confidence_level(x: Column) -> Column:
    return F.when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")


def duration(seconds: Column) -> Column:
    """Minutes, rounded up, as ``h:mm``."""
    minutes = F.ceil(seconds / 60)
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def remaining_seconds(done: Column, total: Column, elapsed: Column, prior: float = 4.0) -> Column:
    """Rows left times a pace that moves from the prior to the observed one as rows are done."""
    share = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    observed = F.when(done > 0, elapsed / done).otherwise(F.lit(prior))
    return (total - done) * (F.lit(prior) * (1 - share) + observed * share)


def display_amount(amount: Column) -> Column:
    """Italian style: dots for thousands, a comma for decimals."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")
