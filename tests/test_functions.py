"""Golden cases of scalar functions and rule semantics."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates
from ledgerloom.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("€ 12,5", "12.5"), ("1,234", "1234"), ("12.345", "12.345"), ("-415,05", "-415.05"), ("1.234.567,89", "1234567.89"), ("abc", None), ("", None), (None, None)],
)
def test_parse_amount(spark, text, value):
    got = one(spark, amounts.parse_amount(F.lit(text).cast("string")))
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    ("text", "day"),
    [("5/3/2024", (2024, 3, 5)), ("13/12/99", (1999, 12, 13)), ("2024-02-29", (2024, 2, 29)), ("2024-02-29T10:11:12Z", (2024, 2, 29)), ("02 settembre 2026", (2026, 9, 2)), ("March 4, 2021", (2021, 3, 4)), ("31/02/2024", None), ("x", None), (None, None)],
)
def test_parse_date(spark, text, day):
    assert one(spark, dates.parse_date(F.lit(text).cast("string"))) == (None if day is None else datetime.date(*day))


@pytest.mark.parametrize(
    ("text", "key"),
    [("CLIVATI 1969 S.R.L.", "clivati 1969 srl"), ("McDonald’s", "mcdonalds"), ("Città*Nuova", "citta nuova"), ("Straße 5", "strasse 5"), ("", ""), (None, ""), ("東京 店", "東京 店")],
)
def test_exact_key(spark, text, key):
    assert one(spark, tx.exact_key(F.lit(text).cast("string"))) == key


def test_tidy_keeps_apostrophes(spark):
    assert one(spark, tx.tidy(F.lit("GOOGLE*CLOUD dell’Arte A T M"))) == "GOOGLE CLOUD dell'Arte ATM"


def test_redact(spark):
    text = "Rossi Mario IT60X0542811101000000123456 4111 1111 1111 1111 ****1234 CAU 12345 RSSMRA80A01H501U"
    got = one(spark, tx.redact(F.lit(text), ("Mario Rossi",)))
    assert got == "Person Alpha <ACCOUNT_ID> <CARD_ID> <CARD_ID> <TX_CODE> <FISCAL_ID>"
    assert not one(spark, tx.leaks(F.lit(got)))
    assert one(spark, tx.redact(F.lit(got), ())) == got


def test_seal(spark):
    assert one(spark, tx.seal(F.lit("AL CANTINONE VIA AGN"), F.lit("CANTINONE"))) == "AL CANTINONE"
    assert one(spark, tx.seal(F.lit("AL CANTINONE VIA AGN"), F.lit("VIA CANTINONE"))) is None
    assert one(spark, tx.seal(F.lit("F24 IP"), F.lit("IP"))) is None


def test_day_first(spark):
    order = lambda values, country=None: spark.createDataFrame([(v,) for v in values], "d string").agg(dates.day_first(F.col("d"), country).alias("v")).first()["v"]
    assert order(["13/02/2024", "01/02/2024"]) is True
    assert order(["02/13/2024"]) is False
    assert order(["01/02/2024"], "US") is False
    assert order(["13/02/2024", "02/13/2024"]) is None
