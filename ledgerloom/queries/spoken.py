"""Queries: every order's total said in one of five ways, its date in one of eight, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spoken
from .common import query, table


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN CAST(floor(o_totalprice) AS DOUBLE) WHEN o_orderkey % 5 = 4 THEN CAST(round(o_totalprice * 100) % 100 AS DOUBLE) / 100 ELSE round(o_totalprice, 2) END AS amount, o_orderkey % 5 <> 3 AS cents_said FROM orders WHERE o_orderkey % 5 <> 4 OR round(o_totalprice * 100) % 100 > 0")
def fn_spoken_amount(spark: SparkSession, sf: str) -> DataFrame:
    """Euros and cents in words, as written, with "virgola", without cents, cents alone (where there are any)."""
    way = F.col("o_orderkey") % 5
    orders = table(spark, sf, "orders").withColumn("all", F.round(F.col("o_totalprice") * 100).cast("long"))
    e, c = F.floor(F.col("all") / 100), F.col("all") % 100
    written = F.translate(F.format_number(F.col("all") / 100, 2), ",.", ".,")
    said = (
        F.when(way == 0, F.concat(F.lit("Ieri ho speso "), spoken.spell(e, elide=True), F.lit(" euro e "), spoken.spell(c)))
        .when(way == 1, F.concat(F.lit("pagati "), written, F.lit(" euro")))
        .when(way == 2, F.concat(spoken.spell(e), F.lit(" virgola "), F.lpad(c.cast("string"), 2, "0")))
        .when(way == 3, F.concat(F.lit("Dal fornaio "), spoken.spell(e), F.lit(" euro dal fornaio")))
        .otherwise(F.concat(F.lit("solo "), spoken.spell(c), F.lit(" centesimi")))
    )
    read = orders.filter((way != 4) | (c > 0)).select("o_orderkey", spoken.amount(said).alias("a"))
    return read.select("o_orderkey", F.col("a.value").cast("double").alias("amount"), F.col("a.cents_said").alias("cents_said"))


#: Without a year, the 29th of February is no date in a year that has none.
@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 8 AS INTEGER) AS way, CAST(o_custkey AS INTEGER) AS c FROM orders)
SELECT o_orderkey, CASE WHEN NOT (way IN (2, 7) AND month(d) = 2 AND day(d) = 29 AND day(last_day(make_date(year(d + c % 300), 2, 1))) = 28) THEN d END AS said FROM o""")
def fn_spoken_date(spark: SparkSession, sf: str) -> DataFrame:
    """In figures with a year, in words with a year, day and short month, words like "ieri", weekdays with and without "scorso", day alone, ordinals, figures without a year."""
    d, c, way = F.col("o_orderdate").cast("date"), F.col("o_custkey").cast("int"), F.col("o_orderkey") % 8
    number = F.dayofmonth(d)
    name = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), i)
    month = F.month(d) - 1
    later = F.when(way.isin(2, 7), c % 300).when(way == 3, c % 3).when(way == 4, c % 7 + F.when(c % 2 == 0, 1).otherwise(0)).when(way.isin(5, 6), c % 28).otherwise(0)
    ordinal = F.when(number <= 10, name(spoken.ORDINALS, number - 1)).otherwise(spoken.spell(number))
    text = (
        F.when(way == 0, F.concat(F.lit("pane 3,50 euro il "), F.date_format(d, "dd/MM/yyyy")))
        .when(way == 1, F.concat(F.lit("Speso il "), spoken.spell(number), F.lit(" di "), name(spoken.MONTH_NAMES, month), F.date_format(d, " yyyy")))
        .when(way == 2, F.concat(F.lit("spesa del "), number.cast("string"), F.lit(" "), name(spoken.MONTH_SHORT, month)))
        .when(way == 3, F.concat(F.lit("spesa "), name(["Oggi", "ieri", "L\u2019altro ieri"], c % 3)))
        .when(way == 4, F.concat(name(["Luned\u00ec", *spoken.WEEKDAYS[1:]], F.weekday(d)), F.when(c % 2 == 0, " scorso").otherwise(""), F.lit(" al bar")))
        .when(way == 5, F.concat(F.lit("dal fornaio il "), number.cast("string")))
        .when(way == 6, F.concat(ordinal, F.lit(" del mese")))
        .otherwise(F.concat(F.lit("bolletta "), F.date_format(d, "d-M")))
    )
    return table(spark, sf, "orders").select("o_orderkey", spoken.date(text, F.date_add(d, later)).alias("said"))
