"""Spoken amounts and dates: sentences, what is no amount, and every number word below 3,000 and around the thousands."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import spoken
from ledgerloom.storage import Workspace

CASES = {
    "ventitré euro e quaranta": ("23.4", True), "zero e 90": ("0.9", True), "novanta centesimi": ("0.9", True), "milleduecento": ("1200", False), "12,50 euro di pane": ("12.5", True), "1.234,5": ("1234.5", True),
    "3 virgola 4": ("3.4", True), "tre virgola quattro": ("3.4", True), "tre punto quaranta": ("3.4", True), "tre virgola 05": ("3.05", True), "centotto": ("108", False), "Ventuno euro": ("21", False), "due euro cinquanta": ("2.5", True), "due cinquanta": ("2", False),
    "duemilatrecentoquarantacinque euro": ("2345", False), "spesa il martedì 7 euro": ("7", False), "zero": None, "zero, poi cinque": ("5", False), "0,00": (None, True), "unocento": None, "zerocento": None, "unomila": None, "nessun numero": None, "": None, None: None, "9" * 40: None, "euro": None,
    "12,50€": ("12.5", True), "cento euro e duecento": ("100", False), "5 cent": ("0.05", True), "mille": ("1000", False), "x " * 5000 + "otto": ("8", False),
}


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, text string").withColumn("value", F.lit("clash"))
    got = {r["i"]: r["a"] for r in df.select("i", spoken.amount(F.col("text")).alias("a")).collect()}
    for i, (text, expected) in enumerate(CASES.items()):
        found = got[i] and (got[i]["value"], got[i]["cents_said"])
        assert found == (expected and (expected[0] and Decimal(expected[0]), expected[1])), text


def test_every_word_is_read_back(spark):
    n = spark.range(3000).unionByName(spark.range(99_500, 101_500)).unionByName(spark.range(999_000, 1_000_000))
    for elide in (False, True):
        said = Workspace(spark, "spoken").save(n.select("id", spoken.spell(F.col("id"), elide).alias("w")), "said")
        assert said.filter(~spoken.number(F.col("w")).eqNullSafe(F.col("id"))).limit(3).collect() == []
    words = [r["w"] for r in spark.createDataFrame([(v,) for v in (0, 21, 28, 33, 100, 101, 188, 1000, 1001, 2000, 345_678)], "n long").select(spoken.spell(F.col("n")).alias("w")).collect()]
    assert words == ["zero", "ventuno", "ventotto", "trentatre", "cento", "centouno", "centoottantotto", "mille", "milleuno", "duemila", "trecentoquarantacinquemilaseicentosettantotto"]


#: What is said on Sunday, 25 October 2026, as (month, day) of that year or a whole date.
DATES = {
    "oggi": (10, 25), "Ieri sera": (10, 24), "l'altro ieri": (10, 23), "avantieri": (10, 23), "ieri l\u2019altro": (10, 23), "gestern": (10, 24), "aujourd'hui": (10, 25), "domenica": (10, 25), "domenica scorsa": (10, 18), "lunedì": (10, 19),
    "sabato scorso 12 euro": (10, 24), "il 12": (10, 12), "il 31": date(2026, 8, 31), "il trenta": (9, 30), "il 26": (9, 26), "il primo": (10, 1), "primo del mese": (10, 1), "il ventitré del mese": (10, 23), "2 del mese": (10, 2), "12 maggio": (5, 12),
    "dodici di maggio": (5, 12), "12 dicembre": date(2025, 12, 12), "primo ott": (10, 1), "1 gennaio 2024": date(2024, 1, 1), "12/05/26": (5, 12), "12-05": (5, 12), "12.05.2026": (5, 12), "26/10": date(2025, 10, 26), "29/2/2024": date(2024, 2, 29),
    "29 febbraio": None, "31/02/2026": None, "31/02/2026 o il 3": (10, 3), "1/1/000": None, "40 maggio, poi 3 maggio": (5, 3), "il 40": None, "secondo me": None, "primo 12": None, "23,40": None, "12.05": None, "": None, None: None,
    "il 7 e ieri": (10, 24), "ieri o il 3/9": (9, 3), "spesa " * 4000 + "il 3": (10, 3), "martedì e lunedì": (10, 20),
}


def test_dates(spark):
    df = spark.createDataFrame(list(enumerate(DATES)), "i int, text string").withColumn("day", F.lit("clash"))
    got = {r["i"]: r["d"] for r in df.select("i", spoken.date(F.col("text"), F.lit(date(2026, 10, 25))).alias("d")).collect()}
    for i, (text, expected) in enumerate(DATES.items()):
        assert got[i] == (date(2026, *expected) if isinstance(expected, tuple) else expected), text[:60]
    unknown = F.lit(None).cast("date")
    row = df.limit(1).select(spoken.date(F.lit("ieri"), unknown).alias("a"), spoken.date(F.lit("1/2/2020"), unknown).alias("b")).first()
    assert (row["a"], row["b"]) == (None, date(2020, 2, 1))
