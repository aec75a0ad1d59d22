"""Patterns of brand names: what they are, and that they find the names they were made of."""

import re

from pyspark.sql import functions as F

from ledgerloom.functions.text import brand_pattern

CASES = {
    "Centra": r"\bcentra\b", "Esselunga Market": r"\besselunga\ ", "Esselunga": r"\besselunga\b", "  ACME  S.p.A. ": r"\bacme\b", "Rossi Spa Srl": r"\brossi\ spa\b", "Müller GmbH": r"\bmüller\b", "7-Eleven": r"\b7\-eleven\b",
    "H&M": None, "ab": None, "": None, None: None, "McDonald's": r"\bmcdonalds\b", "x" * 31: r"\b" + "x" * 20, "Spa": r"\bspa\b", "日本銀行": r"\b日本銀行\b",
}


def test_patterns(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(CASES)], "k int, name string").select("k", brand_pattern(F.col("name")).alias("p"))
    assert {r["k"]: r["p"] for r in df.collect()} == dict(enumerate(CASES.values()))


def test_patterns_find_their_names(spark):
    for name, p in CASES.items():
        if p and "S.p.A." not in name and "GmbH" not in name and "Srl" not in name and "'" not in name:
            assert re.search(p, f"paid {name.lower()} today"), name
