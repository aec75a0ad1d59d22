"""The index of literals against every pattern tried on every text, and its plan with many patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins, patterns

KINDS = "pattern_id long, kind string, pattern string"


@pytest.mark.parametrize(("pattern", "holds"), [("^small ring", ["small ring"]), ("(old|new) gear", [" gear"]), ("ab?cde|xyz{2}", ["cde", "xy"]), (r"\d+", []), ("a*", []), (r"7\-eleven", ["7-eleven"]), ("x|", []), ("(", []), (r"\p{Lu}abc", []), ("(?:ab|c)+", ["ab", "c"])])
def test_required(pattern, holds):
    assert sorted(patterns.required(pattern)) == sorted(holds)


@pytest.mark.parametrize("few", [0, 64])
def test_candidates_hold_all_matches(spark, few):
    r = random.Random(3)
    words = ["red", "Blue", "RING", "bolt", "7-eleven", "é", "Straße", "ΣΑΣ", "x", "ab", "naïve", "Пятёрочка", "a.b", "İzmir", "42"]
    texts = sorted({" ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(250)} | {"", " ", "red Bolt"})
    rules = [(1, "contains", "ring"), (2, "contains", "a"), (3, "contains", ""), (4, "starts_with", "Red b"), (5, "starts_with", "пят"), (6, "contains", "σας"), (7, "contains", "é"), (8, "exact", "RED bolt"), (9, "regex", "^(red|blue) r"), (10, "regex", r"\d+"), (11, "regex", "x$|^ab"),
             (12, "regex", "7-e?l"), (13, "contains", "izmir"), (14, "contains", None), (15, "regex", "straße|na.ve"), (16, "contains", "not there"), (17, "other", "red"), (18, "regex", "[rb]ed|olt")]
    t, p = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame(rules, KINDS)
    hit = joins.rule_hit(F.col("text"), F.col("kind"), F.col("pattern"))
    want = {(x["text"], x["pattern_id"]) for x in t.join(p, hit).collect()}
    near = patterns.candidates(t, p, few)
    got = {(x["text"], x["pattern_id"]) for x in near.join(p, "pattern_id").filter(hit).collect()}
    assert got == want and {i for _, i in want} >= {1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 15, 18}
    assert near.count() == near.distinct().count()


def test_many_patterns_without_a_loop(spark):
    names = [f"{a}{b}{c} {d}" for a in ("al", "be", "ko", "zu", "mi") for b in ("ra", "lo", "ti", "ne") for c in ("x", "s", "m", "q", "v") for d in range(100)]
    brands = spark.createDataFrame([(k, rf"\b{re.escape(n)}\b", "shop=x", "IT") for k, n in enumerate(names)], "brand_idx int, pattern string, tag string, countries string")
    df = spark.createDataFrame([(k, f"Paid {n.upper()} today") for k, n in enumerate(names[::7])] + [(-1, None), (-2, "nobody")], "id int, description string")
    found = joins.brand(df, brands, "IT")
    assert {r["id"]: r["brand_idx"] for r in found.collect()} == {k: names.index(n) for k, n in enumerate(names[::7])} | {-1: None, -2: None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
