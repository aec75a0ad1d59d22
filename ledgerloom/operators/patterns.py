"""Many texts against many patterns without a loop over pairs: an index of required literals.

A text that a pattern meets holds the pattern's required literals: the pattern itself for prefixes and substrings, what its syntax tree
can't do without for a regular expression (one literal for each of its alternatives). Each literal is looked up by its rarest run of
three characters (of the texts at hand), so texts and patterns meet in an equality join on such runs; whether a pair really
matches is left to the caller's own condition. Exact patterns meet by the reduced text. Only patterns without any literal (``\\d+``) meet
every text, as nothing can tell in advance which they match.

Runs with a letter whose lower case depends on what stands beside it (sigma, a dotted capital I) are not looked up by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..storage import Workspace, broadcast_if_small

GRAM = 3
#: So few patterns meet every text in a broadcast loop, which is then cheaper than the index. The result is the same.
FEW = 64
#: Letters that lower case changes by their place, or to two characters.
UNSURE = "Σσςİ\u0307"


def _runs(tree) -> list[list[str]]:
    """Of a parsed sequence: lists of literals of which a match holds one each (a list per alternation and per literal run)."""
    found, run = [], ""
    for op, value in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL" and chr(value) not in UNSURE:
            run += chr(value)
            continue
        if run:
            found.append([run])
            run = ""
        if name == "SUBPATTERN":
            found += _runs(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            found += _runs(value[-1])
        elif name == "ATOMIC_GROUP":
            found += _runs(value)
        elif name == "BRANCH":
            each = [_best(_runs(b)) for b in value[1]]
            if all(each):
                found.append([x for b in each for x in b])
    return found


def _best(lists: list[list[str]]) -> list[str]:
    """The list whose shortest literal is longest."""
    return max(lists, key=lambda x: min(map(len, x)), default=[])


def required(pattern: str) -> list[str]:
    """Literals of which every match of a regular expression holds one; none if there are no such, or its syntax isn't known here."""
    if re.search(r"\\[pPQEGZhHRX]|&&|\(\?[a-zA-Z-]*[xd]|\[[^\]]*\[", pattern):  # syntax that differs between engines
        return []
    try:
        return _best(_runs(re._parser.parse(pattern)))
    except (re.error, OverflowError, RecursionError):
        return []


def _grams(text: Column, size: int) -> Column:
    """Different runs of so many characters that can be looked up by."""
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, size))), lambda g: ~g.rlike(f"[{UNSURE}]"))


def literals(patterns: DataFrame) -> DataFrame:
    """(pattern_id, part, literal): the required literals of (pattern_id, kind, pattern), in lower case; patterns of kind exact are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s) for i, p in zip(b["pattern_id"], b["pattern"], strict=True) for n, s in enumerate(required(p or "") if p is not None else [])]
            yield pd.DataFrame(rows, columns=["pattern_id", "part", "literal"]).astype({"pattern_id": "int64", "part": "int32"})

    some = patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "kind", "pattern")
    plain = some.filter("kind IN ('contains', 'starts_with') AND pattern IS NOT NULL").select("pattern_id", F.lit(0).alias("part"), F.col("pattern").alias("literal"))
    parsed = some.filter("kind = 'regex' AND pattern IS NOT NULL").select("pattern_id", "pattern").mapInPandas(run, "pattern_id long, part int, literal string")
    return plain.unionByName(parsed).select("pattern_id", "part", F.lower("literal").alias("literal"))


def candidates(texts: DataFrame, patterns: DataFrame, few: int = FEW) -> DataFrame:
    """(text, pattern_id): pairs among which are all that match. ``texts``: different, not null; ``patterns``: pattern_id, kind
    (exact, contains, starts_with, regex), pattern."""
    known = patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "kind", "pattern").filter("pattern IS NOT NULL")
    if known.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(known.select("pattern_id")), F.lit(True)).select("text", "pattern_id")
    space = Workspace(texts.sparkSession, "patterns")
    found_literals = space.save(literals(known), "literals")
    wanted, exact = found_literals, broadcast_if_small(space.save(known.filter("kind = 'exact'").select("pattern_id", exact_key("pattern").alias("key")), "exact"))
    found = texts.withColumn("key", exact_key("text")).join(exact, "key").select("text", "pattern_id")
    for size in range(GRAM, 0, -1):  # shorter literals by shorter runs; texts are cut so only where there are such
        cut = wanted.withColumn("grams", _grams(F.col("literal"), size))
        of_size = cut.filter(F.size("grams") > 0).select("pattern_id", "part", F.explode("grams").alias("gram"))
        wanted = cut.filter(F.size("grams") == 0).select("pattern_id", "part", "literal")
        if of_size.isEmpty():
            continue
        held = texts.select("text", F.explode(_grams(F.lower("text"), size)).alias("gram"))
        counts = held.join(of_size.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        # The rarest run of each literal; one that no text holds leaves nothing to look up.
        ranked = of_size.join(counts, "gram", "left").withColumn("nth", F.row_number().over(Window.partitionBy("pattern_id", "part").orderBy(F.coalesce("n", F.lit(0)), "gram")))
        keys = space.save(ranked.filter("nth = 1 AND n IS NOT NULL").select("pattern_id", "gram"), f"keys-{size}")
        found = found.unionByName(held.join(broadcast_if_small(keys), "gram").select("text", "pattern_id"))
    without = known.filter("kind = 'regex'").join(found_literals.select("pattern_id"), "pattern_id", "left_anti").select("pattern_id")
    every = space.save(without.unionByName(wanted.select("pattern_id")).distinct(), "every")
    if not every.isEmpty():
        found = found.unionByName(texts.join(broadcast_if_small(every), F.lit(True)).select("text", "pattern_id"))
    return found.distinct()
