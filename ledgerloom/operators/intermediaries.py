"""Payment intermediaries: a known prefix in a bank's text, and the merchant behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tidy, words

#: A merchant field has at most so many characters.
FIELD = 25


def split(raw: Column) -> Column:
    """(prefix, rest) of ``PREFIX *REST``; null without an asterisk after a prefix."""
    prefix = F.array_join(words(F.regexp_extract(raw, r"^([^*]*?)\s*\*", 1)), " ")
    return F.when(F.contains(raw, F.lit("*")) & (prefix != ""), F.struct(prefix.alias("prefix"), F.trim(F.regexp_extract(raw, r"^[^*]*\*(.*)$", 1)).alias("rest")))


def learn(texts: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(prefix, names): prefixes that at least ``least`` different merchant words follow. A word counts with 4 letters and no digit."""
    found = texts.select(split(F.col(column)).alias("s")).filter("s is not null").select("s.prefix", F.get(words(F.col("s.rest")), 0).alias("name"))
    named = found.filter((F.length(F.regexp_replace("name", "[^A-Z]", "")) >= 4) & ~F.col("name").rlike("[0-9]"))
    return named.groupBy("prefix").agg(F.count_distinct("name").alias("names")).filter(F.col("names") >= least)


def pattern(prefixes: list[str]) -> str:
    """One regex for all active prefixes, longest first: group 1 is the prefix, group 2 the field behind its separator.

    The separator is an asterisk or two blanks; the field ends at the next gap, asterisk, line end or run of five digits.
    """
    body = "|".join(r"[\W_]+".join(f"\\Q{w}\\E" for w in p.split()) for p in sorted(prefixes, key=lambda p: (-len(p), p)))
    return rf"(?i)(?<![A-Za-z0-9])({body})(?![A-Za-z0-9])(?:\s*\*\s*|\s{{2,}})(.*?)(?=\s{{2,}}|\*|\n|\d{{5}}|$)"


def merchant(raw: Column, prefixes: list[str]) -> Column:
    """(prefix, merchant) of a row paid through an active intermediary; null if there is none or it names nobody."""
    p = pattern(prefixes)
    field = F.regexp_extract(raw, p, 2)
    cut = F.when(F.length(field) <= FIELD, field).when(F.substring(field, 1, FIELD + 1).contains(" "), F.regexp_extract(F.substring(field, 1, FIELD + 1), r"^(.*) ", 1)).otherwise(F.substring(field, 1, FIELD))
    name = tidy(cut)
    return F.when(name.rlike(r"\p{L}{3}"), F.struct(F.array_join(words(F.regexp_extract(raw, p, 1)), " ").alias("prefix"), name.alias("merchant")))


def dirty(description: Column, raw: Column, prefixes: list[str]) -> Column:
    """The merchant to write where a description still shows the intermediary; null elsewhere."""
    hit = merchant(raw, prefixes)
    key = F.array_join(words(description), " ")
    return F.when((key == hit["prefix"]) | F.startswith(key, F.concat(hit["prefix"], F.lit(" "))), hit["merchant"])


def rules_of(rules: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rules whose ``pattern`` begins with the whole words of a ``prefix``: an equi-join on runs of first words, without a loop over prefixes."""
    w = words("pattern")
    starts = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda n: F.slice(w, 1, n)))
    named = prefixes.select(words("prefix").alias("__start")).filter(F.size("__start") > 0).distinct()
    hit = rules.select("rule_id", F.explode(starts).alias("__start")).join(named, "__start", "left_semi").select("rule_id").distinct()
    return rules.join(hit, "rule_id", "left_semi")
