"""Joins of the ledger with itself and with dimensions: duplicates, rules, brands, nearest expenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..storage import broadcast_if_small
from ..types import ALWAYS_DROPPED, NEVER_COUNTED
from .filters import direction, unchecked
from .patterns import candidates


def duplicates(df: DataFrame) -> DataFrame:
    """Rows whose (date, bank text, amount) stands on more than one account. Grouped, then a semi-join."""
    groups = df.groupBy("date", "raw_description", "amount").agg(F.count_distinct("account_label").alias("k")).filter("k > 1")
    return df.join(groups.select("date", "raw_description", "amount"), ["date", "raw_description", "amount"], "left_semi")


def duplicate_account_pairs(df: DataFrame) -> DataFrame:
    """(a, b, groups): unordered pairs of accounts that share a group of duplicates. A group lists each account once."""
    sets = df.groupBy("date", "raw_description", "amount").agg(F.array_sort(F.collect_set("account_label")).alias("s")).filter("size(s) > 1")
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("groups"))


def rule_hit(text: Column, match_type: Column, pattern: Column) -> Column:
    """Whether a rule's pattern meets a text, both columns; regexes and prefixes ignore case."""
    return (
        F.when(match_type == "exact", exact_key(text) == exact_key(pattern))
        .when(match_type == "contains", F.contains(F.lower(text), F.lower(pattern)))
        .when(match_type == "starts_with", F.startswith(F.lower(text), F.lower(pattern)))
        .when(match_type == "regex", F.regexp_like(text, F.concat(F.lit("(?i)"), pattern)))
        .otherwise(F.lit(False))
    )


def first_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df plus the columns of the first rule that matches each row (multi first, then priority, then rule id), null without one.

    Rules meet distinct texts, not rows, by an index of the rules' literals (see ``patterns``); what matches meets distinct
    (description, direction, doc_type) and then the rows by equality.
    """
    facts = df.select("description", direction(F.col("amount")).alias("__dir"), "doc_type").distinct()
    r = broadcast_if_small(rules.select(*[F.col(c).alias(f"rule_{c}" if not c.startswith("rule_") else c) for c in rules.columns]))
    guard = lambda c, of: F.col(c).isNull() | (F.col(c) == F.col(of))
    texts = facts.select(F.col("description").alias("text")).filter("text IS NOT NULL").distinct()
    near = candidates(texts, rules.select(F.col("rule_id").alias("pattern_id"), F.col("match_type").alias("kind"), "pattern"))
    hits = near.join(r, F.col("pattern_id") == F.col("rule_id")).filter(rule_hit(F.col("text"), F.col("rule_match_type"), F.col("rule_pattern")))
    met = facts.join(hits, (F.col("description") == F.col("text")) & guard("rule_direction", "__dir") & guard("rule_doc_type", "doc_type"))
    best = met.groupBy("description", "__dir", "doc_type").agg(F.min_by(F.struct("rule_id", "rule_category", "rule_subcategory", "rule_multi"), F.struct(~F.col("rule_multi"), -F.col("rule_priority"), "rule_id")).alias("r"))
    b = best.select(F.col("description").alias("b_d"), F.col("__dir").alias("b_dir"), F.col("doc_type").alias("b_t"), "r.*")
    on = df["description"].eqNullSafe(F.col("b_d")) & (direction(df["amount"]) == F.col("b_dir")) & df["doc_type"].eqNullSafe(F.col("b_t"))
    return df.join(b, on, "left").drop("b_d", "b_dir", "b_t")


#: Codes of a list that stand for everywhere and for a continent.
EVERYWHERE, CONTINENT = "001", "150"


def brand(df: DataFrame, brands: DataFrame, country: str, continent: str = CONTINENT) -> DataFrame:
    """df plus tag, brand_idx and scope (0 the country, 1 its continent, 2 everywhere, 3 elsewhere) of the best brand, ties by list order."""
    texts = df.select(F.col("description").alias("text")).filter("text IS NOT NULL").distinct()
    codes = F.split("countries", ",")
    scope = F.when(F.array_contains(codes, country), 0).when(F.array_contains(codes, continent), 1).when(F.array_contains(codes, EVERYWHERE), 2).otherwise(3)
    r = broadcast_if_small(brands.select("brand_idx", F.col("pattern").alias("b_pattern"), "tag", scope.alias("scope")))
    near = candidates(texts, brands.select(F.col("brand_idx").alias("pattern_id"), F.lit("regex").alias("kind"), "pattern"))
    met = near.join(r, F.col("pattern_id") == F.col("brand_idx")).filter(F.regexp_like(F.lower("text"), F.col("b_pattern")))
    best = met.groupBy(F.col("text").alias("b_d")).agg(F.min_by(F.struct("tag", "brand_idx", "scope"), F.struct("scope", "brand_idx")).alias("b")).select("b_d", "b.*")
    return df.join(best, F.col("description") == F.col("b_d"), "left").drop("b_d")


def brand_category(df: DataFrame, brands: DataFrame, tags: DataFrame, country: str) -> DataFrame:
    """df plus brand_category and brand_subcategory: mapped tags of brands of the country or of everywhere."""
    t = F.broadcast(tags.select(F.col("tag").alias("t_tag"), F.col("category").alias("brand_category"), F.col("subcategory").alias("brand_subcategory")))
    return brand(df, brands, country).join(t, (F.col("tag") == F.col("t_tag")) & F.col("scope").isin(0, 2), "left").drop("t_tag", "brand_idx")


def nearest_movement(receipts: DataFrame, movements: DataFrame, days: int = 4) -> DataFrame:
    """(receipt_id, id, gap): the movement of the same amount, whatever its sign, nearest in days, then earliest, then by id.

    Buckets of ``days`` + 1 are an equi-join. Receipts or movements without a day or amount match nothing.
    """
    width = days + 1
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
    c = lambda a: F.round(F.abs(a) * 100).cast("long")
    r = receipts.select("receipt_id", F.col("day").alias("r_day"), c(F.col("value")).alias("r_c")).withColumn("b", F.explode(F.array(bucket(F.col("r_day")) - 1, bucket(F.col("r_day")), bucket(F.col("r_day")) + 1)))
    m = movements.select("id", F.col("date").alias("m_day"), c(F.col("amount")).alias("m_c"), bucket(F.col("date")).alias("m_b"))
    gap = F.abs(F.datediff("r_day", "m_day"))
    met = r.join(m, (F.col("r_c") == F.col("m_c")) & (F.col("b") == F.col("m_b"))).filter(gap <= days).withColumn("gap", gap)
    return met.groupBy("receipt_id").agg(F.min(F.struct("gap", "m_day", "id")).alias("n")).select("receipt_id", "n.id", "n.gap")


def nearest_expense(receipts: DataFrame, movements: DataFrame, days: int = 4) -> DataFrame:
    """``nearest_movement`` among the outflows."""
    return nearest_movement(receipts, movements.filter("amount < 0"), days)


def receipt_matches(receipts: DataFrame, movements: DataFrame, links: DataFrame, cash_account: str | None = None, days: int = 4) -> DataFrame:
    """(receipt_id, kind, id, gap): for each waiting receipt (receipt_id, kind, day, value) the nearest unchecked movement.

    An expense looks among the counted outflows, a refund among the counted inflows, a withdrawal among the outflows of accounts
    other than the cash one, transfers included that are in no row of links (out_id). A movement without a type counts; a null
    kind is an expense.
    """
    typed = lambda *types: ~F.coalesce(F.col("tx_type").isin(*types), F.lit(False))
    open_rows = unchecked(movements)
    counted = open_rows.filter(typed(*NEVER_COUNTED))
    elsewhere = open_rows.filter((F.col("amount") < 0) & typed(*ALWAYS_DROPPED, "internal_in"))
    if cash_account is not None:
        elsewhere = elsewhere.filter(~F.col("account_label").eqNullSafe(F.lit(cash_account)))
    elsewhere = elsewhere.join(links.select(F.col("out_id").alias("id")), "id", "left_anti")
    kind = F.coalesce("kind", F.lit("expense"))
    found = None
    for name, pool in (("expense", counted.filter("amount < 0")), ("refund", counted.filter("amount > 0")), ("withdrawal", elsewhere)):
        some = nearest_movement(receipts.filter(kind == name), pool, days).select("receipt_id", F.lit(name).alias("kind"), "id", "gap")
        found = some if found is None else found.unionByName(some)
    return found
