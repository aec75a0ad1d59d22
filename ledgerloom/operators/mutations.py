"""Changes of the ledger as copy-on-write transforms, and the categorisation cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..types import INTERNAL, USER_SOURCES
from . import joins
from .filters import direction

AUTO, SUGGEST = 0.9, 0.5


def protected() -> Column:
    """Rows that rules never touch: set by hand, checked, internal."""
    return F.coalesce(F.col("category_source") == "manual", F.lit(False)) | F.coalesce("human_validated", F.lit(False)) | F.coalesce(F.col("tx_type").isin(*INTERNAL), F.lit(False))


def apply_rules(df: DataFrame, rules: DataFrame, only: Column | None = None) -> DataFrame:
    """Category, subcategory, source and review flag from the first rule, for rows that aren't protected (and meet ``only``)."""
    ruled = joins.first_rule(df, rules)
    hit = F.col("rule_id").isNotNull() & ~protected() & (F.lit(True) if only is None else only)
    out = {"category": F.col("rule_category"), "subcategory": F.col("rule_subcategory"), "category_source": F.when(F.col("rule_multi"), "multi").otherwise("rule"), "to_review": F.col("rule_multi")}
    return ruled.select(*[F.when(hit, out[c]).otherwise(F.col(c)).alias(c) if c in out else F.col(c) for c in df.columns])


def upsert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """First write wins: rows of new whose id is stored already are left out, as are repeats inside new."""
    fresh = new.dropDuplicates(["id"]).join(ledger.select("id"), "id", "left_anti")
    return ledger.unionByName(fresh.select(*ledger.columns))


def is_late(today: Column) -> Column:
    return F.coalesce(F.col("date") > today, F.lit(False))


def hold(df: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, held rows): rows dated after today don't enter the ledger; rows without a date do."""
    late = is_late(today)
    return df.filter(~late), df.filter(late)


def invert(df: DataFrame, batch: int) -> DataFrame:
    """The batch's amounts negated and its paired types exchanged."""
    pairs = {"internal_out": "internal_in", "internal_in": "internal_out", "income": "expense", "expense": "income"}
    swap = F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[F.col("tx_type")], F.col("tx_type"))
    mine = F.col("batch_id") == batch
    return df.withColumn("tx_type", F.when(mine, swap).otherwise(F.col("tx_type"))).withColumn("amount", F.when(mine, -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,4)"))


def delete_duplicates(df: DataFrame) -> DataFrame:
    """One row of each (date, bank text, amount) that several accounts hold: the smallest id."""
    first = df.groupBy("date", "raw_description", "amount").agg(F.min("id").alias("keep_id"), F.count_distinct("account_label").alias("k")).filter("k > 1")
    same = (df["date"] == first["date"]) & (df["raw_description"] == first["raw_description"]) & (df["amount"] == first["amount"])
    return df.join(first, same & (df["id"] != first["keep_id"]), "left_anti")


def set_internal(df: DataFrame, chosen: Column) -> DataFrame:
    """Chosen rows become internal by their sign, without category; other internal rows stay."""
    kind = F.when(F.col("amount") < 0, "internal_out").otherwise("internal_in")
    gone = ("category", "subcategory", "category_source")
    return df.select(*[F.when(chosen, kind).otherwise(F.col(c)).alias(c) if c == "tx_type" else F.when(~chosen, F.col(c)).alias(c) if c in gone else F.col(c) for c in df.columns])


def categorize(df: DataFrame, rules: DataFrame, profiles: DataFrame, brands: DataFrame, tags: DataFrame, country: str, fallbacks: DataFrame) -> DataFrame:
    """(id, category, subcategory, source, review): the first of rule, sure history, mapped brand, likely history (to review),
    and the direction's fallback (to review). Every step is a join; ``coalesce`` of structs takes the first that answers."""
    ruled = joins.brand_category(joins.first_rule(df, rules), brands, tags, country).withColumn("__key", exact_key("description"))
    p = profiles.select(F.col("key").alias("p_key"), F.col("category").alias("p_cat"), F.col("subcategory").alias("p_sub"), F.col("confidence").alias("p_conf"))
    f = F.broadcast(fallbacks.select(F.col("direction").alias("f_dir"), F.col("category").alias("f_cat"), F.col("subcategory").alias("f_sub")))
    j = ruled.join(p, F.col("__key") == F.col("p_key"), "left").join(f, direction(F.col("amount")) == F.col("f_dir"), "left")
    answer = lambda c, s, source, review: F.struct(F.col(c).alias("category"), F.col(s).alias("subcategory"), source.alias("source"), review.alias("review"))
    yes, no = F.lit(True), F.lit(False)
    first = F.coalesce(
        F.when(F.col("rule_id").isNotNull(), answer("rule_category", "rule_subcategory", F.when(F.col("rule_multi"), "multi").otherwise("rule"), F.col("rule_multi"))),
        F.when(F.col("p_conf") >= AUTO, answer("p_cat", "p_sub", F.lit("history"), no)),
        F.when(F.col("brand_category").isNotNull(), answer("brand_category", "brand_subcategory", F.lit("nsi"), no)),
        F.when(F.col("p_conf") >= SUGGEST, answer("p_cat", "p_sub", F.lit("history"), yes)),
        answer("f_cat", "f_sub", F.lit("fallback"), yes),
    )
    return j.select("id", first.alias("a")).select("id", "a.*")


def rename_account(df: DataFrame, old: str, new: str) -> DataFrame:
    """(old_id, new_id, account_label): identifiers follow the account's name; links are rewritten by joining on old_id."""
    from ..functions.amounts import transaction_id

    c = F.col
    of = lambda a: transaction_id(a, c("source_file"), c("date").cast("string"), c("amount").cast("string"), c("raw_description"))
    return df.filter(c("account_label") == old).select(of(c("account_label")).alias("old_id"), of(F.lit(new)).alias("new_id"), F.lit(new).alias("account_label"))


def decided_by_user() -> Column:
    return F.coalesce(F.col("category_source").isin(*USER_SOURCES), F.lit(False))
