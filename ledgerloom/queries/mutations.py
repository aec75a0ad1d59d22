"""Queries: changes of the ledger and the categorisation cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from ..operators import mutations as op
from .aggregates import _PROFILES
from .common import dimension, ledger, oracle, query
from .joins import _BRAND_SQL, _RULE_SQL

S, D = SparkSession, DataFrame
_PROTECTED = "(coalesce(category_source = 'manual', FALSE) OR coalesce(human_validated, FALSE) OR coalesce(tx_type IN ('internal_out', 'internal_in'), FALSE))"
_APPLY = "SELECT id, CASE WHEN {h} THEN rule_category ELSE category END AS category, CASE WHEN {h} THEN CASE WHEN rule_multi THEN 'multi' ELSE 'rule' END ELSE category_source END AS category_source, CASE WHEN {h} THEN rule_multi ELSE to_review END AS to_review FROM ruled"
_HIT = f"rule_id IS NOT NULL AND NOT {_PROTECTED}"
_COLS = ("id", "category", "category_source", "to_review")


@query(oracle(_APPLY.format(h=f"({_HIT})"), _RULE_SQL, ("rules",)))
def mut_apply_rules_all(spark: S, sf: str) -> D:
    return op.apply_rules(ledger(spark, sf), dimension(spark, "rules")).select(*_COLS)


@query(oracle(_APPLY.format(h=f"({_HIT} AND to_review)"), _RULE_SQL, ("rules",)))
def mut_apply_rules_review(spark: S, sf: str) -> D:
    return op.apply_rules(ledger(spark, sf), dimension(spark, "rules"), F.col("to_review")).select(*_COLS)


@query(oracle(_APPLY.format(h=f"({_HIT} AND batch_id = 7)"), _RULE_SQL, ("rules",)))
def mut_apply_rules_ids(spark: S, sf: str) -> D:
    return op.apply_rules(ledger(spark, sf), dimension(spark, "rules"), F.col("batch_id") == 7).select(*_COLS)


@query(oracle("SELECT id FROM ledger WHERE batch_id < 5 OR account_label = 'ACC-1'"))
def snk_upsert(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return op.upsert(df.filter("batch_id < 5"), df.filter("account_label = 'ACC-1'")).select("id")


@query(oracle("SELECT id, CASE WHEN date > DATE '2001-01-01' THEN 'held' ELSE 'ledger' END AS place FROM ledger"))
def mut_hold_cycle(spark: S, sf: str) -> D:
    stored, held = op.hold(ledger(spark, sf), F.lit("2001-01-01").cast("date"))
    return stored.select("id", F.lit("ledger").alias("place")).unionByName(held.select("id", F.lit("held").alias("place")))


@query(oracle("SELECT id, CAST(CASE WHEN batch_id = 4 THEN -amount ELSE amount END AS DOUBLE) AS amount, CASE WHEN batch_id = 4 THEN CASE tx_type WHEN 'internal_out' THEN 'internal_in' WHEN 'internal_in' THEN 'internal_out' WHEN 'income' THEN 'expense' WHEN 'expense' THEN 'income' ELSE tx_type END ELSE tx_type END AS tx_type FROM ledger"))
def mut_invert_batch(spark: S, sf: str) -> D:
    return op.invert(ledger(spark, sf), 4).select("id", F.col("amount").cast("double").alias("amount"), "tx_type")


@query(oracle("SELECT id FROM ledger WHERE (date, raw_description, amount) NOT IN (SELECT (date, raw_description, amount) FROM ledger GROUP BY date, raw_description, amount HAVING count(DISTINCT account_label) > 1) OR id IN (SELECT min(id) FROM ledger GROUP BY date, raw_description, amount HAVING count(DISTINCT account_label) > 1)"))
def mut_delete_dups(spark: S, sf: str) -> D:
    return op.delete_duplicates(ledger(spark, sf)).select("id")


@query(oracle("SELECT id FROM ledger WHERE batch_id <> 3"))
def mut_cancel_batch(spark: S, sf: str) -> D:
    return ledger(spark, sf).filter("batch_id <> 3").select("id")


@query(oracle("SELECT id, CASE WHEN raw_description LIKE 'TRANSFER TO%' THEN CASE WHEN amount < 0 THEN 'internal_out' ELSE 'internal_in' END ELSE tx_type END AS tx_type, CASE WHEN raw_description NOT LIKE 'TRANSFER TO%' THEN category END AS category FROM ledger"))
def mut_giroconto(spark: S, sf: str) -> D:
    return op.set_internal(ledger(spark, sf), F.startswith("raw_description", F.lit("TRANSFER TO"))).select("id", "tx_type", "category")


@query(oracle("SELECT id, CASE WHEN account_label = 'ACC-1' THEN TRUE ELSE human_validated END AS human_validated, CASE WHEN account_label = 'ACC-1' THEN FALSE ELSE to_review END AS to_review FROM ledger"))
def mut_validate(spark: S, sf: str) -> D:
    mine = F.col("account_label") == "ACC-1"
    return ledger(spark, sf).select("id", F.when(mine, True).otherwise(F.col("human_validated")).alias("human_validated"), F.when(mine, False).otherwise(F.col("to_review")).alias("to_review"))


@query(oracle("SELECT substr(sha256(concat_ws('|', account_label, CAST(date AS VARCHAR), CAST(amount AS VARCHAR), raw_description)), 1, 24) AS old_id, substr(sha256(concat_ws('|', 'MAIN', CAST(date AS VARCHAR), CAST(amount AS VARCHAR), raw_description)), 1, 24) AS new_id, 'MAIN' AS account_label FROM ledger WHERE account_label = 'ACC-6'"))
def mut_rename_account(spark: S, sf: str) -> D:
    return op.rename_account(ledger(spark, sf), "ACC-6", "MAIN")


_CASC = f"{_RULE_SQL}, {_BRAND_SQL}, {_PROFILES}, fb AS (SELECT direction, category, subcategory FROM taxonomy WHERE is_fallback QUALIFY row_number() OVER (PARTITION BY direction ORDER BY sort_order DESC) = 1)"
_PICK = "CASE WHEN l.rule_id IS NOT NULL THEN {0} WHEN pr.confidence >= 0.9 THEN {1} WHEN bt.category IS NOT NULL THEN {2} WHEN pr.confidence >= 0.5 THEN {3} ELSE {4} END"


@query(
    oracle(
        f"SELECT l.id, {_PICK.format('l.rule_category', 'pr.category', 'bt.category', 'pr.category', 'fb.category')} AS category, {_PICK.format('l.rule_subcategory', 'pr.subcategory', 'bt.subcategory', 'pr.subcategory', 'fb.subcategory')} AS subcategory, "
        + _PICK.format("CASE WHEN l.rule_multi THEN 'multi' ELSE 'rule' END", "'history'", "'nsi'", "'history'", "'fallback'") + " AS source, " + _PICK.format("l.rule_multi", "FALSE", "FALSE", "TRUE", "TRUE")
        + " AS review FROM ruled l LEFT JOIN bb ON l.description = bb.description LEFT JOIN brand_taxonomy bt ON bb.tag = bt.tag AND scope IN (0, 2) LEFT JOIN profiles pr ON lower(l.description) = pr.key LEFT JOIN fb ON fb.direction = CASE WHEN l.amount < 0 THEN 'out' ELSE 'in' END",
        _CASC, ("rules", "brands", "brand_taxonomy", "taxonomy"),
    )
)
def casc_categorize(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return op.categorize(df, dimension(spark, "rules"), aggregates.profiles(aggregates.associations(df)), dimension(spark, "brands"), dimension(spark, "brand_taxonomy"), "IT", aggregates.fallbacks(dimension(spark, "taxonomy")))
