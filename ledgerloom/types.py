"""Types of the ledger: the canonical schema and the sets of values that operators share."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

#: Types that no total counts.
NEVER_COUNTED = ("internal_out", "internal_in", "card_settlement", "aggregate_debit")
#: Types that every aggregation drops, whether or not it keeps internal transfers.
ALWAYS_DROPPED = ("card_settlement", "aggregate_debit")
INTERNAL = ("internal_out", "internal_in")
#: Types whose category can be decided.
CATEGORIZABLE = ("expense", "income", "card_tx", "unknown")
CARD_DOCUMENTS = ("credit_card", "debit_card", "prepaid_card")
USER_SOURCES = ("manual", "rule")
AUTOMATIC_SOURCES = ("llm", "nsi", "history")
#: Labels for missing context, category and subcategory in aggregations.
NO_CONTEXT, NO_CATEGORY, NO_SUBCATEGORY = "—", "Altro", ""

LEDGER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("amount", MONEY),
    T.StructField("currency", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("raw_description", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("doc_type", T.StringType()),
    T.StructField("account_label", T.StringType()),
    T.StructField("tx_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("category_source", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("reconciled", T.BooleanType()),
    T.StructField("to_review", T.BooleanType()),
    T.StructField("human_validated", T.BooleanType()),
    T.StructField("transfer_pair_id", T.StringType()),
    T.StructField("created_at", T.DateType()),
])
