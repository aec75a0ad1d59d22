"""Projections and filters over the ledger."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..types import CARD_DOCUMENTS, CATEGORIZABLE, INTERNAL, MONEY, NEVER_COUNTED


@dataclass(frozen=True)
class Filters:
    """Optional filters of the ledger; a field that is None doesn't filter. ``no_context`` asks for rows without one."""

    tx_type: str | None = None
    category: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    to_review: bool | None = None
    category_source: str | None = None
    account_label: str | None = None
    description: str | None = None
    subcategory: str | None = None
    categories: tuple[str, ...] | None = None
    subcategories: tuple[str, ...] | None = None
    contexts: tuple[str | None, ...] | None = None
    exclude_tx_types: tuple[str, ...] | None = None


def where(df: DataFrame, f: Filters) -> DataFrame:
    """Rows that pass every filter that is set. Excluding types drops rows without a type, as SQL does."""
    conditions = {
        "date_from": lambda v: F.col("date") >= F.lit(v).cast("date"),
        "date_to": lambda v: F.col("date") <= F.lit(v).cast("date"),
        "to_review": lambda v: F.coalesce("to_review", F.lit(False)) == v,
        "description": lambda v: F.col("description").ilike(f"%{v}%"),
        "categories": lambda v: F.col("category").isin(*v),
        "subcategories": lambda v: F.col("subcategory").isin(*v),
        "contexts": lambda v: F.col("context").isin(*[c for c in v if c is not None]) | (F.col("context").isNull() if None in v else F.lit(False)),
        "exclude_tx_types": lambda v: ~F.col("tx_type").isin(*v),
    }
    for field in fields(f):
        value = getattr(f, field.name)
        if value is not None:
            df = df.filter(conditions.get(field.name, lambda v, n=field.name: F.col(n) == v)(value))
    return df


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first; ids break ties."""
    return df.orderBy(F.col("date").desc(), "id").offset(offset).limit(limit)


def counted(df: DataFrame) -> DataFrame:
    """Rows whose type is counted; rows without a type are."""
    return df.filter(~F.coalesce(F.col("tx_type").isin(*NEVER_COUNTED), F.lit(False)))


def search(df: DataFrame, text: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Text in either description, or an absolute amount from low to high, half a cent wide on both sides."""
    hit = F.col("description").ilike(f"%{text}%") | F.col("raw_description").ilike(f"%{text}%")
    if low is not None:
        half = F.lit("0.005").cast(MONEY)
        hit = hit | F.abs("amount").between(F.lit(low).cast(MONEY) - half, F.lit(high).cast(MONEY) + half)
    return df.filter(hit)


def text_match(df: DataFrame, query: str) -> DataFrame:
    """The query's key is a part of the description's or the bank text's key; an empty query matches all."""
    key = exact_key(F.lit(query))
    return df.filter((key == "") | F.contains(exact_key("description"), key) | F.contains(exact_key("raw_description"), key))


def direction(amount: Column) -> Column:
    """Zero counts as in."""
    return F.when(amount < 0, "out").otherwise("in")


def pattern_matches(text: Column, pattern: str, match_type: str) -> Column:
    if match_type == "exact":
        return exact_key(text) == exact_key(F.lit(pattern))
    if match_type == "contains":
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    if match_type == "starts_with":
        return F.startswith(F.lower(text), F.lit(pattern.lower()))
    return text.rlike("(?i)" + pattern)


def unchecked(df: DataFrame) -> DataFrame:
    """A missing flag counts as unchecked."""
    return df.filter(~F.coalesce("human_validated", F.lit(False)))


def unpaired(df: DataFrame) -> DataFrame:
    return df.filter(F.col("transfer_pair_id").isNull() & ~F.coalesce(F.col("tx_type") == "card_tx", F.lit(False)))


def one_sided(df: DataFrame) -> DataFrame:
    return df.filter(F.col("tx_type").isin(*INTERNAL) & F.col("transfer_pair_id").isNull())


def review_queue(df: DataFrame) -> DataFrame:
    return df.filter(F.col("to_review") & F.col("tx_type").isin(*CATEGORIZABLE))


def refund_split(df: DataFrame, expense_categories: Column | list[str]) -> DataFrame:
    """kind and a positive value: money in under a category that only has expenses is a negative expense."""
    back = (F.col("amount") > 0) & F.col("category").isin(*expense_categories)
    return df.withColumn("kind", F.when((F.col("amount") > 0) & ~F.coalesce(back, F.lit(False)), "income").otherwise("expense")).withColumn(
        "value", F.when(F.col("kind") == "income", F.col("amount")).otherwise(-F.col("amount"))
    )


def infer_type(df: DataFrame, transfer_patterns: tuple[str, ...] = ()) -> Column:
    """Type of a new row: transfer pattern, card document, sign. Zero is an expense; patterns match as plain text, any case."""
    amount = F.col("amount")
    marked = F.lit(False)
    for p in transfer_patterns:
        marked = marked | F.contains(F.lower(F.col("raw_description")), F.lit(p.lower()))
    return (
        F.when(F.coalesce(marked, F.lit(False)), F.when(amount < 0, "internal_out").otherwise("internal_in"))
        .when(F.col("doc_type").isin(*CARD_DOCUMENTS), "card_tx")
        .when(amount > 0, "income")
        .otherwise("expense")
    )


_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def concat_descriptions(*parts: Column) -> Column:
    """Parts one space apart, without empty ones, identifiers, and parts that the text so far holds already."""

    def add(so_far: Column, part: Column) -> Column:
        p = F.trim(F.coalesce(part, F.lit("")))
        skip = (p == "") | F.lower(p).isin("nan", "none", "null") | p.rlike(_UUID) | F.contains(F.lower(so_far), F.lower(p))
        return F.when(skip, so_far).when(so_far == "", p).otherwise(F.concat(so_far, F.lit(" "), p))

    return F.aggregate(F.array(*parts), F.lit(""), add)
