"""Queries: categories named or meant by texts. Categories are the parts' types and names; texts say them again, whole, in part, turned round or misspelt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spoken
from ..operators import closeness as op
from ..storage import Workspace
from .common import query, table

_PAIRS = "SELECT p_type AS category, p_name AS subcategory, min(p_partkey) AS rank FROM {part} GROUP BY 1, 2"
_TEXTS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('la ', p_name) WHEN 1 THEN concat(p_type, ' / ', p_name) WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' di ', split_part(p_name, ' ', 1), ' ', lower(p_type))
  WHEN 3 THEN concat(p_type, ' ', split_part(p_name, ' ', 2)) WHEN 4 THEN p_name ELSE translate(lower(concat(p_name, ' ', p_type)), 'ol', 'a') END AS text FROM {part}"""


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    return spark.sql(_TEXTS, part=part), spark.sql(_PAIRS, part=part)


@query()
def topk_near_cat(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest categories of each distinct text."""
    return op.nearest(*_inputs(spark, sf), Workspace(spark, "nearest"))


@query()
def fn_closeness(spark: SparkSession, sf: str) -> DataFrame:
    """Closeness of each part's text to its own category."""
    part = table(spark, sf, "part")
    return spark.sql(_TEXTS, part=part).join(part.select("p_partkey", op.label(F.col("p_type"), F.col("p_name")).alias("label")), "p_partkey").select("p_partkey", F.round(op.closeness(F.col("text"), F.col("label")), 9).alias("closeness"))


_STOP = ", ".join(f"'{w}'" for w in spoken.STOP)
_WORDS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: NOT list_contains([" + _STOP + "], w))"
_STEMS = "list_distinct(list_transform({}, lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '[aeio]$') THEN left(w, length(w) - 1) ELSE w END))"


@query(f"""WITH p AS (SELECT category, subcategory, rank, {_STEMS.format(_WORDS.format("category || ' ' || subcategory"))} AS stems FROM ({_PAIRS.format(part="part")})),
t AS (SELECT DISTINCT text, {_STEMS.format("list_filter(" + _WORDS.format("text") + ", lambda w: regexp_matches(w, '[a-z]'))")} AS s FROM ({_TEXTS.format(part="part")})),
e AS (SELECT text, arg_min(category, rank) AS category, arg_min(subcategory, rank) AS subcategory FROM t JOIN p ON lower(text) IN (lower(category || ' / ' || subcategory), lower(subcategory)) GROUP BY text),
o AS (SELECT text, min(category) AS category, min(subcategory) AS subcategory FROM t JOIN p ON len(s) > 0 AND list_has_all(stems, s) GROUP BY text HAVING count(*) = 1)
SELECT t.text, coalesce(e.category, o.category) AS category, coalesce(e.subcategory, o.subcategory) AS subcategory FROM t LEFT JOIN e USING (text) LEFT JOIN o USING (text)""")
def fn_category_match(spark: SparkSession, sf: str) -> DataFrame:
    return op.named(*_inputs(spark, sf))
