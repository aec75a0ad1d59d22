"""Queries: scalar functions over whole columns. Parsers are checked by round trips: a known value written as text and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates
from ..functions import text as tx
from .common import ledger, oracle, query, table

S, D = SparkSession, DataFrame
_KEY = "lower(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g'), '^ | $', '', 'g'))"


def _noisy(c: str = "description") -> Column:
    """A description with accents, apostrophes and signs that keys don't see."""
    return F.concat(F.lit("*É"), F.col(c), F.lit("  McDonald's S.R.L. "))


@query(oracle("SELECT id, concat('e', lower(description), ' mcdonalds srl') AS key FROM ledger"))
def fn_exact_key(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.exact_key(_noisy()).alias("key"))


@query(oracle("SELECT id, concat('E', upper(description), ' MCDONALDS SRL') AS words FROM ledger"))
def fn_words(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", F.array_join(tx.words(_noisy()), " ").alias("words"))


@query(oracle("SELECT id, concat('É', description, ' McDonald''s SRL') AS tidy FROM ledger"))
def fn_tidy(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.tidy(_noisy()).alias("tidy"))


@query(oracle("SELECT id, concat(description, ' SRL 1969 ATM') AS joined FROM ledger"))
def fn_join_initials(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.join_initials(F.concat("description", F.lit(" S R L 1969 A T M"))).alias("joined"))


@query("SELECT p_partkey, concat(upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2), ' ', upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2)) AS shown FROM part")
def fn_counterpart_case(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.counterpart_case(F.upper("p_name")).alias("shown"))


@query(oracle("SELECT id, array_to_string(list_filter(string_split(lower(raw_description), ' '), lambda w: NOT regexp_matches(w, '[0-9]')), ' ') AS signature FROM ledger"))
def fn_raw_signature(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.raw_signature("raw_description").alias("signature"))


@query(oracle("SELECT id, array_to_string(list_filter(string_split(lower(raw_description), ' '), lambda w: NOT regexp_matches(w, '[0-9]')), ' ') AS signature, CAST(amount AS DOUBLE) AS amount, CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction FROM ledger"))
def fn_own_name_key(spark: S, sf: str) -> D:
    a = F.col("amount")
    k, d = tx.own_name_key("raw_description", a), tx.own_name_direction_key("raw_description", a)
    return ledger(spark, sf).select("id", k["signature"].alias("signature"), k["amount"].cast("double").alias("amount"), d["direction"].alias("direction"))


@query(oracle("SELECT id, lower(trim(description)) AS text FROM ledger"))
def fn_normalize_desc(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.normalize_description(F.concat(F.lit("  "), "description", F.lit(" "))).alias("text"))


@query(oracle("SELECT id, lower(description) = 'small ring' OR starts_with(lower(description), 'small ring ') AS hit FROM ledger"))
def fn_starts_with(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.starts_with("description", F.lit("Small, RING")).alias("hit"))


@query("SELECT p_partkey, CASE WHEN length(split_part(p_name, ' ', 2)) >= 4 THEN upper(p_name) END AS seal FROM part")
def fn_seal(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.seal(F.concat("p_name", F.lit(" via agn")), F.split("p_name", " ")[1]).alias("seal"))


@query("SELECT p_partkey, TRUE AS whole, p_type = 'SMALL' AND p_name LIKE '%small%' AS part FROM part")
def fn_sealed(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.sealed("p_name", F.concat(F.lit("xx "), "p_name")).alias("whole"), tx.sealed("p_type", F.when(F.col("p_type") == "SMALL", F.col("p_name")).otherwise("")).alias("part"))


@query("SELECT p_partkey, p_name AS text FROM part")
def fn_strip_symbols(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.strip_symbols(F.concat("p_name", F.lit("€™♥"))).alias("text"))


_SETS = "a AS (SELECT p_partkey, list_distinct(string_split(upper(p_name || ' ' || p_type), ' ')) AS x, list_distinct(string_split(upper(p_name || ' ' || replace(p_brand, '#', ' ')), ' ')) AS y FROM part)"


@query(f"WITH {_SETS} SELECT p_partkey, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS score FROM a")
def fn_jaccard(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.jaccard(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_brand")).alias("score"))


@query(f"WITH {_SETS} SELECT p_partkey, len(list_intersect(x, y)) / len(x) AS score FROM a")
def fn_containment(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.containment(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_brand")).alias("score"))


_SPACE = r"[\t\n\v\f\r ]"
_REDACTED = "coalesce(text, '')"
for _p, _mark in (
    (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}\b", "<ACCOUNT_ID>"),
    (rf"\b[0-9]{{4}}({_SPACE}|-)?[0-9]{{4}}({_SPACE}|-)?[0-9]{{4}}({_SPACE}|-)?[0-9]{{1,7}}\b", "<CARD_ID>"),
    (rf"[\*X]{{4}}({_SPACE}|-)?[0-9]{{4}}", "<CARD_ID>"),
    (rf"(?i)\b(CAU|NDS|POS|TRN|CRO|RIF|ID{_SPACE}*TRANSAZIONE){_SPACE}*[0-9\-]+", "<TX_CODE>"),
    (r"(?i)\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", "<FISCAL_ID>"),
):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{_mark}', 'g')"


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted FROM documents")
def fn_redact(spark: S, sf: str) -> D:
    s = tx.redact("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(s, 256).alias("redacted"))


@query("SELECT p_partkey, p_name AS text FROM part")
def fn_restore(spark: S, sf: str) -> D:
    owners = ("Anna Verdi", "Zoe Blu")
    hidden = tx.redact(F.concat("p_name", F.lit(" Verdi Anna")), owners)
    return table(spark, sf, "part").select("p_partkey", F.replace(tx.restore(hidden, owners), F.lit(" Anna Verdi"), F.lit("")).alias("text"))


@query("SELECT CAST(0 AS BIGINT) AS leaks, CAST(count(*) AS BIGINT) AS n FROM documents")
def fn_assert_clean(spark: S, sf: str) -> D:
    return table(spark, sf, "documents").agg(F.count_if(tx.leaks(tx.redact("text"))).alias("leaks"), F.count("*").alias("n"))


@query(oracle("SELECT id, CASE WHEN raw_description LIKE 'TRANSFER TO %' THEN split_part(raw_description, ' ', 3) ELSE upper(description) END AS dest_key FROM ledger"))
def fn_destination(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", tx.destination("description", "raw_description").alias("dest_key"))


@query("SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS prefix, split_part(p_name, ' ', 2) AS rest FROM part")
def fn_intermed_split(spark: S, sf: str) -> D:
    from ..operators.intermediaries import split

    s = split(F.replace(F.col("p_name"), F.lit(" "), F.lit(" *")))
    return table(spark, sf, "part").select("p_partkey", s["prefix"].alias("prefix"), s["rest"].alias("rest"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN split_part(p_name, ' ', 2) END AS merchant FROM part")
def fn_is_dirty(spark: S, sf: str) -> D:
    from ..operators.intermediaries import dirty

    raw = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" *")), F.lit("  98765432"))
    return table(spark, sf, "part").select("p_partkey", dirty(F.col("p_name"), raw, ["RED"]).alias("merchant"))


def _written(v: Column, style: Column) -> Column:
    """A positive amount in four styles of bank exports."""
    whole, rest = F.floor(v).cast("long"), F.lpad((F.round(v * 100).cast("long") % 100).cast("string"), 2, "0")
    grouped = F.concat(F.floor(whole / 1000).cast("string"), F.lit("{}"), F.lpad((whole % 1000).cast("string"), 3, "0"))
    eu, us = F.concat(F.replace(grouped, F.lit("{}"), F.lit(".")), F.lit(","), rest), F.concat(F.replace(grouped, F.lit("{}"), F.lit(",")), F.lit("."), rest)
    return F.when(style == 0, F.concat(F.lit("€ "), eu)).when(style == 1, us).when(style == 2, F.concat(whole.cast("string"), F.lit(","), rest)).otherwise(F.concat(F.lit("-"), whole.cast("string"), F.lit("."), rest))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders")
def fn_parse_amount(spark: S, sf: str) -> D:
    text = _written(F.col("o_totalprice"), F.col("o_orderkey") % 4)
    return table(spark, sf, "orders").select("o_orderkey", amounts.parse_amount(text).cast("double").alias("amount"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice ELSE NULL END AS debit_positive, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice ELSE NULL END AS credit_negative, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice ELSE NULL END AS debit_credit_signed FROM orders")
def prj_sign(spark: S, sf: str) -> D:
    v, side = F.col("o_totalprice").cast("decimal(18,4)"), F.col("o_orderkey") % 3
    none = F.lit(None).cast("decimal(18,4)")
    debit, credit = F.when(side == 1, v), F.when(side == 0, v)
    return table(spark, sf, "orders").select("o_orderkey", *[amounts.signed(F.lit(c), none, debit, credit).cast("double").alias(c) for c in ("debit_positive", "credit_negative", "debit_credit_signed")])


_STYLES = ("dd/MM/yyyy", "yyyy-MM-dd", "d-M-yy", "yyyy-MM-dd'T'HH:mm:ss", "d MMMM yyyy", "dd/MM/yyyy HH:mm")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def fn_parse_date(spark: S, sf: str) -> D:
    d, style = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % len(_STYLES)
    text = F.lit(None).cast("string")
    for i, f in enumerate(_STYLES):
        text = F.when(style == i, F.date_format(d, f)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_date(text).alias("date"))


@query("SELECT o_custkey, TRUE AS day_first FROM orders GROUP BY o_custkey")
def fn_date_order(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(dates.day_first(F.date_format("o_orderdate", "dd/MM/yyyy"), "IT").alias("day_first"))


@query(oracle("SELECT id, CASE WHEN day(date) <= 12 AND day(date) <> month(date) AND make_date(year(date), day(date), month(date)) <= DATE '2001-06-30' THEN make_date(year(date), day(date), month(date)) END AS swapped FROM ledger"))
def fn_swapped(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", dates.swapped(F.col("date"), F.lit("2001-06-30").cast("date")).alias("swapped"))


@query(oracle("SELECT id, strftime(date, '%Y-%m') AS month FROM ledger"))
def fn_month_key(spark: S, sf: str) -> D:
    return ledger(spark, sf).select("id", dates.month_key(F.col("date")).alias("month"))


@query(oracle("SELECT account_label, (date_trunc('month', max(date)) - INTERVAL 2 MONTH)::DATE AS p_start, last_day(max(date)) AS p_end, (date_trunc('month', max(date)) - INTERVAL 4 MONTH)::DATE AS w_start, last_day(max(date)) < DATE '2001-10-31' AS stale FROM ledger GROUP BY 1"))
def fn_reference_period(spark: S, sf: str) -> D:
    g = ledger(spark, sf).groupBy("account_label").agg(F.max("date").alias("last"))
    start, end = dates.reference_period(F.col("last"))
    return g.select("account_label", start.alias("p_start"), end.alias("p_end"), dates.window_start(F.col("last")).alias("w_start"), (F.last_day("last") < F.lit("2001-10-31").cast("date")).alias("stale"))


@query(oracle("SELECT account_label, last_day(max(date)) AS close_on FROM ledger GROUP BY 1"))
def fn_suggest_close(spark: S, sf: str) -> D:
    return ledger(spark, sf).groupBy("account_label").agg(F.last_day(F.max("date")).alias("close_on"))


@query(oracle("SELECT substr(sha256(concat_ws('|', account_label, CAST(date AS VARCHAR), CAST(amount AS VARCHAR), raw_description)), 1, 24) AS tx_id FROM ledger"))
def fn_tx_id(spark: S, sf: str) -> D:
    c = F.col
    return ledger(spark, sf).select(amounts.transaction_id(c("account_label"), c("source_file"), c("date").cast("string"), c("amount").cast("string"), c("raw_description")).alias("tx_id"))


@query("SELECT event_id, CASE WHEN (user_id % 11) / 10 >= 0.8 THEN 'high' WHEN (user_id % 11) / 10 >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM events")
def fn_confidence_level(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", amounts.confidence_level((F.col("user_id") % 11) / 10).alias("level"))


@query("SELECT event_id, round((1000 - k) * (4.0 * (1 - k / 1000.0) + CASE WHEN k > 0 THEN value / k ELSE 4.0 END * (k / 1000.0)), 6) AS seconds FROM (SELECT *, user_id % 500 AS k FROM events)")
def fn_eta(spark: S, sf: str) -> D:
    k = F.col("user_id") % 500
    return table(spark, sf, "events").select("event_id", F.round(amounts.remaining_seconds(k, F.lit(1000), F.col("value")), 6).alias("seconds"))


@query("SELECT event_id, concat(CAST(CAST(floor(ceil(user_id * 100 / 60) / 60) AS BIGINT) AS VARCHAR), ':', lpad(CAST(CAST(ceil(user_id * 100 / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS text FROM events")
def fn_duration(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", amounts.duration(F.col("user_id") * 100).alias("text"))


@query("SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS shown FROM orders")
def fn_display_amount(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").select("o_orderkey", amounts.display_amount(F.col("o_totalprice")).alias("shown"))


_COMPANY = "concat(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE '' END, CASE WHEN p_partkey % 4 = 1 THEN upper(p_name) WHEN p_partkey % 4 = 2 THEN replace(p_name, ' ', '-') WHEN p_partkey % 4 = 3 THEN split_part(p_name, ' ', 2) ELSE concat(p_name, '''s & co!') END, CASE p_partkey % 5 WHEN 0 THEN ' S.p.A.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Ltd' WHEN 3 THEN ' S.A.' ELSE '' END)"


@query(f"""SELECT p_partkey, CASE WHEN length(b) < 3 THEN NULL WHEN length(b) <= 10 THEN '\\b' || q || '\\b' ELSE '\\b' || replace(replace(substr(b, 1, CAST(greatest(5, floor(length(b) * 2 / 3)) AS INT)), '-', '\\-'), ' ', '\\ ') END AS pattern
FROM (SELECT p_partkey, b, replace(replace(b, '-', '\\-'), ' ', '\\ ') AS q FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({_COMPANY})), ' (s\\.p\\.a\\.|gmbh|ltd|s\\.a\\.)$', ''), '[^\\w\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS b FROM part))""")
def fn_brand_pattern(spark: S, sf: str) -> D:
    return table(spark, sf, "part").select("p_partkey", tx.brand_pattern(F.expr(_COMPANY)).alias("pattern"))
