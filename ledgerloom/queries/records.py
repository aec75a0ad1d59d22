"""Queries: what follows a user's answers. Links join each mirrored transfer to its order's income row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import records as op
from .common import derived, derived_oracle, dimension, ledger, oracle, query, table

S, D = SparkSession, DataFrame
_LINKS = """links AS (SELECT concat('x-', CAST(o_orderkey AS STRING)) AS out_id, concat('i-', CAST(o_orderkey AS STRING)) AS in_id,
  CASE o_orderkey % 3 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS user_decision FROM orders WHERE o_orderkey % 11 = 0)"""
#: A bank text's signature in SQL: its words without digits, in lower case.
_SIG = "trim(regexp_replace(lower({}raw_description), '\\S*[0-9]\\S*\\s*', '', 'g'))"
_FREE = "coalesce(category_source NOT IN ('manual', 'rule'), TRUE) AND NOT coalesce(human_validated, FALSE)"
_IN = "coalesce({}tx_type IN ('internal_out', 'internal_in'), FALSE)"


def _links(spark: S, sf: str) -> D:
    key = F.col("o_orderkey")
    at = lambda p: F.concat(F.lit(p), key.cast("string"))
    decision = F.when(key % 3 == 1, "yes").when(key % 3 == 2, "no")
    return table(spark, sf, "orders").filter("o_orderkey % 11 = 0").select(at("x-").alias("out_id"), at("i-").alias("in_id"), decision.alias("user_decision"))


_FAN = "src AS (SELECT description, min(id) AS source_id FROM ledger WHERE batch_id = 1 AND category_source = 'manual' GROUP BY 1), fan AS (SELECT l.id AS target_id, s.category AS c, s.subcategory AS sc, s.context AS x FROM ledger l JOIN src USING (description) JOIN ledger s ON s.id = source_id WHERE l.batch_id = 2)"


@query(oracle(f"SELECT id, CASE WHEN hit THEN c ELSE category END AS category, CASE WHEN hit THEN coalesce(x, context) ELSE context END AS context, CASE WHEN hit THEN 'history' ELSE category_source END AS category_source FROM (SELECT l.*, f.*, f.target_id IS NOT NULL AND {_FREE} AS hit FROM ledger l LEFT JOIN fan f ON l.id = f.target_id)", _FAN))
def mut_fan_out(spark: S, sf: str) -> D:
    """The first manual row of a counterpart in batch 1 to the rows of batch 2."""
    df = ledger(spark, sf)
    first = df.filter("batch_id = 1 and category_source = 'manual'").groupBy("description").agg(F.min("id").alias("source_id"))
    targets = df.filter("batch_id = 2").select("description", F.col("id").alias("target_id"))
    return op.fan_out(df, targets.join(first, "description").select("source_id", "target_id")).select("id", "category", "context", "category_source")


_PAST = f"ans AS (SELECT DISTINCT ON (k, o) lower(description) AS k, amount < 0 AS o, category AS c, coalesce(subcategory, '') AS s FROM ledger WHERE batch_id = 8 AND category_source = 'llm' AND category IS NOT NULL AND category NOT IN ('Altro', 'Altre entrate') AND NOT {_IN.format('')} AND lower(description) NOT IN (SELECT lower(description) FROM declined) ORDER BY k, o, id)"


@query(oracle("SELECT id, CASE WHEN hit THEN c ELSE category END AS category, CASE WHEN hit THEN s ELSE subcategory END AS subcategory, CASE WHEN hit THEN 'llm' ELSE category_source END AS category_source FROM (SELECT l.*, a.c, a.s, coalesce(a.k IS NOT NULL AND category_source IN ('llm', 'nsi', 'history') AND NOT coalesce(human_validated, FALSE) AND tx_type NOT IN ('internal_out', 'internal_in') AND (coalesce(category, '') <> a.c OR coalesce(subcategory, '') <> a.s), FALSE) AS hit FROM ledger l LEFT JOIN ans a ON lower(l.description) = a.k AND (l.amount < 0) = a.o)", _PAST, ("declined",)))
def mut_rewrite_past(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    accepted = dimension(spark, "declined").withColumn("direction", F.lit(None).cast("string"))
    return op.rewrite_past(df, df.filter("batch_id = 8"), ("Altro", "Altre entrate"), accepted).select("id", "category", "subcategory", "category_source")


@query("SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'cold') AND p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'shop' END AS description FROM part")
def mut_rewrite_intermediary(spark: S, sf: str) -> D:
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, first).otherwise("shop").alias("description"), F.concat(first, F.lit(" *"), second).alias("raw_description"))
    return op.rewrite_intermediaries(rows, ["RED", "COLD"]).select("p_partkey", "description")


@query(oracle("SELECT id, CASE WHEN batch_id = 6 THEN 'Chosen' ELSE category END AS category, CASE WHEN batch_id = 6 THEN 'manual' ELSE category_source END AS category_source, coalesce(batch_id = 6 AND category_source IN ('rule', 'llm', 'nsi', 'history'), FALSE) AS corrected FROM ledger"))
def mut_category(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    out, log = op.choose_category(df, df.filter("batch_id = 6").select("id", F.lit("Chosen").alias("category"), F.lit("One").alias("subcategory")))
    return out.join(log.select("id", F.lit(True).alias("c")), "id", "left").select("id", "category", "category_source", F.coalesce("c", F.lit(False)).alias("corrected"))


@query(oracle("SELECT id, CASE WHEN account_label = 'ACC-2' THEN 'Travel' ELSE context END AS context FROM ledger"))
def mut_context(spark: S, sf: str) -> D:
    return op.set_context(ledger(spark, sf), F.col("account_label") == "ACC-2", "Travel").select("id", "context")


_OWN = f"keyed AS (SELECT *, {_SIG.format('')} AS sig FROM ledger), ref AS (SELECT DISTINCT ON (sig, o) sig, amount < 0 AS o, id AS rid, concat('Mine ', CAST(l_batch AS VARCHAR)) AS name, tx_type AS rt, category AS rc, subcategory AS rs, category_source AS rsrc, coalesce(category_source IN ('manual', 'rule'), FALSE) OR coalesce(human_validated, FALSE) AS decided FROM (SELECT *, batch_id AS l_batch FROM keyed) WHERE id IN (SELECT min(id) FROM ledger GROUP BY batch_id) AND sig <> '' ORDER BY sig, o, id)"
_OWN_HIT = f"""SELECT k.*, r.*, {_IN.format('r.')} AS inner_ FROM keyed k LEFT JOIN (SELECT *, rt AS tx_type FROM ref) r ON k.sig = r.sig AND (k.amount < 0) = r.o"""


@query(oracle(
    f"""SELECT id, CASE WHEN name IS NOT NULL THEN name ELSE description END AS description, CASE WHEN takes AND i THEN CASE WHEN amount < 0 THEN 'internal_out' ELSE 'internal_in' END ELSE tx_type END AS tx_type,
    CASE WHEN takes AND i THEN NULL WHEN takes AND rc IS NOT NULL THEN rc ELSE category END AS category,
    CASE WHEN takes AND i THEN NULL WHEN takes AND rc IS NOT NULL THEN CASE WHEN decided THEN 'rule' ELSE rsrc END ELSE category_source END AS category_source
    FROM (SELECT k.*, r.name, r.rc, r.rsrc, r.decided, coalesce(r.rt IN ('internal_out', 'internal_in'), FALSE) AS i,
      r.rid IS NOT NULL AND k.id <> r.rid AND NOT (coalesce(k.category_source = 'manual', FALSE) OR coalesce(k.human_validated, FALSE) OR {_IN.format('k.')}) AS takes FROM keyed k LEFT JOIN ref r ON k.sig = r.sig AND (k.amount < 0) = r.o)""", _OWN,
))
def mut_own_name(spark: S, sf: str) -> D:
    """The first row of each batch gets a name, for any amount of its direction."""
    df = ledger(spark, sf)
    named = df.groupBy("batch_id").agg(F.min("id").alias("id")).select("id", F.concat(F.lit("Mine "), F.col("batch_id").cast("string")).alias("name"))
    return op.own_name(df, named, any_amount=True).select("id", "description", "tx_type", "category", "category_source")


@query(oracle("SELECT a.id, b.id AS other_id, round(a.amount, 2) = round(b.amount, 2) AS same_amount FROM keyed a JOIN keyed b ON a.sig = b.sig AND (a.amount < 0) = (b.amount < 0) AND a.id <> b.id WHERE a.sig <> '' AND a.id IN (SELECT min(id) FROM ledger GROUP BY batch_id)", f"keyed AS (SELECT *, {_SIG.format('')} AS sig FROM ledger)"))
def op_same_movements(spark: S, sf: str) -> D:
    df = ledger(spark, sf)
    return op.same_movements(df, df.groupBy("batch_id").agg(F.min("id").alias("id")))


@query(oracle(f"SELECT name, n.signature, n.direction, CAST(coalesce(k, 0) AS BIGINT) AS n, coalesce(example, '') AS example FROM (VALUES ('Ring', 'small ring card', 'out'), ('Moved', 'transfer to', 'out'), ('Pay', 'salary building ref', 'in'), ('None', 'nothing here', 'out')) n(name, signature, direction) LEFT JOIN (SELECT {_SIG.format('')} AS signature, CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction, count(*) AS k, arg_min(raw_description, id) AS example FROM ledger GROUP BY 1, 2) s ON n.signature = s.signature AND n.direction = s.direction"))
def op_own_names_list(spark: S, sf: str) -> D:
    names = spark.createDataFrame([("Ring", "small ring card", "out"), ("Moved", "transfer to", "out"), ("Pay", "salary building ref", "in"), ("None", "nothing here", "out")], "name string, signature string, direction string")
    return op.own_name_list(ledger(spark, sf), names)


_GONE = "coalesce(account_label = 'ACC-1' AND date < DATE '2000-01-01', FALSE)"


@query(oracle(f"SELECT 'row' AS kind, id FROM ledger WHERE NOT {_GONE} UNION ALL SELECT 'link', out_id FROM links WHERE out_id NOT IN (SELECT id FROM gone) AND in_id NOT IN (SELECT id FROM gone)", f"{_LINKS}, gone AS (SELECT id FROM ledger WHERE {_GONE})"))
def mut_delete_filter(spark: S, sf: str) -> D:
    rows, links = op.delete(ledger(spark, sf), _links(spark, sf), (F.col("account_label") == "ACC-1") & (F.col("date") < "2000-01-01"))
    return rows.select(F.lit("row").alias("kind"), "id").unionByName(links.select(F.lit("link").alias("kind"), F.col("out_id").alias("id")))


_ENDS = "ans AS (SELECT out_id, in_id, CASE WHEN user_decision IS NULL THEN 'yes' ELSE 'no' END AS d FROM links WHERE user_decision IS NULL OR user_decision = 'yes'), ends AS (SELECT out_id AS id, 'internal_out' AS kind, d FROM ans UNION ALL SELECT in_id, 'internal_in', d FROM ans)"


@query(oracle("SELECT l.id, CASE WHEN d = 'yes' THEN kind ELSE tx_type END AS tx_type, CASE WHEN coalesce(d, '') <> 'no' THEN 'p' END AS transfer_pair_id FROM ledger l LEFT JOIN ends ON l.id = ends.id UNION ALL SELECT out_id, coalesce(ans.d, user_decision), 'link' FROM links LEFT JOIN ans USING (out_id, in_id)", f"{_LINKS}, {_ENDS}"))
def mut_decide_pair(spark: S, sf: str) -> D:
    """Open pairs are confirmed, confirmed ones undone."""
    links = _links(spark, sf)
    answers = op.open_links(links).select("out_id", "in_id", F.when(F.col("user_decision").isNull(), "yes").otherwise("no").alias("decision"))
    rows, after = op.decide_pairs(ledger(spark, sf).withColumn("transfer_pair_id", F.lit("p")), links, answers)
    return rows.select("id", "tx_type", "transfer_pair_id").unionByName(after.select(F.col("out_id").alias("id"), F.col("user_decision").alias("tx_type"), F.lit("link").alias("transfer_pair_id")))


@query(f"WITH {_LINKS} SELECT out_id, in_id FROM links WHERE user_decision IS NULL UNION SELECT out_id, in_id FROM links")
def op_links_create(spark: S, sf: str) -> D:
    links = _links(spark, sf)
    return op.create_links(links.filter("user_decision is null"), links).select("out_id", "in_id")


@query(f"WITH {_LINKS} SELECT out_id, in_id, CASE WHEN user_decision = 'no' THEN 'rejected' ELSE 'open' END AS state FROM links")
def op_pair_filters(spark: S, sf: str) -> D:
    links = _links(spark, sf)
    return op.open_links(links).select("out_id", "in_id", F.lit("open").alias("state")).unionByName(op.rejected_links(links).select("out_id", "in_id", F.lit("rejected").alias("state")))


@query(derived_oracle("SELECT dest_key, coalesce(n.answer, c.answer) AS answer FROM customer_answers c FULL JOIN new_answers n USING (dest_key)", "customer_answers", "new_answers"))
def op_destinations(spark: S, sf: str) -> D:
    """A destination's last answer replaces the one there was."""
    return op.upsert_by(derived(spark, sf, "customer_answers"), derived(spark, sf, "new_answers"), ["dest_key"])


@query(derived_oracle("SELECT pattern, match_type, direction, CASE WHEN priority % 5 = 0 THEN 'Gifts' ELSE category END AS category FROM part_rules WHERE priority % 7 <> 0 OR priority % 5 = 0 UNION ALL SELECT * FROM supplier_rules", "part_rules", "supplier_rules"))
def mut_rule_crud(spark: S, sf: str) -> D:
    """A rule is one by (pattern, match type, direction): some are deleted, some replaced (after that), others come in."""
    columns, rules = ["pattern", "match_type", "direction", "category"], derived(spark, sf, "part_rules")
    changed = rules.filter("priority % 5 = 0").withColumn("category", F.lit("Gifts")).select(columns)
    return op.upsert_by(rules.filter("priority % 7 <> 0").select(columns), changed.unionByName(derived(spark, sf, "supplier_rules")), columns[:3])


@query(derived_oracle("SELECT category, coalesce(n.target_pct, b.target_pct) AS target_pct FROM (SELECT * FROM part_budget WHERE target_pct <> 0) b FULL JOIN new_budget n USING (category)", "part_budget", "new_budget"))
def mut_budget(spark: S, sf: str) -> D:
    """Targets of zero are deleted, then targets are set."""
    return op.upsert_by(derived(spark, sf, "part_budget").filter("target_pct <> 0"), derived(spark, sf, "new_budget"), ["category"])


@query(oracle("SELECT id, CASE category WHEN 'Income BUILDING' THEN 'Site' WHEN 'Income MACHINERY' THEN NULL ELSE category END AS category, CASE WHEN category <> 'Income MACHINERY' OR category IS NULL THEN subcategory END AS subcategory FROM ledger"))
def mut_taxonomy(spark: S, sf: str) -> D:
    new = spark.createDataFrame([("Income BUILDING", "Site"), ("Income MACHINERY", None)], "category string, new_category string")
    return op.rename_categories(ledger(spark, sf), new).select("id", "category", "subcategory")


@query(oracle("SELECT id, CASE WHEN day(date) <= 12 AND day(date) <> month(date) AND make_date(year(date), day(date), month(date)) <= DATE '2000-06-30' THEN make_date(year(date), day(date), month(date)) END AS suggested FROM ledger WHERE date > DATE '2000-06-30'"))
def op_held_rows(spark: S, sf: str) -> D:
    today = F.lit("2000-06-30").cast("date")
    return ledger(spark, sf).filter(F.col("date") > today).select("id", dates.swapped(F.col("date"), today).alias("suggested"))


@query(oracle("SELECT description, CASE WHEN count(*) > 1 THEN round(-sum(n / t * log2(n / t)) / log2(count(*)), 6) ELSE 0.0 END AS entropy FROM (SELECT description, n, sum(n) OVER (PARTITION BY description)::DOUBLE AS t FROM (SELECT description, category, count(*) AS n FROM ledger WHERE category IS NOT NULL GROUP BY 1, 2)) GROUP BY 1"))
def fn_entropy(spark: S, sf: str) -> D:
    counts = ledger(spark, sf).filter("category is not null").groupBy("description", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("description").agg(F.collect_list("n").alias("ns")).select("description", F.round(op.entropy(F.col("ns")), 6).alias("entropy"))


@query("SELECT o_orderkey, date_trunc('month', CAST(o_orderdate AS DATE))::DATE - INTERVAL 4 MONTH AS start_day FROM orders")
def fn_window_start(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").select("o_orderkey", dates.window_start(F.col("o_orderdate").cast("date")).cast("timestamp").alias("start_day"))
