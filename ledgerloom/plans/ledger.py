"""The ledger as a view over the driver's tables, and the small dimension tables.

The view is one text that Spark and the SQL oracle both run, so both see the same rows. Its parts: spending rows (line items),
income rows (orders), mirrored transfers (some orders again with the opposite sign on the next account), twins (some line
items again from another file with a longer text) and exact duplicates on another account.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..storage import TASK_ROWS, table

_COLUMNS = "id, batch_id, date, amount, currency, description, raw_description, source_file, doc_type, account_label, tx_type, category, subcategory, category_source, context, reconciled, to_review, human_validated, transfer_pair_id, created_at"

_SPEND = """
SELECT concat('s-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id,
  CAST(o_custkey % 20 AS BIGINT) AS batch_id, CAST(l_shipdate AS DATE) AS date, CAST(-l_extendedprice AS DECIMAL(18,4)) AS amount, 'EUR' AS currency,
  concat(p_name, ' ', replace(p_brand, '#', ' ')) AS description, concat(upper(p_name), ' CARD ', CAST(l_orderkey % 1000 AS STRING)) AS raw_description,
  concat('file-', CAST(o_custkey % 20 AS STRING), '.csv') AS source_file, CASE WHEN o_custkey % 7 < 2 THEN 'credit_card' ELSE 'bank_account' END AS doc_type,
  concat('ACC-', CAST(o_custkey % 7 AS STRING)) AS account_label,
  CASE WHEN l_returnflag = 'R' THEN 'card_tx' WHEN l_orderkey % 17 = 0 THEN 'card_settlement' WHEN l_orderkey % 19 = 0 THEN 'aggregate_debit'
    WHEN l_orderkey % 23 = 0 THEN 'internal_out' WHEN l_orderkey % 29 = 0 THEN 'unknown' WHEN l_orderkey % 31 = 0 THEN CAST(NULL AS STRING) ELSE 'expense' END AS tx_type,
  CASE WHEN l_orderkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS category, CASE WHEN l_orderkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END AS subcategory,
  CASE l_linenumber WHEN 1 THEN 'manual' WHEN 2 THEN 'rule' WHEN 3 THEN 'llm' WHEN 4 THEN 'nsi' WHEN 5 THEN 'history' WHEN 6 THEN 'multi' ELSE CAST(NULL AS STRING) END AS category_source,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE substr(o_orderpriority, 3) END AS context, l_orderkey % 37 = 0 AS reconciled, o_custkey % 3 = 0 AS to_review,
  CASE WHEN l_linestatus = 'F' THEN TRUE WHEN l_linenumber = 1 THEN CAST(NULL AS BOOLEAN) ELSE FALSE END AS human_validated,
  CAST(NULL AS STRING) AS transfer_pair_id, CAST(o_orderdate AS DATE) AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""

_INCOME = """
SELECT concat('i-', CAST(o_orderkey AS STRING)) AS id, CAST(o_custkey % 20 AS BIGINT) AS batch_id, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,4)) AS amount, 'EUR' AS currency,
  concat('Salary ', c_mktsegment) AS description, concat('SALARY ', c_mktsegment, ' REF ', CAST(o_orderkey % 1000 AS STRING)) AS raw_description,
  concat('file-', CAST(o_custkey % 20 AS STRING), '.csv') AS source_file, 'bank_account' AS doc_type, concat('ACC-', CAST(o_custkey % 7 AS STRING)) AS account_label,
  CASE WHEN o_orderkey % 22 = 0 THEN 'internal_in' ELSE 'income' END AS tx_type, concat('Income ', c_mktsegment) AS category, 'Salary' AS subcategory,
  CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'history' END AS category_source, CAST(NULL AS STRING) AS context, FALSE AS reconciled, o_orderkey % 5 = 0 AS to_review,
  o_orderstatus = 'F' AS human_validated, CAST(NULL AS STRING) AS transfer_pair_id, CAST(o_orderdate AS DATE) AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

_MIRROR = """
SELECT concat('x-', CAST(o_orderkey AS STRING)) AS id, CAST(o_custkey % 20 AS BIGINT) AS batch_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 8 AS INT) AS date,
  CAST(-o_totalprice AS DECIMAL(18,4)) AS amount, 'EUR' AS currency, 'Transfer' AS description, concat('TRANSFER TO IT60X0542811101', CAST(100000000 + o_custkey AS STRING)) AS raw_description,
  concat('file-', CAST(o_custkey % 20 AS STRING), '.csv') AS source_file, 'bank_account' AS doc_type, concat('ACC-', CAST((o_custkey + 1) % 7 AS STRING)) AS account_label,
  CASE WHEN o_orderkey % 33 = 0 THEN 'internal_out' ELSE 'expense' END AS tx_type, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS subcategory, CAST(NULL AS STRING) AS category_source,
  CAST(NULL AS STRING) AS context, FALSE AS reconciled, TRUE AS to_review, FALSE AS human_validated, CAST(NULL AS STRING) AS transfer_pair_id, CAST(o_orderdate AS DATE) AS created_at
FROM {orders} WHERE o_orderkey % 11 = 0"""

_AGAIN = """
SELECT concat('t', substr(id, 2)) AS id, batch_id, date, amount, currency, description, CASE WHEN batch_id % 2 = 0 THEN concat(raw_description, ' MILANO') ELSE raw_description END AS raw_description,
  'file-again.csv' AS source_file, doc_type, CASE WHEN batch_id % 2 = 0 THEN account_label ELSE 'ACC-COPY' END AS account_label, tx_type, category, subcategory, category_source, context,
  reconciled, to_review, FALSE AS human_validated, transfer_pair_id, created_at
FROM spend WHERE CAST(amount * 100 AS BIGINT) % 40 = 0"""

_PARTS = {"spend": _SPEND, "income": _INCOME, "mirror": _MIRROR, "again": _AGAIN}
TABLES = ("lineitem", "orders", "part", "customer")

_CTES = ", ".join(f"{name} AS ({text})" for name, text in _PARTS.items())
_UNION = " UNION ALL ".join(f"SELECT {_COLUMNS} FROM {name}" for name in _PARTS)
_TEXT = f"{_CTES}, ledger AS ({_UNION})"

#: For oracles: common table expressions that end with ``ledger``.
LEDGER_SQL = f"{_CTES}, ledger AS MATERIALIZED ({_UNION})".format(**{t: t for t in TABLES})


#: Rows of a table that others are joined to, up to which Spark's own choice of join stays.
OWN_CHOICE = 2_000_000
#: By table: the key it is dealt by, and the table whose rows its join deals too.
_DEALT = {"lineitem": ("l_orderkey", "lineitem"), "part": ("p_partkey", "lineitem"), "customer": ("c_custkey", "orders")}


def _dealt(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, with the sides of large joins dealt over so many tasks that none sorts much more than TASK_ROWS rows.

    The other side of a join is then dealt alike. Left to itself a sort gets as many rows as fit into a partition's bytes, some ten
    millions of these narrow rows. Only joins whose both sides are large are merged; others keep their broadcast.
    """
    rows = {"lineitem": tables["lineitem"].count()}
    if rows["lineitem"] <= OWN_CHOICE:
        return tables
    rows |= {t: tables[t].count() for t in TABLES if t != "lineitem"}
    least = int(tables["lineitem"].sparkSession.conf.get("spark.sql.shuffle.partitions"))  # Spark takes up no smaller number
    out = dict(tables)
    for name, (key, longer) in _DEALT.items():
        if rows["orders" if name == "lineitem" else name] > OWN_CHOICE:
            out[name] = tables[name].repartition(max(least, rows[longer] // TASK_ROWS + 1), key).hint("merge")
    return out


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_TEXT} SELECT * FROM ledger", **_dealt({t: table(spark, sf_dir, t) for t in TABLES}))


#: Small dimension tables, as VALUES that both engines read.
DIMENSIONS = {
    "rules": (
        "rule_id, pattern, match_type, direction, doc_type, category, subcategory, priority, multi",
        "(1, 'small ring', 'starts_with', NULL, NULL, 'Jewels', 'Rings', 10, FALSE), (2, 'widget', 'contains', 'out', NULL, 'Tools', 'Widgets', 5, FALSE), (3, 'red bolt brand 4', 'exact', NULL, NULL, 'Tools', 'Bolts', 20, FALSE), "
        "(4, '^(old|new) g(ear|izmo)', 'regex', NULL, NULL, 'Machines', 'Gear', 7, FALSE), (5, 'salary', 'starts_with', 'in', NULL, 'Income', 'Salary', 1, FALSE), (6, 'anvil', 'contains', NULL, 'credit_card', 'Tools', 'Anvils', 3, FALSE), "
        "(7, 'cold', 'contains', NULL, NULL, 'Various', 'Various', 1, TRUE), (8, 'widget', 'contains', 'in', NULL, 'Refunds', 'Widgets', 5, FALSE)",
    ),
    "brands": (
        "brand_idx, pattern, tag, countries",
        "(1, '^small ring', 'shop=jewelry', 'IT,FR'), (2, 'ring', 'shop=jewelry', '001'), (3, '^hot ', 'amenity=fast_food', '150'), (4, '^cold ', 'shop=frozen_food', 'US'), (5, 'anvil', 'craft=blacksmith', '001'), (6, '^red ', 'shop=paint', 'IT')",
    ),
    "brand_taxonomy": ("tag, category, subcategory", "('shop=jewelry', 'Leisure', 'Jewels'), ('amenity=fast_food', 'Food', 'Restaurants'), ('craft=blacksmith', 'Home', 'Works'), ('shop=paint', 'Home', 'Paint')"),
    "taxonomy": (
        "direction, category, subcategory, sort_order, is_fallback",
        "('out', 'ECONOMY', 'Brand#1', 1, FALSE), ('out', 'ECONOMY', 'Brand#2', 2, FALSE), ('out', 'MEDIUM', 'Brand#1', 1, FALSE), ('out', 'Altro', 'Various', 1, FALSE), ('out', 'Altro', 'Spese non classificate', 2, TRUE), "
        "('in', 'Income', 'Salary', 1, FALSE), ('in', 'Altre entrate', 'Gifts', 1, FALSE), ('in', 'Altre entrate', 'Entrate non classificate', 2, TRUE), ('both', 'PROMO', 'Brand#3', 1, FALSE)",
    ),
    "budget": ("category, target_pct", "('ECONOMY', 18.0), ('MEDIUM', 12.5), ('LARGE', 30.0), ('Housing', 10.0), ('STANDARD', 0.4)"),
    "benchmark_shares": ("category, share, per_capita", "('ECONOMY', 22.0, TRUE), ('MEDIUM', 11.0, FALSE), ('LARGE', 40.0, FALSE), ('PROMO', 2.0, TRUE), ('Housing', 25.0, FALSE)"),
    "intermediaries": ("prefix", "('RED'), ('COLD PLATE'), ('COLD')"),
    "destination_answers": ("dest_key, answer", "('IT60X0542811101100000011', 'other_person'), ('IT60X0542811101100000022', 'mine'), ('IT60X0542811101100000033', 'other_person')"),
    "closed_accounts": ("account_label, closed_on", "('ACC-3', DATE '2001-03-31'), ('ACC-5', DATE '2001-07-15')"),
    "declined": ("description", "('red bolt Brand 4'), ('Salary MACHINERY')"),
    "owner_names": ("name", "('Small Ring'), ('Gizmo Old')"),
}


def dimension_sql(name: str) -> str:
    columns, values = DIMENSIONS[name]
    return f"SELECT * FROM (VALUES {values}) AS t({columns})"


def dimension(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(dimension_sql(name))


#: Dimensions that grow with the given tables, as one text that both engines read.
DERIVED = {
    "part_rules": "SELECT min(p_partkey) AS rule_id, lower(concat(p_name, ' ', replace(p_brand, '#', ' '))) AS pattern, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'starts_with' END AS match_type, "
    "CASE p_partkey % 3 WHEN 0 THEN 'out' WHEN 1 THEN 'in' END AS direction, min(p_type) AS category, CAST(max(p_size) AS BIGINT) AS priority FROM {part} GROUP BY 2, 3, 4",
    "supplier_rules": "SELECT lower(s_name) AS pattern, 'contains' AS match_type, 'out' AS direction, 'Suppliers' AS category FROM {supplier} GROUP BY 1",
    "supplier_brands": "SELECT s_suppkey AS brand_idx, lower(s_name) AS pattern, concat(n_name, ',', r_name) AS countries FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "part_prefixes": "SELECT DISTINCT upper(p_name) AS prefix FROM {part} WHERE length(p_name) % 3 = 0",
    "part_taxonomy": "SELECT CASE WHEN length(p_type) % 2 = 0 THEN 'out' ELSE 'in' END AS direction, p_type AS category, p_brand AS subcategory, min(p_partkey) AS sort_order, min(p_partkey) % 3 = 0 AS is_fallback FROM {part} GROUP BY p_type, p_brand",
    "part_budget": "SELECT concat(p_type, ' ', p_brand) AS category, CAST(count(*) % 40 AS DOUBLE) AS target_pct FROM {part} GROUP BY 1",
    "new_budget": "SELECT CASE WHEN p_size % 2 = 0 THEN p_type ELSE concat(p_type, ' ', p_brand) END AS category, CAST(max(p_size) AS DOUBLE) AS target_pct FROM {part} WHERE p_size > 40 GROUP BY 1",
    "customer_answers": "SELECT concat('IT60X0542811101', CAST(100000000 + c_custkey AS STRING)) AS dest_key, CASE WHEN c_custkey % 3 = 0 THEN 'mine' ELSE 'other_person' END AS answer FROM {customer} WHERE c_custkey % 2 = 0",
    "new_answers": "SELECT concat('IT60X0542811101', CAST(100000000 + c_custkey AS STRING)) AS dest_key, 'mine' AS answer FROM {customer} WHERE c_custkey % 5 = 0",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = re.findall(r"\{(\w+)\}", DERIVED[name])
    return spark.sql(DERIVED[name], **{t: table(spark, sf_dir, t) for t in tables})


def derived_oracle(select: str, *names: str) -> str:
    """Oracle text over derived dimensions alone."""
    return f"WITH {', '.join(f'{n} AS ({re.sub(r"[{}]", "", DERIVED[n])})' for n in names)} {select}"


def oracle(select: str, ctes: str = "", dims: tuple[str, ...] = ()) -> str:
    """Oracle text: the ledger, the named dimensions, more common table expressions, the final select."""
    parts = [LEDGER_SQL, *[f"{d} AS ({dimension_sql(d)})" for d in dims], *([ctes] if ctes else [])]
    return f"WITH {', '.join(parts)} {select}"
