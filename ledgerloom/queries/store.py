"""Queries: imports stored as commits, and the ledger's streams, on the ledger of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..storage import Workspace
from ..streaming import ledger as streams
from .common import ledger, oracle, query
from .joins import _CAND

S, D = SparkSession, DataFrame
_TODAY = "2001-01-01"
_RECS = """o AS (SELECT id, tx_type, source_file, date, regexp_extract(id, '^s-([0-9]+)-', 1) AS k FROM ledger WHERE id LIKE 's-%'),
recs AS (SELECT a.id AS settlement_id, b.id AS detail_id FROM o a JOIN o b ON a.k = b.k WHERE a.tx_type = 'card_settlement' AND b.tx_type = 'card_tx' AND a.date <= DATE '2001-01-01' AND b.date <= DATE '2001-01-01'),
pairs AS (SELECT x.id AS out_id, i.id AS in_id FROM ledger x JOIN ledger i ON i.id = concat('i', substr(x.id, 2)) WHERE x.id LIKE 'x-%' AND x.date <= DATE '2001-01-01' AND i.date <= DATE '2001-01-01')"""


@query(
    oracle(
        "SELECT 'row' AS place, id, CAST(reconciled OR id IN (SELECT settlement_id FROM recs UNION ALL SELECT detail_id FROM recs) AS BIGINT) AS n FROM ledger WHERE date <= DATE '2001-01-01' UNION ALL SELECT 'held', id, 0 FROM ledger WHERE date > DATE '2001-01-01' "
        "UNION ALL SELECT 'file', source_file, count(*) FROM ledger GROUP BY source_file UNION ALL SELECT 'transfer', concat(out_id, ' ', in_id), 0 FROM pairs UNION ALL SELECT 'settlement', concat(settlement_id, ' ', detail_id), 0 FROM recs",
        _RECS,
    )
)
def snk_persist(spark: S, sf: str) -> D:
    """Two imports whose files overlap, read back: the second one's stored files are left out."""
    rows = Workspace(spark, "imports").save(ledger(spark, sf), "ledger").withColumn("sha256", F.sha2("source_file", 256))  # read many times
    spend = rows.filter("id like 's-%'").select("id", "tx_type", "sha256", F.split("id", "-")[1].alias("k"))
    a = spend.filter("tx_type = 'card_settlement'").select("k", "sha256", F.col("id").alias("settlement_id"))
    b = spend.filter("tx_type = 'card_tx'").select("k", F.col("id").alias("detail_id"))
    settlements = a.join(b, "k").select("sha256", "settlement_id", "detail_id", F.lit(0.0).alias("delta"), F.lit("order").alias("method"))
    x = rows.filter("id like 'x-%'").select("sha256", F.col("id").alias("out_id"), F.concat(F.lit("i"), F.expr("substr(id, 2)")).alias("in_id"), F.lit("low").alias("confidence"))
    transfers = x.join(rows.select(F.col("id").alias("in_id")), "in_id", "left_semi")
    kept = store.Store(spark, Workspace(spark, "store").root)
    today, early = F.lit(_TODAY).cast("date"), rows.filter("batch_id < 12 and source_file <> 'file-again.csv'")
    files = early.select("sha256").distinct()
    store.persist(kept, early, transfers.join(files, "sha256", "left_semi"), settlements.join(files, "sha256", "left_semi"), today)
    store.persist(kept, rows.filter("batch_id >= 8 or source_file = 'file-again.csv'"), transfers, settlements, today)
    part = lambda place, df, key, n: df.select(F.lit(place).alias("place"), key.alias("id"), n.cast("long").alias("n"))
    none = F.lit(0)
    out = part("row", kept.ledger(), F.col("id"), F.col("reconciled")).unionByName(part("held", kept.read("held"), F.col("id"), none)).unionByName(part("file", kept.read("batches"), F.col("filename"), F.col("n_transactions")))
    out = out.unionByName(part("transfer", kept.read("transfers"), F.concat_ws(" ", "out_id", "in_id"), none))
    return out.unionByName(part("settlement", kept.read("settlements"), F.concat_ws(" ", "settlement_id", "detail_id"), none))


@query(oracle("SELECT id, CASE WHEN date > DATE '2001-01-01' THEN 'held' ELSE 'ledger' END AS place FROM ledger"))
def stream_ingest(spark: S, sf: str) -> D:
    """Files that arrive in three turns, many of them twice; the stream is started anew each turn."""
    space = Workspace(spark, "ingest")
    df = space.save(ledger(spark, sf), "ledger")  # read every turn
    inbox, today = streams.Inbox(space, df), F.lit(_TODAY).cast("date")
    for arrived in ("batch_id < 9", "batch_id between 6 and 14", "batch_id >= 12 or batch_id = 0"):
        inbox.land(df.filter(arrived))
        rows, held = streams.ingest(inbox.stream(), space, today)
    return rows.select("id", F.lit("ledger").alias("place")).unionByName(held.select("id", F.lit("held").alias("place")))


@query(oracle("SELECT * FROM cand", _CAND))
def stream_pairs(spark: S, sf: str) -> D:
    """Rows that arrive two years at a time; the join goes on from its checkpoint each turn."""
    space = Workspace(spark, "pairs")
    df = space.save(ledger(spark, sf).select("id", "date", "amount", "account_label", "tx_type"), "rows")  # read every turn
    inbox, found = streams.Inbox(space, df), None
    first, last = df.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    for year in range(first or 0, (last or 0) + 1, 2):
        inbox.land(df.filter(F.year("date").between(year, year + 1)))
        found = streams.pair_arrivals(inbox.stream(), space)
    return found
