"""How the ledger's joins are dealt over tasks."""

from pyspark.sql import functions as F

from ledgerloom.plans import ledger as plan

SF = "/root/testdata/sf0.01"


def test_large_joins_are_dealt_by_rows(spark, monkeypatch):
    whole = plan.ledger(spark, SF)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    before = digest(whole)
    monkeypatch.setattr(plan, "OWN_CHOICE", 1_000)
    monkeypatch.setattr(plan, "TASK_ROWS", 2_000)
    dealt = plan.ledger(spark, SF)
    assert digest(dealt) == before
    spend = dealt.filter(F.col("id").startswith("s-")).groupBy(F.spark_partition_id()).count()
    assert spend.agg(F.max("count")).first()[0] < 4_000 and spend.count() > 20


def test_small_joins_keep_their_broadcast(spark):
    given = {t: plan.table(spark, SF, t) for t in plan.TABLES}
    assert plan._dealt(given) == given
