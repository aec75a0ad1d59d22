"""Counterparts: how often their rows are read."""

from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as op


def test_counterparts_read_their_rows_once(spark, tmp_path):
    rows = [("Bar Rex", "Food", "Bars", "llm", "expense", -2), ("BAR, REX", None, None, None, None, -3), ("bar rex", "Food", None, "manual", "internal_out", -4), ("Bar rex", "Home", "Bars", "multi", "internal_in", None), ("..", "Food", "Bars", "llm", "expense", -1)]
    spark.createDataFrame(rows, "description string, category string, subcategory string, category_source string, tx_type string, amount int").withColumn("amount", F.col("amount").cast("decimal(18,4)")).write.parquet(f"{tmp_path}/rows")
    out = op.counterparts(spark.read.parquet(f"{tmp_path}/rows"))
    assert all("/counterparts-" in f for f in out.inputFiles())
    assert out.collect() == [("bar rex", 4, 9.0, 2.25, "mixed", "mixed", 1, True, False, 1, "Food", 2, 2, None)]
