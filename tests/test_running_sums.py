"""Running sums by buckets against a plain running sum."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import windows as op


@pytest.mark.parametrize("down", [False, True])
def test_running_sum(spark, down):
    r = random.Random(2)
    rows = [(k, Decimal(r.choice([0, 1, r.randrange(1, 10**8), r.randrange(1, 300)])) / 100) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, v decimal(18,2)")
    bucket = op.log_bucket(F.col("v"))
    got = op.running_sum(df, -bucket if down else bucket, [F.desc("v") if down else "v", "k"], F.col("v"))
    want, upto = {}, Decimal(0)
    for k, v in sorted(rows, key=lambda x: (-x[1] if down else x[1], x[0])):
        upto += v
        want[k] = upto
    assert {x["k"]: x["upto"] for x in got.collect()} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, v decimal(18,2)")
    assert op.running_sum(df, op.log_bucket(F.col("v")), ["v", "k"], F.col("v")).count() == 0
