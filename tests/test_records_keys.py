"""Keys of bank texts on odd texts, and how often the ledger is read for the few rows that are asked for."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import records


def test_ascii_keys_equal_the_general_ones(spark):
    rng = random.Random(5)
    odd = ["", " ", "'", "a'b", "a''b", "S R L", " s r l 1 ", "a 'b c' d", "x1 b2", "É", "á b", "ß S’A", None, "a\tb\nc d", "A B\x1fC", "1 a b 2"]
    texts = odd + ["".join(rng.choice("aB1 '’.-\té") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.coalesce("t", F.lit(""))
    kept = F.filter(F.split(tx._any_key(tx.tidy("t")), " "), lambda w: (w != "") & ~w.rlike("[0-9]"))
    wanted = [tx._any_key(t), F.array_join(kept, " "), F.when(F.size(kept) >= 2, F.array_join(kept, " ")).otherwise("")]
    got = [tx.exact_key("t"), tx.raw_signature("t", 1), tx.raw_signature("t", 2)]
    for r in df.select("t", F.array(*got).alias("got"), F.array(*wanted).alias("wanted")).collect():
        assert r["got"] == r["wanted"], r["t"]


def _counted(spark):
    """Rows of a ledger, and how many of them were read."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    data = [(f"r{i}", f"SHOP {'AB'[i % 2]} {i}", -1.0 - i, "expense", None, None, None, False) for i in range(20)]
    df = spark.createDataFrame(data, "id string, raw_description string, amount double, tx_type string, category string, subcategory string, category_source string, human_validated boolean")
    df = df.withColumn("amount", F.col("amount").cast("decimal(18,4)")).withColumn("description", F.col("raw_description"))
    return df.mapInArrow(run, df.schema), reads


def test_own_name_reads_the_ledger_twice(spark):
    df, reads = _counted(spark)
    named = spark.createDataFrame([("r0", "Mine"), ("gone", "None")], "id string, name string")
    got = {r["id"] for r in records.own_name(df, named, any_amount=True).filter("description = 'Mine'").collect()}
    assert got == {f"r{i}" for i in range(0, 20, 2)}
    assert reads.value == 40


def test_same_movements_read_the_ledger_twice(spark):
    df, reads = _counted(spark)
    got = {(r["id"], r["other_id"]) for r in records.same_movements(df, spark.createDataFrame([("r1",)], "id string")).collect()}
    assert got == {("r1", f"r{i}") for i in range(3, 20, 2)}
    assert reads.value == 40
