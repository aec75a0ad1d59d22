"""Mixing against a sequential earliest-deadline-first pass over exact fractions."""

import math
import random
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import pytest

from ledgerloom.llm import mixing
from ledgerloom.llm.common import Workspace

SCHEMA = "id long, source string"


def flow(blocks, w):
    """T of the docstring, as a function of an exact fraction, and its inverse by source: target(i, slot)."""
    order = sorted(w, key=lambda s: Fraction(blocks[s], w[s]))
    bends, c, rate = [(Fraction(0), 0, sum(w.values()))], 0, sum(w.values())
    for s in order:
        c, rate = c + blocks[s], rate - w[s]
        bends.append((Fraction(blocks[s], w[s]), c, rate))

    def t(v):
        _, c, rate = [b for b in bends if b[0] <= v][-1]
        return c + v * rate

    def target(s, slot):
        v, c, rate = [b for b in bends if t(b[0]) <= slot][-1]
        v = v if rate == 0 else Fraction(slot - c, rate)
        return min(Fraction(blocks[s]), w[s] * v)

    return t, target


def sequential(blocks, w):
    """[(source, k)] by slot; sources are keys in their order."""
    t, _ = flow(blocks, w)
    at, k = list(w), dict.fromkeys(w, 0)
    job = lambda s: (math.ceil(t(Fraction(k[s] + 1, w[s]))), at.index(s), math.floor(t(Fraction(k[s], w[s]))))
    jobs, out = {s: job(s) for s in at if blocks[s]}, []
    for slot in range(sum(blocks.values())):
        due, i, _ = min(j for j in jobs.values() if j[2] <= slot)
        s = at[i]
        assert slot < due
        out.append((s, k[s]))
        k[s] += 1
        if k[s] < blocks[s]:
            jobs[s] = job(s)
        else:
            del jobs[s]
    return out


def deviation(picks, blocks, w):
    _, target = flow(blocks, w)
    done, most = Counter(), Fraction(0)
    for slot, (s, _) in enumerate(picks, 1):
        done[s] += 1
        most = max(most, max(abs(done[x] - target(x, slot)) for x in w))
    return most


@pytest.mark.parametrize("seed,slots", [(1, 64), (2, 100), (3, 50), (4, 4096)])
def test_schedule_is_the_sequential_one(spark, seed, slots):
    rng = random.Random(seed)
    names = [f"s{i:02}" for i in range(rng.choice([1, 3, 8, 15]))]
    blocks = {s: rng.randint(1, 120) for s in names}
    w = {s: rng.choice([1, 7, 7, 300, rng.randint(1, 9999)]) for s in names}
    df = spark.createDataFrame([(i, blocks[s], Decimal(w[s])) for i, s in enumerate(names)], "i int, blocks long, w decimal(19,0)")
    got = sorted((r["slot"], names[r["i"]], r["k"]) for r in mixing.schedule(df, Workspace(spark, "t"), slots).collect())
    want = sequential(blocks, w)
    assert [x[0] for x in got] == list(range(len(want)))
    assert [x[1:] for x in got] == want
    assert deviation(want, blocks, w) < 1


def test_small_weight_keeps_its_share(spark):
    """Weights 0.001 to 0.9 over more than 10,000 slots: no rounding of shares."""
    w = {"a": 900_000, "b": 99_000, "c": 1_000}
    blocks = {"a": 9_500, "b": 900, "c": 12}
    df = spark.createDataFrame([(i, blocks[s], Decimal(w[s])) for i, s in enumerate(w)], "i int, blocks long, w decimal(19,0)")
    got = sorted((r["slot"], "abc"[r["i"]], r["k"]) for r in mixing.schedule(df, Workspace(spark, "t")).collect())
    assert [x[0] for x in got] == list(range(10_412))
    assert deviation([x[1:] for x in got], blocks, w) < 1


def test_rows_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 7, i]), rng.choice([None, "x", "x", "x", "y"]), i) for i in range(900)]
    rows += [rows[0]] * 40
    df = spark.createDataFrame(rows, "id long, source string, n long").withColumnsRenamed({"n": "prefix"})
    weights = spark.createDataFrame([("x", 0.9), (None, 0.001), ("x", 0.05), ("z", 0.3), ("y", -1.0)], "source string, weight double")
    got = mixing.mix(df, ["prefix"], weights, block_rows=4, prefix_rows=20, slice_slots=32, ties=["prefix"]).collect()
    assert sorted(map(str, ((r["id"], r["source"], r["prefix"]) for r in got))) == sorted(map(str, rows))
    counts = Counter(r[1] for r in rows)
    names = [None, "x", "y"]
    blocks = {s: -(-counts[s] // 4) for s in names}
    want = sequential(blocks, {None: 1_000, "x": 950_000, "y": 1_000})
    spots = sorted((r["slot"], r["place"], r["source"], r["block"]) for r in got if r["place"] == 0)
    assert [(s[2], s[3]) for s in spots] == want
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)


def test_many_equal_sources_leave_no_hole(spark):
    rows = [(i, f"s{i % 100}") for i in range(9_000) if i % 100 < 50 or i < 3_000]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), []).select("slot").distinct().collect()
    assert sorted(r[0] for r in got) == list(range(len(got)))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df, []).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string, source string, slot long")
    assert mixing.order(docs).collect() == [] and mixing.order(docs).columns == docs.columns


def test_written_files_are_in_the_order_of_the_mix(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, f"text {i}", rng.choice("aab"), i) for i in range(500)], "doc_id long, text string, source string, __row long")
    spots = {r["id"]: (r["slot"], r["place"]) for r in mixing.mix(docs.select("doc_id", "source").toDF("id", "source"), []).collect()}
    mixing.order(docs).write.parquet(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    import pyarrow.parquet as pq

    got = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert got == sorted(spots, key=spots.get)
