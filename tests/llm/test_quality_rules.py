"""Quality rules against a plain version: base measures, weights, scores and verdicts; odd rows, empty tables, clashing columns."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules as q

BUCKETS = 64
SCHEMA = "doc_id long, text string, one string, __x int"
GOOD = "the quick fox runs " + " ".join(f"w{i} of" for i in range(40)) + " the quick fox"
ROWS = [
    (1, GOOD), (2, GOOD + "\nmore plain prose about rivers"), (3, "spam " * 80), (4, "buy now cheap " * 30), (5, None), (6, ""), (7, " \n\t\x0b"), (8, "a b c"), (9, GOOD), (9, GOOD), (None, GOOD + " extra"),
    (10, "line one here\nline one here\n\nline two\nline one here " + GOOD), (11, "#$ % <| " + GOOD), (12, "zeta " + " ".join(f"z{i} qq{i}" for i in range(60))), (13, " ".join(f"u{i % 977}" for i in range(60_000))), (14, "a b " * 60), (15, "x y z " * 9 + "p q r s t u " * 9 + GOOD),
]
TARGET = [1, 2, 9, 99]


def grams(text):
    ws = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return ws, [(w,) for w in ws] + list(zip(ws, ws[1:], strict=False))


def base(text):
    ws, _ = grams(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def buckets(spark):
    """The bucket of each n-gram; the hash itself is the engine's."""
    every = sorted({g for _, t in ROWS for g in grams(t)[1]})
    df = spark.createDataFrame([(list(g),) for g in every], "g array<string>")
    value = F.when(F.size("g") == 1, F.xxhash64(F.get("g", F.lit(0)))).otherwise(F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1))))
    return {tuple(r["g"]): r["b"] for r in df.select("g", F.pmod(value, F.lit(BUCKETS)).alias("b")).collect()}


def plain(buckets, threshold):
    raw, target = Counter(), Counter()
    for i, t in ROWS:
        found = [buckets[g] for g in grams(t)[1]]
        raw.update(found)
        if i in TARGET:
            target.update(found)
    flat = q.SMOOTHING * BUCKETS
    ratio = lambda b: math.log((target[b] + q.SMOOTHING) / (target.total() + flat)) - math.log((raw[b] + q.SMOOTHING) / (raw.total() + flat))
    weight = [math.floor(abs(ratio(b)) * q.UNIT + 0.5) * (1 if ratio(b) > 0 else -1) for b in range(BUCKETS)]
    out = []
    for i, t in ROWS:
        b, found = base(t), [buckets[g] for g in grams(t)[1]]
        total = sum(weight[x] for x in found)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((i, *b, failed, total / len(found) / q.UNIT if found else 0.0, not failed and total >= math.floor(len(found) * threshold * q.UNIT)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("threshold", [-0.25, 0.1])
def test_scores_and_verdicts(spark, docs, buckets, threshold):
    ids = spark.createDataFrame([(i,) for i in TARGET], "doc_id long")
    got = order(tuple(r) for r in q.measures(docs, ids, buckets=BUCKETS, threshold=threshold).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept").collect())
    want = order(plain(buckets, threshold))
    for g, w in zip(got, want, strict=True):
        assert (*g[:7], g[8]) == (*w[:7], w[8]) and g[7] == pytest.approx(w[7], abs=1e-9), g
    assert {w[8] for w in want} == {True, False}


def test_many_and_few_repeated_windows_agree(docs, monkeypatch):
    def found():
        return sorted((str(r["doc_id"]), r["n_repeat_words"]) for r in q.base_measures(docs).collect())

    few = found()
    monkeypatch.setattr(q, "FEW", 0)
    assert found() == few == sorted((str(i), base(t)[4]) for i, t in ROWS)


def test_keep_returns_the_rows_as_they_are(spark, docs, buckets):
    ids = spark.createDataFrame([(i,) for i in TARGET], "doc_id long")
    left = q.keep(docs, ids, buckets=BUCKETS)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in plain(buckets, q.THRESHOLD) if r[8])


def test_no_target_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    rows = q.measures(docs, none, buckets=BUCKETS).collect()
    assert all(r["llr"] == 0 and r["kept"] == (not r["base_failed"]) for r in rows) and len(rows) == len(ROWS)
    assert q.measures(docs.limit(0), none, buckets=BUCKETS).collect() == [] and q.keep(docs.limit(0), none, buckets=BUCKETS).collect() == []


def test_trusted_is_bounded_and_without_repeats(spark):
    labels = spark.createDataFrame([(i % 50, 1 if i % 3 else None) for i in range(300)] + [(None, 1), (77, 0)], "doc_id long, quality int")
    ids = [r["doc_id"] for r in q.trusted(labels, rows=20).collect()]
    assert len(ids) == len(set(ids)) == 20 and 77 not in ids
