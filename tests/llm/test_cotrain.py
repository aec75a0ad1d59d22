"""Co-training: held-out accuracy, the choice of confident rows against a plain version, odd rows, one-sided labels, empty tables."""

import zlib

import numpy as np
import pytest

from ledgerloom.llm import cotrain as c
from ledgerloom.llm.common import Workspace, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, h int"
SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, rank = np.asarray(score)[order], np.empty(len(y))
    for v in np.unique(s):
        at = s == v
        rank[order[at]] = np.mean(np.flatnonzero(at)) + 1
    n = sum(y)
    return (rank[np.array(y, bool)].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    """The classifier never sees the rows it is judged on: their ids' crc32 is divisible by five."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = c.features(docs, Workspace(spark, "cotrain-test"))
    scored = c.score(rows, c.train(rows, labels))
    assert scored.count() == docs.count()
    judged = scored.filter("held_out").join(labels.filter("quality is not null").groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "y"), "doc_id").collect()
    y = [r["y"] for r in judged]
    assert 0 < sum(y) < len(y) and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in judged)
    print("held out", len(y), *(round(auc([r[k] for r in judged], y), 3) for k in ("score", "p_text", "p_meta")))
    assert auc([r["score"] for r in judged], y) > 0.95
    assert np.mean([r["kept"] == bool(r["y"]) for r in judged]) > 0.9


@pytest.fixture(scope="module")
def odd(spark):
    good, bad = "Plain words that make some sense, number N of them. " * 4, "$$$ ### N " * 30
    rows = [(i, (good if i % 2 else bad).replace("N", str(i)), "en", ("web", "junk")[1 - i % 2], 200, "clash", 1) for i in range(160)]
    rows += [(500, None, None, None, None, "", 0), (501, "", "", "", 0, "", 0), (502, " \n" * 9, "xx", "y", -5, "", 0), (503, "w " * 400_000, "en", "web", 800_000, "", 0), (None, "a", "en", "web", 1, "", 0), (11, "again", "en", "web", 5, "", 0), (11, "again", "en", "web", 5, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_odd_rows_and_repeats(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] * 2 + [(500, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = c.features(odd, Workspace(spark, "cotrain-odd"))
    got = c.score(rows, c.train(rows, labels, rounds=3, per_round=10)).collect()
    assert len(got) == 167 and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)
    judged = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] != 11]
    assert all(r["kept"] == bool(r["doc_id"] % 2) for r in judged)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    again = c.score(rows, c.train(rows, labels, rounds=3, per_round=10)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_labels_of_one_class_or_none(spark, odd, labels):
    rows = c.features(odd, Workspace(spark, "cotrain-one"))
    model = c.train(rows, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model is None and all(r["score"] == 1 and r["kept"] for r in c.score(rows, model).collect())


def test_no_rows(spark, odd):
    rows = c.features(odd.limit(0), Workspace(spark, "cotrain-none"))
    assert c.score(rows, c.train(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))).collect() == []


def test_most_confident_rows_overall(spark, odd):
    """Merged from all tasks: the same rows, in the same order, as from one sorted list."""
    rows = c.features(odd, Workspace(spark, "cotrain-best"))
    rng = np.random.default_rng(3)
    data = rows.collect()
    xt = np.array([r["t"] for r in data], float)
    weights = [rng.normal(size=xt.shape[1]), rng.normal(size=c.META) * 3]
    xm = np.zeros((len(data), c.META))
    for k, r in enumerate(data):
        xm[k, r["m"]] = 1
    kinds, taken = c._kinds(0.5, 12), {data[0]["n"], data[5]["n"]}
    got = [(r["kind"], r["n"]) for r in c._best(rows, weights, kinds, taken).collect()]
    want = []
    for j, (i, label, _, floor) in enumerate(kinds):
        p = c._sigmoid((xt, xm)[i] @ weights[i])
        sure = p if label else 1 - p
        listed = sorted((-s, r["h"], r["n"]) for s, r in zip(sure, data, strict=True) if s >= floor and r["n"] not in taken)
        want += [(j, n) for _, _, n in listed[: sum(k[2] for k in kinds)]]
    assert got == want
