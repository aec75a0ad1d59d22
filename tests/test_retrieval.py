"""Retrieval against sequential versions: scores, hot terms, the choice within a budget."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.operators import retrieval as op
from ledgerloom.storage import Workspace

STOP = ("the", "of")


def toks(text):
    return [t for t in re.findall(r"\w+", (text or "").lower()) if len(t) > 1 and t not in STOP]


def brute_scores(docs, asked):
    df = Counter(t for _, d in docs for t in set(toks(d)))
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}

    def vector(text):
        c = Counter(toks(text))
        return {t: n / sum(c.values()) * idf.get(t, 1.0) for t, n in c.items()}

    out = {}
    for q, text in asked:
        a = vector(text)
        for i, d in docs:
            b = vector(d)
            dot = sum(a[t] * b[t] for t in a if t in b)
            if dot:
                out[q, i] = round(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9)
    return out


def brute_choice(scored, length, budget, top):
    chosen, used = [], 0
    for s, i in sorted(scored, reverse=True):
        if chosen and used + length[i] > budget:
            if len(chosen) >= top:
                break
            continue
        chosen.append((i, s))
        used += length[i]
    return chosen


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = [f"wort{k}" for k in range(30)] + ["the", "of", "Über", "x_1", "a"]
    docs = [(k, " ".join(r.choices(words, k=r.randrange(0, 25)))) for k in range(80)] + [(200 + k, "wort1, wort2! WORT1") for k in range(40)] + [(300, None), (301, ""), (302, "the of a")]
    asked = [(k, " ".join(r.choices([*words, "unseen"], k=5))) for k in range(12)] + [(50, ""), (51, None), (52, "wort1 wort2")]
    return docs, asked


@pytest.mark.parametrize("hot", [1, 20, 10_000])
def test_scores(spark, corpus, hot):
    docs, asked = corpus
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "id long, text string")
    index = op.build(d, "id", "text", Workspace(spark, "retrieval-test"), STOP, hot)
    got = {(r["question"], r["id"]): r["score"] for r in op.scores(index, q, "id", "text").collect()}
    want = brute_scores(docs, asked)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in got)
    best = {r["question"]: (r["id"], r["score"]) for r in op.best(op.scores(index, q, "id", "text"), 0.3).collect()}
    for k, _ in asked:
        top = max(((s, -i) for (a, i), s in got.items() if a == k), default=(0, 0))
        assert best.get(k) == ((-top[1], top[0]) if top[0] >= 0.3 else None)


@pytest.mark.parametrize(("budget", "top"), [(60, 3), (17, 2), (500, 5), (5, 1)])
def test_choice_within_budget(spark, budget, top):
    r = random.Random(budget)
    length = {i: r.choice([0, 1, 3, 9, 9, 20, 70, 600]) for i in range(150)}
    rows = [(q, i, round(r.choice([0.1, 0.5, r.random()]), 3)) for q in range(6) for i in r.sample(range(150), 120 if q else 1)]
    scored, lengths = spark.createDataFrame(rows, "question long, id long, score double"), spark.createDataFrame(list(length.items()), "id long, length long")
    got = {}
    for x in op.within_budget(scored, lengths, budget, top).orderBy("question", "position").collect():
        got.setdefault(x["question"], []).append((x["id"], x["score"]))
    for q in range(6):
        assert got[q] == brute_choice([(s, i) for a, i, s in rows if a == q], {i: max(n, 1) for i, n in length.items()}, budget, top)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    some = spark.createDataFrame([(1, "two words")], "id long, text string")
    for d, q in ((none, some), (some, none)):
        index = op.build(d, "id", "text", Workspace(spark, "retrieval-test"))
        assert op.within_budget(op.scores(index, q, "id", "text"), index.lengths).count() == 0


def test_few_questions_move_no_pairs(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 3}") for i in range(50)], "id long, text string")
    index = op.build(docs, "id", "text", Workspace(spark, "t"), STOP)
    found = op.scores(index, docs.limit(5), "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(question" not in plan and "hashpartitioning(id" in plan
    assert found.count() == 5 * 50
