"""Filter audit against documents that are dropped one by one, and its behaviour on odd tables."""

import hashlib
import re
from collections import defaultdict

import pytest

from ledgerloom.llm import filter_audit
from ledgerloom.llm.common import Workspace

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"
#: Signed sums and cells of one part, by mask.
KEYS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def played(docs, labels):
    """{(part, order, step): counts}, one document and one order at a time."""
    first, good, toxic, fails = {}, set(), set(), {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    out = {}
    for k, (i, text, _) in enumerate(docs):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        fails[k] = {f for f, x in zip("ABCDE", found, strict=True) if x}
    for part in {(lang or "") for _, _, lang in docs}:
        mine = [(k, i) for k, (i, _, lang) in enumerate(docs) if (lang or "") == part]
        shapley = defaultdict(int)
        for order in filter_audit.ORDERS:
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(k, i) for k, i in left if f in fails[k]]
                left = [x for x in left if x not in gone]
                shapley[f] += len(gone)
                redundant = sum(f in fails[k] for k, _ in mine) - sum(1 for k, _ in mine if f in fails[k] and (k in {g for g, _ in gone}))
                out[part, order, step] = [len(left), len(gone), redundant, sum(fails[k] == {f} for k, _ in mine), sum(i is not None and i in good for _, i in gone), sum(i is not None and i in toxic for _, i in gone)]
        for order in filter_audit.ORDERS:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def run(spark, docs, labels, **clash):
    d, x = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    return filter_audit.audit(d, x, Workspace(spark, "audit-test"))


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[k] for k in (*KEYS, "shapley")] for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"word{k}" for k in range(150))


@pytest.fixture(scope="module")
def corpus():
    docs, labels = [], []
    for k in range(90):
        h = int(hashlib.md5(str(k).encode()).hexdigest(), 16)
        words = [f"w{j % 60 if h & 1 else j}" for j in range(120 if h & 2 else 20)]
        text = " ".join(words).upper() if h & 4 else "\x0b".join(words)
        docs.append((k, ("# " if h & 8 else "") + text, ["en", "de", None, ""][h % 7 % 4]))
        labels.append((k, h >> 5 & 1, h >> 6 & 1))
    docs += [(100, None, "en"), (101, "", "en"), (102, "", None), (None, LONG, "en"), (103, LONG, "en"), (104, LONG, "de"), (103, LONG, "en"), (105, "Ü" * 300, "xx"), (106, "word " * 300_000, "long")]
    docs += [(200 + k, "the same text", "hot") for k in range(60)]
    return docs, [*labels, (103, 1, None), (103, 0, 1), (None, 1, 1), (104, None, None), (999, 1, 1), (201, 1, 1)]


def test_every_order_played_out(spark, corpus):
    assert found(run(spark, *corpus)) == played(*corpus)


def test_inverse_of_parity_sums(spark, corpus):
    rows = spark.createDataFrame([("p", m, m % 2, m % 3) for m in range(32) for _ in range(m * m)], "part string, mask int, quality int, toxic int")
    cells = filter_audit.invert(filter_audit.parity_sums(rows)).first()
    assert list(cells["n"]) == [m * m for m in range(32)]
    assert list(cells["good"]) == [m * m * (m % 2) for m in range(32)]
    assert list(cells["toxic"]) == [m * m * (m % 3 == 1) for m in range(32)]


def test_hot_and_cold_copies_agree(spark, corpus, monkeypatch):
    want = found(run(spark, *corpus))
    whole = filter_audit.join_hot
    monkeypatch.setattr(filter_audit, "join_hot", lambda *a, **k: whole(*a[:5], -10**6, **k))  # every key counts as hot
    assert found(run(spark, *corpus)) == want


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], []).count() == 0
    docs = [(1, "A b", "en"), (2, "A b", "en")]
    clash = spark.createDataFrame([(*d, 7, "x", 3, True, "y") for d in docs], DOCS + ", mask int, part string, own int, copies boolean, digest string")
    labels = spark.createDataFrame([(1, 1, 0, 5, "z")], LABELS + ", part int, text string")
    assert found(filter_audit.audit(clash, labels, Workspace(spark, "audit-test"))) == played(docs, [(1, 1, 0)])
