"""N-best segmentation against enumeration, and exact round trips."""

import os
import random
import re

import pytest

from ledgerloom.llm import nbest

V = nbest.Vocabulary(
    {"▁": 0, "a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5, "▁a": 6, "▁ab": 7, "c": 8, "bc": 9, "abc": 10},
    {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "ba": -4.25, "aba": -6.0, "▁a": -3.0, "▁ab": -5.0, "c": -3.25, "bc": -5.0, "abc": -6.5},
    list(range(100, 356)),
)


def enumerate_all(chunks, v):
    """All segmentations of a list of chunks as (score, ids), best first."""

    def one(chunk):
        if not chunk:
            return [(0.0, ())]
        out = []
        for n in range(1, len(chunk) + 1):
            p = chunk[:n]
            if p in v.scores or (n == 1 and p not in v.scores):
                s = v.scores.get(p, v.unknown)
                out += [(s + t, (*v.spell(p), *rest)) for t, rest in one(chunk[n:])]
        return out

    total = [(0.0, ())]
    for c in chunks:
        total = [(s + t, (*x, *y)) for s, x in total for t, y in one(c)]
    return sorted(total, key=lambda x: -x[0])


def rebuilt(encoder, text, changes):
    chunks = encoder.chunks(text)
    parts = [encoder.first(c)[0] for c in chunks]
    for k, ids in changes:
        parts[k] = tuple(ids)
    return tuple(i for p in parts for i in p)


def test_nbest_equals_enumeration():
    rng = random.Random(3)
    for n in (1, 2, 3, 5, 9):
        for _ in range(120):
            text = "".join(rng.choice("aabbc é\n ") for _ in range(rng.randint(0, 9)))
            encoder = nbest.Encoder(V, n)
            ids, scores, changes = encoder.encode(text)
            every = enumerate_all(encoder.chunks(text), V)
            assert len(scores) == min(n, len(every))
            assert scores == pytest.approx([s for s, _ in every[:n]])
            found = [rebuilt(encoder, text, c) for c in changes]
            assert found[0] == tuple(ids)
            assert len(set(zip(found, map(str, changes)))) == len(found)
            by_ids = {}
            for s, x in every:
                by_ids.setdefault(x, set()).add(round(s, 6))
            assert all(round(s, 6) in by_ids[x] for s, x in zip(scores, found))
            assert all(nbest.decode(list(x), V) == text for x in found)


def test_second_best_is_read_off_the_first_walk():
    rng = random.Random(4)
    for _ in range(200):
        chunk = "".join(rng.choice("aabbc") for _ in range(rng.randint(1, 9)))
        x = nbest.Lattice(chunk, V)
        every = enumerate_all([chunk], V)
        assert x.best == pytest.approx(every[0][0])
        assert x.second == (pytest.approx(every[1][0]) if len(every) > 1 else -float("inf"))
        assert [s for s, _ in x.search(50)] == pytest.approx([s for s, _ in every[:50]])


def test_long_chunks_and_memory(monkeypatch):
    monkeypatch.setattr(nbest, "MEMORY", 2)
    e = nbest.Encoder(V, 3)
    text = "ab " * 50 + "abcab" * 2000 + " ab c"
    ids, scores, _ = e.encode(text)
    assert nbest.decode(ids, V) == text and scores == sorted(scores, reverse=True) and len(e.known) <= 2


@pytest.mark.skipif(not os.path.exists(nbest.MODEL), reason="no model here")
def test_operator_with_the_public_model(spark):
    texts = ["", None, "Hello world", "  two  spaces \n\ttabs ", "naïve café ①ﬁ 梦 👍", "x" * 30000, " ", "\n\n", "a b " * 3000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r for r in nbest.encode(docs, "text", ["doc_id"]).collect()}
    assert all(r["round_trip"] for r in rows.values())
    assert rows[0]["n_pieces"] == 0 and rows[0]["scores"] == [0.0] and rows[1]["ids"] == []
    v = nbest.Vocabulary.read()
    e = nbest.Encoder(v, nbest.N)
    for i, t in enumerate(texts):
        ids, scores, _ = e.encode(t or "")
        assert rows[i]["ids"] == ids and rows[i]["scores"] == scores and len(scores) <= nbest.N
    every = enumerate_all(e.chunks("Hello world"), v)
    assert rows[2]["scores"] == pytest.approx([s for s, _ in every[: nbest.N]])
    back = {r["doc_id"]: r["text"] for r in nbest.decoded(nbest.encode(docs, "text", ["doc_id"]), "ids", ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert nbest.encode(docs.limit(0), "text", ["doc_id"]).count() == 0


def test_chunks_are_cut_without_giving_back():
    """The same chunks as by the pattern that tries every shorter run before a sign."""
    v = nbest.Vocabulary({p: i for i, p in enumerate(("a", "b.", ".", "é", "▁"))}, dict.fromkeys(("a", "b.", ".", "é", "▁"), -1.0), [])
    assert "++" in v.chunk.pattern
    plain = re.compile(v.chunk.pattern.replace("*+", "*").replace("]++(?=", "]*[^\\W\\d_](?=").replace("(?<=[^\\W\\d_])", ""))
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choice("ab9_é.,-(\n▁▁") for _ in range(rng.randrange(25)))
        assert v.chunk.findall(text) == plain.findall(text), text
