"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.common import Workspace


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """rows: (id, fp); component is the least id reachable."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return {i: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for ks in out.values() for i in ks}


def test_fingerprint_matches_definition():
    texts = ["", None, "One", "a b c", "A b C d", "É É é é x", "a b c d e f", "x " * 500, "\t\n\x0b a  b\x0cc d e\r"]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_fingerprint_of_text_longer_than_a_chunk(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(3000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 257)
    assert simhash.fingerprint(text) == want == brute_fingerprint(text)


def test_every_close_pair_meets_at_an_anchor():
    rng = random.Random(1)
    for radius, bits in ((2, 2), (3, 4)):
        for _ in range(300):
            x = rng.getrandbits(32)
            y = x
            for b in rng.sample(range(32), bits):
                y ^= 1 << b
            i, a = simhash._anchors(np.array([x, y], np.uint32), radius)
            assert set(a[i == 0]) & set(a[i == 1])


def frames(spark, fps):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")


def linked(spark, fps, crowd):
    space = Workspace(spark, "t")
    edges = simhash.links(frames(spark, fps), space, crowd)
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(edges, space).collect()}
    return [roots.get(x, x) for x in fps]


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for x in list(fps):
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(14)}  # a crowd
    fps = sorted(fps)
    rows = [(i, x) for i, x in enumerate(fps)]
    want = brute_components(rows)
    for crowd in (simhash.CROWD, 10):
        got = linked(spark, fps, crowd)
        ours, theirs = {}, {}
        for i in range(len(fps)):
            ours.setdefault(got[i], set()).add(i)
            theirs.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_groups_and_keep(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them again " * 20
    rows = [(5, base), (3, base.replace("again", "Again")), (9, base + "extra"), (7, None), (4, ""), (8, "other words entirely"), (None, "other words entirely"), (None, "alone here"), (5, base)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = simhash.groups(docs).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(fps)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=key) == sorted(((i, f, want[k]) for k, (i, f) in enumerate(fps)), key=key)
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, rows[1][1]), (4, ""), (8, "other words entirely"), (None, "alone here")], key=str) or kept.count() == len(set(want.values()))
    assert simhash.groups(docs.limit(0)).count() == 0
    assert simhash.keep(docs.limit(0)).count() == 0
