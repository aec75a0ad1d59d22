"""Hard-negative search against all pairs, with vectors that bunch, tie, repeat or can't take part."""

import numpy as np

from ledgerloom.llm import hard_negatives
from ledgerloom.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<double>, label int"
SMALL = {"pivots": 6, "sample": 60, "block": 17, "bits": 2}


def expected(rows, anchor=lambda i: i % 5 == 0):
    ok = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in ok), default=0)
    ok = [(i, v + [0] * (width - len(v)), y) for i, v, y in ok]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in ok if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for j, w, z in ok if j != i)
        for p, j, _ in [x for x in scored if x[2]][:5]:
            inside = [(-n, m) for n, m, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, j, rank, m, -p, n) for rank, (n, m) in enumerate(inside[:3], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, hard_negatives.mine(df, "id % 5 = 0", Workspace(spark, "negatives-test"), **(SMALL | options)).collect()))


def bunched(n, dim, seed, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    return [(k, (centres[k % 8] + spread * r.normal(size=dim)).tolist(), int(r.integers(0, 3))) for k in range(n)]


def test_all_pairs(spark):
    rows = bunched(240, 6, 3)
    assert mined(spark, rows) == expected(rows)


def test_ties_copies_and_rows_that_take_no_part(spark):
    rows = bunched(60, 4, 4) + [(1000 + k, [0.5, 0.25, 0.0, 0.0], k % 3) for k in range(60)]  # equal vectors
    rows += [(500, None, 1), (505, [], 1), (510, [1.0, None, 0.0, 0.0], 1), (515, [float("nan"), 0.0, 0.0, 0.0], 2), (520, [float("inf"), 0.0, 0.0, 0.0], 2), (525, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(530, [1.0, 1.0], 1), (530, [1.0, 1.0], 1), (535, [0.0, 0.0, 0.0, 0.0], 0), (540, [-1.0, -1.0, -1.0, -1.0], 2), (7, [2.0, 0.1, 0.3, 0.2], 0)]
    assert mined(spark, rows) == expected(rows)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(9)
    rows = [(k, (r.integers(-(1 << 19), 1 << 19, 5)).astype(float).tolist(), k % 2) for k in range(60)]
    assert mined(spark, rows) == expected(rows)


def test_few_rows(spark):
    assert mined(spark, []) == []
    two = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [0.7, 1.4], 1)]
    assert mined(spark, two) == expected(two) != []


def test_clashing_columns(spark):
    rows = bunched(40, 3, 5)
    df = spark.createDataFrame([(*x, 1, 2, "x", 0.5) for x in rows], SCHEMA + ", id int, a int, block string, pivot double")
    assert sorted(map(tuple, hard_negatives.mine(df, "id % 5 = 0", Workspace(spark, "negatives-test"), **SMALL).collect())) == expected(rows)


def test_blocks_beyond_the_bound_are_not_scanned(spark):
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), y) for i, v, y in bunched(400, 4, 6, 0.02)]
    space = Workspace(spark, "negatives-test")
    known = hard_negatives.prepare(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", space)
    g, first = hard_negatives.geometry(known, 8, 200)
    blocks, anchors = hard_negatives.index(known, g, space, 10), hard_negatives.anchors_of(known.filter("id % 5 = 0"), g, space, 1)
    assert blocks.selectExpr("sum(size(ids))").first()[0] == 400 and blocks.filter("size(ids) > 10 or low > high").count() == 0
    slots = "array(named_struct('slot', 0, 'least', -4611686018427387904, 'most', 4611686018427387904)) AS slots"
    wanted = anchors.selectExpr("a", slots, "0.0D AS near", f"{2 * g.top ** 0.5 + 1}D AS far", f"{first}D AS radius")
    found, rounds = hard_negatives.search(anchors, wanted, blocks, g, 5, True, space, "p")
    assert found.count() == 5 * 80
    assert sum(rounds) < 0.5 * blocks.count() * anchors.select("grp").distinct().count()
