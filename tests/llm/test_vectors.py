"""Hard negatives and nearest rows against brute force in plain Python."""

import math
import random

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from cadenza.llm import oracle, pivots, queries, vptree
from cadenza.llm.vectors import Best, far_apart

SCHEMA = "vec_id long, label int, v array<double>"


def clean(rows, zero):
    best = {}
    for i, g, v in rows:
        if i is None or v is None or (g is None and not zero) or any(x is None or not math.isfinite(x) for x in v) or (zero and not any(v)):
            continue
        key = v if zero else (g, v)
        if i not in best or key < best[i][0]:
            best[i] = (key, g, v)
    return {i: (g, v) for i, (_, g, v) in best.items()}


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def hard(rows, positives=5, negatives=10):
    known, out = clean(rows, False), []
    for a, (label, v) in known.items():
        if a % 100:
            continue
        scored = sorted((-int(dot(map(int, v), map(int, w))), i, g) for i, (g, w) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, t) for t, n, g in scored if g != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def near(rows, k, every=20):
    known, out = clean(rows, True), []
    for q, (_, v) in known.items():
        if q % every == 0:
            found = sorted((-vptree.measure(np.array([v]), np.array([list(w)[: len(v)] + [0.0] * (len(v) - len(w))]))[0] if len(v) >= len(w) else -dot(v, w), i) for i, (_, w) in known.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def clustered(n, dim, seed, scale=200):
    """Whole vectors around a few centres, a third of them copies of one."""
    r = random.Random(seed)
    centres = [[r.randint(-scale, scale) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        v = list(centres[0]) if i % 3 == 0 else [x + r.randint(-scale // 10, scale // 10) for x in c]
        rows.append((i, r.randint(0, 3), [float(x) for x in v]))
    return rows


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n", [1, 37, 700])
def test_hard_negatives_equal_brute_force(spark, n):
    rows = clustered(n, 8, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pivots.mine(df, F.col("vec_id") % 100 == 0)) == hard(rows)


def test_brackets_hold_and_prune():
    rows = clustered(3000, 8, 5)
    x = np.array([v for _, _, v in rows])
    space = pivots.Space(8, float((x * x).sum(axis=1).max()), np.zeros((0, 9)))
    points = space.augmented(x)
    space.pivots = points[far_apart(points[:500], 8)]
    d = space.to_pivots(points)
    order = np.lexsort((d.min(axis=1), d.argmin(axis=1)))
    q = x[::100]
    away, norms = space.to_pivots(np.column_stack([q, np.zeros(len(q))])), (q * q).sum(axis=1)
    left = total = 0
    for at in np.array_split(order, 40):
        page = pivots.Page(at, at, x[at], d[at].min(axis=0), d[at].max(axis=0))
        low, high = pivots.bracket(away, norms, page, space.big)
        s = q @ x[at].T
        assert (s.min(axis=1) >= low).all() and (s.max(axis=1) <= high).all()
        left, total = left + (high >= 0.9 * norms).sum(), total + len(q)
    assert left < total / 2  # most pages of clustered rows can't hold what is as close as 0.9 of the own norm


ODD = [(0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (100, 1, [1.0]), (200, 2, []), (3, 1, [3.0, 4.0]), (4, 2, [2.0, 3.0]), (5, 2, [2.0, 3.0]), (5, 3, [9.0, 9.0]), (6, None, [3.0, 3.0]), (7, 2, None),
       (8, 1, [float("nan"), 1.0]), (9, 1, [float("inf"), 1.0]), (10, 2, [None, 1.0]), (None, 1, [1.0, 1.0]), (11, 1, [0.0, 0.0]), (12, 1, [-1.0, -1.0]), (20, 2, [2.0, 2.0])]


def test_hard_negatives_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"d": F.lit(1), "score": F.lit(2), "rank": F.lit("x"), "slot": F.lit(3)})
    assert got(pivots.mine(df, F.col("vec_id") % 100 == 0)) == hard(ODD)
    assert got(pivots.mine(df.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**30)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 1, [big, 2.0]), (3, 2, [big / 2, 5.0]), (4, 2, [big / 2, 7.0]), (5, 2, [big / 2, 6.0])]
    assert got(pivots.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)) == hard(rows)
    huge = [(0, 1, [1e300, 0.0]), (1, 1, [1e300, 0.0]), (2, 2, [1.0, 0.0])]
    assert pivots.mine(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_best_keeps_the_first_of_ties():
    best = Best(2, 2, np.int64)
    for ids in ([5, 9], [1, 7], [3, 2]):
        best.add(np.array([0, 0]), np.array(ids), np.array([4, 4]))
        best.cut()
    assert best.cut()[1].tolist() == [1, 2]
    assert best.least.tolist() == [4, np.iinfo(np.int64).min] and best.last.tolist()[0] == 2


@pytest.mark.parametrize("leaf,shard", [(4, 1 << 12), (64, 1 << 14)])
def test_factor_one_is_exact(spark, leaf, shard):
    rows = clustered(900, 6, leaf)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert got(vptree.search(df, F.col("vec_id") % 20 == 0, 20, factor=1, leaf=leaf, shard_bytes=shard)) == near(rows, 20)


def test_every_row_is_in_a_leaf():
    points = np.array([v for _, _, v in clustered(2000, 5, 1)])
    order, nodes = vptree.plant(points, 16)
    leaves = sorted((int(x[vptree.START]), int(x[vptree.END])) for x in nodes if x[vptree.LEFT] < 0)
    assert sorted(order) == list(range(2000)) and leaves[0][0] == 0 and leaves[-1][1] == 2000
    assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_of_the_production_factor(spark, seed):
    """Vectors around 200 centres in 16 dimensions, where halves are left out."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(200, 16))[r.integers(0, 200, 6000)] + 0.25 * r.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    found = {}
    for q, i in vptree.search(df, F.col("vec_id") % 20 == 0, 20, leaf=64).select("query_id", "vec_id").collect():
        found.setdefault(q, set()).add(i)
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    truth = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(found[20 * q] & set(t.tolist())) / 20 for q, t in enumerate(truth)]) >= 0.9


def test_nearest_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit(2), "rank": F.lit("x"), "slot": F.lit(3), "ids": F.lit(3)})
    assert got(vptree.search(df, F.col("vec_id") % 20 == 0, 20, factor=1)) == near(ODD, 20)
    assert got(vptree.search(df.limit(0), F.col("vec_id") % 20 == 0, 20)) == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_nearest"])
def test_queries_equal_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), connect(small), oracle.ORACLES[name])
