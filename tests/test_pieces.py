"""Windows in pieces against whole ones, ranks of whole tables, and exact rank tests against full enumeration."""

import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import clean, filters, halo, lag, masks, signif


@pytest.fixture(scope="module")
def line(spark):
    """Two sequences with gaps in their numbers, long stretches without a known value, and one without any."""
    rnd = random.Random(1)
    rows = [(u, t, None if u == 3 or (u == 1 and 20 < t < 70) or rnd.random() < 0.4 else float(rnd.randrange(100)), rnd.random() < 0.1) for u in (1, None, 3) for t in range(90) if rnd.random() < 0.8]
    return spark.createDataFrame(rows, "u long, t long, x double, e boolean").repartition(3)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_pieces_equal_whole_windows(line, size):
    for f in (
        lambda n: lag.hankel(line, ["u"], ["t"], ["x"], 4, 2, rows=n),
        lambda n: masks.event_mask(line, ["u"], ["t"], F.col("e"), 5, 2, rows=n),
        lambda n: masks.expand_mask(line, ["u"], ["t"], "e", 4, 1, rows=n),
        lambda n: clean.fill_linear(line, ["u"], "t", "x", rows=n),
        lambda n: clean.velocity(line, ["u"], "t", "x", "x", rows=n),
    ):
        assert rows(f(size)) == rows(f(None))


def test_positions_without_a_key(spark, line):
    one = line.withColumn("id", F.col("t") * 4 + F.coalesce("u", F.lit(0)))
    got = halo.positions(one, [], ["id"], "seq", 10).orderBy("id").select("seq").collect()
    assert [r.seq for r in got] == list(range(line.count()))
    assert halo.positions(one.limit(0), ["u"], ["id"]).count() == 0


def enumerate_signed(d):
    a = np.abs([x for x in d if x])
    ranks = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    w = ranks[np.array([x for x in d if x]) > 0].sum()
    null = np.array([ranks[np.array(s, bool)].sum() for s in product((0, 1), repeat=len(ranks))])
    return np.mean(null >= w - 1e-9), np.mean(null <= w + 1e-9)


def enumerate_sums(a, b):
    v = np.concatenate([a, b])
    ranks = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    w = ranks[: len(a)].sum()
    null = np.array([ranks[list(c)].sum() for c in combinations(range(len(v)), len(a))])
    return np.mean(null >= w - 1e-9), np.mean(null <= w + 1e-9)


def test_exact_rank_tests_with_ties(spark):
    rnd = random.Random(3)
    pairs = {k: [rnd.randint(-4, 5) for _ in range(n)] for k, n in enumerate((1, 2, 5, 9, 12, 12))}
    df = spark.createDataFrame([(k, float(x), 0.0) for k, d in pairs.items() for x in d], "k long, a double, b double")
    for alternative, pick in (("greater", lambda t: t[0]), ("less", lambda t: t[1]), ("two-sided", lambda t: min(1, 2 * min(t)))):
        got = {r.k: r.p for r in signif.wilcoxon_p(signif.wilcoxon(df, ["k"], "a", "b"), alternative).collect()}
        for k, d in pairs.items():
            if any(d):
                assert got[k] == pytest.approx(pick(enumerate_signed(d)))
    groups = {k: ([rnd.randint(0, 5) for _ in range(n)], [rnd.randint(1, 6) for _ in range(m)]) for k, (n, m) in enumerate([(1, 1), (3, 4), (5, 7), (6, 6), (2, 0)])}
    df = spark.createDataFrame([(k, i == 0, float(x)) for k, g in groups.items() for i in (0, 1) for x in g[i]], "k long, f boolean, v double")
    for alternative, pick in (("greater", lambda t: t[0]), ("less", lambda t: t[1]), ("two-sided", lambda t: min(1, 2 * min(t)))):
        got = {r.k: r.p for r in signif.mann_whitney_p(signif.mann_whitney(df, ["k"], F.col("f"), "v"), alternative).collect()}
        for k, g in groups.items():
            assert got[k] == pytest.approx(pick(enumerate_sums(*g)))


def test_normal_tails_are_near_the_exact_ones(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i % 2 == 0, float(rnd.randint(0, 20) + (i % 2 == 0) * 3)) for i in range(120)], "f boolean, v double")
    stats = signif.mann_whitney(df, [], F.col("f"), "v")
    row = signif.mann_whitney_p(stats).first()
    assert row.groups is None  # more rows than are counted exactly
    v = df.toPandas()
    twice = [int(2 * ((v.v < x).sum() + ((v.v == x).sum() + 1) / 2)) for x in v.v]
    assert row.p == pytest.approx(kernels.rank_sum_tails(twice, row.u, row.n1)[0], abs=2e-3)


def test_ranks_of_a_whole_table_do_not_meet_in_one_task(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 501).cast("double").alias("v"))
    out = signif.mid_ranks(df, [], "v")
    v = np.array([r.v for r in df.collect()])
    for r in out.limit(50).collect():
        assert r.rank == (v < r.v).sum() + ((v == r.v).sum() + 1) / 2
    adj = signif.benjamini_hochberg(df.select((F.col("v") / 501).alias("p"), F.monotonically_increasing_id().alias("i")), [], "p", ["i"])
    p = np.sort(v / 501)
    want = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    assert [r.adjusted for r in adj.orderBy("p", "i").collect()] == pytest.approx(list(want))


@pytest.mark.parametrize("low,high,analytic", [(1.0, 9.0, False), (None, 6.0, False), (5.0, 10.0, True)])
def test_filters_in_pieces_equal_those_of_the_whole_series(spark, low, high, analytic):
    h = filters.weights(30.0, low, high, analytic=analytic)
    x = np.cumsum(np.random.default_rng(1).standard_normal((4000, 2)), axis=0)
    df = spark.createDataFrame([(u, 3 * t + 1, *map(float, r)) for u, part in ((1, x[:2900]), (None, x[2900:])) for t, r in enumerate(part)], "u long, t long, a double, b double").repartition(3)
    whole = {(r.u, r.t): (r.a, r.b) for r in filters.filtered(df, ["u"], "t", ["a", "b"], h, rows=10_000).collect()}
    assert len(whole) == 4000
    for size in (300, 1000):
        got = {(r.u, r.t): (r.a, r.b) for r in filters.filtered(df, ["u"], "t", ["a", "b"], h, rows=size).collect()}
        assert set(got) == set(whole) and max(abs(got[k][i] - whole[k][i]) for k in whole for i in (0, 1)) < 1e-9
    kernel = kernels.envelope(kernels.band_pass(x[:2900], 30.0, low, high)) if analytic else kernels.band_pass(x[:2900], 30.0, low, high)
    mid = slice(len(h) // 2 + 40, 2900 - len(h) // 2 - 40)  # ends are continued otherwise
    got = np.array([whole[1, 3 * t + 1] for t in range(2900)])
    assert len(h) < 2000 and np.abs(got[mid] - kernel[mid]).max() < 1e-2 * np.abs(kernel[mid]).max()
