from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.functions.expr import binomial_critical, binomial_tail, correlation_p, safe_corr
from cadenza.operators import clean, decide, folds, lag, masks, models, moments, segment, signif
from cadenza.sources import npy, tables


def series(spark, values, u=0):
    return spark.createDataFrame([(u, t, None if v is None else float(v)) for t, v in enumerate(values)], "u long, t long, x double")


def got(df, *cols):
    return [tuple(r) for r in df.orderBy("u", "t").select(*cols).collect()]


@pytest.mark.parametrize(("lags", "offset"), [(1, 0), (3, 0), (3, 1), (5, 2)])
def test_hankel_equals_its_definition(spark, lags, offset):
    x = list(range(1, 24))
    rows = got(lag.hankel(series(spark, x), ["u"], ["t"], ["x"], lags, offset), *[f"x_{k}" for k in range(lags)])
    at = lambda i: float(x[i]) if 0 <= i < len(x) else 0.0
    assert rows == [tuple(at(t + offset - k) for k in range(lags)) for t in range(len(x))]


def test_block_hankel_is_channel_major(spark):
    df = spark.createDataFrame([(0, t, [float(t), float(10 * t)]) for t in range(1, 4)], "u long, t long, ch array<double>")
    assert got(lag.block_hankel(df, ["u"], ["t"], "ch", 2, 2), "h") == [([1.0, 0.0, 10.0, 0.0],), ([2.0, 1.0, 20.0, 10.0],), ([3.0, 2.0, 30.0, 20.0],)]


def test_lags_stop_at_the_key_and_not_before(spark):
    df = series(spark, [1, 2, 3, 4]).withColumn("vid", F.floor(F.col("t") / 2))
    assert [r[0] for r in got(lag.hankel(df, ["u"], ["t"], ["x"], 2), "x_1")] == [0, 1, 2, 3]
    assert [r[0] for r in got(lag.hankel(df, ["u", "vid"], ["t"], ["x"], 2), "x_1")] == [0, 1, 0, 3]


@pytest.mark.parametrize("events", [[], [0], [22], [5, 6, 19]])
def test_event_mask_equals_brute_force(spark, events):
    df = series(spark, range(23)).withColumn("e", F.col("t").isin(events) if events else F.lit(False))
    keep = [r[0] for r in got(masks.event_mask(df, ["u"], ["t"], F.col("e"), 2, 4), "keep")]
    assert keep == [not any(e - 2 <= t <= e + 4 for e in events) for t in range(23)]


def test_expand_mask_equals_brute_force(spark):
    m = [t % 5 != 0 for t in range(17)]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(m)], "u long, t long, m boolean")
    keep = [r[0] for r in got(masks.expand_mask(df, ["u"], ["t"], "m", 3, 1), "keep")]
    assert keep == [all(m[i] for i in range(t + 1 - 3 + 1, t + 2) if 0 <= i < 17) for t in range(17)]


def test_fill_linear(spark):
    x = [None, None, 2, None, None, 5, 5, None, 9, None, None]
    assert [r[0] for r in got(clean.fill_linear(series(spark, x), ["u"], "t", "x"), "x")] == pytest.approx([0, 1, 2, 3, 4, 5, 5, 7, 9, 11, 13])
    assert got(clean.fill_linear(series(spark, [None, 1, None]), ["u"], "t", "x"), "x") == [(None,), (1.0,), (None,)]
    assert got(clean.fill_linear(series(spark, [None, None]), ["u"], "t", "x"), "x") == [(None,), (None,)]


def test_peaks_and_plateaus(spark):
    x = [0, 1, 0, 2, 2, 0, 3, 3, 3, 1, 4]
    assert [t for t, p in got(clean.peaks(series(spark, x), ["u"], "t", "x"), "t", "peak") if p] == [1, 3, 7]


@pytest.mark.parametrize("n", [7, 20, 23, 40])
def test_segments_as_even_as_they_go(spark, n):
    seg = [r[0] for r in got(segment.segments(series(spark, range(n)), ["u"], "t", 10), "segment")]
    want = [i for i, part in enumerate(np.array_split(np.arange(n), n // 10 + 1)) for _ in part]
    assert seg == want


def test_tumbling_short_and_exact(spark):
    cut = lambda n: segment.tumbling(series(spark, range(n)), ["u"], "t", 10).count()
    assert [cut(n) for n in (9, 10, 19, 20)] == [0, 10, 10, 20]


def test_bootstrap_fits_and_repeats(spark):
    n = spark.createDataFrame([(0, 100), (1, 10), (2, 9)], "u long, len long")
    s = segment.bootstrap_starts(n, ["u"], 10, 3, seed=1).collect()
    assert sorted(map(str, s)) == sorted(map(str, segment.bootstrap_starts(n, ["u"], 10, 3, seed=1).collect()))
    assert {r.u for r in s} == {0, 1} and all(0 <= r.start < 90 for r in s if r.u == 0) and all(r.start == 0 for r in s if r.u == 1)
    assert sum(r.u == 0 for r in s) == 33


def test_folds_are_disjoint_and_leave_the_rest_to_training(spark):
    f = folds.contiguous(series(spark, range(23)), ["u"], "t", 5)
    assert [r[0] for r in got(f, "fold")] == [t // 4 + 1 if t < 20 else None for t in range(23)]
    roles = folds.roles(f, "fold", 5).groupBy("t").agg(F.count_if(F.col("role") == "test").alias("k")).collect()
    assert {r.k for r in roles if r.t < 20} == {1} and {r.k for r in roles if r.t >= 20} == {0}
    with pytest.raises(ValueError):
        folds.check_divisible(7, 2)


def test_safe_corr_edges(spark):
    df = spark.createDataFrame([("c", 1.0, 5.0), ("c", 1.0, 6.0), ("n", 1.0, None), ("n", 2.0, 4.0), ("n", 3.0, 2.0), ("n", None, 9.0), ("s", 1.0, 1.0)], "k string, a double, b double")
    r = {x.k: x.r for x in df.groupBy("k").agg(safe_corr("a", "b").alias("r")).collect()}
    assert np.isnan(r["c"]) and r["n"] == pytest.approx(-1) and np.isnan(r["s"])


@pytest.mark.parametrize(("k", "n"), [(0, 1), (3, 5), (60, 100), (520, 1000), (5, 5)])
def test_binomial(spark, k, n):
    from math import comb

    tail, crit = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n)), binomial_critical(F.lit(n), 0.05)).first()
    assert tail == pytest.approx(sum(comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-9)
    assert crit == next(c for c in range(n + 1) if sum(comb(n, i) for i in range(c + 1)) >= 0.95 * 2**n)


def test_ties_are_not_correct(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [2.0, 1.0]), (0, [float("nan"), 1.0], [0.0, 0.0]), (0, [3.0, 0.0], [1.0, 1.0])], "u long, a array<double>, b array<double>")
    acc = decide.accuracy(decide.label(df, "a", "b"), ["u"]).first()
    assert (acc.n, acc.n_correct) == (2, 1)
    assert decide.accuracy(decide.label(df, "a", "b"), ["u"], trained_on_attended=False).first().n_correct == 1


def test_levels(spark):
    df = series(spark, [3, 1, 2, 2, 5])
    level = lambda m: signif.order_statistic(df, ["u"], F.col("x"), F.lit(m)).first().level
    assert [level(m) for m in (0, 1, 2, 3, 4, 5)] == [1, 5, 3, 2, 2, 1]
    assert signif.pooled_level(df, [], "x", 0.4).first().level == 3


def test_bh_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.9]
    out = signif.benjamini_hochberg(series(spark, p), ["u"], "x", ["t"]).orderBy("x").collect()
    assert [r.adjusted for r in out] == pytest.approx([0.05, 0.2 / 3, 0.2 / 3, 0.625, 0.9])


def test_cca_recovers_and_masks_nothing(spark):
    rng = np.random.default_rng(1)
    s = rng.standard_normal(600)
    x = np.outer(s, [1, -1, 0.5]) + rng.standard_normal((600, 3))
    y = np.outer(s, [0.7, 0.2]) + rng.standard_normal((600, 2))
    df = spark.createDataFrame([(1, t, x[t].tolist(), y[t].tolist()) for t in range(600)], "u long, t long, x array<double>, y array<double>").repartition(5)
    fit = models.cca_fit(df, ["u"], "x", "y", [3], [2], 2, shrink=False).orderBy("component").collect()
    qx, qy = (np.linalg.qr(v - v.mean(axis=0))[0] for v in (x, y))
    assert [r.r for r in fit] == pytest.approx(np.linalg.svd(qx.T @ qy)[1])


def test_residual_is_orthogonal(spark):
    rng = np.random.default_rng(2)
    rows = [(1, rng.standard_normal(3).tolist(), rng.standard_normal(2).tolist()) for _ in range(50)]
    df = spark.createDataFrame(rows, "u long, x array<double>, c array<double>")
    res = moments.regress_out_block(df, ["u"], "x", 3, "c", 2, "r").collect()
    assert np.abs(np.array([r.r for r in res]).T @ np.array([r.c for r in res])).max() < 1e-9


def test_permutation_null_is_lower_than_a_true_link(spark):
    rng = np.random.default_rng(3)
    s = rng.standard_normal(300)
    df = spark.createDataFrame([(0, t, float(s[t]), float(s[t] + 0.3 * rng.standard_normal())) for t in range(300)], "u long, t long, a double, b double")
    null = models.permuted_correlations(df, ["u"], "t", "a", "b", 60, chunk=25)
    assert null.count() == 60 and null.select("perm").distinct().count() == 60
    assert null.agg(F.max(F.abs("r"))).first()[0] < 0.5
    assert models.permuted_correlations(df, ["u"], "t", "a", "b", 10, block=20).count() == 10


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.upsert(old, new, ["k"], overwrite=False)) == [(1, "a"), (2, "b"), (3, "d")]
    path = str(tmp_path / "t")
    tables.save_upsert(old, path, ["k"])
    assert rows(tables.save_upsert(new, path, ["k"])) == rows(tables.load(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers at the same time: each retries on what the others committed, so every key is there in the end."""
    path = f"file://{tmp_path}/t"
    one = lambda i: tables.save_upsert(spark.createDataFrame([(i, f"w{i}"), (100, f"w{i}")], "k long, v string"), path, ["k"])
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, range(4)))
    got = {r.k: r.v for r in tables.load(spark, path).collect()}
    assert set(got) == {0, 1, 2, 3, 100} and tables.committed(spark, path)[0] == 3
    assert not tables.commit(spark, path, 3, "late") and tables.load(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        tables.load(spark, f"{tmp_path}/none")
    a, b = (tables.save_if_absent(spark.range(n), str(tmp_path / "once")).count() for n in (2, 5))
    assert a == b == 2


def test_folds_that_do_not_divide_are_noticed(spark):
    videos = spark.createDataFrame([(u, v) for u, n in ((1, 4), (2, 3)) for v in range(n)], "u long, vid long")
    folds.check_recordings(videos.where("u = 1"), ["u"], 2)
    with pytest.raises(ValueError):
        folds.check_recordings(videos, ["u"], 2)


def test_correlation_p_equals_quadrature(spark):
    cases = [(r, n) for n in (3, 4, 5, 10, 30, 200, 5000) for r in (0.0, 0.01, 0.05, -0.3, 0.6, -0.95, 0.9999)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long").withColumn("p", correlation_p(F.col("r"), F.col("n")))
    for row in df.collect():
        assert row.p == pytest.approx(kernels.pearson_p(row.r, row.n), abs=1e-9)
    edge = spark.createDataFrame([(1.0, 9), (float("nan"), 9), (0.5, 2)], "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert edge[0].p == 0 and all(np.isnan(e.p) for e in edge[1:])


def test_readers(spark, tmp_path):
    np.save(tmp_path / "g.npy", np.array([[1.0, np.nan], [3.0, 4.0], [5.0, 6.0]]))
    for name in ("a_b_b.set", "c.set", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = npy.read_npy(spark, f"file://{tmp_path}/*.npy", rows=2)
    assert [r.ch for r in got.orderBy("t").collect()] == [[1.0, None], [3.0, 4.0], [5.0, 6.0]] and got.rdd.getNumPartitions() == 2
    assert [r.ch for r in npy.filled(got, 2).orderBy("t").collect()] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    assert [(r.name, r.n_objects, r.att, r.unatt) for r in tables.list_recordings(spark, f"{tmp_path}/*").collect()] == [("a_b_b.set", 2, "b", "a"), ("c.set", 1, "c", None)]


def test_features_of_recordings(spark, tmp_path):
    data = {r: np.arange(n * 6, dtype=np.float32).reshape(n, 3, 2) + i for i, (r, n) in enumerate({"a": 25_000, "b": 7, "c": 3}.items())}
    for r, x in data.items():
        x[2, 1, 0] = np.nan
        np.save(tmp_path / f"{r}_reweight.npy", x)
    got = {}
    for row in npy.read_features(spark, str(tmp_path), ["a", "b"], 5, offset=4, rows=9000).orderBy("t").collect():
        got.setdefault(row.recording, []).append(row.ch)
    assert set(got) == {"a", "b"} and np.array(got["a"]) == pytest.approx(data["a"][4:9].reshape(5, 6)) and len(got["b"]) == 5
    line = npy.concatenated(npy.read_npy(spark, str(tmp_path), 9000)).orderBy("at").select("at", "t", "path").collect()
    assert [r.at for r in line] == list(range(25_010)) and line[25_000].path.endswith("b_reweight.npy")
    np.save(tmp_path / "o.npy", np.array([None, 1.0], object))
    with pytest.raises(Exception, match="only arrays of numbers"):
        npy.read_npy(spark, str(tmp_path / "o.npy")).count()


def test_dataset_modes(spark, tmp_path):
    path = str(tmp_path / "d")
    make = lambda n: lambda: spark.range(n).withColumnRenamed("id", "u")
    assert tables.load_dataset(spark, path, make(2), "new", ["u"]).count() == 2
    assert tables.load_dataset(spark, path, make(5), "add", ["u"]).count() == 5
    assert tables.load_dataset(spark, path, make(9), "load", ["u"]).count() == 5


def test_empty_tables(spark):
    empty = series(spark, [])
    assert clean.fill_linear(empty, ["u"], "t", "x").count() == 0
    assert models.intersubject(empty, ["u"], "t", "t", "x").count() == 0
    assert signif.pooled_level(empty, ["u"], "x", 0.05).count() == 0


def test_permuted_rows(spark):
    df = series(spark, range(30)).unionByName(series(spark, range(100, 105), u=2))
    got = {(r.u, r.t): r.x for r in segment.permute_rows(df, ["u"], "t", ["x"], seed=4).collect()}
    assert sorted(v for (u, _), v in got.items() if u == 0) == list(range(30)) and [got[0, t] for t in range(30)] != list(range(30))
    assert sorted(v for (u, _), v in got.items() if u == 2) == list(range(100, 105))
    assert got == {(r.u, r.t): r.x for r in segment.permute_rows(df.repartition(3), ["u"], "t", ["x"], seed=4).collect()}


def test_seeded_draws(spark):
    df = series(spark, range(40))
    a, b = (sorted(r.t for r in segment.random_subset(df, ["u"], "t", 4, seed=s).collect()) for s in (1, 1))
    assert a == b and len(set(a)) == 4
    moved = segment.random_rotation(df, ["u"], "t", 5, seed=3).collect()
    shift = {(r.pos - r.t) % 40 for r in moved}
    assert len(shift) == 1 and 5 <= shift.pop() <= 35 and {r.pos for r in moved} == set(range(40))
