"""Many short series in one call of Python: the same results as series by series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import decide, filters, halo, models, moments, runs, signif
from cadenza.plans import experiments, modelling
from cadenza.sources import npy


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scrambled_correlations_equal_scrambled_series():
    rng = np.random.default_rng(1)
    seeds = np.array([3, 1 << 40], np.uint64)
    for n, c in ((2, 2), (9, 2), (20, 4)):
        x = rng.standard_normal((2, n, c)).cumsum(axis=1)
        got = kernels.scrambled_correlations(x, seeds, 2, 5, most=40)
        for s in range(2):
            for p in range(5):
                phase = 2 * np.pi * kernels.uniforms(seeds[[s]], (2 + p) * (n // 2) * c, n // 2 * c).reshape(-1, c)
                phase[-1] *= n % 2
                spectrum = np.abs(np.fft.rfft(x[s], axis=0)).astype(complex)
                spectrum[1:] *= np.exp(1j * phase)
                assert got[s, p] == pytest.approx(kernels.mean_correlation(np.fft.irfft(spectrum, n=n, axis=0)), abs=1e-9)
    assert np.isnan(kernels.scrambled_correlations(np.ones((1, 6, 2)), seeds[:1], 0, 3)).all()
    u = kernels.uniforms(np.arange(100, dtype=np.uint64), 5, 400)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[0], u[1])[0, 1]) < 0.2


def test_permutations_of_many_short_series(spark):
    """No call of Python for each series, draws that do not depend on chunks or partitions, and one computation for a level."""
    df = spark.range(60 * 12).select((F.col("id") % 60).alias("u"), F.floor(F.col("id") / 60).alias("t"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.where("t < 4 + u % 9").persist()
    null = models.permuted_correlations(df, ["u"], "t", "a", "b", 30, chunk=7, seed=2)
    assert "FlatMapGroupsInPandas" not in plan(null)
    got = {(r.u, r.perm): r.r for r in null.collect()}
    again = {(r.u, r.perm): r.r for r in models.permuted_correlations(df.repartition(5), ["u"], "t", "a", "b", 30, chunk=30, seed=2).collect()}
    assert len(got) == 60 * 30 and set(got) == set(again) and max(abs(got[k] - again[k]) for k in got) < 1e-12
    assert len({round(v, 9) for v in got.values()}) > 1500
    level = {r.u: r.level for r in signif.pooled_level(null, ["u"], "r", 0.1).collect()}
    assert level == {u: sorted((abs(got[u, p]) for p in range(30)), reverse=True)[2] for u in range(60)}
    assert plan(signif.pooled_level(null, ["u"], "r", 0.1)).split("== Physical")[1].count("MapInPandas") == 1


def test_runs_are_cut_only_between_series(spark):
    df = spark.range(1000).select(F.floor(F.sqrt("id")).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:

        def task(batches):
            for frame, starts in runs.whole_runs(batches):
                for run in np.split(frame, starts[1:]):
                    assert (np.diff(run["id"]) == 1).all()
                    yield run.iloc[:1][["k"]].assign(n=len(run))

        got = runs.in_order(df, ["k"], ["id"]).mapInPandas(task, "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in got) == [(k, min(2 * k + 1, 1000 - k * k)) for k in range(32)]


def test_filters_of_many_short_series(spark):
    """Series shorter than the weights reach, in pieces, as each by itself; a row goes to no piece beyond the last and the chain is computed once."""
    rng = np.random.default_rng(4)
    data = {u: rng.standard_normal(1 + u % 23) for u in range(60)}
    df = spark.createDataFrame([(u, t, float(v)) for u, x in data.items() for t, v in enumerate(x)], "u long, t long, x double").repartition(3)
    h = filters.weights(30.0, 5.0, 10.0, analytic=True)
    got = {(r.u, r.t): r.x for r in filters.filtered(df, ["u"], "t", ["x"], h, rows=100).collect()}
    reach = len(h) // 2
    for u, x in data.items():
        m = min(reach, len(x) - 1)
        wide = np.concatenate([np.zeros(reach - m), 2 * x[0] - x[m:0:-1], x, 2 * x[-1] - x[::-1][1 : m + 1], np.zeros(reach - m)])
        want = np.abs(np.convolve(wide, h, "valid"))
        assert [got[u, t] for t in range(len(x))] == pytest.approx(list(want), abs=1e-9)
    line = halo.positions(df, ["u"], ["t"], "seq", 10, "n")
    assert halo.windowed(line, ["u"], "seq", 500, 500, lambda d, w: d.withColumn("_k", F.lit(1)), 10, "n").count() == sum(map(len, data.values()))
    spread = line.withColumn("p", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10)))).count()
    pieces = []
    halo.windowed(line, ["u"], "seq", 500, 500, lambda d, w: pieces.append(d) or d, 10, "n")
    assert pieces[0].count() == spread
    text = plan(filters.envelope(df, ["u"], "t", ["x"], 30.0, 5.0, 10.0, every=3, rows=40)).split("== Physical")[1]
    assert text.count("MapInPandas") == 2 and "FlatMapGroupsInPandas" not in text


def test_many_small_npy_files_are_read_by_few_tasks(spark, tmp_path):
    data = {k: np.arange(3.0 * (1 + k % 70)).reshape(-1, 3) for k in range(300)}
    for k, x in data.items():
        np.save(tmp_path / f"{k}.npy", x)
    reader = npy.NpyReader({"path": str(tmp_path), "rows": "16"})
    parts = reader.partitions()
    assert len(parts) == 2 and sum(len(p.ranges) for p in parts) == 300  # 600 tasks before
    got = npy.read_npy(spark, str(tmp_path), rows=16).withColumn("k", F.regexp_extract("path", r"([^/]+)\.npy$", 1))
    assert {(r.k, r.t): r.ch for r in got.collect()} == {(str(k), t): list(row) for k, x in data.items() for t, row in enumerate(x)}
    np.save(tmp_path / "big.npy", np.arange(3 << 20, dtype=float))
    parts = npy.NpyReader({"path": str(tmp_path), "rows": "500000"}).partitions()
    assert len(parts) == 2 + 7 and [p.ranges[0][1:] for p in parts[:2]] == [(0, 500_000), (500_000, 1_000_000)]
    assert [x[0] for b in reader.read(npy.Samples([(str(tmp_path / "big.npy"), 499_990, 510_005)])) for x in b["ch"].to_pylist()] == list(range(499_990, 510_005))
    df = spark.createDataFrame([(k, t, *map(float, row)) for k, x in data.items() for t, row in enumerate(x)], "u long, t long, a double, b double, c double").repartition(5)
    out = npy.write_npy(df, "u", "t", ["a", "b", "c"], f"file://{tmp_path}/out")
    assert "FlatMapGroupsInPandas" not in plan(out) and sorted(r.n for r in out.collect()) == sorted(len(x) for x in data.values())
    assert all((np.load(tmp_path / "out" / f"{k}.npy") == x).all() for k, x in data.items())


@pytest.mark.parametrize("bootstrap", [True, False])
def test_decoding_copies_no_samples(spark, small, bootstrap):
    """Counts from whole test parts equal those of trials cut by joins, for every fold, distractor and rotation; nothing is exploded."""
    s = modelling.SETUP
    rec = modelling.recordings(spark, small).where("u < 9")
    line = experiments.test_line(rec, s).persist()
    got = experiments.fold_scores(experiments.test_parts(rec, s), s, [5, 6], 7, seed=3, bootstrap=bootstrap, margin=1).persist()
    text = plan(got).split("== Physical")[1].split("MapInPandas")[0]
    assert "Generate" not in text and "SortMergeJoin" not in text
    seen = 0
    for length in (5, 6):
        cut = experiments.trial_rows(line, length, bootstrap, seed=3, margin=1).persist()
        t = experiments.by_trial(cut, ["u", "fold", "trial"], {"att": ("px", "pa"), "unatt": ("px", "pu"), "mismatch": ("px", "pd")})
        own = got.where(F.col("trial_len") == length)
        for rival, c in (("unatt", "att"), ("mismatch", "match")):
            want = {(r.u, r.fold): (r.n, r.n_correct) for r in decide.accuracy(decide.label(decide.drop_undefined(t, rival), "att", rival, s.used), ["u", "fold"]).collect()}
            assert {(r.u, r.fold): (r[f"n_{c}"], r[f"hits_{c}"]) for r in own.where(f"n_{c} > 0").collect()} == want
            seen += len(want)
        want = {(r.u, r.perm): r.acc for r in experiments.permuted_accuracy(cut, s, 7, seed=3).collect()}
        sums = own.select("u", F.posexplode(F.arrays_zip("ns", "hits")).alias("perm", "c")).groupBy("u", "perm").agg((F.sum("c.hits") / F.sum("c.ns")).alias("acc"))
        assert {(r.u, r.perm): r.acc for r in sums.where("acc is not null").collect()} == pytest.approx(want)
    assert seen > 60


def test_sums_and_fits_of_many_small_keys_together():
    rng = np.random.default_rng(6)
    dims, starts = [3, 4], np.array([0, 5, 6, 40, 60])
    x = rng.standard_normal((100, 7)) + 3
    parts = np.split(x, starts[1:])
    rows = moments.sums_by_group(x, dims, starts)
    flat = [np.concatenate(list(map(np.atleast_1d, moments.sums_of(p, dims)))) for p in parts]
    assert np.allclose(rows, flat) and moments.values_in(rows.shape[1], dims) == 7
    sums = [moments.sums_of(p, dims) for p in parts if len(p) > 10]
    many, single = moments.Stack(sums, dims), [moments.Moments(s, dims) for s in sums]
    for i, m in enumerate(single):
        assert np.allclose(many.cov[i], m.cov) and np.allclose([f[i] for f in many.fourths], m.fourths) and many.dims == m.dims
    cov = kernels.shrink_blocks(many.cov, many.n, dims, many.fourths)
    for got, f in ((kernels.cca(cov, 3, 2), lambda i: kernels.cca(cov[i], 3, 2)), (kernels.gcca(cov, dims, 2, many.n), lambda i: kernels.gcca(cov[i], dims, 2, many.n[i]))):
        for i, m in enumerate(single):
            assert np.allclose(cov[i], kernels.shrink_blocks(m.cov, m.n, dims, m.fourths))
            assert all(np.allclose(g[i], w) for g, w in zip(got, f(i), strict=True))


def test_fits_of_a_stack_with_a_singular_member(spark):
    """A key with too few samples for all components is fitted by itself; the others' fits stay."""
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(12) for _ in range(30)] + [(12, [1.0, 2.0, 3.0, 4.0])] * 3
    df = spark.createDataFrame(rows, "k long, z array<double>").repartition(2)
    got = models.gcca_fit(df, ["k"], "z", 2, 3, shrink=False).collect()
    assert {k: len({r.component for r in got if r.k == k}) for k in range(13)} == {**dict.fromkeys(range(12), 3), 12: 0}
    for k in range(12):
        x = np.array([z for j, z in rows if j == k])
        lam, w = kernels.gcca(np.cov(x, rowvar=False), [2, 2], 3, 30)
        for r in (r for r in got if r.k == k):
            assert r.lam == pytest.approx(lam[r.component - 1]) and np.allclose(r.w, w[2 * r.view : 2 * r.view + 2, r.component - 1])


def test_experiment_isc_calls_no_python_for_each_group(spark, small):
    text = plan(modelling.experiment_isc(spark, small)).split("== Physical")[1]
    assert "FlatMapGroupsInPandas" not in text and text.count("MapInPandas") == 1  # the permutations, once; the fits are settled
