"""Queries on fitted models against numpy versions that hold all samples in memory."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import folds, models, moments
from cadenza.operators.iterate import gcca_iterate
from cadenza.plans import experiments, modelling
from cadenza.sources.adapters import array_signal


def recording(spark, small):
    """{label: samples x channels}, in order."""
    pdf = array_signal(spark, small).toPandas().sort_values("vec")
    return {g: np.vstack(p["ch"]) for g, p in pdf.groupby("grp")}


def shrunk(x, dims):
    """Sample covariance whose diagonal blocks are Ledoit-Wolf estimates from the rows themselves."""
    cov, at = np.cov(x, rowvar=False), 0
    for d in dims:
        c = x[:, at : at + d] - x[:, at : at + d].mean(axis=0)
        cov[at : at + d, at : at + d] = kernels.ledoit_wolf(len(c), c.T @ c / len(c), ((c**2).sum(axis=1) ** 2).sum())
        at += d
    return cov


def isc(views):
    r = np.corrcoef(np.column_stack(views), rowvar=False)
    return r[np.triu_indices(len(r), 1)].mean()


def by_label(frame, *more):
    return {tuple(r[k] for k in ("grp", *more)): r for r in frame.collect()}


def test_cca_fit(spark, small):
    got = by_label(modelling.cca_fit(spark, small), "component")
    for g, x in recording(spark, small).items():
        x = x[:, :34]
        cov = shrunk(x, [32, 2])
        half = lambda c: np.linalg.inv(np.linalg.cholesky(c))
        hx, hy = half(cov[:32, :32]), half(cov[32:, 32:])
        u, _, vt = np.linalg.svd(hx @ cov[:32, 32:] @ hy.T)
        want = [abs(np.corrcoef(x[:, :32] @ hx.T @ u[:, c], x[:, 32:] @ hy.T @ vt[c])[0, 1]) for c in range(2)]
        assert [got[g, c + 1].r for c in range(2)] == pytest.approx(want, abs=2e-6)


def test_gcca_isc(spark, small):
    got = by_label(modelling.gcca_isc(spark, small), "component")
    for g, x in recording(spark, small).items():
        _, w = kernels.gcca(shrunk(x[:, :32], [8] * 4), [8] * 4, 2, len(x))
        for c in range(2):
            views = [x[:, 8 * v : 8 * v + 8] @ w[8 * v : 8 * v + 8, c] for v in range(4)]
            assert got[g, c + 1].isc == pytest.approx(isc(views), abs=2e-6)


def test_multimod_gcca_on_held_out_folds(spark, small):
    got = {(r.grp, r.fold, r.component, r.kind, r.of): r.r for r in modelling.multimod_gcca_cv(spark, small).collect()}
    dims, at, n = [12, 12, 4, 4], [0, 12, 24, 28, 32], 0
    for g, x in recording(spark, small).items():
        x = x[:, :32]
        size = len(x) // 3
        for fold in (1, 2, 3):
            test = np.zeros(len(x), bool)
            test[(fold - 1) * size : fold * size] = True
            _, w = kernels.gcca(shrunk(x[~test], dims), dims, 2, (~test).sum())
            for c in range(2):
                s = [x[test][:, at[v] : at[v + 1]] @ w[at[v] : at[v + 1], c] for v in range(4)]
                r = np.corrcoef(np.column_stack(s), rowvar=False)
                for (kind, of), (i, j) in {("isc", "eeg"): (0, 1), ("isc", "eog"): (2, 3), ("imc", "s0"): (0, 2), ("imc", "s1"): (1, 3)}.items():
                    assert got[g, fold, c + 1, kind, of] == pytest.approx(r[i, j], abs=2e-6)
                    n += 1
    assert n == len(got)


def test_si_gcca_solves_its_eigenproblem(spark, small):
    got = by_label(modelling.si_gcca(spark, small), "view", "component")
    for g, x in recording(spark, small).items():
        dims = [8, 8, 8, 8, 2]
        cov = shrunk(x[:, :34], dims)
        # the stimulus counts rho = 2 times: sum of the projections on the views and twice on the stimulus
        weight = np.repeat([1.0, 2.0], [32, 2])
        top = np.sort(np.linalg.eigvals(np.linalg.inv(kernels.block_diagonal(cov, dims)) @ cov @ np.diag(weight)).real)[::-1]
        assert [got[g, 0, c].lam for c in (1, 2)] == pytest.approx(1 / top[:2], abs=2e-6)


def folds_of(n):
    """(train, test) rows of two contiguous folds; an odd last row only trains."""
    size = n // 2
    for k in range(2):
        test = np.arange(k * size, (k + 1) * size)
        yield k + 1, np.setdiff1d(np.arange(n), test), test


def test_multimod_decode_on_held_out_trials(spark, small):
    got, seen = by_label(modelling.multimod_decode(spark, small), "fold", "trial"), 0
    for g, x in recording(spark, small).items():
        for fold, train, test in folds_of(len(x)):
            _, w = kernels.gcca(shrunk(x[train, :34], [16, 16, 2]), [16, 16, 2], 1, len(train))
            for trial in range(len(test) // 10):
                y = x[test[10 * trial : 10 * trial + 10]]
                eeg, row = [y[:, :16] @ w[:16], y[:, 16:32] @ w[16:32]], got[g, fold, trial]
                want = [isc([*eeg, y[:, i : i + 2] @ w[32:]]) for i in (32, 34)]
                assert [row.att, row.unatt] == pytest.approx(want, abs=2e-6)
                assert row.correct == (want[0] > want[1])
                seen += 1
    assert seen == len(got)


def test_si_gcca_cv_takes_the_weight_that_validates_best(spark, small):
    got = by_label(modelling.si_gcca_cv(spark, small))
    for g, x in recording(spark, small).items():
        val, train, dims = x[: len(x) // 10, :34], x[len(x) // 10 :, :34], [16, 16, 2]
        score = {}
        for rho in modelling.SWEEP:
            _, w = kernels.stimulus_gcca(shrunk(train, dims), dims, rho, 1, len(train))
            score[rho] = isc([val[:, :16] @ w[:16], val[:, 16:32] @ w[16:32], val[:, 32:] @ w[32:]])
        assert got[(g,)].isc == pytest.approx(max(score.values()), abs=2e-6)
        assert score[got[(g,)].rho] == pytest.approx(max(score.values()), abs=2e-6)


def test_si_gcca_over_folds(spark, small):
    got = {(r.grp, r.fold, r.component): r for r in modelling.si_gcca_cross_val(spark, small).collect()}
    chosen = by_label(modelling.si_gcca_cv(spark, small))
    dims, seen = [16, 16, 2], 0
    for g, x in recording(spark, small).items():
        rest = x[len(x) // 10 :, :34]
        size = len(rest) // 3
        for fold in (1, 2, 3):
            test = np.zeros(len(rest), bool)
            test[(fold - 1) * size : fold * size] = True
            rho = chosen[(g,)].rho
            _, w = kernels.stimulus_gcca(shrunk(rest[~test], dims), dims, rho, 2, (~test).sum())
            for c in range(2):
                r = got[g, fold, c + 1]
                views = lambda rows: [rows[:, :16] @ w[:16, c], rows[:, 16:32] @ w[16:32, c], rows[:, 32:] @ w[32:, c]]  # noqa: B023, E731
                assert r.rho == rho and r.isc_test == pytest.approx(isc(views(rest[test])), abs=2e-6) and r.isc_train == pytest.approx(isc(views(rest[~test])), abs=2e-6)
                assert 0 < r.level < 1
                seen += 1
    assert seen == len(got)


def test_dcca_on_held_out_trials(spark, small):
    got = by_label(modelling.dcca_decode(spark, small))
    for g, x in recording(spark, small).items():
        hits = n = 0
        for _, train, test in folds_of(len(x)):
            s, c, y = x[train, 32:34], x[train, 34:36], x[train, :32]
            full = np.cov(np.hstack([s, c, s - c, y]), rowvar=False)
            lam, ws, wy = kernels.discriminative(full[:2, :2], full[2:4, 2:4], full[6:, 6:], full[4:6, 4:], 1)
            if lam[0] == pytest.approx(1):  # the rival is the stronger in all directions: no filter of the signal, no trials
                assert (ws == 0).all()
                continue
            for t in range(len(test) // 10):
                z = x[test[10 * t : 10 * t + 10]]
                r = [np.corrcoef((z[:, i : i + 2] @ ws)[:, 0], (z[:, :32] @ wy)[:, 0])[0, 1] for i in (32, 34)]
                hits, n = hits + (r[0] > r[1]), n + 1
        assert (got[(g,)].n, got[(g,)].n_correct) == (n, hits)


def test_dcca_with_a_filter_of_the_competitor(spark, small):
    got = by_label(modelling.dcca_fit_apart(spark, small), "component")
    for g, x in recording(spark, small).items():
        y, s, c = x[:, :32], x[:, 32:34], x[:, 34:38]
        full = np.cov(np.hstack([s, -c, y]), rowvar=False)
        base = kernels.block_diagonal(full, [2, 4, 32])
        base[2:6, 2:6] *= -1
        top = np.sort(np.linalg.eigvals(np.linalg.solve(base, full)).real)[::-1]
        assert [got[g, k].lam for k in (1, 2)] == pytest.approx(list(top[:2]), rel=1e-5)


def lagged(x, lags, offset):
    """Channel by channel: the value at t + offset - k, 0 beyond either end."""
    out = np.zeros((len(x), x.shape[1] * lags))
    for c in range(x.shape[1]):
        for k in range(lags):
            for t in range(len(x)):
                if 0 <= t + offset - k < len(x):
                    out[t, c * lags + k] = x[t + offset - k, c]
    return out


def test_experiment_correlations(spark, small):
    s = modelling.SETUP
    rec = modelling.recordings(spark, small).toPandas().sort_values(["u", "t"])
    got = {(r.u, r.fold, r.component): r for r in experiments.correlations(modelling.recordings(spark, small), s).collect()}
    seen = 0
    for u, own in rec.groupby("u"):
        for fold in sorted(set(own.vid // s.leave_out)):
            test = (own.vid // s.leave_out == fold).to_numpy()
            if test.all():
                continue
            part = {}
            for role, rows in (("train", own[~test]), ("test", own[test])):
                part[role] = [lagged(np.vstack(rows[c]), n, o) for c, n, o in (("x", s.lags_x, s.offset_x), ("att", s.lags_s, s.offset_s), ("unatt", s.lags_s, s.offset_s))]
            z = np.hstack(part["train"][:2])
            wa, wb, _ = kernels.cca(shrunk(z, [4, 3]), 4, 2)
            for c in range(2):
                row = got[u, fold, c + 1]
                assert row.r_train == pytest.approx(abs(np.corrcoef(z[:, :4] @ wa[:, c], z[:, 4:] @ wb[:, c])[0, 1]), abs=1e-6)
                x, a, b = (v @ w[:, c] for v, w in zip(part["test"], (wa, wb, wb), strict=True))
                if min(np.ptp(v) for v in (x, a, b)) > 1e-9:
                    assert [row.att, row.unatt] == pytest.approx([np.corrcoef(x, v)[0, 1] for v in (a, b)], abs=1e-6)
                seen += 1
    assert seen == len(got)


def by_copies(rec, s, masked):
    """Weights with a copy of a subject's samples for each fold: lagged within (u, fold, role), then fitted."""
    both = folds.leave_out(rec, ["u"], s.leave_out).join(experiments.marked(rec, s, masked), ["u", "vid"])
    keys = ["u", "fold", "role"]
    return experiments.train(experiments.lagged(both, keys, s).where("role = 'train'"), s, ["u", "fold"])


@pytest.mark.parametrize("masked,change", [(False, {"lags_x": 4, "offset_x": 2, "lags_s": 5, "offset_s": 1}), (True, {}), (True, {"offset_x": 0, "combine": True, "after": 3}), (False, {"lags_x": 1, "offset_x": 0, "lags_s": 1})])
def test_folds_without_copies(spark, small, masked, change):
    """Totals less a fold's own sums, corrected at the seam, give the fits on copied training parts."""
    s = replace(modelling.SETUP, leave_out=1, **change)
    rec = modelling.recordings(spark, small).where("u < 12").persist()
    got = {(r.u, r.fold, r.component): r for r in experiments.train_folds(rec, s, masked).collect()}
    want = {(r.u, r.fold, r.component): r for r in by_copies(rec, s, masked).collect()}
    assert set(got) == set(want) and len(want) > 30
    for k, w in want.items():
        assert got[k].r == pytest.approx(w.r, abs=1e-6)
        assert abs(np.dot(got[k].wa, w.wa)) == pytest.approx(np.linalg.norm(got[k].wa) * np.linalg.norm(w.wa), rel=1e-4) or w.r < 1e-3
    parts = experiments.fold_of(experiments.lagged(experiments.marked(rec, s, masked), ["u"], s), s)
    assert parts.count() <= rec.count()  # no sample is copied


def test_accuracy_permutations(spark, small):
    """Rotated trials against plain loops: the drawn rotations lie between a quarter and three quarters."""
    s = modelling.SETUP
    line = experiments.test_line(modelling.recordings(spark, small).where("u < 12"), s)
    cut = experiments.trial_rows(line, 5, bootstrap=False).persist()
    got = {(r.u, r.perm): r.acc for r in experiments.permuted_accuracy(cut, s, 6, seed=3).collect()}
    n = {(r.u, r.fold): r.n for r in cut.groupBy("u", "fold").agg((F.max("trial") + 1).alias("n")).collect()}
    drawn = spark.createDataFrame([(*k, p, m) for k, m in n.items() for p in range(6)], "u long, fold long, perm long, n long")
    quarter = F.floor(F.col("n") / 4)
    drawn = {(r.u, r.fold, r.perm): r.by for r in drawn.withColumn("by", quarter + F.pmod(F.xxhash64(F.lit(3), "u", "fold", "perm"), 2 * quarter + 1)).collect()}
    pdf = cut.select("u", "fold", "trial", "pos", "component", "px", "pa", "pu").toPandas().sort_values(["component", "pos"])
    series = {k: {c: g[c].to_numpy().reshape(2, -1) for c in ("px", "pa", "pu")} for k, g in pdf.groupby(["u", "fold", "trial"])}
    corr = lambda a, b: [np.corrcoef(x, y)[0, 1] if min(np.ptp(x), np.ptp(y)) > 0 else np.nan for x, y in zip(a, b, strict=True)]
    for u, perm in got:
        hits = []
        for (v, fold), m in n.items():
            by = drawn[v, fold, perm]
            assert m // 4 <= by <= m // 4 * 3
            if v == u:
                for t in range(m):
                    x, y = series[u, fold, (t + by) % m]["px"], series[u, fold, t]
                    a, b = corr(x, y["pa"]), corr(x, y["pu"])
                    if not np.isnan(a + b).any():
                        hits.append(sum(a) > sum(b))
        assert got[u, perm] == pytest.approx(np.mean(hits))
    assert len(got) > 20


def test_experiment_isc_takes_all_subjects(spark, small):
    s = modelling.SETUP
    rec = modelling.recordings(spark, small).toPandas()
    got = {(r.grp, r.fold, r.component): r for r in modelling.experiment_isc(spark, small).collect()}
    assert {g for g, _, _ in got} == set(rec.u // 4)
    for g, own in rec.groupby(rec.u // 4):
        subjects = sorted(set(own.u))
        for fold in {f for h, f, _ in got if h == g}:
            stacks = {}
            for role in (False, True):
                parts = []
                for u in subjects:
                    rows = own[(own.u == u) & ((own.vid // s.leave_out == fold) == role)].sort_values("t")
                    h = lagged(np.vstack(rows["x"]), s.lags_x, s.offset_x)
                    parts.append(pd.DataFrame(h, index=rows["t"]))
                stacks[role] = pd.concat(parts, axis=1, join="inner").to_numpy()
            dims = [4] * len(subjects)
            _, w = kernels.gcca(shrunk(stacks[False], dims), dims, 2, len(stacks[False]))
            for c in range(w.shape[1]):
                views = [stacks[True][:, 4 * v : 4 * v + 4] @ w[4 * v : 4 * v + 4, c] for v in range(len(subjects))]
                assert got[g, fold, c + 1].isc == pytest.approx(isc(views), abs=2e-6)


@pytest.mark.parametrize("shrink", [True, False])
def test_gcca_of_19_subjects_by_iteration(spark, shrink):
    """All views in one fit, two keys at once, equal to the eigenproblem over all of them."""
    rng = np.random.default_rng(2)
    rows, data = [], {}
    for key in (1, None):
        latent = rng.standard_normal((600, 3)) * [1.5, 1.0, 0.7]
        x = np.hstack([latent @ rng.standard_normal((3, 8)) + 2 * rng.standard_normal((600, 8)) + 5 for _ in range(19)])
        data[key] = x
        rows += [(key, r.tolist()) for r in x]
    df = spark.createDataFrame(rows, "k long, z array<double>").repartition(4).persist()
    got = {(r.k, r.view, r.component): r for r in gcca_iterate(df, ["k"], "z", 8, 3, shrink).collect()}
    assert len(got) == 2 * 19 * 3
    for key, x in data.items():
        dims = [8] * 19
        cov = shrunk(x, dims) if shrink else np.cov(x, rowvar=False)
        lam, w = kernels.gcca(cov, dims, 3, len(x))
        f = len(x) * kernels.block_diagonal(cov, dims) @ w
        for v in range(19):
            for c in range(3):
                r = got[key, v, c + 1]
                assert r.lam == pytest.approx(lam[c], rel=1e-8)
                assert r.w == pytest.approx(w[8 * v : 8 * v + 8, c], abs=1e-6) and r.f == pytest.approx(f[8 * v : 8 * v + 8, c], abs=1e-4)


def test_fit_without_equals_a_fit_on_the_rest(spark):
    rng = np.random.default_rng(5)
    rows = [(u, f, (10 + rng.standard_normal(3)).tolist()) for u in (1, None) for f in (0, 1, 2, None) for _ in range(12)]
    df = spark.createDataFrame(rows, "u long, f long, z array<double>").repartition(5)
    got = moments.fit_by(df, ["u"], "z", [2, 1], lambda m: [(m.n, m.cov.ravel(), m.fourths)], "n double, cov array<double>, fourths array<double>", without="f").collect()
    assert sorted((str(r.u), r.f) for r in got) == [(u, f) for u in ("1", "None") for f in range(3)]
    for r in got:
        x = np.array([z for u, f, z in rows if u == r.u and f != r.f])
        c = x - x.mean(axis=0)
        assert r.n == len(x) == 36 and r.cov == pytest.approx(np.cov(x, rowvar=False).ravel())
        assert r.fourths == pytest.approx([((c[:, :2] ** 2).sum(axis=1) ** 2).sum(), (c[:, 2] ** 4).sum()], rel=1e-6)


def test_keys_far_apart_stay_apart(spark):
    """One subject with 20,000 folds beside the next subject: no two fits share their rows."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("u"), F.floor(F.col("id") / 2).alias("fold"), F.array(F.col("id").cast("double")).alias("z"))
    got = moments.fit_by(df, ["u", "fold"], "z", [1], lambda m: [(m.n, float(m.s[0]))], "n double, s double")
    assert got.agg(F.count("*"), F.max("n"), F.sum((F.col("s") != F.col("fold") * 2 + F.col("u")).cast("int"))).first()[:] == (40_000, 1.0, 0)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "u long, f long, z array<double>")
    for without in (None, "f"):
        assert models.gcca_fit(empty, ["u"], "z", 1, 1, without=without).count() == 0
    one = spark.createDataFrame([(1, 7, [1.0, 2.0]), (1, 7, [2.0, 1.0])], "u long, f long, z array<double>")
    assert models.gcca_fit(one, ["u"], "z", 1, 1, without="f").count() == 0
