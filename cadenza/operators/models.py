"""Least squares, CCA, GCCA and their kin: moments by Spark, a small kernel per key, weights as a table, projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.functions.expr import safe_corr
from cadenza.operators.moments import Moments, Stack, fit_by, head_of
from cadenza.operators.runs import alike, in_order, whole_runs

CCA_SCHEMA = "component long, r double, wa array<double>, wb array<double>, fa array<double>"
GCCA_SCHEMA = "view long, component long, lam double, w array<double>, f array<double>"


def cca_fit(df: DataFrame, keys: list[str], x: str, y: str, dims_x: list[int], dims_y: list[int], components: int, shrink: bool = True, rank: int | None = None, without: str | None = None, seams: DataFrame | None = None) -> DataFrame:
    """(keys, component, r, wa, wb, fa): filters of both sides, correlation on these samples, forward model of side x.

    ``dims_x`` and ``dims_y`` are the widths of stacked modalities, each shrunk by itself. ``without`` and ``seams`` as in ``fit_by``.
    """
    dx, dims = sum(dims_x), [*dims_x, *dims_y]

    def kernel(m: Moments) -> list[tuple]:
        cov = kernels.shrink_blocks(m.cov, m.n, dims, m.fourths) if shrink else m.cov
        wa, wb, _ = kernels.cca(cov, dx, components, rank)
        va, vb = (np.einsum("ik,ij,jk->k", w, c, w) for w, c in ((wa, m.cov[:dx, :dx]), (wb, m.cov[dx:, dx:])))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.einsum("ik,ij,jk->k", wa, m.cov[:dx, dx:], wb) / np.sqrt(va * vb)
        wa = wa * np.where(r < 0, -1.0, 1.0)
        fa = kernels.haufe(m.cov[:dx, :dx], wa)
        return [(c + 1, abs(r[c]), wa[:, c], wb[:, c], fa[:, c]) for c in range(len(r))]

    def many(m: Stack) -> list[list[tuple]]:
        cov = kernels.shrink_blocks(m.cov, m.n, dims, m.fourths) if shrink else m.cov
        wa, wb, _ = kernels.cca(cov, dx, components)
        va, vb, ab = (np.einsum("mik,mij,mjk->mk", p, c, q) for p, c, q in ((wa, m.cov[:, :dx, :dx], wa), (wb, m.cov[:, dx:, dx:], wb), (wa, m.cov[:, :dx, dx:], wb)))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = ab / np.sqrt(va * vb)
        wa = wa * np.where(r < 0, -1.0, 1.0)[:, None]
        fa = kernels.haufe(m.cov[:, :dx, :dx], wa)
        return [[(c + 1, abs(r[i, c]), wa[i, :, c], wb[i, :, c], fa[i, :, c]) for c in range(r.shape[1])] for i in range(len(r))]

    if rank is None:
        kernel.many = many
    z = F.concat(x, y)
    return fit_by(df.withColumn("_z", z), keys, "_z", dims, kernel, CCA_SCHEMA, without, None if seams is None else seams.withColumn("_z", z))


def gcca_rows(m: Moments, components: int, shrink: bool, rho: float | None) -> list[tuple]:
    cov = kernels.shrink_blocks(m.cov, m.n, m.dims, m.fourths) if shrink else m.cov
    lam, w = kernels.gcca(cov, m.dims, components, m.n) if rho is None else kernels.stimulus_gcca(cov, m.dims, rho, components, m.n)
    f, rows, at = m.n * kernels.block_diagonal(cov, m.dims) @ w, [], 0
    for view, d in enumerate(m.dims):
        rows += [(view, c + 1, lam[c], w[at : at + d, c], f[at : at + d, c]) for c in range(w.shape[1])]
        at += d
    return rows


def gcca_fit(df: DataFrame, keys: list[str], z: str, dims: list[int] | int, components: int, shrink: bool = True, rho: float | None = None, without: str | None = None) -> DataFrame:
    """(keys, view, component, lam, w, f): GCCA filters of each view of stacked arrays, and forward models.

    With ``rho`` the last view is a stimulus of that weight. Views are subjects, modalities or both; ``dims`` has their
    widths, or the one width of all, as many as a key has. Their total width bounds the kernel's memory.
    """

    def kernel(m: Moments) -> list[tuple]:
        return gcca_rows(m, components, shrink, rho)

    def many(m: Stack) -> list[list[tuple] | None]:
        """None for all where one of them lacks a component: those are fitted one by one."""
        cov = kernels.shrink_blocks(m.cov, m.n, m.dims, m.fourths) if shrink else m.cov
        lam, w = kernels.gcca(cov, m.dims, components, m.n)
        if lam.shape[1] < min(components, cov.shape[1]):
            return [None] * len(cov)
        f = m.n[:, None, None] * kernels.block_diagonal(cov, m.dims) @ w
        places = [(v, c, slice(at, at + d)) for v, (at, d) in enumerate(zip(np.cumsum([0, *m.dims]), m.dims)) for c in range(w.shape[2])]
        return [[(v, c + 1, lam[i, c], w[i, at, c], f[i, at, c]) for v, c, at in places] for i in range(len(cov))]

    if rho is None:
        kernel.many = many
    return fit_by(df, keys, z, dims, kernel, GCCA_SCHEMA, without)


def gcca_sweep(df: DataFrame, keys: list[str], z: str, dims: list[int], components: int, rhos: list[float], shrink: bool = True, without: str | None = None) -> DataFrame:
    """(keys, rho, view, component, lam, w, f): ``gcca_fit`` for each weight of the stimulus, from one set of moments."""

    def kernel(m: Moments) -> list[tuple]:
        return [(r, *row) for r in rhos for row in gcca_rows(m, components, shrink, r)]

    return fit_by(df, keys, z, dims, kernel, f"rho double, {GCCA_SCHEMA}", without)


def isc_of(m: Moments, w: np.ndarray) -> float:
    """Mean correlation over all pairs of views on the samples that the moments sum up, for one component's filters."""
    edges = np.cumsum([0, *m.dims])
    p = np.zeros((len(w), len(m.dims)))
    for v, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        p[i:j, v] = w[i:j]
    c = p.T @ m.cov @ p
    s = np.sqrt(np.diag(c))
    if len(c) < 2 or (s <= 0).any():
        return float("nan")
    return float((c / np.outer(s, s))[np.triu_indices(len(c), 1)].mean())


def gcca_sweep_scored(df: DataFrame, keys: list[str], z: str, dims: list[int], components: int, rhos: list[float], shrink: bool = True, without: str | None = None) -> DataFrame:
    """(keys, rho, component, isc_train, ws): as ``gcca_sweep``, the filters of all views in one array, with their ISC in training.

    That follows from the moments too, so training samples are not projected.
    """

    def kernel(m: Moments) -> list[tuple]:
        out = []
        for r in rhos:
            rows = gcca_rows(m, components, shrink, r)
            for c in sorted({x[1] for x in rows}):
                w = np.concatenate([x[3] for x in rows if x[1] == c])
                out.append((r, c, isc_of(m, w), w))
        return out

    return fit_by(df, keys, z, dims, kernel, "rho double, component long, isc_train double, ws array<double>", without)


def discriminative_fit(df: DataFrame, keys: list[str], signal: str, compete: str, target: str, d: int, dy: int, components: int, without: str | None = None) -> DataFrame:
    """(keys, component, lam, ws, wy): filters that favour the signal over its competitor against one target."""
    diff = F.zip_with(F.col(signal), F.col(compete), lambda a, b: a - b)
    both = df.withColumn("_z", F.concat(F.col(signal), F.col(compete), diff, F.col(target)))

    def kernel(m: Moments) -> list[tuple]:
        c = m.cov
        lam, ws, wy = kernels.discriminative(c[:d, :d], c[d : 2 * d, d : 2 * d], c[3 * d :, 3 * d :], c[2 * d : 3 * d, 2 * d :], components)
        return [(k + 1, lam[k], ws[:, k], wy[:, k]) for k in range(len(lam))]

    return fit_by(both, keys, "_z", [d, d, d, dy], kernel, "component long, lam double, ws array<double>, wy array<double>", without)


def discriminative_fit_apart(df: DataFrame, keys: list[str], signal: str, compete: str, target: str, dims: tuple[int, int, int], components: int, without: str | None = None) -> DataFrame:
    """(keys, component, lam, ws, wc, wy): as ``discriminative_fit`` with a filter of the competitor's own.

    ``dims`` are the widths of signal, competitor and target, which may all differ.
    """
    ds, dc, dy = dims

    def kernel(m: Moments) -> list[tuple]:
        lam, w = kernels.discriminative_apart(m.cov, [ds, dc, dy], components, m.n)
        return [(k + 1, lam[k], w[:ds, k], w[ds : ds + dc, k], w[ds + dc :, k]) for k in range(len(lam))]

    both = df.withColumn("_z", F.concat(signal, compete, target))
    return fit_by(both, keys, "_z", [ds, dc, dy], kernel, "component long, lam double, ws array<double>, wc array<double>, wy array<double>", without)


def least_squares_fit(df: DataFrame, keys: list[str], x: str, y: str, dx: int, dy: int) -> DataFrame:
    """(keys, w, mse): weights (dx x dy, row by row) that predict y from x without intercept, and the mean squared error."""

    def kernel(m: Moments) -> list[tuple]:
        gx, gxy, gy = m.gram[:dx, :dx], m.gram[:dx, dx:], m.gram[dx:, dx:]
        w = np.linalg.lstsq(gx, gxy, rcond=None)[0]
        return [(w.ravel(), (np.trace(gy) - 2 * (w * gxy).sum() + np.trace(w.T @ gx @ w)) / m.n / dy)]

    return fit_by(df.withColumn("_z", F.concat(x, y)), keys, "_z", [dx, dy], kernel, "w array<double>, mse double")


def project(df: DataFrame, weights: DataFrame, keys: list[str], sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows by component: for each name, the inner product of an array with a weight, e.g. {"a": ("x", "wa")}.

    The arrays keep their means, which drop out of correlations and covariances.
    """
    both = df.join(weights, keys)
    return both.withColumns({name: F.aggregate(F.zip_with(F.col(x), F.col(w), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) for name, (x, w) in sides.items()})


def correlate(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per ``keys``: a correlation for each named pair of columns."""
    return df.groupBy(*keys).agg(*[safe_corr(a, b).alias(n) for n, (a, b) in pairs.items()])


def intersubject(df: DataFrame, by: list[str], t: str, subject: str, col: str) -> DataFrame:
    """(by, isc, iscov, n_views): mean correlation and covariance over all pairs of subjects with a common time base.

    No pairs are formed: with standardised series z, the sum over pairs i != j of r_ij is the sum over t of
    (sum_i z)^2 - sum_i z^2, over T - 1; covariances likewise. Subjects whose series is constant leave ISC undefined.
    """
    stats = df.groupBy(*by, subject).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"), F.count(F.lit(1)).alias("_t"))
    c = df.join(stats, [*by, subject]).select(*by, t, "_t", (F.col(col) - F.col("_m")).alias("_c"), F.coalesce(F.try_divide(F.col(col) - F.col("_m"), F.col("_s")), F.lit(float("nan"))).alias("_z"))
    at = c.groupBy(*by, t).agg(*[(F.pow(F.sum(v), F.lit(2.0)) - F.sum(F.pow(v, F.lit(2.0)))).alias(v) for v in ("_c", "_z")], F.count(F.lit(1)).alias("_n"), F.max("_t").alias("_t"))
    pairs = F.max("_n") * (F.max("_n") - 1) * (F.max("_t") - 1)
    return at.groupBy(*by).agg(F.try_divide(F.sum("_z"), pairs).alias("isc"), F.try_divide(F.sum("_c"), pairs).alias("iscov"), F.max("_n").alias("n_views"))


def intersubject_trials(df: DataFrame, by: list[str], t: str, subject: str, col: str, length: int) -> DataFrame:
    """(by, trial, isc, iscov, n_views): ``intersubject`` within trials of ``length`` samples of ``t``; incomplete trials are dropped.

    ``t`` numbers the common samples of ``by`` from 0, the same for all subjects.
    """
    last = df.groupBy(*by).agg((F.max(t) + 1).alias("_len"))
    cut = df.join(last, by).withColumn("trial", F.floor(F.col(t) / length)).where(F.col("trial") < F.floor(F.col("_len") / length))
    return intersubject(cut.drop("_len"), [*by, "trial"], t, subject, col)


def per_series(df: DataFrame, keys: list[str], t: str, cols: list[str], apply: Callable[[np.ndarray, int], np.ndarray], seed: int = 0) -> DataFrame:
    """Apply a kernel (samples x channels, seed) to each whole series of ``keys``; it may change the number of samples.

    One series, that is one recording of one subject, has to fit into a task; keys should name the recording. The seed
    differs by key, so channels and series get independent draws that repeat from run to run.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"{t} long", *[f"{c} double" for c in cols]])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        own = int(pd.util.hash_pandas_object(pdf[keys].iloc[:1], index=False).iloc[0]) if keys else 0
        out = np.asarray(apply(pdf[cols].to_numpy(float), (seed * 1_000_003 + own) % (1 << 63)))
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**{k: [v] * len(out) for k, v in head.items()}, t: np.arange(len(out)), **{c: out[:, i] for i, c in enumerate(cols)}})

    return df.select(*keys, t, *cols).groupBy(*keys).applyInPandas(task, schema)


def permuted(df: DataFrame, keys: list[str], t: str, cols: list[str], permutations: int, chunk: int = 50, block: int | None = None, seed: int = 0) -> DataFrame:
    """(keys, perm, r): mean correlations between columns that are all phase-scrambled (with ``block`` block-shuffled).

    ``cols`` are columns of numbers, or one array column. Columns are scrambled apart from each other. A key's series fits a
    task; permutations are dealt in chunks, so that one key's work spreads over tasks. Series of one length are scrambled together.
    """
    chunks = -(-permutations // chunk)
    spread = df.select(*keys, t, *cols, F.xxhash64(F.lit(seed), *keys).alias("_own")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kept = [*keys, "_own", "_chunk", "_at", *cols]

    def blocks(x: np.ndarray, own: int, first: int, n: int) -> list[float]:
        draw = lambda p: [kernels.shuffle_blocks(x[:, [i]], block, [seed, own, p, i])[: len(x)] for i in range(x.shape[1])]
        return [kernels.mean_correlation(np.hstack(draw(p))) for p in range(first, first + n)]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_runs(batches):
            values = [frame[c].to_numpy() for c in cols]
            size, widths = np.diff([*starts, len(frame)]), [np.array([np.size(v[i]) for i in starts]) for v in values]
            first, own = frame["_chunk"].to_numpy(np.int64)[starts] * chunk, frame["_own"].to_numpy(np.int64)[starts].view(np.uint64)
            heads, perms, found = [], [], []
            for some in alike(size, first, *widths):
                at = starts[some][:, None] + np.arange(size[some[0]])
                x = np.concatenate([np.stack(v[at.ravel()]).astype(float).reshape(*at.shape, -1) for v in values], axis=2)
                lo = int(first[some[0]])
                n = min(chunk, permutations - lo)
                r = kernels.scrambled_correlations(x, own[some], lo, n) if block is None else np.array([blocks(s, int(o), lo, n) for s, o in zip(x, own[some], strict=True)])
                heads.append(np.repeat(starts[some], n))
                perms.append(np.tile(np.arange(lo, lo + n), len(some)))
                found.append(r.ravel())
            yield frame[keys].iloc[np.concatenate(heads)].reset_index(drop=True).assign(perm=np.concatenate(perms), r=np.concatenate(found))

    return in_order(spread, [*keys, "_chunk"], [t]).select(*kept).mapInPandas(task, ", ".join(filter(None, [head_of(df, keys), "perm long, r double"])))


def permuted_correlations(df: DataFrame, keys: list[str], t: str, a: str, b: str, permutations: int, chunk: int = 50, block: int | None = None, seed: int = 0) -> DataFrame:
    """(keys, perm, r): correlations of ``a`` with ``b`` after both are scrambled; NaN where one is constant."""
    return permuted(df, keys, t, [a, b], permutations, chunk, block, seed)


def as_array(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])
