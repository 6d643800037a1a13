"""Small numpy kernels: what is left of a model once Spark has reduced the samples to moments, and per-series filters."""

from __future__ import annotations

import numpy as np

Array = np.ndarray
NOISE = 1e-10  # eigenvalues below this share of the largest are rounding: fewer samples than channels leave such directions


def powered(m: Array, power: float, rank: int | None = None) -> Array:
    """Power of a symmetric matrix, or of each of a stack, over its ``rank`` largest eigenvalues (None: those above rounding)."""
    lam, v = np.linalg.eigh((m + m.swapaxes(-1, -2)) / 2)
    keep = (lam[..., -1:] > 0) & (lam > lam[..., -1:] * m.shape[-1] * np.finfo(float).eps)
    if rank is not None:
        keep[..., : max(0, lam.shape[-1] - rank)] = False
    return (v * np.where(keep, np.where(keep, lam, 1.0) ** power, 0.0)[..., None, :]) @ v.swapaxes(-1, -2)


def rank_of(m: Array) -> int:
    return int(np.linalg.matrix_rank(m, hermitian=True))


def ledoit_wolf(n: float | Array, cov: Array, fourth: float | Array) -> Array:
    """Shrunk covariance of one block, or of a stack. ``cov`` has divisor n; ``fourth`` is the sum of squared squared norms of the centred rows."""
    d = cov.shape[-1]
    mean, square = np.trace(cov, axis1=-2, axis2=-1) / d, (cov**2).sum(axis=(-2, -1))
    off, noise = square - d * mean**2, (fourth / n - square) / n
    share = np.where(off <= 0, 0.0, np.clip(noise / np.where(off <= 0, 1.0, off), 0.0, 1.0))[..., None, None]
    return (1 - share) * cov + share * np.asarray(mean)[..., None, None] * np.eye(d)


def shrink_blocks(cov: Array, n: float | Array, dims: list[int], fourths: list[float] | list[Array]) -> Array:
    """Sample covariance (divisor n - 1), or a stack of them, with the diagonal blocks replaced by shrunk ones."""
    out, at, share = cov.copy(), 0, np.asarray((n - 1) / n)[..., None, None]
    for d, f in zip(dims, fourths, strict=True):
        s = slice(at, at + d)
        out[..., s, s] = ledoit_wolf(n, cov[..., s, s] * share, f)
        at += d
    return out


def block_diagonal(cov: Array, dims: list[int]) -> Array:
    out, at = np.zeros_like(cov), 0
    for d in dims:
        out[..., at : at + d, at : at + d] = cov[..., at : at + d, at : at + d]
        at += d
    return out


def fix_signs(w: Array) -> Array:
    """Columns with their largest entry positive, so results repeat."""
    top = np.take_along_axis(w, np.abs(w).argmax(axis=-2)[..., None, :], axis=-2)
    return w * np.where(top < 0, -1.0, 1.0)


def without_noise(w: Array) -> Array:
    """Columns with entries of rounding size 0, so that a side which has no part in a filter has no series either."""
    return np.where(np.abs(w) < NOISE * np.abs(w).max(axis=0), 0.0, w)


def cca(cov: Array, dx: int, k: int, rank: int | None = None) -> tuple[Array, Array, Array]:
    """(wa, wb, r): ``k`` pairs of filters, unit variance each, and their correlations under ``cov``.

    By the singular values of the whitened cross-covariance; signs are such that r is not negative. Without ``rank`` also for a stack.
    """
    cx, cy, cxy = cov[..., :dx, :dx], cov[..., dx:, dx:], cov[..., :dx, dx:]
    if rank is not None:
        rank = min(rank, rank_of(cx), rank_of(cy))
    wx, wy = powered(cx, -0.5, rank), powered(cy, -0.5, rank)
    u, s, vt = np.linalg.svd(wx @ cxy @ wy)
    k = min(k, s.shape[-1])
    wa = fix_signs(wx @ u[..., :k])
    wb = wy @ vt[..., :k, :].swapaxes(-1, -2)
    r = np.einsum("...ik,...ij,...jk->...k", wa, cxy, wb)
    return wa, wb * np.where(r < 0, -1.0, 1.0)[..., None, :], np.abs(r)


def smallest_pencil(a: Array, b: Array, k: int) -> tuple[Array, Array]:
    """(lam, w): the k smallest positive of a w = lam b w, as the k largest of b against a.

    ``a``, block diagonal, is whitened: it stays positive where ``b``, whose diagonal blocks alone are shrunk, need not be.
    """
    half = powered(a, -0.5)
    mu, v = np.linalg.eigh(half @ b @ half)
    some = np.flatnonzero((mu > 1e-12).reshape(-1, mu.shape[-1]).all(axis=0))[::-1][:k]
    return 1 / mu[..., some], half @ v[..., some]


def gcca(cov: Array, dims: list[int], k: int, n: float | Array) -> tuple[Array, Array]:
    """(lam, w) of MAXVAR: smallest of the pencil (block diagonal, full); filters scaled to a shared space of unit norm.

    For a stack too: then components that are not there in all of it are left out.
    """
    diag = block_diagonal(cov, dims)
    lam, w = smallest_pencil(diag, cov, k)
    wl = w * lam[..., None, :]
    return lam, fix_signs(w @ powered(wl.swapaxes(-1, -2) @ (cov * np.asarray(n)[..., None, None]) @ wl, -0.5))


def stimulus_gcca(cov: Array, dims: list[int], rho: float, k: int, n: float) -> tuple[Array, Array]:
    """GCCA whose last block, the stimulus, has weight ``rho``."""
    scale = np.ones(len(cov))
    scale[-dims[-1] :] = np.sqrt(rho)
    lam, w = smallest_pencil(block_diagonal(cov, dims), cov * scale[:, None] * scale[None], k)
    w = w * np.where(np.arange(len(w)) >= len(w) - dims[-1], 1 / np.sqrt(rho), 1.0)[:, None]
    wl = w * lam
    both = cov * scale[:, None] ** 2 * scale[None] ** 2
    return lam, fix_signs(w @ powered(wl.T @ (both * n) @ wl, -0.5))


def discriminative(signal: Array, compete: Array, target: Array, cross: Array, k: int) -> tuple[Array, Array, Array]:
    """(lam, ws, wy): largest of [signal - compete, target] against (signal - compete) + target; that side is indefinite.

    ``signal`` and ``compete`` are covariances of the two sources, ``cross`` (d x y) of their difference with the
    target; the difference's own covariance stands in the full matrix's corner.
    """
    d, y = len(signal), len(target)
    full, base = np.zeros((d + y, d + y)), np.zeros((d + y, d + y))
    full[:d, :d], full[d:, d:] = cross[:, :d], target
    full[:d, d:] = cross[:, d:]
    full[d:, :d] = cross[:, d:].T
    base[:d, :d], base[d:, d:] = signal - compete, target
    lam, w = np.linalg.eig(np.linalg.pinv(base, rcond=NOISE, hermitian=True) @ full)
    order = np.argsort(-lam.real)[:k]
    w = fix_signs(without_noise(w[:, order].real))
    return lam[order].real, w[:d], w[d:]


def discriminative_apart(cov: Array, dims: list[int], k: int, n: float) -> tuple[Array, Array]:
    """(lam, w): largest of the full covariance of [signal, -competitor, target] against its blocks, the competitor's negative.

    Filters are scaled so that w' base w is lam / n in size.
    """
    ds, dc, _ = dims
    sign = np.ones(len(cov))
    sign[ds : ds + dc] = -1
    base = block_diagonal(cov, dims) * sign[:, None]
    lam, w = np.linalg.eig(np.linalg.pinv(base, rcond=NOISE, hermitian=True) @ (cov * sign[:, None] * sign[None]))
    order = np.argsort(-lam.real)[:k]
    lam, w = lam[order].real, without_noise(w[:, order].real)
    norm = np.abs(np.einsum("ik,ij,jk->k", w, base, w)) * n
    return lam, fix_signs(w * np.sqrt(np.abs(lam) / np.where(norm > 0, norm, 1.0)))


def mean_correlation(x: Array) -> float:
    """Mean correlation over all pairs of columns; NaN where a column is constant."""
    if len(x) < 2 or x.shape[1] < 2 or (np.ptp(x, axis=0) == 0).any():
        return float("nan")
    r = np.corrcoef(x, rowvar=False)
    return float(r[np.triu_indices(len(r), 1)].mean())


def standard(x: Array) -> Array:
    """Series along the last axis centred and of unit norm, so that inner products are correlations; NaN where one is constant."""
    c = x - x.mean(axis=-1, keepdims=True)
    norm = np.where(np.ptp(x, axis=-1, keepdims=True) > 0, np.sqrt((c**2).sum(axis=-1, keepdims=True)), np.nan)
    return c / norm


def trial_hits(own: Array, rival: Array, used: int) -> tuple[Array, Array]:
    """(n, hits) by row of correlations (rows x components x trials): trials without NaN, and those whose ``used`` best sum to more than the rival's."""
    defined = ~np.isnan(own + rival).any(axis=1)
    top = lambda r: -np.sort(-np.nan_to_num(r), axis=1)[:, :used].sum(axis=1)
    return defined.sum(axis=1), (defined & (top(own) > top(rival))).sum(axis=1)


def decoded(x: Array, a: Array, u: Array, starts: Array, first: Array, shifts: Array, length: int, margin: int, used: int) -> list[Array]:
    """Counts over the trials of test parts of one size (parts x components x samples): n and hits of attention and of match-mismatch, then both arrays by shift.

    ``first`` is NaN where a trial has no distractor; with a shift, trial t of ``x`` is replaced by trial t + shift, around.
    """
    m, c, _ = x.shape
    cut = lambda y, at: standard(y[np.arange(m)[:, None, None, None], np.arange(c)[None, :, None, None], at[:, None]])
    at = starts[:, :, None] + np.arange(length)
    lead, some = np.maximum(starts - margin, 0)[:, :, None], ~np.isnan(first)
    far = np.nan_to_num(first).astype(np.int64)[:, :, None] + np.arange(length)
    far = np.where(some[:, :, None], np.where(far < lead, far, far - lead + starts[:, :, None] + (length + margin)), 0)
    zx, za, zu, zd = cut(x, at), cut(a, at), cut(u, at), cut(a, far)
    r = lambda p, q: np.einsum("mctl,mctl->mct", p, q)
    own = r(zx, za)
    out = [*trial_hits(own, r(zx, zu), used), *trial_hits(own, np.where(some[:, None], r(zx, zd), np.nan), used)]
    n, trials = shifts.shape[1], np.arange(starts.shape[1])
    turned = lambda by: zx[np.arange(m)[:, None], :, (trials + by[:, None]) % len(trials)].transpose(0, 2, 1, 3)
    ways = np.unique(shifts)
    lists = [np.full(m, w) for w in ways] if len(ways) < n else list(shifts.T)  # few parts of a kind have few rotations: each once
    counts = [trial_hits(r(z, za), r(z, zu), used) for z in map(turned, lists)]
    both = [np.stack([k[i] for k in counts], axis=1) if n else np.zeros((m, 0), np.int64) for i in (0, 1)]
    if len(ways) < n:
        both = [np.take_along_axis(b, np.searchsorted(ways, shifts), axis=1) for b in both]
    return out + both


def haufe(cov: Array, w: Array) -> Array:
    """Forward model: how each latent series shows in the channels."""
    return cov @ w @ np.linalg.pinv(w.swapaxes(-1, -2) @ cov @ w)


def phase_scramble(x: Array, seed: int | list[int]) -> Array:
    """Series (samples x channels) with their amplitude spectra and new random phases, channel by channel."""
    rng, spectrum = np.random.default_rng(seed), np.abs(np.fft.rfft(x, axis=0))
    phase = np.exp(2j * np.pi * rng.random(spectrum.shape))
    phase[0] = 1
    if len(x) % 2 == 0:
        phase[-1] = 1
    return np.fft.irfft(spectrum * phase, n=len(x), axis=0)


def uniforms(keys: Array, first: int, n: int) -> Array:
    """(keys x n): of each key's own series of numbers in [0, 1) those from ``first`` on, by SplitMix64: a mixed counter, so any part can be drawn."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def scrambled_correlations(x: Array, keys: Array, first: int, n: int, most: int = 1 << 20) -> Array:
    """(series x n): ``mean_correlation`` of series (series x samples x columns) whose columns are phase-scrambled apart, draws ``first`` on.

    Scrambling keeps amplitude spectra, so the correlations follow from these and the phases (Parseval), without series in time. ``keys``
    seed the draws of each series. NaN where a column is constant.
    """
    m, length, c = x.shape
    out = np.full((m, n), np.nan)
    if length < 2 or c < 2:
        return out
    amp = np.abs(np.fft.rfft(x, axis=1))[:, 1:] * np.sqrt(2.0)
    last = length % 2 == 0  # that frequency occurs once, and is real
    if last:
        amp[:, -1] /= np.sqrt(2.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        amp = amp / np.sqrt((amp**2).sum(axis=1, keepdims=True))
    amp[(np.ptp(x, axis=1) == 0).any(axis=1)] = np.nan
    size = amp.shape[1] * c
    step = max(1, most // (m * size))
    for lo in range(0, n, step):
        k = min(step, n - lo)
        phase = 2 * np.pi * uniforms(keys, (first + lo) * size, k * size).reshape(m, k, -1, c)
        if last:
            phase[:, :, -1] = 0
        total = sum((np.einsum("mfc,mkfc->mkf", amp, f(phase)) ** 2).sum(axis=2) for f in (np.cos, np.sin))
        out[:, lo : lo + k] = (total - c) / (c * (c - 1))
    return out


def shuffle_blocks(x: Array, size: int, seed: int | list[int]) -> Array:
    """Blocks of ``size`` samples in a random order; the end is padded with zeros to a whole block."""
    blocks = -(-len(x) // size)
    padded = np.concatenate([x, np.zeros((blocks * size - len(x), *x.shape[1:]))])
    return padded.reshape(blocks, size, *x.shape[1:])[np.random.default_rng(seed).permutation(blocks)].reshape(padded.shape)


def response(n: int, fs: float, low: float | None, high: float | None, order: int = 5) -> Array:
    """Zero-phase gain (forward and backward) of a Butterworth band over the frequencies of a real FFT."""
    f = np.fft.rfftfreq(n, 1 / fs)
    warp = np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-9)) / fs)
    edge = lambda x: np.tan(np.pi * x / fs)
    with np.errstate(divide="ignore"):
        if low and high:
            w = (warp**2 - edge(low) * edge(high)) / np.where(warp > 0, warp, 1e-300) / (edge(high) - edge(low))
        elif low:
            w = edge(low) / np.where(warp > 0, warp, 1e-300)
        else:
            w = warp / edge(high)
        return 1 / (1 + np.minimum(np.abs(w), 1e30) ** (2 * order))


def mirrored(x: Array, pad: int) -> Array:
    """Odd extension at both ends, against edge transients."""
    pad = min(pad, len(x) - 1)
    if pad <= 0:
        return x
    return np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])


def band_pass(x: Array, fs: float, low: float | None, high: float | None, order: int = 5) -> Array:
    """Zero-phase Butterworth filter of series (samples x channels)."""
    wide = mirrored(x, 3 * (2 * order + 1))
    at = (len(wide) - len(x)) // 2
    out = np.fft.irfft(np.fft.rfft(wide, axis=0) * response(len(wide), fs, low, high, order)[:, None], n=len(wide), axis=0)
    return out[at : at + len(x)]


def notch(x: Array, fs: float, freq: float, width: float = 1.0) -> Array:
    gain = (np.abs(np.fft.rfftfreq(len(x), 1 / fs) - freq) > width / 2).astype(float)
    return np.fft.irfft(np.fft.rfft(x, axis=0) * gain[:, None], n=len(x), axis=0)


def envelope(x: Array) -> Array:
    """Magnitude of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=0) * gain[:, None], axis=0))


def resample(x: Array, n: int) -> Array:
    """Fourier resampling to ``n`` samples."""
    old = np.fft.rfft(x, axis=0)
    new = np.zeros((n // 2 + 1, *x.shape[1:]), complex)
    m = min(len(old), len(new))
    new[:m] = old[:m]
    return np.fft.irfft(new, n=n, axis=0) * n / len(x)


def cubic(xs: Array, ys: Array, at: Array) -> Array:
    """Not-a-knot cubic spline through (xs, ys), extrapolated; with fewer than four points the polynomial through them."""
    n = len(xs)
    if n < 4:
        return np.polyval(np.polyfit(xs - xs[0], ys, n - 1), at - xs[0])
    h, slope = np.diff(xs), np.diff(ys) / np.diff(xs)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(xs, at, side="right") - 1, 0, n - 2)
    u, v = at - xs[i], xs[i + 1] - at
    return (m[i] * v**3 + m[i + 1] * u**3) / (6 * h[i]) + (ys[i] / h[i] - m[i] * h[i] / 6) * v + (ys[i + 1] / h[i] - m[i + 1] * h[i] / 6) * u


def tails(ways: Array, at: int) -> tuple[float, float]:
    """P(X >= at) and P(X <= at) from the number of ways to reach each value."""
    return float(ways[at:].sum() / ways.sum()), float(ways[: at + 1].sum() / ways.sum())


def signed_rank_tails(twice: list[int], w: float) -> tuple[float, float]:
    """Tails of the signed-rank statistic under random signs, exact with ties: counts of sums of doubled ranks."""
    ways = np.zeros(sum(twice) + 1)
    ways[0] = 1
    for r in twice:
        ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
    return tails(ways, round(2 * w))


def rank_sum_tails(twice: list[int], u: float, n1: float) -> tuple[float, float]:
    """Tails of U over all choices of ``n1`` rows, exact with ties: counts by how many are chosen and the sum of their doubled ranks."""
    n1 = int(n1)
    ways = np.zeros((n1 + 1, sum(twice) + 1))
    ways[0, 0] = 1
    for r in twice:
        ways[1:, r:] = ways[1:, r:] + ways[:-1, : ways.shape[1] - r].copy()
    return tails(ways[n1], round(2 * u) + n1 * (n1 + 1))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation: the t tail as an incomplete beta integral, by Gauss-Legendre quadrature."""
    if n < 3 or not np.isfinite(r):
        return float("nan")
    nodes, weights = np.polynomial.legendre.leggauss(200)
    angle = lambda lo, hi: ((hi - lo) / 2 * weights * np.cos((hi - lo) / 2 * nodes + (hi + lo) / 2) ** (n - 3)).sum()
    edge = np.arcsin(min(1.0, abs(r)))
    return float(min(1.0, angle(edge, np.pi / 2) / angle(0.0, np.pi / 2)))
