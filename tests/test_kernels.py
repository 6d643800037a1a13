import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.functions import kernels as k

rng = np.random.default_rng(0)


def latent(n=4000, views=3, width=4, shared=2, noise=0.5):
    s = rng.standard_normal((n, shared))
    return [s @ rng.standard_normal((shared, width)) + noise * rng.standard_normal((n, width)) for _ in range(views)]


def test_cca_equals_principal_angles():
    x, y = latent(views=2)
    cov = np.cov(np.hstack([x, y]), rowvar=False)
    wa, wb, r = k.cca(cov, 4, 3)
    qx, qy = (np.linalg.qr(v - v.mean(axis=0))[0] for v in (x, y))
    assert np.allclose(r, np.linalg.svd(qx.T @ qy)[1][:3], atol=1e-8)
    for i in range(3):
        assert np.corrcoef(x @ wa[:, i], y @ wb[:, i])[0, 1] == pytest.approx(r[i], abs=1e-8)


def test_cca_of_a_constant_channel_stays_finite():
    x, y = latent(views=2)
    x[:, 1] = 3.0
    _, _, r = k.cca(np.cov(np.hstack([x, y]), rowvar=False), 4, 2)
    assert np.isfinite(r).all() and (r <= 1 + 1e-9).all()


def test_ledoit_wolf_equals_its_definition():
    x = rng.standard_normal((50, 6)) * np.arange(1, 7)
    c = x - x.mean(axis=0)
    s = c.T @ c / 50
    mu = np.trace(s) / 6
    delta = ((s - mu * np.eye(6)) ** 2).sum()
    beta = min(delta, sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / 50**2)
    want = beta / delta * mu * np.eye(6) + (1 - beta / delta) * s
    assert np.allclose(k.ledoit_wolf(50, s, float(((c**2).sum(axis=1) ** 2).sum())), want)


def test_gcca_finds_the_shared_space():
    views = latent(views=4)
    z = np.hstack(views)
    n = len(z)
    lam, w = k.gcca(np.cov(z, rowvar=False), [4] * 4, 2, n)
    comps = [v @ w[4 * i : 4 * i + 4] for i, v in enumerate(views)]
    r = [abs(np.corrcoef(comps[i][:, 0], comps[j][:, 0])[0, 1]) for i in range(4) for j in range(i)]
    assert min(r) > 0.8 and (np.diff(lam) >= 0).all()
    shared = (z - z.mean(axis=0)) @ (w * lam)
    assert np.allclose(shared.T @ shared * n / (n - 1), np.eye(2) * n / (n - 1) * 1.0, atol=2e-2)


def test_two_views_in_closed_form():
    x, y = (v[:, :1] for v in latent(views=2))
    cov = np.cov(np.hstack([x, y]), rowvar=False)
    lam, _ = k.gcca(cov, [1, 1], 1, len(x))
    assert lam[0] == pytest.approx(1 / (1 + abs(np.corrcoef(x[:, 0], y[:, 0])[0, 1])))


def test_stimulus_weight_one_is_plain_gcca():
    z = np.hstack(latent(views=3))
    cov = np.cov(z, rowvar=False)
    a, b = k.gcca(cov, [4, 4, 4], 2, len(z))[0], k.stimulus_gcca(cov, [4, 4, 4], 1.0, 2, len(z))[0]
    assert np.allclose(a, b)


def test_discriminative_prefers_the_signal():
    n = 5000
    s, c = rng.standard_normal((n, 2)), rng.standard_normal((n, 2))
    y = s @ rng.standard_normal((2, 3)) + 0.3 * c @ rng.standard_normal((2, 3)) + 0.2 * rng.standard_normal((n, 3))
    cov = np.cov(np.hstack([1.5 * s, c, 1.5 * s - c, y]), rowvar=False)
    lam, ws, wy = k.discriminative(cov[:2, :2], cov[2:4, 2:4], cov[6:, 6:], cov[4:6, 4:], 1)
    assert abs(np.corrcoef(s @ ws[:, 0], y @ wy[:, 0])[0, 1]) > abs(np.corrcoef(c @ ws[:, 0], y @ wy[:, 0])[0, 1])


@settings(deadline=None, max_examples=40)
@given(st.integers(2, 40), st.integers(1, 3), st.integers(0, 1000))
def test_phase_scramble_keeps_the_amplitudes(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    y = k.phase_scramble(x, seed)
    assert y.dtype == float and np.allclose(np.abs(np.fft.fft(x, axis=0)), np.abs(np.fft.fft(y, axis=0)))


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(0, 1000))
def test_block_shuffle_keeps_the_blocks(n, size, seed):
    x = np.arange(1.0, n + 1)[:, None]
    y = k.shuffle_blocks(x, size, seed)
    assert sorted(y[y > 0]) == sorted(x[:, 0]) and len(y) == -(-n // size) * size


def test_band_pass_keeps_the_band_without_delay():
    t = np.arange(3000) / 100
    inside, outside = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 30 * t)
    y = k.band_pass((inside + outside)[:, None], 100.0, 8.0, 12.0)[:, 0]
    assert np.abs(y - inside)[300:-300].max() < 0.02


def test_envelope_of_a_modulated_wave():
    t = np.arange(4000) / 200
    slow = 1 + 0.5 * np.cos(2 * np.pi * 0.5 * t)
    assert np.abs(k.envelope((slow * np.sin(2 * np.pi * 20 * t))[:, None])[:, 0] - slow)[100:-100].max() < 0.02


def test_resample_and_notch():
    t = np.arange(600) / 100
    x = np.sin(2 * np.pi * 3 * t)
    assert np.allclose(k.resample(x[:, None], 300)[:, 0], x[::2], atol=1e-9)
    assert np.abs(k.notch((x + np.sin(2 * np.pi * 25 * t))[:, None], 100.0, 25.0)[:, 0] - x).max() < 1e-9


def test_cubic_is_exact_for_cubics_and_extrapolates():
    f = lambda v: v**3 - 2 * v + 1
    xs = np.array([0.0, 1, 3, 4, 7])
    at = np.array([-1.0, 0.5, 2, 6, 9])
    assert np.allclose(k.cubic(xs, f(xs), at), f(at))
    assert np.allclose(k.cubic(xs[:2], xs[:2] * 2, at), at * 2)


def test_signed_rank_and_pearson_tails():
    assert k.signed_rank_tails([2, 4, 6], 6) == pytest.approx((1 / 8, 1))
    assert k.signed_rank_tails([2, 4, 6], 0) == pytest.approx((1, 1 / 8))
    assert k.pearson_p(0.0, 20) == pytest.approx(1, abs=1e-6)
    assert k.pearson_p(0.8, 4) == pytest.approx(0.2, abs=1e-6)  # n = 4: p = 1 - |r|
