import math

import numpy as np
import pytest

from loomgraph.config import CIConfig, DiscoverConfig, SplineConfig, resolve_max_size
from loomgraph.functions import splines
from loomgraph.functions.special import gammaincc, normal_two_sided
from loomgraph.operators import ci, residuals


def test_gamma_tail():
    assert gammaincc(1.0, 2.0) == pytest.approx(math.exp(-2), rel=1e-13)
    assert gammaincc(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2)), rel=1e-12)
    assert gammaincc(2.0, 50.0) == pytest.approx(51 * math.exp(-50), rel=1e-12)
    assert gammaincc(3.0, 0.0) == 1.0
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def _slow_dcov(x, y):
    n = len(x)
    k, m = (np.array([[abs(a - b) for b in v] for a in v]) for v in (x, y))
    h = np.eye(n) - 1 / n
    a, b = h @ k @ h, h @ m @ h
    return (a * b).sum() / n, k.mean() * m.mean(), 2 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3)) * (a * a).sum() * (b * b).sum() / n**2


def test_dcov_against_definition():
    rng = np.random.default_rng(7)
    for n in (8, 70):
        x = rng.integers(0, 9, n).astype(float)
        y = 0.3 * x**2 + rng.normal(size=n)
        r = ci.dcov_gamma(x, y)
        assert (r.statistic, r.mean, r.variance) == pytest.approx(_slow_dcov(x, y), rel=1e-9)
        b = ci.dcov_gamma_blocks(x, y, block=7)
        assert (b.statistic, b.variance, b.p_value) == pytest.approx((r.statistic, r.variance, r.p_value), rel=1e-9)
        full = ci.dcov_lowrank(x, y, n)
        assert full.statistic == pytest.approx(r.statistic, rel=1e-8)


def test_errors():
    with pytest.raises(ValueError, match="six rows"):
        ci.dcov_gamma(np.arange(5.0), np.arange(5.0))
    with pytest.raises(ValueError, match="finite number"):
        ci.dcov_gamma([1, 2, 3, 4, 5, np.nan], np.arange(6.0))
    with pytest.raises(ValueError, match="differ"):
        ci.hsic_gamma(np.arange(6.0), np.arange(7.0))
    with pytest.raises(ValueError):
        CIConfig("other")
    with pytest.raises(ValueError):
        DiscoverConfig(conservative=True, majority=True)


def test_hsic_low_rank_meets_exact():
    rng = np.random.default_rng(3)
    x = np.linspace(-2, 2, 60)
    y = np.sin(x) + 0.08 * rng.normal(size=60)
    a, b = ci.hsic_gamma(x, y), ci.hsic_gamma(x, y, num_col=60)
    assert a.statistic == pytest.approx(b.statistic, rel=1e-2)
    assert a.p_value < 1e-6
    assert ci.hsic_gamma(np.ones(10), np.ones(10)).p_value == 1.0


def test_permutation_tests_are_repeatable():
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 50))
    y = x + 0.2 * rng.normal(size=50)
    cfg = CIConfig("dcc.perm", replicates=19, seed=3)
    assert ci.dcov_perm(x, y, cfg).p_value == pytest.approx(0.05)
    assert ci.dcov_perm(x, z, cfg).replicates == ci.dcov_perm(x, z, cfg).replicates
    assert ci.hsic_clust(x, y, z, CIConfig("hsic.clust", replicates=19)).p_value <= 0.1
    assert math.isnan(ci.hsic_test(x, y, 0, "perm").p_value)


def test_bases():
    x = np.linspace(0, 1, 50)
    b = splines.bump_basis(x)
    assert b.shape == (50, 10) and np.allclose(b.sum(1), 1)
    assert (splines.bump_basis(np.ones(5))[:, 0] == 1).all()
    far = splines.bump_basis(np.array([0, 0.001, 0.002, 0.003, 0.004, 50.0, 100.0]))
    assert np.allclose(far.sum(1), 1)
    assert np.allclose(splines.second_difference_penalty(4) @ np.arange(4.0), 0)
    assert splines.second_difference_penalty(2).tolist() == np.eye(2).tolist()
    d, p = splines.design([x, x**2])
    assert d.shape == (50, 100) and p.shape == (100, 100)
    assert len(splines.lambda_grid(SplineConfig())) == 25 and splines.lambda_grid()[0] == pytest.approx(1e-4)


def test_residuals():
    rng = np.random.default_rng(2)
    s = rng.uniform(-2, 2, (160, 3))
    y = np.sin(2 * s[:, 0]) + 0.05 * rng.normal(size=160)
    lin = residuals.linear(y, s[:, :1])
    assert abs(lin.residuals @ s[:, 0]) < 1e-9
    for f in (residuals.fast_spline, residuals.tprs_gcv):
        for k in (1, 2, 3):
            assert f(y, s[:, :k]).residuals.std() < 0.35 * y.std(), (f, k)
    assert residuals.tprs_gcv(y, s[:, :1]).residuals.std() < 0.08
    assert (residuals.residual(y, np.empty((160, 0)), "linear") == y).all()
    with pytest.raises(ValueError, match="unknown residuals"):
        residuals.residual(y, s, "other")


def test_sizes():
    assert resolve_max_size(float("inf"), 6) == 4 and resolve_max_size(2.9, 6) == 2
    with pytest.raises(ValueError):
        resolve_max_size(-1, 4)
