"""Kernels against plain recursions and invariants."""

import math

import numpy as np
import pandas as pd
import pytest

from strandline.functions import kernels as k
from strandline.functions.annualisation import annualisation_factor, conversion_factor


def test_ewm_equals_recursion_and_pandas():
    x = np.random.default_rng(0).standard_normal(50)
    got = k.ewm(x, 0.9, "x0")
    assert np.allclose(got, pd.Series(x).ewm(alpha=0.1, adjust=False).mean())
    s = 0.0
    for t, v in enumerate(x):
        s = s if t == 0 else 0.9 * s + 0.1 * v
        assert k.ewm(x[: t + 1], 0.9, 0.0)[-1] == pytest.approx(s)


@pytest.mark.parametrize("gap,want", [("ffill", [1, 1, 2]), ("deflated", [1, 0.5, 1.75]), ("zero", [1, 0.5, 1.75]), ("nan", [1, math.nan, 2])])
def test_gaps(gap, want):
    got = k.ewm(np.array([np.nan, 1.0, np.nan, 3.0]), 0.5, "x0", gap)
    assert np.isnan(got[0]) and np.allclose(got[1:], want, equal_nan=True)


def test_covariance_is_outer_recursion():
    x = np.random.default_rng(1).standard_normal((30, 3))
    c = k.ewm_covar(x, 0.9)
    s = np.zeros((3, 3))
    for t in range(30):
        s = 0.9 * s + 0.1 * np.outer(x[t], x[t])
    assert np.allclose(c[-1], s) and np.allclose(np.diag(k.covar_to_corr(s)), 1)


def test_betas_recover_a_linear_model():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    assert np.allclose(k.beta_tensor(x, x @ [0.5, -2.0], 0.98, 50)[-1], [0.5, -2.0])


def test_pca_is_ordered_and_reconstructs():
    a = np.random.default_rng(3).standard_normal((5, 5))
    c = a @ a.T
    w, v = k.pca(c)
    assert (np.diff(w) <= 0).all() and np.allclose(v @ np.diag(w) @ v.T, c) and (v.sum(axis=0) >= 0).all()
    e = k.eigen_portfolios(c)
    assert np.allclose(np.diag(e @ c @ e.T), 1)


def test_buy_and_hold_without_costs_is_weighted_price():
    p = np.cumprod(1 + 0.01 * np.random.default_rng(4).standard_normal((60, 2)), axis=0)
    flags = np.zeros(60, bool)
    flags[0] = True
    out = k.held_units(p, np.tile([0.3, 0.7], (60, 1)), flags)
    assert np.allclose(out["nav"], 100 * (0.3 * p[:, 0] / p[0, 0] + 0.7 * p[:, 1] / p[0, 1]))


def test_daily_rebalancing_compounds_weighted_returns_and_costs_lower_it():
    p = np.cumprod(1 + 0.01 * np.random.default_rng(5).standard_normal((60, 2)), axis=0)
    w, flags = np.tile([0.5, 0.5], (60, 1)), np.ones(60, bool)
    nav = k.held_units(p, w, flags)["nav"]
    r = (p[1:] / p[:-1] - 1).mean(axis=1)
    assert np.allclose(nav[1:] / nav[:-1] - 1, r)
    assert k.held_units(p, w, flags, cost=np.full((60, 2), 0.001))["nav"][-1] < nav[-1]


def test_average_cost():
    avg, real, mtm = k.average_cost(np.array([10.0, 12.0, 11.0, 13.0]), np.array([1.0, 2.0, 1.0, 0.0]))
    assert avg.tolist() == [10, 11, 11, 0] and real.tolist() == [0, 0, 0, 2]


@pytest.mark.parametrize("kind", ["iid", "stationary", "fixed"])
def test_bootstrap_indices(kind):
    a = k.bootstrap_indices(kind, 50, 200, 10, 3)
    assert len(a) == 200 and a.min() >= 0 and a.max() < 50 and (a == k.bootstrap_indices(kind, 50, 200, 10, 3)).all()
    if kind == "fixed":
        assert all(((a[i : i + 10] - a[i]) % 50 == np.arange(10)).all() for i in range(0, 200, 10))


def test_circular_bootstrap_is_even():
    n = np.bincount(np.concatenate([k.bootstrap_indices("stationary", 50, 50, 10, i) for i in range(2000)]), minlength=50)
    assert abs(n[0] / n.mean() - 1) < 0.1 and n.std() / n.mean() < 0.05


def test_unsmoothing_inverts_smoothing():
    rng = np.random.default_rng(6)
    true = 0.02 * rng.standard_normal(2000)
    r = np.empty(2000)
    r[0] = true[0]
    for t in range(1, 2000):
        r[t] = 0.4 * r[t - 1] + 0.6 * true[t]
    out, _ = k.ar_unsmooth(r, k.decay(400), 1, 50, mean="none")
    assert np.corrcoef(out[300:], true[300:])[0, 1] > 0.98 and out[300:].std() > 1.3 * r[300:].std()


def test_student_p():
    assert k.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and k.student_p(0.0, 5) == pytest.approx(1.0)
    assert k.student_p(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_annualisation():
    assert [annualisation_factor(f) for f in ("B", "W-WED", "ME", "2QE", "YE", "D")] == [252, 52, 12, 2, 1, 365]
    assert annualisation_factor("B", calendar_days=True) == 365 and conversion_factor("ME", "QE") == 3
    with pytest.raises(ValueError):
        annualisation_factor("nope")


def test_floored_volatility():
    x = np.random.default_rng(3).standard_normal(300) * np.linspace(1, 0.1, 300)
    x[50:52] = np.nan
    var = k.ewm(x**2, 0.9, "x0")
    floored = var.copy()
    for t in range(300):
        seen = var[max(0, t - 39) : t + 1]
        if len(seen) >= 8:
            floored[t] = max(var[t], np.quantile(seen, 0.3, method="lower"))
    np.testing.assert_allclose(k.ewm_vol(x, 0.9, floor_quantile=0.3, floor_rows=40), np.sqrt(floored), rtol=1e-12)
    assert (floored > var).any()
