"""numpy kernels for ordered recursions, small dense matrices and distribution functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

LAMBDA = 0.94


def decay(span: float | None = None, lam: float | None = None) -> float:
    """lambda of a span, 1 - 2 / (span + 1)."""
    if span is not None:
        return 1.0 - 2.0 / (span + 1.0)
    return LAMBDA if lam is None else lam


def ewm(x: np.ndarray, lam: float, init: float | str = 0.0, gap: str = "ffill") -> np.ndarray:
    """s_t = lam s_{t-1} + (1 - lam) x_t from the first finite x on, where s is the seed.

    init: a number, or x0, mean, var. gap: ffill (state stays), deflated (state decays), zero (x counts as 0), nan.
    """
    out = np.full(len(x), np.nan)
    seen = np.flatnonzero(np.isfinite(x))
    if not len(seen):
        return out
    if isinstance(init, str):
        init = {"zero": 0.0, "x0": x[seen[0]], "mean": float(np.mean(x[seen])), "var": float(np.var(x[seen]))}[init]
    s = float(init)
    out[seen[0]] = s
    for t in range(seen[0] + 1, len(x)):
        if np.isfinite(x[t]):
            s = lam * s + (1 - lam) * x[t]
            out[t] = s
        elif gap == "ffill":
            out[t] = s
        elif gap == "deflated":
            s *= lam
            out[t] = s
        elif gap == "zero":
            s *= lam
            out[t] = s
    return out


def unit_vol_load(lam: float) -> float:
    return math.sqrt((1 + lam) / (1 - lam))


def demeaned(x: np.ndarray, how: str, lam: float) -> np.ndarray:
    """x less its mean: none, insample, expanding or ewma."""
    if how == "none":
        return x
    if how == "insample":
        return x - np.nanmean(x)
    if how == "expanding":
        n = np.cumsum(np.isfinite(x))
        return x - np.divide(np.nancumsum(x), n, out=np.full(len(x), np.nan), where=n > 0)
    if how == "ewma":
        return x - ewm(x, lam, "x0")
    raise ValueError(how)


def ewm_vol(x: np.ndarray, lam: float, mean: str = "none", init: str | float = "x0", af: float = 1.0, warmup: int = 0, floor_quantile: float | None = None, floor_rows: int = 1300) -> np.ndarray:
    """floor_quantile: no less than this quantile of itself over the last floor_rows rows, once a fifth of them is there."""
    var = ewm(demeaned(x, mean, lam) ** 2, lam, init)
    if floor_quantile is not None:
        floor = pd.Series(var).rolling(floor_rows, min_periods=int(0.2 * floor_rows)).quantile(floor_quantile, interpolation="lower").to_numpy()
        var = np.where(var < floor, floor, var)
    out = np.sqrt(af * var)
    if warmup:
        out[np.flatnonzero(np.isfinite(out))[:warmup]] = np.nan
    return out


def newey_west_vol(x: np.ndarray, lam: float, lags: int, af: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Volatility with Bartlett-weighted lagged products, and its ratio to the plain one."""
    base = ewm(x * x, lam, "x0")
    var = base.copy()
    for m in range(1, lags + 1):
        lagged = np.concatenate([np.full(m, np.nan), x[:-m]])
        var = var + 2 * (1 - m / (lags + 1)) * np.nan_to_num(ewm(x * lagged, lam, 0.0))
    var = np.maximum(var, 0)
    return np.sqrt(af * var), np.sqrt(np.divide(var, base, out=np.full(len(x), np.nan), where=base > 0))


def ewm_covar(x: np.ndarray, lam: float, seed: np.ndarray | None = None) -> np.ndarray:
    """[t, n, n]: the same recursion on outer products from a zero seed; entries without both values stay."""
    t, n = x.shape
    s = np.zeros((n, n)) if seed is None else seed.copy()
    out = np.empty((t, n, n))
    for i in range(t):
        o = np.outer(x[i], x[i])
        ok = np.isfinite(o)
        s = np.where(ok, lam * s + (1 - lam) * np.where(ok, o, 0.0), s)
        out[i] = s
    return out


def covar_newey_west(x: np.ndarray, lam: float, lags: int) -> np.ndarray:
    out = ewm_covar(x, lam)[-1]
    for m in range(1, lags + 1):
        s = np.zeros_like(out)
        for i in range(m, len(x)):
            o = np.outer(x[i], x[i - m])
            ok = np.isfinite(o)
            s = np.where(ok, lam * s + (1 - lam) * np.where(ok, o, 0.0), s)
        out = out + (1 - m / (lags + 1)) * (s + s.T)
    return out


def covar_to_corr(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(np.diag(c), 0, None))
    outer = np.outer(d, d)
    out = np.divide(c, outer, out=np.zeros_like(c), where=outer > 0)
    np.fill_diagonal(out, 1.0)
    return out


def beta_tensor(x: np.ndarray, y: np.ndarray, lam: float, warmup: int = 0, correlated: bool = True) -> np.ndarray:
    """[t, factors]: inv(Sxx) Sxy of EWM moments; the diagonal alone if the matrix is singular."""
    t, k = x.shape
    sxx, sxy, out = np.zeros((k, k)), np.zeros(k), np.full((t, k), np.nan)
    for i in range(t):
        xx, xy = np.outer(x[i], x[i]), x[i] * y[i]
        ok = np.isfinite(xx)
        sxx = np.where(ok, lam * sxx + (1 - lam) * np.where(ok, xx, 0.0), sxx)
        ok = np.isfinite(xy)
        sxy = np.where(ok, lam * sxy + (1 - lam) * np.where(ok, xy, 0.0), sxy)
        if i < warmup:
            continue
        d = np.diag(sxx)
        if correlated and d.min() > 1e-8 and np.linalg.cond(sxx) < 1e12:
            out[i] = np.linalg.solve(sxx, sxy)
        else:
            out[i] = np.divide(sxy, d, out=np.full(k, np.nan), where=d > 0)
    return out


def pca(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and eigenvectors by column, each with a positive sum."""
    w, v = np.linalg.eigh(c)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    return w, v * np.where(v.sum(axis=0) < 0, -1.0, 1.0)


def eigen_portfolios(c: np.ndarray) -> np.ndarray:
    """Eigenvectors by row, scaled to unit variance."""
    w, v = pca(c)
    return (v / np.sqrt(np.maximum(w, 1e-300))).T


def winsor_markov(x: np.ndarray, lam: float, threshold: float = 5.0, init: float = 0.0, init_var: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clean values, mean, variance and score; the state starts at init and max(init^2, init_var).

    The score is the distance from yesterday's mean over yesterday's deviation. From the threshold on, a value doesn't
    change the state and the last clean value stands for it; nor does a gap, which has no score and no clean value.
    Where the first row has a value it only starts the state: score 0, no clean value.
    """
    clean, means, variances, scores = (np.full(len(x), np.nan) for _ in range(4))
    mean = var = np.nan
    for t, v in enumerate(x):
        if np.isnan(mean) and np.isfinite(v):
            mean, var = init, max(init * init, init_var)
            if t == 0:
                means[t], variances[t], scores[t] = mean, var, 0.0
                continue
        if np.isfinite(v):
            score = (v - mean) / math.sqrt(var) if var > 0 else np.nan
            if abs(score) >= threshold:
                clean[t] = clean[t - 1]
            else:
                mean = lam * mean + (1 - lam) * v
                var = lam * var + (1 - lam) * (v - mean) ** 2
                clean[t] = v
            scores[t] = score
        means[t], variances[t] = mean, var
    return clean, means, variances, scores


def up_down_vol(x: np.ndarray, lam: float, af: float = 1.0, init: str = "mean") -> tuple[np.ndarray, np.ndarray]:
    """EWM volatility of gains and of losses, neither of which a zero is.

    init: mean starts each side at its in-sample mean square; first at its first square, which looks at no later value.
    """
    out = []
    for side in (np.where(x > 0, x * x, np.nan), np.where(x < 0, x * x, np.nan)):
        if init == "first" or not np.isfinite(side).any():
            out.append(np.sqrt(af * ewm(side, lam, "x0")))
            continue
        s, path = float(np.nanmean(side)), np.empty(len(x))
        for t, v in enumerate(side):
            s = lam * s + (1 - lam) * v if t and np.isfinite(v) else s
            path[t] = s
        out.append(np.sqrt(af * path))
    return out[0], out[1]


# --- portfolios ----------------------------------------------------------------------------------------------


def held_units(prices: np.ndarray, weights: np.ndarray, rebalance: np.ndarray, funding: np.ndarray | None = None, fee: np.ndarray | None = None, carry: np.ndarray | None = None, cost: np.ndarray | None = None, nav0: float = 100.0) -> dict[str, np.ndarray]:
    """Held-units backtest over [t, n] arrays; rates are per period. The first rebalance books no cost."""
    t, n = prices.shape
    nav, cash_path = np.empty(t), np.empty(t)
    units_path, cost_path, weight_path = np.zeros((t, n)), np.zeros((t, n)), np.zeros((t, n))
    units, cash = np.zeros(n), nav0
    before = nav0
    for i in range(t):
        p = prices[i]
        if i:
            cash = cash * (1 + (funding[i] if funding is not None else 0.0)) - (fee[i] * before if fee is not None else 0.0)
            if carry is not None:
                cash += np.nansum(units * p * carry[i])
        value = np.nansum(units * p) + cash
        if rebalance[i]:
            target = np.nan_to_num(value * weights[i] / p, nan=0.0, posinf=0.0, neginf=0.0)
            delta = target - units
            paid = np.zeros(n)
            if i and cost is not None:
                paid = np.nan_to_num(cost[i] * p * np.abs(delta))
            cash -= np.nansum(delta * p) + paid.sum()
            units, cost_path[i] = target, paid
        before = np.nansum(units * p) + cash
        nav[i], cash_path[i], units_path[i] = before, cash, units
        weight_path[i] = np.nan_to_num(units * p) / before if before else 0.0
    return {"nav": nav, "cash": cash_path, "units": units_path, "costs": cost_path, "weights": weight_path}


def average_cost(prices: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Average cost, realised and mark-to-market profit of one long position."""
    t = len(prices)
    avg, real, mtm = np.zeros(t), np.zeros(t), np.zeros(t)
    held, cost = 0.0, 0.0
    for i in range(t):
        p, u = prices[i], units[i]
        if not np.isfinite(p):
            avg[i] = cost
            continue
        delta = u - held
        mark = held * (p - cost)
        if delta > 0:
            cost = (held * cost + delta * p) / u if u else 0.0
        elif delta < 0:
            real[i] = -delta * (p - cost)
        mtm[i] = mark - real[i]
        held = u
        if held == 0:
            cost = 0.0
        avg[i] = cost
    return avg, real, mtm


# --- resampling ----------------------------------------------------------------------------------------------


def bootstrap_indices(kind: str, n: int, length: int, block: int, seed: int, least: int = 1) -> np.ndarray:
    """Row numbers of one sample: iid, stationary (circular geometric blocks) or fixed (circular blocks)."""
    rng = np.random.default_rng(seed)
    if kind == "iid":
        return rng.integers(0, n, length)
    out = np.empty(length, np.int64)
    at = 0
    while at < length:
        size = block if kind == "fixed" else max(least, int(rng.geometric(1.0 / block)))
        size = min(size, length - at)
        out[at : at + size] = (rng.integers(0, n) + np.arange(size)) % n
        at += size
    return out


# --- unsmoothing ---------------------------------------------------------------------------------------------


def ar_unsmooth(r: np.ndarray, lam: float, order: int = 1, warmup: int = 10, top: float = 0.75, low: float = 0.0, mean: str = "ewma") -> tuple[np.ndarray, np.ndarray]:
    """(r - sum b_{i,t-1} r_{t-i}) / (1 - sum b_{t-1}), with EWM betas whose sum is clipped."""
    x = demeaned(r, mean, lam)
    lags = np.stack([np.concatenate([np.full(i, np.nan), x[:-i]]) for i in range(1, order + 1)], axis=1)
    beta = beta_tensor(lags, x, lam, warmup)
    total = np.nansum(beta, axis=1)
    clipped = np.clip(total, low, top)
    beta = beta * np.divide(clipped, total, out=np.ones_like(total), where=np.abs(total) > 1e-12)[:, None]
    beta = np.vstack([np.full((1, order), np.nan), beta[:-1]])
    raw = np.stack([np.concatenate([np.full(i, np.nan), r[:-i]]) for i in range(1, order + 1)], axis=1)
    ok = np.isfinite(beta).all(axis=1) & np.isfinite(raw).all(axis=1)
    out = r.copy()
    out[ok] = (r[ok] - (beta[ok] * raw[ok]).sum(axis=1)) / (1 - beta[ok].sum(axis=1))
    return out, beta


def glm_theta(r: np.ndarray, order: int) -> np.ndarray:
    """Static AR coefficients by least squares."""
    y = r[order:]
    x = np.stack([r[order - i : len(r) - i] for i in range(1, order + 1)], axis=1)
    x = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(x, y, rcond=None)[0][1:]


def dimson(r: np.ndarray, m: np.ndarray, lags: int, least: int = 20) -> dict[str, float]:
    """Sum of the betas to the market and its lags, and its ratio to the plain beta."""
    cols = [np.concatenate([np.full(i, np.nan), m[: len(m) - i]]) for i in range(lags + 1)]
    x = np.column_stack([np.ones(len(m)), *cols])
    ok = np.isfinite(x).all(axis=1) & np.isfinite(r)
    nan = float("nan")
    if ok.sum() < max(least, lags + 3):
        return {"beta": nan, "beta_dimson": nan, "ratio": nan, "t_lags": nan, "n": float(ok.sum())}
    x, y = x[ok], r[ok]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    cov = np.linalg.pinv(x.T @ x) * (e @ e) / (len(y) - x.shape[1])
    c = np.zeros(x.shape[1])
    c[2:] = 1
    se = math.sqrt(max(c @ cov @ c, 0))
    return {"beta": b[1], "beta_dimson": b[1:].sum(), "ratio": b[1:].sum() / b[1] if b[1] else nan, "t_lags": b[2:].sum() / se if se else nan, "n": float(len(y))}


# --- distribution functions ----------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value."""
    if t is None or dof is None or not np.isfinite(t) or dof <= 0:
        return float("nan")
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def normality_p(x: np.ndarray) -> float:
    """p-value of skewness and kurtosis together (chi-square with two degrees of freedom on their asymptotic scores)."""
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 8 or x.std() == 0:
        return float("nan")
    z = (x - x.mean()) / x.std()
    s, k = (z**3).mean(), (z**4).mean() - 3
    return math.exp(-(n * s * s / 6 + n * k * k / 24) / 2)
