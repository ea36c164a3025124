"""Exponentially weighted estimators: one ordered scan an asset (or a matrix kernel a panel), grouped by Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import kernels as k
from strandline.functions.expressions import over_asset
from strandline.operators.calendars import resample_last
from strandline.operators.panel import nan_to_null
from strandline.operators.returns import to_returns

OUT = "ts date, asset string, value double"


def scan(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str = OUT, *keys: str) -> DataFrame:
    """Each asset's rows in time order go through run; NaN comes back as NULL."""
    names = [c.split()[0] for c in schema.split(", ")]

    def grouped(g: pd.DataFrame) -> pd.DataFrame:
        return run(g.sort_values("ts", kind="stable").reset_index(drop=True))[names]

    out = df.groupBy(*(keys or ("asset",))).applyInPandas(grouped, schema)
    return nan_to_null(out, *[c.split()[0] for c in schema.split(", ") if c.split()[1] == "double"])


def one(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    return scan(df, lambda g: g.assign(value=f(g["value"].to_numpy(float))))


def ewm_mean(panel: DataFrame, span: float | None = None, lam: float | None = None, init: str | float = "x0", gap: str = "ffill") -> DataFrame:
    d = k.decay(span, lam)
    return one(panel, lambda x: k.ewm(x, d, init, gap))


def ewm_mean_sql(panel: DataFrame, span: float) -> DataFrame:
    """The same with seed x0 and no Python: a fold over each asset's sorted array."""
    d = k.decay(span)
    rows = panel.filter("value is not null").groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("rows"))
    step = lambda acc, r: F.array_append(acc, F.struct(r["ts"].alias("ts"), (d * F.coalesce(F.try_element_at(acc, F.lit(-1))["value"], r["value"]) + (1 - d) * r["value"]).alias("value")))
    start = F.slice("rows", 1, 0)
    return rows.select("asset", F.inline(F.aggregate("rows", start, step))).select("ts", "asset", "value")


def ewm_vol(panel: DataFrame, span: float | None = None, lam: float | None = None, mean: str = "none", init: str | float = "x0", af: float = 1.0, warmup: int = 0, floor_quantile: float | None = None, floor_rows: int = 1300) -> DataFrame:
    d = k.decay(span, lam)
    return one(panel, lambda x: k.ewm_vol(x, d, mean, init, af, warmup, floor_quantile, floor_rows))


def newey_west_vol(panel: DataFrame, span: float, lags: int = 2, af: float = 1.0) -> DataFrame:
    d = k.decay(span)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v, ratio = k.newey_west_vol(g["value"].to_numpy(float), d, lags, af)
        return g.assign(value=v, nw_ratio=ratio)

    return scan(panel, run, OUT + ", nw_ratio double")


def up_down_vol(panel: DataFrame, span: float, af: float = 1.0, init: str = "mean") -> DataFrame:
    """EWM volatility of gains (up) and of losses (down)."""
    d = k.decay(span)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        up, down = k.up_down_vol(g["value"].to_numpy(float), d, af, init)
        return g.assign(up=up, down=down)

    return scan(panel, run, "ts date, asset string, up double, down double")


def long_short(panel: DataFrame, long_span: float, short_span: float | None, warmup: int = 0) -> DataFrame:
    """Unit-variance difference of a short and a long filter; without a short span the long filter alone."""
    a, b = k.decay(long_span), k.decay(short_span) if short_span else None

    def f(x: np.ndarray) -> np.ndarray:
        slow = k.ewm(x, a, 0.0)
        if b is None:
            out = slow * k.unit_vol_load(a)
        else:
            fast = k.ewm(x, b, 0.0)
            var = (1 - b) / (1 + b) + (1 - a) / (1 + a) - 2 * (1 - a) * (1 - b) / (1 - a * b)
            out = (fast - slow) / np.sqrt(max(var, 1e-300))
        if warmup:
            out[np.flatnonzero(np.isfinite(out))[:warmup]] = np.nan
        return out

    return one(panel, f)


def cross_xy(pairs: DataFrame, span: float, what: str = "beta", mean: str = "none") -> DataFrame:
    """EWM covar, beta (of y on x) or corr of paired columns x, y."""
    d = k.decay(span)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = (k.demeaned(g[c].to_numpy(float), mean, d) for c in ("x", "y"))
        xy = k.ewm(x * y, d, 0.0)
        if what != "covar":
            xx, yy = k.ewm(x * x, d, 0.0), k.ewm(y * y, d, 0.0)
            den = xx if what == "beta" else np.sqrt(xx * yy)
            xy = np.divide(xy, den, out=np.full(len(x), np.nan), where=den > 0)
        return g.assign(value=xy)

    return scan(pairs, run)


def beta_alpha(pairs: DataFrame, span: float) -> DataFrame:
    """beta, alpha, prediction with yesterday's estimates, and EWM r2 of the prediction."""
    d = k.decay(span)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        xx, xy = k.ewm(x * x, d, 0.0), k.ewm(x * y, d, 0.0)
        beta = np.divide(xy, xx, out=np.full(len(x), np.nan), where=xx > 0)
        alpha = k.ewm(y - beta * x, d, 0.0)
        lag = lambda a: np.concatenate([[np.nan], a[:-1]])
        hat = lag(alpha) + lag(beta) * x
        res, tot = k.ewm((y - hat) ** 2, d, "x0"), k.ewm(y * y, d, "x0")
        r2 = 1 - np.divide(res, tot, out=np.full(len(x), np.nan), where=tot > 0)
        return g.assign(beta=beta, alpha=alpha, prediction=hat, r2=r2)

    return scan(pairs, run, "ts date, asset string, beta double, alpha double, prediction double, r2 double")


def ewm_sharpe(returns: DataFrame, span: float, norm: int = 1, af: float = 1.0, initial: float | None = None) -> DataFrame:
    """Annualised EWM Sharpe ratio: norm 0 the mean alone, 1 over the root of the mean square, 2 over the deviation from the EWM mean.

    Gaps count as 0. initial: a Sharpe ratio at 10 % volatility to start from; without one, mean and variance start at 0.
    """
    if norm not in (0, 1, 2):
        raise ValueError(f"unknown norm {norm}")
    d = k.decay(span)
    mean0, var0 = (0.0, 0.0) if initial is None else (0.1 * initial / af, 0.01 / af)

    def f(x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x, nan=0.0)
        m = k.ewm(x, d, mean0)
        if norm == 0:
            return af * m
        v = np.sqrt(k.ewm((x - m if norm == 2 else x) ** 2, d, var0))
        return np.sqrt(af) * np.divide(m, v, out=np.full(len(x), np.nan), where=v > 0)

    return one(returns, f)


def ewm_sharpe_of_prices(prices: DataFrame, freq: str, span: float, norm: int = 1, af: float = 1.0) -> DataFrame:
    return ewm_sharpe(to_returns(resample_last(prices, freq), "log"), span, norm, af)


def unit_std(panel: DataFrame, span: float) -> DataFrame:
    """EWM of (value / EWM volatility), scaled to unit variance."""
    d = k.decay(span)

    def f(x: np.ndarray) -> np.ndarray:
        v = k.ewm_vol(x, d)
        return k.ewm(np.divide(x, v, out=np.full(len(x), np.nan), where=v > 0), d, 0.0) * k.unit_vol_load(d)

    return one(panel, f)


def ewm_score(panel: DataFrame, span: float) -> DataFrame:
    """(value - EWM mean) / EWM volatility."""
    d = k.decay(span)

    def f(x: np.ndarray) -> np.ndarray:
        m = k.ewm(x, d, "x0")
        v = np.sqrt(k.ewm((x - m) ** 2, d, "var"))
        return np.divide(x - m, v, out=np.full(len(x), np.nan), where=v > 0)

    return one(panel, f)


def winsorise(panel: DataFrame, span: float, quantile: float = 0.025, replace: str = "quantile") -> DataFrame:
    """Values whose EWM score is beyond its in-sample quantiles become the EWM mean, NULL, or the value at the quantile."""
    d = k.decay(span)

    def f(x: np.ndarray) -> np.ndarray:
        m = k.ewm(x, d, "x0")
        v = np.sqrt(k.ewm((x - m) ** 2, d, "var"))
        s = np.divide(x - m, v, out=np.full(len(x), np.nan), where=v > 0)
        if not np.isfinite(s).any():
            return x
        lo, hi = np.nanquantile(s, [quantile, 1 - quantile])
        bad = (s < lo) | (s > hi)
        new = {"mean": m, "null": np.full(len(x), np.nan), "quantile": m + v * np.clip(s, lo, hi)}[replace]
        return np.where(bad, new, x)

    return one(panel, f)


def winsorise_markov(panel: DataFrame, span: float, threshold: float = 5.0, init: float = 0.0, init_var: float = 0.1) -> DataFrame:
    """The clean value, with the mean, variance and score that judge it."""
    d = k.decay(span)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        clean, mean, var, score = k.winsor_markov(g["value"].to_numpy(float), d, threshold, init, init_var)
        return g.assign(value=clean, mean=mean, variance=var, score=score)

    return scan(panel, run, OUT + ", mean double, variance double, score double")


def filter_outliers(panel: DataFrame, abs_ceil: float | None = None, abs_floor: float | None = None, sigmas: float | None = None) -> DataFrame:
    """NULL beyond absolute bounds and beyond so many in-sample deviations."""
    own = Window.partitionBy("asset")
    v = F.col("value")
    good = F.lit(True)
    if abs_ceil is not None:
        good = good & (v <= abs_ceil)
    if abs_floor is not None:
        good = good & (v >= abs_floor)
    out = panel.withColumn("value", F.when(good, v))
    if sigmas is not None:
        dev = F.abs(v - F.avg(v).over(own))
        out = out.withColumn("_d", dev).withColumn("_s", F.stddev_pop(v).over(own)).withColumn("value", F.when(F.col("_d") <= sigmas * F.col("_s"), v)).drop("_d", "_s")
    return out


def rolling_demeaned(panel: DataFrame, how: str, span: float | None = None) -> DataFrame:
    """Value less its mean: in-sample and expanding by windows, ewma by a scan."""
    if how == "insample":
        return panel.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("asset")))
    if how == "expanding":
        return panel.withColumn("value", F.col("value") - F.avg("value").over(over_asset().rowsBetween(Window.unboundedPreceding, 0)))
    d = k.decay(span)
    return one(panel, lambda x: k.demeaned(x, how, d))


# --- matrices: one group a panel key -------------------------------------------------------------------------


def matrix_scan(panel: DataFrame, run: Callable[[pd.Index, list[str], np.ndarray], pd.DataFrame], schema: str, key: str | None = None) -> DataFrame:
    """run(dates, assets, [t, n]) for each panel. Without a key the whole panel is one: n is a portfolio's universe, t its dates."""

    def grouped(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="ts", columns="asset", values="value", dropna=False).sort_index()
        out = run(wide.index, list(wide.columns), wide.to_numpy(float))
        if key:
            out[key] = g[key].iloc[0]
        return out

    if key:
        return panel.groupBy(key).applyInPandas(grouped, f"{schema}, {key} string")
    return panel.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda g: grouped(g), schema)


def _long(dates, assets: list[str], tensor: np.ndarray) -> pd.DataFrame:  # noqa: ANN001
    t, n = len(dates), len(assets)
    return pd.DataFrame({"ts": np.repeat(dates, n * n), "asset_i": np.tile(np.repeat(assets, n), t), "asset_j": np.tile(assets, t * n), "cov": tensor.reshape(-1)})


COV = "ts date, asset_i string, asset_j string, cov double"


def covariance_tensor(returns: DataFrame, span: float, corr: bool = False, vol_norm: bool = False, every: int = 1) -> DataFrame:
    """EWM covariance (or correlation) at every `every`-th date, long. vol_norm: on returns over their EWM volatility, scaled back."""
    d = k.decay(span)

    def run(dates, assets, x):  # noqa: ANN001, ANN202
        if vol_norm:
            vol = np.stack([k.ewm_vol(x[:, i], d) for i in range(x.shape[1])], axis=1)
            c = k.ewm_covar(np.divide(x, vol, out=np.full_like(x, np.nan), where=vol > 0), d)
            filled = np.nan_to_num(vol)
            c = c * filled[:, :, None] * filled[:, None, :]
        else:
            c = k.ewm_covar(x, d)
        if corr:
            c = np.stack([k.covar_to_corr(m) for m in c])
        at = np.arange(len(x) - 1, -1, -every)[::-1]
        return _long(dates[at], assets, c[at])

    return matrix_scan(returns, run, COV)


def covariance_last(returns: DataFrame, span: float, lags: int = 0) -> DataFrame:
    """The final EWM covariance, with Bartlett-weighted lags if asked for."""
    d = k.decay(span)

    def run(dates, assets, x):  # noqa: ANN001, ANN202
        c = k.covar_newey_west(x, d, lags) if lags else k.ewm_covar(x, d)[-1]
        return _long(dates[-1:], assets, c[None])

    return matrix_scan(returns, run, COV)


def factor_betas(returns: DataFrame, factors: DataFrame, span: float, warmup: int = 0, correlated: bool = True) -> DataFrame:
    """ts, asset, factor, beta: rolling multi-factor betas; the factor panel rides along with each asset as an array."""
    d = k.decay(span)
    wide = factors.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "value")))).alias("f"))
    both = returns.join(wide, "ts")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted({n for m in g["f"] for n in m})
        x = np.array([[np.nan if (v := m.get(n)) is None else v for n in names] for m in (dict(f) for f in g["f"])], float).reshape(len(g), len(names))
        b = k.beta_tensor(x, g["value"].to_numpy(float), d, warmup, correlated)
        return pd.DataFrame({"ts": np.repeat(g["ts"].to_numpy(), len(names)), "asset": g["asset"].iloc[0], "factor": np.tile(names, len(g)), "beta": b.reshape(-1)})

    return scan(both, run, "ts date, asset string, factor string, beta double")


def pca_r2(returns: DataFrame, span: float, every: int = 1) -> DataFrame:
    """ts, component, r2: explained shares of the EWM correlation."""
    d = k.decay(span)

    def run(dates, assets, x):  # noqa: ANN001, ANN202
        c = k.ewm_covar(x, d)
        at = np.arange(len(x) - 1, 0, -every)[::-1]
        rows = []
        for i in at:
            w, _ = k.pca(k.covar_to_corr(c[i]))
            rows += [(dates[i], j + 1, v) for j, v in enumerate(w / w.sum())]
        return pd.DataFrame(rows, columns=["ts", "component", "r2"])

    return matrix_scan(returns, run, "ts date, component int, r2 double")


def matrix_autocorr(returns: DataFrame, span: float, lag: int = 1, what: str = "trace") -> DataFrame:
    """Trace or off-diagonal mean of the EWM lagged covariance over the plain one."""
    d = k.decay(span)

    def run(dates, assets, x):  # noqa: ANN001, ANN202
        n = x.shape[1]
        s, s0, out = np.zeros((n, n)), np.zeros((n, n)), np.full(len(x), np.nan)
        pick = (lambda m: np.trace(m)) if what == "trace" else (lambda m: m.sum() - np.trace(m))
        for t in range(lag, len(x)):
            s = d * s + (1 - d) * np.nan_to_num(np.outer(x[t], x[t - lag]))
            s0 = d * s0 + (1 - d) * np.nan_to_num(np.outer(x[t], x[t]))
            out[t] = pick(s) / pick(s0) if pick(s0) else np.nan
        return pd.DataFrame({"ts": dates, "value": out})

    return nan_to_null(matrix_scan(returns, run, "ts date, value double"))


def vector_autocorr(returns: DataFrame, span: float, lag: int = 1) -> DataFrame:
    """EWM autocorrelation of each asset."""
    d = k.decay(span)

    def f(x: np.ndarray) -> np.ndarray:
        lagged = np.concatenate([np.full(lag, np.nan), x[:-lag]])
        a, b = k.ewm(x * lagged, d, 0.0), k.ewm(x * x, d, 0.0)
        return np.divide(a, b, out=np.full(len(x), np.nan), where=b > 0)

    return one(returns, f)


# --- risk-adjusted returns -----------------------------------------------------------------------------------


def ra_returns(returns: DataFrame, span: float, vol_target: float | None = None, af: float = 260.0, lag: int = 1, logs: bool = False) -> DataFrame:
    """Returns times yesterday's 1 / volatility (or target / annualised volatility). logs: log returns in, simple ones weighted."""
    d = k.decay(span)

    def f(x: np.ndarray) -> np.ndarray:
        v = k.ewm_vol(x, d, af=af if vol_target else 1.0)
        w = np.divide(vol_target or 1.0, v, out=np.full(len(x), np.nan), where=v > 0)
        r = np.expm1(x) if logs else x
        return r * np.concatenate([np.full(lag, np.nan), w[:-lag]]) if lag else r * w

    return one(returns, f)


def ra_momentum(returns: DataFrame, momentum_span: float, vol_span: float) -> DataFrame:
    d = k.decay(momentum_span)
    return one(ra_returns(returns, vol_span), lambda x: k.ewm(x, d, 0.0) * k.unit_vol_load(d))


def rolling_ra(returns: DataFrame, n: int, span: float, norm: bool = True) -> DataFrame:
    """Sum of the last n risk-adjusted returns, over sqrt(n)."""
    w = over_asset().rowsBetween(1 - n, 0)
    total = F.sum("value").over(w)
    return ra_returns(returns, span).withColumn("value", F.when(F.count("value").over(w) == n, total / (n**0.5 if norm else 1.0)))


def returns_transform(returns: DataFrame, how: str = "rolling", span: int = 31, momentum_span: float = 31, vol_span: float = 33) -> DataFrame:
    """rolling: log returns summed over span rows, simple again, over their volatility of the same span; momentum: ra_momentum."""
    if how not in ("rolling", "momentum"):
        raise ValueError(how)
    if how == "momentum":
        return ra_momentum(returns, momentum_span, vol_span)
    w = over_asset().rowsBetween(1 - span, 0)
    return ra_returns(returns.withColumn("value", F.when(F.count("value").over(w) == span, F.sum("value").over(w))), span, logs=True)


def signal_convolution(signals: DataFrame, returns: DataFrame, n: int, span: float, what: str = "corr") -> DataFrame:
    """EWM correlation or beta of rolling-sum returns on signals shifted by the sum's length."""
    w = over_asset()
    future = returns.withColumn("y", F.sum("value").over(w.rowsBetween(1 - n, 0))).select("ts", "asset", "y")
    past = signals.withColumn("x", F.lag("value", n).over(w)).select("ts", "asset", "x")
    return cross_xy(past.join(future, ["ts", "asset"]), span, what)
