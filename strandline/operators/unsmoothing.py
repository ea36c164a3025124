"""Unsmoothing of appraisal-like returns: one ordered kernel an asset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import kernels as k
from strandline.functions.expressions import over_asset
from strandline.operators.ewm import OUT, ewm_mean, ewm_vol, scan
from strandline.operators.returns import nav, to_returns


def least_observations(order: int, warmup: int) -> int:
    return 2 * warmup + 2 + (order - 1)


def ar(returns: DataFrame, span: float = 40, order: int = 1, warmup: int = 10, top: float = 0.75, low: float = 0.0, mean: str = "ewma") -> DataFrame:
    """Rolling AR(order) unsmoothing; short series pass through. beta is the sum that was taken out."""
    d = k.decay(span)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g["value"].to_numpy(float)
        if np.isfinite(r).sum() < least_observations(order, warmup):
            return g.assign(beta=np.nan)
        out, beta = k.ar_unsmooth(r, d, order, warmup, top, low, mean)
        return g.assign(value=out, beta=beta.sum(axis=1))

    return scan(returns, run, OUT + ", beta double")


def ar_prices(prices: DataFrame, span: float = 40, **options: float) -> DataFrame:
    return nav(ar(to_returns(prices, drop_first=True), span, **options).drop("beta"))


def glm(returns: DataFrame, order: int = 1) -> DataFrame:
    """Static AR fit by least squares; theta and the ratio of volatilities with it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g["value"].to_numpy(float)
        good = r[np.isfinite(r)]
        if len(good) < order + 5:
            return g.assign(theta=np.nan, vol_ratio=np.nan)
        theta = k.glm_theta(good, order)
        out = r.copy()
        for t in range(order, len(r)):
            past = r[t - order : t][::-1]
            if np.isfinite(past).all():
                out[t] = (r[t] - theta @ past) / (1 - theta.sum())
        return g.assign(value=out, theta=theta.sum(), vol_ratio=np.nanstd(out, ddof=1) / np.nanstd(r, ddof=1))

    return scan(returns, run, OUT + ", theta double, vol_ratio double")


def dimson_betas(returns: DataFrame, market: DataFrame, lags: int = 2, least: int = 20) -> DataFrame:
    both = returns.join(market.select("ts", F.col("value").alias("m")), "ts")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"asset": g["asset"].iloc[0], **k.dimson(g["value"].to_numpy(float), g["m"].to_numpy(float), lags, least)}])

    return scan(both, run, "asset string, beta double, beta_dimson double, ratio double, t_lags double, n double")


def _lagged(m: np.ndarray, lags: int) -> np.ndarray:
    return np.column_stack([np.concatenate([np.full(i, np.nan), m[: len(m) - i]]) for i in range(lags + 1)])


def factor_lag(returns: DataFrame, factor: DataFrame, span: float = 40, lags: int = 1, warmup: int = 10, top: float = 2.0) -> DataFrame:
    """Moves the response to lagged factor returns to the date itself: r + sum b_l (F_t - F_{t-l}), b of yesterday."""
    d = k.decay(span)
    both = returns.join(factor.select("ts", F.col("value").alias("m")), "ts")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r, x = g["value"].to_numpy(float), _lagged(g["m"].to_numpy(float), lags)
        b = k.beta_tensor(x, r, d, warmup)
        b = np.vstack([np.full((1, lags + 1), np.nan), b[:-1]])
        lag = np.where(np.sign(b[:, 1:]) == np.sign(b[:, :1]), b[:, 1:], 0.0)
        total = np.abs(lag).sum(axis=1)
        lag = lag * np.minimum(1.0, np.divide(top, total, out=np.ones(len(total)), where=total > 0))[:, None]
        move = (lag * (x[:, :1] - x[:, 1:])).sum(axis=1)
        return g.assign(value=np.where(np.isfinite(move), r + move, r))

    return scan(both, run)


def joint(returns: DataFrame, factor: DataFrame, span: float = 40, warmup: int = 10, top: float = 0.75) -> DataFrame:
    """Own lag and lagged factor together: (r - p r_{t-1} + b (F_t - F_{t-1})) / (1 - p), estimates of yesterday."""
    d = k.decay(span)
    both = returns.join(factor.select("ts", F.col("value").alias("m")), "ts")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r, m = g["value"].to_numpy(float), g["m"].to_numpy(float)
        before, fbefore = (np.concatenate([[np.nan], a[:-1]]) for a in (r, m))
        est = k.beta_tensor(np.column_stack([before, fbefore]), r, d, warmup)
        est = np.vstack([np.full((1, 2), np.nan), est[:-1]])
        phi = np.clip(est[:, 0], 0.0, top)
        out = (r - phi * before + est[:, 1] * (m - fbefore)) / (1 - phi)
        return g.assign(value=np.where(np.isfinite(out), out, r))

    return scan(both, run)


def bridged(reported: DataFrame, pivot: DataFrame, span: float, af: float = 260.0, logs: bool = False, vol_adjustment: float = 1.15) -> DataFrame:
    """Returns on a frequent grid that add up to the reported ones: a Brownian bridge whose innovations are a pivot's.

    reported: ts, asset, value, with gaps between reports. pivot: the same for one asset; its returns, less their EWM
    mean and over their EWM volatility, standardised from an asset's first report on, are the innovations (0 until it has one). Rows: the
    pivot's dates since the first report, and all dates of reports. NULL at the first report and after the last one.
    logs: simple returns in and out, bridged as logarithms. af: periods of the pivot a year.
    """
    own = Window.partitionBy("asset")
    order = over_asset()
    rep = reported.filter("value is not null").select("ts", "asset", (F.log1p("value") if logs else F.col("value")).alias("value"))
    rep = rep.withColumn("x", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rep = rep.select("ts", "asset", F.struct("x", F.lead("x").over(order).alias("to"), F.col("ts").alias("since"), F.lead("ts").over(order).alias("until"), F.stddev_pop("value").over(own).alias("sd")).alias("report"))
    first = rep.groupBy("asset").agg(F.min("ts").alias("_first"))
    mean, vol = ewm_mean(pivot, span).withColumnRenamed("value", "m"), ewm_vol(pivot, span).withColumnRenamed("value", "s")
    path = pivot.join(mean, ["ts", "asset"]).join(vol, ["ts", "asset"]).select("ts", F.try_divide(F.col("value") - F.col("m"), F.col("s")).alias("b"))
    path = first.join(path, F.col("ts") >= F.col("_first")).select("ts", "asset", F.try_divide(F.col("b") - F.avg("b").over(own), F.stddev_pop("b").over(own)).alias("b"))
    known = order.rowsBetween(Window.unboundedPreceding, 0)
    both = path.join(rep, ["ts", "asset"], "full").select("ts", "asset", *(F.last(c, ignorenulls=True).over(known).alias(c) for c in ("b", "report")))
    both = both.select("ts", "asset", "b", "report.*")
    gone, left, whole = F.datediff("ts", "since"), F.datediff("until", "ts"), F.datediff("until", "since")
    inside = F.col("x") + (F.col("to") - F.col("x")) * gone / whole + vol_adjustment * F.col("sd") * F.sqrt(left * gone / whole / af) * F.coalesce("b", F.lit(0.0))
    level = F.when(F.col("ts") == F.col("since"), F.col("x")).when(F.col("until").isNotNull(), inside)
    step = F.col("level") - F.lag("level").over(order)
    return both.withColumn("level", level).select("ts", "asset", (F.expm1(step) if logs else step).alias("value"))
