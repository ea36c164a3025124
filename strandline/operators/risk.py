"""Risk by join algebra on long covariances (ts, asset_i, asset_j, cov; both triangles)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.calendars import asof_backward
from strandline.operators.correlation import cov_to_corr
from strandline.operators.ewm import covariance_last, ewm_mean, ewm_vol, one
from strandline.operators.returns import to_returns

VAR99 = 2.3263  # fixed value: normal quantile


def _sides(cov: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """cov next to a's value of asset_i (a) and b's of asset_j (b); a, b: ts, asset, value."""
    left = a.select("ts", F.col("asset").alias("asset_i"), F.col("value").alias("a"))
    right = b.select("ts", F.col("asset").alias("asset_j"), F.col("value").alias("b"))
    return cov.join(left, ["ts", "asset_i"]).join(right, ["ts", "asset_j"])


def quadratic(cov: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """ts, value: a' cov b."""
    return _sides(cov, a, b).groupBy("ts").agg(F.sum(F.col("a") * F.col("cov") * F.col("b")).alias("value"))


def on_dates(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Weights as of the covariance's dates; 0 before the first."""
    dates = cov.select("ts").distinct()
    return asof_backward(weights, dates, keep_nulls=True).fillna(0.0, ["value"])


def active(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    p, b = portfolio.withColumnRenamed("value", "p"), benchmark.withColumnRenamed("value", "b")
    return p.join(b, ["ts", "asset"], "full").select("ts", "asset", (F.coalesce("p", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("value"))


def portfolio_vol(cov: DataFrame, weights: DataFrame) -> DataFrame:
    return quadratic(cov, weights, weights).withColumn("value", F.sqrt(F.greatest("value", F.lit(0.0))))


def tracking_error(cov: DataFrame, portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    return portfolio_vol(cov, active(portfolio, benchmark))


def group_tracking_error(cov: DataFrame, portfolio: DataFrame, benchmark: DataFrame, groups: DataFrame) -> DataFrame:
    """ts, grp, value: error of each group's active weights alone; not additive."""
    d = active(portfolio, benchmark).join(groups, "asset")
    left = d.select("ts", F.col("asset").alias("asset_i"), F.col("value").alias("a"), F.col("grp"))
    right = d.select("ts", F.col("asset").alias("asset_j"), F.col("value").alias("b"), F.col("grp").alias("_g"))
    q = cov.join(left, ["ts", "asset_i"]).join(right, ["ts", "asset_j"]).filter("grp = _g")
    return q.groupBy("ts", "grp").agg(F.sqrt(F.greatest(F.sum(F.col("a") * F.col("cov") * F.col("b")), F.lit(0.0))).alias("value"))


def marginal(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """ts, asset, value: Euler contributions w_i (cov w)_i / vol; they sum to the volatility, and are 0 where that is 0."""
    s = _sides(cov, weights, weights).groupBy("ts", F.col("asset_i").alias("asset")).agg((F.first("a") * F.sum(F.col("cov") * F.col("b"))).alias("c"))
    var = F.sum("c").over(Window.partitionBy("ts"))
    return s.select("ts", "asset", F.when(var > 0, F.col("c") / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(F.lit(0.0)).alias("value"))


def marginal_tracking_error(cov: DataFrame, portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    return marginal(cov, active(portfolio, benchmark))


def contribution_ratios(cov: DataFrame, weights: DataFrame) -> DataFrame:
    c = marginal(cov, weights)
    return c.withColumn("value", F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("ts"))), F.lit(0.0)))


def by_group(contributions: DataFrame, groups: DataFrame) -> DataFrame:
    return contributions.join(groups, "asset").groupBy("ts", "grp").agg(F.sum("value").alias("value"))


def benchmark_beta(cov: DataFrame, portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """w_p' cov w_b / w_b' cov w_b."""
    a, b = quadratic(cov, portfolio, benchmark).withColumnRenamed("value", "a"), quadratic(cov, benchmark, benchmark).withColumnRenamed("value", "b")
    return a.join(b, "ts").select("ts", F.coalesce(F.try_divide(F.col("a"), F.col("b")), F.lit(0.0)).alias("value"))


def benchmark_loadings(cov: DataFrame, benchmark: DataFrame) -> DataFrame:
    """ts, asset, value: (cov w_b)_i / var_b."""
    b = benchmark.select("ts", F.col("asset").alias("asset_j"), F.col("value").alias("b"))
    s = cov.join(b, ["ts", "asset_j"]).groupBy("ts", F.col("asset_i").alias("asset")).agg(F.sum(F.col("cov") * F.col("b")).alias("s"))
    var = quadratic(cov, benchmark, benchmark).withColumnRenamed("value", "v")
    return s.join(var, "ts").select("ts", "asset", F.try_divide(F.col("s"), F.col("v")).alias("value"))


def factor_exposures(loadings: DataFrame, weights: DataFrame) -> DataFrame:
    """ts, asset (the factor), value: sum of loading times weight. loadings: ts, asset, factor, beta."""
    return loadings.join(weights, ["ts", "asset"]).groupBy("ts", F.col("factor").alias("asset")).agg(F.sum(F.col("beta") * F.col("value")).alias("value"))


def loadings_at(loadings: DataFrame, dates: DataFrame, lag: int = 0) -> DataFrame:
    """ts, asset, factor, beta: the loadings known so many of the dates before each of them; NULL before the first."""
    w = Window.partitionBy("asset", "factor").orderBy("ts")
    keys = loadings.select("asset", "factor").distinct()
    asked = dates.select("ts").distinct().crossJoin(keys).withColumn("asked", F.lit(True))
    both = loadings.select("ts", "asset", "factor", "beta").join(asked, ["ts", "asset", "factor"], "full")
    known = both.withColumn("beta", F.last("beta", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("asked")
    return known.select("ts", "asset", "factor", (F.lag("beta", lag).over(w) if lag else F.col("beta")).alias("beta"))


def factor_alpha(loadings: DataFrame, factors: DataFrame, returns: DataFrame, lag: int = 1, span: float | None = None) -> DataFrame:
    """ts, asset, alpha, explained: returns less the sum of loadings (a lag ago) times factor returns (ts, asset, value); with a span, alpha is averaged.

    NULL where a factor's loading or return is missing.
    """
    beta = loadings_at(loadings, returns.select("ts"), lag)
    x = factors.select("ts", F.col("asset").alias("factor"), F.col("value").alias("x"))
    part = beta.join(x, ["ts", "factor"], "left").withColumn("part", F.col("beta") * F.col("x")).groupBy("ts", "asset")
    explained = part.agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("explained"))
    out = returns.join(explained, ["ts", "asset"], "left").select("ts", "asset", (F.col("value") - F.col("explained")).alias("alpha"), "explained")
    if span is None:
        return out
    mean = ewm_mean(out.select("ts", "asset", F.col("alpha").alias("value")), span).withColumnRenamed("value", "alpha")
    return mean.join(out.drop("alpha"), ["ts", "asset"])


def residual_correlations(loadings: DataFrame, factors: DataFrame, returns: DataFrame, span: float) -> DataFrame:
    """asset_i, asset_j, corr of residuals at the last date, and mean_corr: half the mean of asset_i's row without its diagonal's one."""
    alpha = factor_alpha(loadings, factors, returns, lag=0).select("ts", "asset", F.col("alpha").alias("value")).filter("value is not null")
    corr = cov_to_corr(covariance_last(alpha, span)).select("asset_i", "asset_j", "corr")
    row = Window.partitionBy("asset_i")
    return corr.withColumn("mean_corr", 0.5 * F.avg(F.col("corr") - (F.col("asset_i") == F.col("asset_j")).cast("double")).over(row))


def factor_risk(loadings: DataFrame, factor_cov: DataFrame, residual_var: DataFrame, weights: DataFrame) -> DataFrame:
    """ts, systematic, residual, total volatility. residual_var: ts, asset, var."""
    e = factor_exposures(loadings, weights)
    sys_ = quadratic(factor_cov, e, e).withColumnRenamed("value", "s")
    res = weights.join(residual_var, ["ts", "asset"]).groupBy("ts").agg(F.sum(F.col("value") * F.col("value") * F.col("var")).alias("r"))
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return sys_.join(res, "ts").select("ts", root(F.col("s")).alias("systematic"), root(F.col("r")).alias("residual"), root(F.col("s") + F.col("r")).alias("total"))


def factor_contributions(loadings: DataFrame, factor_cov: DataFrame, residual_var: DataFrame, weights: DataFrame) -> DataFrame:
    """ts, factor, value: shares of variance by factor, and the idiosyncratic one."""
    e = factor_exposures(loadings, weights)
    c = _sides(factor_cov, e, e).groupBy("ts", F.col("asset_i").alias("factor")).agg((F.first("a") * F.sum(F.col("cov") * F.col("b"))).alias("value"))
    res = weights.join(residual_var, ["ts", "asset"]).groupBy("ts").agg(F.sum(F.col("value") * F.col("value") * F.col("var")).alias("value")).select("ts", F.lit("idiosyncratic").alias("factor"), "value")
    both = c.unionByName(res)
    return both.withColumn("value", F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("ts"))), F.lit(0.0)))


def marginal_active_risk(loadings: DataFrame, factor_cov: DataFrame, residual_var: DataFrame, portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """ts, asset, factor_part, residual_part of the derivative of active risk."""
    d = active(portfolio, benchmark)
    e = factor_exposures(loadings, d)
    fe = factor_cov.join(e.select("ts", F.col("asset").alias("asset_j"), F.col("value").alias("b")), ["ts", "asset_j"]).groupBy("ts", F.col("asset_i").alias("factor")).agg(F.sum(F.col("cov") * F.col("b")).alias("fe"))
    f = loadings.join(fe, ["ts", "factor"]).groupBy("ts", "asset").agg(F.sum(F.col("beta") * F.col("fe")).alias("f"))
    total = factor_risk(loadings, factor_cov, residual_var, d).select("ts", "total")
    out = f.join(d, ["ts", "asset"]).join(residual_var, ["ts", "asset"]).join(total, "ts")
    return out.select("ts", "asset", F.try_divide(F.col("f"), F.col("total")).alias("factor_part"), F.try_divide(F.col("value") * F.col("var"), F.col("total")).alias("residual_part"))


def value_at_risk(cov: DataFrame, weights: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """99 % value at risk of the portfolio, or of each group's weights alone."""
    if groups is None:
        return portfolio_vol(cov, weights).withColumn("value", VAR99 * F.col("value"))
    zero = weights.withColumn("value", F.lit(0.0))
    return group_tracking_error(cov, weights, zero, groups).withColumn("value", VAR99 * F.col("value"))


def independent_var(returns: DataFrame, weights: DataFrame, span: float) -> DataFrame:
    """99 % value at risk without correlation, from EWM volatilities; weights on other dates go (inner join)."""
    v = ewm_vol(returns, span).withColumnRenamed("value", "v")
    return v.join(weights, ["ts", "asset"]).groupBy("ts").agg((VAR99 * F.sqrt(F.sum(F.pow(F.col("v") * F.col("value"), F.lit(2))))).alias("value"))


def limited(weight: Column, vol: Column, limit_bp: float, af: float = 260.0) -> Column:
    """Weight, clipped where its daily value at risk would pass the limit (in basis points)."""
    most = F.try_divide(F.lit(limit_bp / 10_000 * math.sqrt(af) / VAR99), vol)
    return F.greatest(-most, F.least(most, weight))


def realised_tracking_error(strategy: DataFrame, benchmark: DataFrame, span: float, af: float, warmup: int = 0) -> DataFrame:
    """EWM volatility of the difference of returns of two NAVs."""
    b = to_returns(benchmark).select("ts", F.col("value").alias("b"))
    d = to_returns(strategy).join(b, "ts").withColumn("value", F.col("value") - F.col("b")).drop("b").filter("value is not null")
    return ewm_vol(d, span, af=af, warmup=warmup)


def information_ratio(differences: DataFrame, af: float) -> DataFrame:
    """asset, te, ir of return differences."""
    return differences.groupBy("asset").agg((F.stddev_samp("value") * math.sqrt(af)).alias("te"), F.try_divide(F.avg("value") * math.sqrt(af), F.stddev_samp("value")).alias("ir"))


def residual_r2(returns: DataFrame, predicted: DataFrame, span: float) -> DataFrame:
    """1 - EWM residual variance over EWM variance."""
    from strandline.functions.kernels import decay, ewm

    d = decay(span)
    both = returns.join(predicted.withColumnRenamed("value", "_h"), ["ts", "asset"])
    res = one(both.withColumn("value", F.pow(F.col("value") - F.col("_h"), F.lit(2))).drop("_h"), lambda x: ewm(x, d, "x0")).withColumnRenamed("value", "r")
    tot = one(returns.withColumn("value", F.col("value") * F.col("value")), lambda x: ewm(x, d, "x0")).withColumnRenamed("value", "t")
    return res.join(tot, ["ts", "asset"]).select("ts", "asset", (1 - F.try_divide(F.col("r"), F.col("t"))).alias("value"))


def asymmetric(cov: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Cells that differ from their mirror or lack it: should be empty."""
    t = cov.select("ts", F.col("asset_i").alias("asset_j"), F.col("asset_j").alias("asset_i"), F.col("cov").alias("_t"))
    return cov.join(t, ["ts", "asset_i", "asset_j"], "full").filter(F.col("cov").isNull() | F.col("_t").isNull() | (F.abs(F.col("cov") - F.col("_t")) > tolerance))
