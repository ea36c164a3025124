"""Returns, compounding, excess returns, leverage and fees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import over_asset, per_annum, running, sampled_vol, years_between
from strandline.operators.calendars import asof_backward, rates_by_days, resample_agg, split_by_windows
from strandline.operators.panel import ffill, first_last, paired

KINDS = ("relative", "log", "difference", "level", "level0")


def return_column(kind: str, price: Column, before: Column) -> Column:
    if kind == "relative":
        return F.try_divide(price, before) - 1
    if kind == "log":
        return F.ln(price) - F.ln(before)
    if kind == "difference":
        return price - before
    if kind == "level":
        return price
    if kind == "level0":
        return before
    raise ValueError(kind)


def to_returns(prices: DataFrame, kind: str = "relative", fill: bool = True, drop_first: bool = False, zero_first: bool = False) -> DataFrame:
    """Returns of each asset; NULL where the price of the day is missing or not positive. Prices are filled forward first."""
    out = prices.withColumn("_p", F.col("value"))
    out = ffill(out) if fill else out
    w = over_asset()
    r = return_column(kind, F.col("value"), F.lag("value").over(w))
    positive = F.lit(True) if kind in ("difference", "level", "level0") else (F.col("_p") > 0)
    out = out.withColumn("_r", F.when(positive & F.col("_p").isNotNull(), r)).withColumn("_n", F.row_number().over(w))
    value = F.when((F.col("_n") == 1) & F.lit(zero_first), F.lit(0.0)).otherwise(F.col("_r"))
    out = out.withColumn("value", value)
    return (out.filter("_n > 1") if drop_first else out).drop("_p", "_r", "_n")


def total_return(prices: DataFrame) -> DataFrame:
    """asset, total_return, years, pa_return over observed prices."""
    ends = first_last(prices)
    total = F.when(F.col("last_ts") > F.col("first_ts"), F.try_divide(F.col("last_value"), F.col("first_value")) - 1)
    out = ends.withColumn("total_return", total).withColumn("years", years_between(F.col("first_ts"), F.col("last_ts")))
    return out.withColumn("pa_return", per_annum(F.col("total_return"), F.col("years")))


def nav(returns: DataFrame, additive: bool = False, init_value: float = 1.0, terminal: DataFrame | None = None) -> DataFrame:
    """NAV of returns: compounded or summed; scaled to end at terminal(asset, terminal) if given."""
    r = F.coalesce(F.col("value"), F.lit(0.0))
    path = 1 + F.sum(r).over(running()) if additive else F.product(1 + r).over(running())
    out = returns.withColumn("value", path * init_value)
    if terminal is not None:
        last = F.max_by("value", "ts").over(Window.partitionBy("asset"))
        out = out.withColumn("_last", last).join(terminal, "asset").withColumn("value", F.col("value") * F.try_divide(F.col("terminal"), F.col("_last"))).drop("_last", "terminal")
    return out


def log_nav(log_returns: DataFrame, init_value: float = 1.0) -> DataFrame:
    return log_returns.withColumn("value", init_value * F.exp(F.sum(F.coalesce("value", F.lit(0.0))).over(running())))


def scaled_nav(prices: DataFrame, scale: float) -> DataFrame:
    r = to_returns(prices)
    return nav(r.withColumn("value", scale * F.col("value")))


def relative_nav(long: DataFrame, short: DataFrame) -> DataFrame:
    both = paired(to_returns(long), to_returns(short))
    return nav(both.select("ts", "asset", (F.col("x") - F.col("y")).alias("value")))


def zero_first(returns: DataFrame) -> DataFrame:
    """The value at an asset's first observation becomes 0."""
    first = F.min(F.when(F.col("value").isNotNull(), F.col("ts"))).over(Window.partitionBy("asset"))
    return returns.withColumn("_f", first).withColumn("value", F.when(F.col("ts") == F.col("_f"), F.lit(0.0)).otherwise(F.col("value"))).drop("_f")


def portfolio_returns(weights: DataFrame, returns: DataFrame, name: str = "portfolio") -> DataFrame:
    """Sum over assets of yesterday's weight times today's return; NULL where all are."""
    lagged = weights.withColumn("value", F.lag("value").over(over_asset()))
    both = paired(lagged, returns, ("w", "r"))
    return both.groupBy("ts").agg(F.sum(F.col("w") * F.col("r")).alias("value")).select("ts", F.lit(name).alias("asset"), "value")


def summed_nav(returns: DataFrame, name: str = "portfolio") -> DataFrame:
    """NAV of the sum of returns over assets."""
    total = returns.groupBy("ts").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    return nav(total.select("ts", F.lit(name).alias("asset"), "value"))


def excess_returns(returns: DataFrame, rates: DataFrame) -> DataFrame:
    """Returns less the lagged annual rate for the days since the date before."""
    dt = rates_by_days(rates, returns.select("ts").distinct()).withColumnRenamed("value", "_rf")
    return returns.join(dt, "ts").withColumn("value", F.col("value") - F.col("_rf")).drop("_rf")


def excess_nav(prices: DataFrame, rates: DataFrame) -> DataFrame:
    return nav(excess_returns(to_returns(prices, zero_first=True), rates))


def excess_pa(prices: DataFrame, rates: DataFrame) -> DataFrame:
    return total_return(excess_nav(prices, rates)).select("asset", F.col("pa_return").alias("pa_excess_return"))


def funded_nav(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Excess NAV, scaled to end where the prices end."""
    last = first_last(prices).select("asset", F.col("last_value").alias("terminal"))
    return nav(excess_returns(to_returns(prices, zero_first=True), rates), terminal=last)


def additive_components(components: DataFrame, total: DataFrame) -> DataFrame:
    """Component NAVs c * adj**t, so that their annual growth averages to that of the total. t counts years."""
    pa = total_return(components)
    n = pa.agg(F.count("*").alias("n"), F.avg("pa_return").alias("mean"))
    whole = total_return(total).select(F.col("pa_return").alias("whole"))
    adj = n.crossJoin(F.broadcast(whole)).select(F.try_divide(F.col("whole") / F.col("n") + 1, F.col("mean") + 1).alias("_adj"))
    years = F.datediff("ts", F.min("ts").over(Window.partitionBy("asset"))) / 365.25
    return components.crossJoin(F.broadcast(adj)).withColumn("value", F.col("value") * F.pow("_adj", years)).drop("_adj")


def delever(returns: DataFrame, leverage: float, rate: float, periods: float) -> DataFrame:
    """(r + L f) / (1 + L)."""
    return returns.withColumn("value", (F.col("value") + leverage * rate / periods) / (1 + leverage))


def lever(returns: DataFrame, leverage: float, rate: float, periods: float) -> DataFrame:
    """(1 + L) r - L f."""
    return returns.withColumn("value", (1 + leverage) * F.col("value") - leverage * rate / periods)


def implied_leverage(levered: DataFrame, unlevered: DataFrame) -> DataFrame:
    """Slope of levered on unlevered returns, less 1."""
    return paired(levered, unlevered).groupBy("asset").agg((F.regr_slope("x", "y") - 1).alias("leverage"))


def quarterly(returns: DataFrame) -> DataFrame:
    return resample_agg(returns.filter("value is not null"), "QE", "compound")


def sampled_vols(returns: DataFrame, windows: DataFrame, af: float) -> DataFrame:
    """Annualised volatility of returns in each window (closed on both sides)."""
    inside = split_by_windows(returns, windows)
    vol = sampled_vol(F.col("value"), F.count(F.lit(1)))
    return inside.groupBy("asset", "sample", F.col("end").alias("ts")).agg((vol * float(np.sqrt(af))).alias("value"))


def returns_by_frequency(prices: DataFrame, freqs: DataFrame, calendars: dict[str, DataFrame], kind: str = "relative") -> DataFrame:
    """ts, asset, freq, value: returns of each asset at its own frequency (freqs: asset, freq)."""
    out = None
    for freq, dates in calendars.items():
        own = prices.join(freqs.filter(F.col("freq") == freq).select("asset"), "asset", "left_semi")
        part = to_returns(asof_backward(own, dates), kind, drop_first=True).withColumn("freq", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return out


# --- fees: an ordered recursion ------------------------------------------------------------------------------


def fee_path(r: np.ndarray, man: float, perf: float, crystal: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """Net NAV of gross returns: management fee accrues by time; a performance fee above the high-water mark is paid on crystallisation dates."""
    nav_, mark, out = 1.0, 1.0, np.empty(len(r))
    for i in range(len(r)):
        nav_ *= 1 + (0.0 if np.isnan(r[i]) else r[i])
        nav_ *= 1 - man * dt[i]
        if crystal[i] and nav_ > mark:
            nav_ -= perf * (nav_ - mark)
            mark = nav_
        out[i] = nav_
    return out


def net_of_fees(returns: DataFrame, man_fee: float = 0.02, perf_fee: float = 0.2, crystal: str = "YE") -> DataFrame:
    """Net NAV per asset; crystallises on the last observation of each period."""
    from strandline.operators.calendars import period_end

    w = over_asset()
    end = period_end(F.col("ts"), crystal)
    flagged = returns.withColumn("_c", (F.coalesce(F.lead(end).over(w), F.lit("9999-12-31").cast("date")) != end)).withColumn("_dt", F.coalesce(F.datediff("ts", F.lag("ts").over(w)) / 365.0, F.lit(0.0)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        g["value"] = fee_path(g["value"].to_numpy(float), man_fee, perf_fee, g["_c"].to_numpy(bool), g["_dt"].to_numpy(float))
        return g[["ts", "asset", "value"]]

    return flagged.groupBy("asset").applyInPandas(run, "ts date, asset string, value double")
