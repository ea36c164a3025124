"""Rolling statistics with full windows only, and bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expressions import last_rows, ohlc_variance, over_asset
from strandline.operators.returns import to_returns


def _full(panel: DataFrame, n: int, agg: Column) -> DataFrame:
    w = last_rows(n)
    return panel.withColumn("value", F.when(F.count("value").over(w) == n, agg))


def rolling(panel: DataFrame, n: int, what: str = "mean") -> DataFrame:
    w = last_rows(n)
    agg = {"mean": F.avg("value"), "sum": F.sum("value"), "std": F.stddev_samp("value"), "min": F.min("value"), "max": F.max("value"), "skew": F.skewness("value"), "compound": F.product(1 + F.col("value")) - 1}[what]
    return _full(panel, n, agg.over(w))


def rolling_returns(prices: DataFrame, n: int) -> DataFrame:
    return prices.withColumn("value", F.try_divide(F.col("value"), F.lag("value", n).over(over_asset())) - 1)


def rolling_pa(prices: DataFrame, n: int) -> DataFrame:
    """Annual return over the last n rows, by calendar days."""
    w = over_asset()
    years = F.datediff("ts", F.lag("ts", n).over(w)) / 365.25
    total = F.try_divide(F.col("value"), F.lag("value", n).over(w))
    return prices.withColumn("value", F.pow(total, F.try_divide(F.lit(1.0), years)) - 1)


def rolling_vols(prices: DataFrame, n: int, af: float) -> DataFrame:
    r = to_returns(prices, "log", drop_first=True)
    return _full(r, n, F.stddev_samp("value").over(last_rows(n)) * math.sqrt(af))


def rolling_sharpes(prices: DataFrame, n: int, af: float) -> DataFrame:
    """sqrt(af) expm1(mean log return) / std."""
    r, w = to_returns(prices, "log", drop_first=True), last_rows(n)
    return _full(r, n, F.try_divide(math.sqrt(af) * F.expm1(F.avg("value").over(w)), F.stddev_samp("value").over(w)))


def rolling_skews(prices: DataFrame, n: int) -> DataFrame:
    r = to_returns(prices, "log", drop_first=True)
    return _full(r, n, F.skewness("value").over(last_rows(n)))


def bars(ticks: DataFrame, width: str = "1 day", key: str = "asset") -> DataFrame:
    """open, high, low, close, n of ticks(ts timestamp, key, value) in tumbling windows."""
    w = F.window("ts", width)
    out = ticks.groupBy(w.alias("w"), key).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("ts"), key, "open", "high", "low", "close", "n")


def bar_variance(bars_: DataFrame, kind: str, least: int = 1) -> DataFrame:
    before = F.lag("close").over(over_asset())
    v = ohlc_variance(kind, *(F.col(c) for c in ("open", "high", "low", "close")), before)
    return bars_.withColumn("value", F.when(F.col("n") >= least, v)).select("ts", "asset", "value")


def bar_vol(bars_: DataFrame, kind: str, af: float, weekends: bool = True) -> DataFrame:
    """asset, month, vol: annualised root of a month's mean bar variance."""
    v = bar_variance(bars_, kind)
    v = v if weekends else v.filter(F.weekday("ts") < 5)
    return v.groupBy("asset", F.last_day("ts").alias("month")).agg((F.sqrt(F.avg("value") * af)).alias("vol"))
