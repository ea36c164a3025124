"""Regimes of a benchmark, and what assets do in them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import bucket

NAMES = ("bear", "normal", "bull")
QUANTILES = (0.0, 0.16, 0.84, 1.0)


def quantile_regimes(series: DataFrame, q: Sequence[float] = QUANTILES, names: Sequence[str] = NAMES) -> DataFrame:
    """ts, x, regime: right-closed quantile bins of one series, the lowest value included. Equal edges or fewer than three values give no regime."""
    seen = series.filter("value is not null").select("ts", F.col("value").alias("x"))
    edges = seen.agg(F.percentile("x", F.array(*(F.lit(float(p)) for p in q))).alias("_e"), F.count("*").alias("_n"))
    apart = F.lit(True)
    for i in range(len(q) - 1):
        apart = apart & (F.col("_e")[i] < F.col("_e")[i + 1])
    named = bucket(F.col("x"), [F.col("_e")[i] for i in range(len(q))], names)
    return seen.crossJoin(F.broadcast(edges)).select("ts", "x", F.when(apart & (F.col("_n") >= 3), named).alias("regime"))


def sign_regimes(series: DataFrame) -> DataFrame:
    """Missing values count as positive."""
    return series.select("ts", F.col("value").alias("x"), F.when(F.col("value") < 0, F.lit("negative")).otherwise(F.lit("positive")).alias("regime"))


def volatility_regimes(vols: DataFrame, q: Sequence[float] = (0.0, 0.33, 0.66, 1.0), names: Sequence[str] = ("low", "medium", "high")) -> DataFrame:
    """Quantile bins with open ends."""
    edges = vols.agg(F.percentile("value", F.array(*(F.lit(float(p)) for p in q[1:-1]))).alias("_e"))
    inner = [F.col("_e")[i] for i in range(len(q) - 2)]
    named = bucket(F.col("x"), [F.lit(float("-inf")), *inner, F.lit(float("inf"))], names)
    return vols.select("ts", F.col("value").alias("x")).crossJoin(F.broadcast(edges)).select("ts", "x", named.alias("regime"))


def in_regimes(returns: DataFrame, regimes: DataFrame) -> DataFrame:
    return returns.join(regimes.select("ts", "regime"), "ts").filter("regime is not null and value is not null")


def regime_means(sampled: DataFrame) -> DataFrame:
    """asset, regime, mean, frequency."""
    out = sampled.groupBy("asset", "regime").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("asset")))


def regime_pa(sampled: DataFrame, af: float, total: DataFrame | None = None) -> DataFrame:
    """Annual contribution of each regime: expm1(af p m); the gap to the total annual return (asset, pa_return) is shared by p."""
    out = regime_means(sampled).withColumn("pa", F.expm1(af * F.col("frequency") * F.col("mean")))
    if total is None:
        return out
    gap = F.col("pa_return") - F.sum("pa").over(Window.partitionBy("asset"))
    return out.join(total.select("asset", "pa_return"), "asset").withColumn("pa", F.col("pa") + F.col("frequency") * gap).drop("pa_return")


def regime_sharpe(sampled: DataFrame, af: float) -> DataFrame:
    """asset, regime, sharpe: sqrt(af) p m / std of all; adds up to the total ratio."""
    total = sampled.groupBy("asset").agg(F.stddev_samp("value").alias("_std"))
    out = regime_means(sampled).join(total, "asset")
    return out.withColumn("sharpe", F.try_divide(F.lit(math.sqrt(af)) * F.col("frequency") * F.col("mean"), F.col("_std"))).drop("_std")


def regime_table(sampled: DataFrame, af: float, names: Sequence[str] = NAMES) -> DataFrame:
    """One row an asset, a Sharpe column for each regime and their sum."""
    wide = regime_sharpe(sampled, af).groupBy("asset").pivot("regime", list(names)).agg(F.first("sharpe"))
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    return wide.withColumn("total", total)
