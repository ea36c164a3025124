"""Cross-sectional signals against later returns: pairs, betas, information coefficients."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import average_rank, over_asset


def signal_pairs(returns: DataFrame, signal: DataFrame, horizon: int = 1, normalise: bool = True) -> DataFrame:
    """ts, asset, z, r: yesterday's signal and the compounded return of the next `horizon` rows, every horizon-th row; both as scores of the date."""
    w = over_asset()
    ahead = w.rowsBetween(0, horizon - 1)
    n = F.count("value").over(ahead)
    fwd = returns.withColumn("r", F.when(n == horizon, F.product(1 + F.col("value")).over(ahead) - 1)).select("ts", "asset", "r")
    lagged = signal.withColumn("z", F.lag("value").over(w)).select("ts", "asset", "z")
    dates = returns.select("ts").distinct().withColumn("_n", F.row_number().over(Window.orderBy("ts"))).filter((F.col("_n") - 1) % horizon == 0).select("ts")
    both = lagged.join(fwd, ["ts", "asset"]).join(dates, "ts", "left_semi").filter("z is not null and r is not null")
    if not normalise:
        return both
    d = Window.partitionBy("ts")
    return both.withColumns({c: F.try_divide(F.col(c) - F.avg(c).over(d), F.stddev_samp(c).over(d)) for c in ("z", "r")}).filter("z is not null and r is not null")


def pooled(pairs: DataFrame, *keys: str, intercept: bool = False) -> DataFrame:
    """beta, t-stat, r2, n of r on z over all pairs (or per keys)."""
    if intercept:
        out = pairs.groupBy(*keys).agg(F.regr_slope("r", "z").alias("beta"), F.regr_r2("r", "z").alias("r2"), F.count("*").alias("n"))
        return out.withColumn("t", F.signum("beta") * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2"))))
    zz, zr, rr = F.sum(F.col("z") * F.col("z")), F.sum(F.col("z") * F.col("r")), F.sum(F.col("r") * F.col("r"))
    out = pairs.groupBy(*keys).agg(zz.alias("zz"), zr.alias("zr"), rr.alias("rr"), F.count("*").alias("n"))
    out = out.withColumn("beta", F.try_divide(F.col("zr"), F.col("zz"))).withColumn("r2", F.try_divide(F.col("zr") * F.col("zr"), F.col("zz") * F.col("rr")))
    se = F.sqrt(F.try_divide((F.col("rr") - F.col("beta") * F.col("zr")) / (F.col("n") - 1), F.col("zz")))
    return out.withColumn("t", F.when(F.col("n") > 1, F.try_divide(F.col("beta"), se))).drop("zz", "zr", "rr")


def per_asset_betas(pairs: DataFrame, least: int = 10) -> DataFrame:
    return pooled(pairs, "asset").filter(F.col("n") >= least)


def information_coefficients(pairs: DataFrame, method: str = "spearman", least: int = 3) -> DataFrame:
    """ts, ic: correlation over assets of each date, of ranks or of values."""
    x = pairs
    if method == "spearman":
        x = pairs.withColumns({"z": average_rank(F.col("z"), "ts"), "r": average_rank(F.col("r"), "ts")})
    return x.groupBy("ts").agg(F.corr("z", "r").alias("ic"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("ic").isNotNull()).select("ts", "ic")


def ic_information_ratio(ics: DataFrame) -> DataFrame:
    """mean, std, annualised ratio by the median spacing of dates, t-stat, share of positive ones."""
    gap = ics.withColumn("gap", F.datediff("ts", F.lag("ts").over(Window.orderBy("ts"))))
    out = gap.agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.median("gap").alias("gap"), F.count("*").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    ratio = F.try_divide(F.col("mean"), F.col("std"))
    return out.select("mean", "std", (ratio * F.sqrt(F.try_divide(F.lit(365.25), F.col("gap")))).alias("ir"), (ratio * F.sqrt("n")).alias("t"), "hit_rate", "n")


def signal_changes(signals: DataFrame, weights: DataFrame, every: int = 1) -> DataFrame:
    """asset, x, y: changes of signals and of weights over `every` rows, for pooled or single regressions."""
    w = over_asset()
    both = signals.withColumnRenamed("value", "s").join(weights.withColumnRenamed("value", "w"), ["ts", "asset"])
    both = both.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") % every == 0)
    return both.select("ts", "asset", (F.col("s") - F.lag("s").over(w)).alias("x"), (F.col("w") - F.lag("w").over(w)).alias("y"))


def current_by_group(signals: DataFrame, groups: DataFrame) -> DataFrame:
    last = signals.filter("value is not null").groupBy("asset").agg(F.max_by("value", "ts").alias("value"))
    return last.join(groups, "asset")


def annual_ratio(mean: float, std: float, periods: float) -> float:
    return math.sqrt(periods) * mean / std if std else float("nan")
