"""Performance and risk tables, drawdowns, descriptive statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import kurt_unbiased, over_asset, per_annum, running, skew_unbiased, years_between
from strandline.operators.calendars import resample_last
from strandline.operators.returns import excess_nav, to_returns, total_return


def performance_table(prices: DataFrame) -> DataFrame:
    """First and last date and price, years, total and annual returns per asset."""
    out = prices.filter("value is not null").groupBy("asset").agg(
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.min_by("value", "ts").alias("start_price"), F.max_by("value", "ts").alias("end_price"), F.count("*").alias("num_obs")
    )
    out = out.withColumn("years", years_between(F.col("start_date"), F.col("end_date"))).withColumn("total_return", F.try_divide(F.col("end_price"), F.col("start_price")) - 1)
    pa = per_annum(F.col("total_return"), F.col("years"))
    return out.withColumn("pa_return", pa).withColumn("log_pa_return", F.log1p("pa_return"))


def drawdowns(prices: DataFrame) -> DataFrame:
    """value / running maximum - 1."""
    filled = F.last("value", ignorenulls=True).over(running())
    return prices.withColumn("_v", filled).withColumn("value", F.col("_v") / F.max("_v").over(running()) - 1).drop("_v")


def time_under_water(prices: DataFrame) -> DataFrame:
    """Drawdown, and rows since the last peak (0 at a peak)."""
    dd = drawdowns(prices).withColumn("_island", F.sum((F.col("value") >= 0).cast("int")).over(running()))
    days = F.row_number().over(Window.partitionBy("asset", "_island").orderBy("ts")) - 1
    return dd.withColumn("days", days).drop("_island").withColumnRenamed("value", "drawdown")


def drawdown_episodes(prices: DataFrame, top: int = 10) -> DataFrame:
    """The deepest episodes of each asset: peak, trough, end, whether recovered, lengths in days."""
    dd = drawdowns(prices.filter("value is not null"))
    dd = dd.withColumn("_island", F.sum((F.col("value") >= 0).cast("int")).over(running())).withColumn("_next", F.lead("ts").over(over_asset()))
    ep = dd.groupBy("asset", "_island").agg(
        F.min("ts").alias("start"), F.min_by("ts", F.struct("value", "ts")).alias("trough"), F.min("value").alias("max_dd"), F.max("ts").alias("last_under"), F.max_by("_next", "ts").alias("_recovery"), F.count("*").alias("_n")
    ).filter("_n > 1")
    out = ep.withColumn("end", F.coalesce("_recovery", "last_under")).withColumn("recovered", F.col("_recovery").isNotNull())
    out = out.withColumn("days_dd", F.datediff("end", "start")).withColumn("days_to_trough", F.datediff("trough", "start")).withColumn("days_recovery", F.when(F.col("recovered"), F.datediff("end", "trough")))
    rank = F.row_number().over(Window.partitionBy("asset").orderBy("max_dd", "start"))
    return out.withColumn("position", rank).filter(F.col("position") <= top).select("asset", "position", "start", "trough", "end", "recovered", "max_dd", "days_dd", "days_to_trough", "days_recovery")


def max_current_drawdown(prices: DataFrame) -> DataFrame:
    return drawdowns(prices).groupBy("asset").agg(F.min("value").alias("max_dd"), F.max_by("value", "ts").alias("current_dd"))


def drawdown_distribution(prices: DataFrame, q: float = 0.1) -> DataFrame:
    return drawdowns(prices).groupBy("asset").agg(F.avg("value").alias("avg_dd"), F.percentile("value", F.lit(q)).alias("q_dd"), F.min("value").alias("max_dd"))


def risk_aggregates(r: Column, af: float) -> dict[str, Column]:
    """Aggregates of a return column at a frequency with af periods a year."""
    down = F.when(r < 0, r)
    scale = math.sqrt(af)
    return {
        "vol": F.stddev_samp(r) * scale,
        "downside_vol": F.when(F.count(down) >= 2, F.stddev_samp(down) * scale).otherwise(F.lit(0.0)),
        "skewness": skew_unbiased(r),
        "kurtosis": kurt_unbiased(r),
        "worst": F.min(r),
        "best": F.max(r),
    }


def risk_table(prices: DataFrame, freq: str = "ME", af: float = 12.0, kind: str = "log") -> DataFrame:
    """Volatility, downside volatility, skewness, kurtosis, worst and best return at a frequency; drawdowns on all prices."""
    r = to_returns(resample_last(prices, freq), kind).filter("value is not null")
    stats = r.groupBy("asset").agg(*(v.alias(k) for k, v in risk_aggregates(F.col("value"), af).items()))
    simple = to_returns(resample_last(prices, freq)).filter("value is not null").groupBy("asset").agg(F.try_divide(F.lit(math.sqrt(af)) * F.avg("value"), F.stddev_samp("value")).alias("sharpe_arithmetic"))
    return stats.join(simple, "asset").join(max_current_drawdown(prices), "asset")


def ra_perf_table(prices: DataFrame, freq: str = "ME", af: float = 12.0, rates: DataFrame | None = None) -> DataFrame:
    """Performance and risk merged, with Sharpe ratios (annual, log, arithmetic, excess), Sortino and Calmar."""
    out = performance_table(prices).join(risk_table(prices, freq, af), "asset")
    excess = F.col("pa_return")
    if rates is not None:
        out = out.join(total_return(excess_nav(prices, rates)).select("asset", F.col("pa_return").alias("pa_excess_return")), "asset")
        excess = F.col("pa_excess_return")
    else:
        out = out.withColumn("pa_excess_return", excess)
    return out.withColumns({
        "sharpe_pa": F.try_divide(F.col("pa_return"), F.col("vol")), "sharpe_log": F.try_divide(F.col("log_pa_return"), F.col("vol")), "sharpe_excess": F.try_divide(excess, F.col("vol")),
        "sortino": F.try_divide(excess, F.col("downside_vol")), "calmar": F.try_divide(-excess, F.col("max_dd")),
    })


def benchmark_table(prices: DataFrame, benchmark: DataFrame, freq: str = "QE", af: float = 4.0) -> DataFrame:
    """alpha (annual), beta, r2, observations and the two-sided p-value of alpha by regression on the benchmark's returns."""
    r = to_returns(resample_last(prices, freq)).filter("value is not null").withColumnRenamed("value", "y")
    b = to_returns(resample_last(benchmark, freq)).filter("value is not null").select("ts", F.col("value").alias("x"))
    fit = r.join(b, "ts").groupBy("asset").agg(
        F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("_a"), F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n"),
        F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.avg("x").alias("_mx"),
    )
    se2 = F.try_divide(F.col("_syy") * (1 - F.col("r2")), F.col("n") - 2) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.col("_mx") * F.col("_mx"), F.col("_sxx")))
    out = fit.withColumn("alpha", F.col("_a") * af).withColumn("t_alpha", F.try_divide(F.col("_a"), F.sqrt(se2)))
    return out.select("asset", "alpha", "beta", "r2", "n", "t_alpha")


def with_p_values(table: DataFrame, t: str = "t_alpha", n: str = "n", params: int = 2) -> DataFrame:
    """Two-sided p-values of t statistics: a distribution function that needs Python, on one row an asset."""
    import pandas as pd

    from strandline.functions.kernels import student_p

    @F.pandas_udf("double")
    def p(t_, n_):  # noqa: ANN001, ANN202
        return pd.Series([student_p(a, b - params) for a, b in zip(t_, n_, strict=True)])

    return table.withColumn("p_value", p(F.col(t).cast("double"), F.col(n).cast("double")))


def descriptive_by_frequency(panel: DataFrame) -> DataFrame:
    """mean, std, q16, median, q84 of a panel per asset."""
    q = F.percentile("value", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)))
    out = panel.filter("value is not null").groupBy("asset").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), q.alias("_q"))
    return out.select("asset", "mean", "std", F.col("_q")[0].alias("q16"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q84"))


def describe(panel: DataFrame, af: float = 1.0) -> DataFrame:
    """mean, std, t-stat, skewness, kurtosis, min, max, last value and its percent rank per asset."""
    v = F.col("value")
    last = F.max_by(v, "ts").over(Window.partitionBy("asset"))
    out = panel.filter("value is not null").withColumn("_last", last)
    return out.groupBy("asset").agg(
        (F.avg(v) * af).alias("mean"), (F.stddev_samp(v) * math.sqrt(af)).alias("std"), F.try_divide(F.avg(v) * F.sqrt(F.count(v)), F.stddev_samp(v)).alias("t_stat"), skew_unbiased(v).alias("skewness"),
        kurt_unbiased(v).alias("kurtosis"), F.min(v).alias("min"), F.max(v).alias("max"), F.first("_last").alias("last"), F.avg((v <= F.col("_last")).cast("double")).alias("rank"),
    )


def periodic_returns(prices: DataFrame) -> DataFrame:
    """asset, year, one column a month, and the year's total: compounded month-end returns."""
    m = to_returns(resample_last(prices, "ME")).filter("value is not null")
    own = m.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    wide = own.groupBy("asset", "year").pivot("month", list(range(1, 13))).agg(F.first("value"))
    total = own.groupBy("asset", "year").agg((F.product(1 + F.col("value")) - 1).alias("total"))
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    for i, n in enumerate(names, 1):
        wide = wide.withColumnRenamed(str(i), n)
    return wide.join(total, ["asset", "year"])
