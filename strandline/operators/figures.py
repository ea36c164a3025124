"""What figures and tables show, as queries: small frames that a driver can draw."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import bucket, kurt_unbiased, skew_unbiased
from strandline.operators.aggregates import cut_quantiles
from strandline.operators.calendars import period_end, resample_last
from strandline.operators.correlation import ols
from strandline.operators.performance import drawdown_episodes, drawdowns
from strandline.operators.returns import to_returns


def box(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, quartiles, whiskers (the last values within 1.5 quartile ranges) by keys."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), q.alias("_q"))
    stats = stats.select(*keys, "n", "mean", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    both = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    cols = ["n", "mean", "q1", "median", "q3"]
    return both.groupBy(*keys, *cols).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def box_by_bucket(df: DataFrame, x: str, y: str, n: int = 4) -> DataFrame:
    """Boxes of y within quantile buckets of x."""
    return box(cut_quantiles(df, x, n), y, "bin")


def error_bars(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and its standard error by keys."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("error"))


def density(panel: DataFrame, points: int = 50, floor_zero: bool = False) -> DataFrame:
    """asset, x, y: a Gaussian kernel density on a grid between the extremes; the bandwidth is Scott's. The grid is small and meets each value once."""
    s = panel.filter("value is not null").groupBy("asset").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).withColumn("lo", F.greatest("lo", F.lit(0.0)) if floor_zero else F.col("lo"))
    grid = s.select("asset", "h", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("value")) / F.col("h")
    out = panel.filter("value is not null").join(grid, "asset").groupBy("asset", "x", "h", "n").agg(F.sum(F.exp(-0.5 * z * z)).alias("s"))
    return out.select("asset", "x", F.try_divide(F.col("s"), F.col("n") * F.col("h") * math.sqrt(2 * math.pi)).alias("y"))


def histogram_2d(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], n: int = 10) -> DataFrame:
    """ix, iy, n over equal cells of (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = bounds
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - a) / ((b - a) / n)), F.lit(n - 1)).cast("int")
    inside = df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(cell(x, x0, x1).alias("ix"), cell(y, y0, y1).alias("iy")).agg(F.count("*").alias("n"))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function by a published rational approximation (relative error below 1.2e-9)."""
    # The coefficients of the approximation.
    a = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239]
    b = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1]
    c = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416]

    def poly(x: Column, k: Sequence[float], one: bool = False) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out * x + 1 if one else out

    q = p - 0.5
    r = q * q
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    far = poly(tail, c) / poly(tail, d, True)
    return F.when(p < 0.02425, far).when(p > 1 - 0.02425, -far).otherwise(poly(r, a) * q / poly(r, b, True))


def qq(panel: DataFrame) -> DataFrame:
    """asset, theory, value: standardised values against normal quantiles."""
    own = Window.partitionBy("asset")
    seen = panel.filter("value is not null")
    rank = (F.row_number().over(own.orderBy("value")) - 0.5) / F.count("*").over(own)
    z = F.try_divide(F.col("value") - F.avg("value").over(own), F.stddev_samp("value").over(own))
    return seen.select("asset", normal_quantile(rank).alias("theory"), z.alias("value"))


def xy_qq(a: DataFrame, b: DataFrame, points: int = 50) -> DataFrame:
    """Quantiles of two samples side by side."""
    ps = [i / (points - 1) for i in range(points)]
    q = lambda df, n: df.agg(F.percentile("value", F.array(*(F.lit(p) for p in ps))).alias(n))
    both = q(a, "_a").crossJoin(F.broadcast(q(b, "_b")))
    return both.select(F.inline(F.arrays_zip(F.array(*(F.lit(p) for p in ps)).alias("p"), F.col("_a").alias("x"), F.col("_b").alias("y"))))


def scatter(df: DataFrame, *keys: str) -> DataFrame:
    """x, y with the fitted value and the half width of its 95 % band, by keys."""
    fit = ols(df, *keys).join(df.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.var_pop("x").alias("_vx"), F.regr_syy("y", "x").alias("_syy")), list(keys)) if keys else None
    if fit is None:
        return scatter(df.withColumn("_all", F.lit(1)), "_all").drop("_all")
    both = df.join(fit, list(keys))
    s = F.sqrt(F.col("_syy") * (1 - F.col("r2")) / (F.col("n") - 2))
    dx = F.col("x") - F.col("_mx")
    out = both.withColumn("fit", F.col("alpha") + F.col("beta") * F.col("x")).withColumn("band", 1.96 * s * F.sqrt(1 / F.col("n") + F.try_divide(dx * dx, F.col("n") * F.col("_vx"))))
    return out.drop("_mx", "_vx", "_syy", "alpha", "beta", "r2", "n")


def classified_fits(df: DataFrame, n: int = 3) -> DataFrame:
    """A regression within each quantile bucket of x."""
    return ols(cut_quantiles(df, "x", n), "bin")


def stacked(panel: DataFrame) -> DataFrame:
    """Running sums over assets of each date, for stacked areas, and the date's total."""
    w = Window.partitionBy("ts").orderBy("asset")
    return panel.withColumn("top", F.sum(F.coalesce("value", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("value").over(Window.partitionBy("ts")))


def legend_stats(panel: DataFrame) -> DataFrame:
    """first, avg, last, min, max, std, skew, kurt, t-stat, missing share: what legends print."""
    v = F.col("value")
    seen = F.when(v.isNotNull(), F.col("ts"))
    return panel.groupBy("asset").agg(
        F.min_by(v, seen).alias("first"), F.avg(v).alias("avg"), F.max_by(v, seen).alias("last"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"), skew_unbiased(v).alias("skew"),
        kurt_unbiased(v).alias("kurt"), F.try_divide(F.avg(v), F.stddev_samp(v)).alias("t_stat"), F.avg(v.isNull().cast("double")).alias("missing"),
    )


def top_bottom(rows: DataFrame, n: int) -> DataFrame:
    """The n largest and n smallest of (asset, value): a report of fixed size."""
    up = rows.orderBy(F.col("value").desc(), "asset").limit(n).withColumn("side", F.lit("top"))
    return up.unionByName(rows.orderBy("value", "asset").limit(n).withColumn("side", F.lit("bottom")))


def best_worst(prices: DataFrame, freq: str, n: int = 10) -> DataFrame:
    """The n best and worst returns of each asset at a frequency."""
    r = to_returns(resample_last(prices, freq)).filter("value is not null")
    w = Window.partitionBy("asset")
    up, down = F.row_number().over(w.orderBy(F.col("value").desc(), "ts")), F.row_number().over(w.orderBy("value", "ts"))
    return r.withColumns({"best": up, "worst": down}).filter((F.col("best") <= n) | (F.col("worst") <= n)).select("ts", "asset", "value", F.when(F.col("best") <= n, "best").otherwise("worst").alias("side"))


def drawdown_paths(prices: DataFrame, top: int = 5) -> DataFrame:
    """asset, position, day, value: drawdowns of the deepest episodes by days since their start."""
    ep = drawdown_episodes(prices, top).select("asset", "position", "start", "end")
    both = drawdowns(prices).join(ep, "asset").filter(F.col("ts").between(F.col("start"), F.col("end")))
    return both.select("asset", "position", F.datediff("ts", "start").alias("day"), "value")


def quantile_table(df: DataFrame, x: str, y: str, n: int = 4) -> DataFrame:
    """n, mean x, mean and deviation of y by quantile bucket of x."""
    return cut_quantiles(df, x, n).groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))


def periodic_table(prices: DataFrame, freq: str = "QE", total: bool = True) -> DataFrame:
    """asset, period, value: compounded returns of calendar periods, and of everything."""
    r = to_returns(resample_last(prices, freq)).filter("value is not null")
    out = r.select("asset", F.col("ts").cast("string").alias("period"), "value")
    if not total:
        return out
    return out.unionByName(r.groupBy("asset").agg((F.product(1 + F.col("value")) - 1).alias("value")).select("asset", F.lit("Total").alias("period"), "value"))


def period_returns(prices: DataFrame, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """asset, period, value: total returns between named dates, as of each."""
    spark = prices.sparkSession
    dim = spark.createDataFrame([(k, a, b) for k, (a, b) in periods.items()], "period string, a string, b string").select("period", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    both = prices.filter("value is not null").crossJoin(F.broadcast(dim)).filter("ts <= b")
    start = F.max_by("value", F.when(F.col("ts") <= F.col("a"), F.col("ts")))
    return both.groupBy("asset", "period").agg((F.try_divide(F.max_by("value", "ts"), start) - 1).alias("value"))


def annual_matrix(prices: DataFrame) -> DataFrame:
    """asset, first_year, last_year, value: annual return between the ends of every two years of one asset."""
    y = prices.filter("value is not null").groupBy("asset", F.year("ts").alias("y")).agg(F.max_by("value", "ts").alias("v"), F.max("ts").alias("t"))
    a, b = y.select("asset", F.col("y").alias("first_year"), F.col("v").alias("a"), F.col("t").alias("ta")), y.select("asset", F.col("y").alias("last_year"), F.col("v").alias("b"), F.col("t").alias("tb"))
    both = a.join(b, "asset").filter("first_year < last_year")
    years = F.datediff("tb", "ta") / 365.25
    return both.select("asset", "first_year", "last_year", (F.pow(F.try_divide(F.col("b"), F.col("a")), F.try_divide(F.lit(1.0), years)) - 1).alias("value"))


def regime_regressions(returns: DataFrame, benchmark: DataFrame, regimes: DataFrame) -> DataFrame:
    """Regression of assets on the benchmark in each regime."""
    both = returns.withColumnRenamed("value", "y").join(benchmark.select("ts", F.col("value").alias("x")), "ts").join(regimes.select("ts", "regime"), "ts")
    return ols(both.filter("regime is not null"), "asset", "regime")


def price_history(prices: DataFrame) -> DataFrame:
    """First and last date, observations and gaps of each asset: the rows of a coverage chart."""
    gap = F.datediff("ts", F.lag("ts").over(Window.partitionBy("asset").orderBy("ts")))
    out = prices.filter("value is not null").withColumn("gap", gap)
    return out.groupBy("asset").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.max("gap").alias("longest_gap"))


def labels(table: DataFrame, sharpe: str = "sharpe_pa") -> DataFrame:
    """asset, label: name, annual return, volatility, ratio and drawdown in one line, from a performance table."""
    text = F.format_string("%s: p.a.=%.2f%%, vol=%.2f%%, Sharpe=%.2f, max DD=%.2f%%", F.col("asset"), F.col("pa_return") * 100, F.col("vol") * 100, F.col(sharpe), F.col("max_dd") * 100)
    return table.select("asset", text.alias("label"))


def heat_shades(table: DataFrame, value: str = "value", steps: int = 5, *keys: str) -> DataFrame:
    """The table with shade 0 … steps - 1 of its value between the extremes (by keys)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    share = F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w))
    return table.withColumn("shade", F.least(F.floor(share * steps), F.lit(steps - 1)).cast("int"))


def group_total_table(table: DataFrame, value: str, weight: str | None = None, group: str = "grp", total: str = "Total") -> DataFrame:
    """Rows of items, of groups (weighted means where a weight is given) and of the mean of all groups."""
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)) if weight else F.avg(value)
    groups = table.groupBy(group).agg(mean.alias(value))
    items = table.select(group, F.col("asset").alias("row"), value)
    return items.unionByName(groups.select(group, F.col(group).alias("row"), value)).unionByName(groups.agg(F.avg(value).alias(value)).select(F.lit(total).alias(group), F.lit(total).alias("row"), value))


def sampled(panel: DataFrame, freq: str) -> DataFrame:
    """The last row of each calendar period."""
    w = Window.partitionBy("asset", period_end(F.col("ts"), freq)).orderBy(F.col("ts").desc())
    return panel.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def sign_hue(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("hue", bucket(F.signum(value), [-1.5, -0.5, 0.5, 1.5], ["negative", "zero", "positive"]))
