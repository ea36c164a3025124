"""Correlation, covariance, autocorrelation and regression by relational aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import over_asset


def pairs(returns: DataFrame, same: bool = True) -> DataFrame:
    """ts, asset_i, asset_j, x, y for each two assets of a date: grows with the square of a date's assets, never of its rows."""
    a = returns.select("ts", F.col("asset").alias("asset_i"), F.col("value").alias("x"))
    b = returns.select("ts", F.col("asset").alias("asset_j"), F.col("value").alias("y"))
    return a.join(b, "ts").filter("asset_i <= asset_j" if same else "asset_i < asset_j")


def pairwise(returns: DataFrame) -> DataFrame:
    """asset_i, asset_j, n, cov, cov_pop, corr over the dates on which both have values."""
    both = pairs(returns).filter("x is not null and y is not null")
    return both.groupBy("asset_i", "asset_j").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"), F.covar_pop("x", "y").alias("cov_pop"), F.corr("x", "y").alias("corr"))


def mirrored(cov: DataFrame) -> DataFrame:
    """Both triangles of a table (asset_i, asset_j, …)."""
    other = cov.filter("asset_i <> asset_j")
    return cov.unionByName(other.withColumnsRenamed({"asset_i": "_a", "asset_j": "asset_i"}).withColumnRenamed("_a", "asset_j").select(*cov.columns))


def cov_to_corr(cov: DataFrame) -> DataFrame:
    """Keys (ts,) asset_i, asset_j; the diagonal is joined to both sides."""
    keys = [c for c in ("ts",) if c in cov.columns]
    diag = cov.filter("asset_i = asset_j").select(*keys, F.col("asset_i").alias("_k"), F.sqrt("cov").alias("_s"))
    out = cov.join(diag.withColumnsRenamed({"_k": "asset_i", "_s": "_si"}), [*keys, "asset_i"]).join(diag.withColumnsRenamed({"_k": "asset_j", "_s": "_sj"}), [*keys, "asset_j"])
    return out.withColumn("corr", F.try_divide(F.col("cov"), F.col("_si") * F.col("_sj"))).drop("_si", "_sj")


def regularised(cov: DataFrame, cut: float = 1e-5) -> DataFrame:
    return cov.withColumn("cov", F.when(F.abs("cov") < cut, F.lit(0.0)).otherwise(F.col("cov")))


def with_pivot(returns: DataFrame, pivot: str, normalised: bool = True) -> DataFrame:
    """asset, corr of each asset with one of them, without demeaning; over joint dates."""
    p = returns.filter(F.col("asset") == pivot).select("ts", F.col("value").alias("p"))
    both = returns.join(p, "ts").filter("p is not null and value is not null")
    num = F.sum(F.col("p") * F.col("value"))
    den = F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("value") * F.col("value"))) if normalised else F.count("*").cast("double")
    return both.groupBy("asset").agg(F.try_divide(num, den).alias("corr"))


def autocorrelations(panel: DataFrame, lags: list[int]) -> DataFrame:
    """asset, lag, corr of a value with the one so many rows before."""
    w = over_asset()
    seen = panel.filter("value is not null")
    wide = seen.select("asset", "value", *(F.lag("value", k).over(w).alias(f"l{k}") for k in lags))
    out = wide.groupBy("asset").agg(*(F.corr("value", f"l{k}").alias(str(k)) for k in lags))
    return out.unpivot("asset", [str(k) for k in lags], "lag", "corr").withColumn("lag", F.col("lag").cast("int"))


def cross_correlations(xy: DataFrame, lags: list[int]) -> DataFrame:
    """asset, lag, corr(x, y so many rows before)."""
    w = over_asset()
    wide = xy.select("asset", "x", *(F.lag("y", k).over(w).alias(f"l{k}") for k in lags))
    out = wide.groupBy("asset").agg(*(F.corr("x", f"l{k}").alias(str(k)) for k in lags))
    return out.unpivot("asset", [str(k) for k in lags], "lag", "corr").withColumn("lag", F.col("lag").cast("int"))


def autocorrelation_of_sums(returns: DataFrame, n: int) -> DataFrame:
    """First autocorrelation of sums over n rows, counted from the right."""
    from strandline.operators.calendars import resample_every

    return autocorrelations(resample_every(returns, n, "sum"), [1])


def acf_bands(panel: DataFrame, lags: list[int]) -> DataFrame:
    """lag, mean and deviation of autocorrelations over assets."""
    return autocorrelations(panel, lags).groupBy("lag").agg(F.avg("corr").alias("mean"), F.stddev_samp("corr").alias("std"))


def path_autocorrelations(panel: DataFrame, n_lags: int, partial: bool = False) -> DataFrame:
    """asset, lag, corr for lags 1 to n_lags of the values around their mean; NULL for a path of 2 * n_lags values or fewer.

    Autocovariances are sums over all rows, divided by the number of rows, or by that of products for partial ones,
    which solve the Yule-Walker equations lag by lag (Durbin-Levinson, as columns of one row an asset).
    """
    w, ks = over_asset(), range(1, n_lags + 1)
    seen = panel.filter("value is not null").withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy("asset")))
    wide = seen.select("asset", "v", *(F.lag("v", k).over(w).alias(f"l{k}") for k in ks))
    sums = wide.groupBy("asset").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("s"), *(F.sum(F.col("v") * F.col(f"l{k}")).alias(f"s{k}") for k in ks))
    share = lambda k: F.try_divide(F.col("n"), F.col("n") - k) if partial else F.lit(1.0)
    enough = F.col("n") > 2 * n_lags
    out = sums.select("asset", *(F.when(enough, F.try_divide(F.col(f"s{k}"), F.col("s")) * share(k)).alias(f"r{k}") for k in ks))
    last = {k: f"r{k}" for k in ks}
    if partial:
        last[1] = "p1_1"
        out = out.withColumn("p1_1", F.col("r1"))
        for k in range(2, n_lags + 1):
            before = [F.col(f"p{k - 1}_{j}") for j in range(1, k)]
            up = F.col(f"r{k}") - sum((b * F.col(f"r{k - j}") for j, b in enumerate(before, 1)), F.lit(0.0))
            down = 1 - sum((b * F.col(f"r{j}") for j, b in enumerate(before, 1)), F.lit(0.0))
            last[k] = f"p{k}_{k}"
            out = out.withColumn(last[k], F.try_divide(up, down))
            out = out.withColumns({f"p{k}_{j}": before[j - 1] - F.col(last[k]) * before[k - j - 1] for j in range(1, k)})
    found = out.select("asset", *(F.col(last[k]).alias(str(k)) for k in ks))
    return found.unpivot("asset", [str(k) for k in ks], "lag", "corr").withColumn("lag", F.col("lag").cast("int"))


def path_bands(autocorrelations: DataFrame) -> DataFrame:
    """lag, mean and deviation (over all assets) of path_autocorrelations."""
    return autocorrelations.groupBy("lag").agg(F.avg("corr").alias("mean"), F.stddev_pop("corr").alias("std"))


def upper_lower(upper: DataFrame, lower: DataFrame, diagonal: DataFrame) -> DataFrame:
    """asset_i, asset_j, value: one matrix above the diagonal, another below it, and (asset, value) on it."""
    cells = lambda m, which: m.filter(which).select("asset_i", "asset_j", "value")
    own = diagonal.select(F.col("asset").alias("asset_i"), F.col("asset").alias("asset_j"), "value")
    return cells(upper, "asset_i < asset_j").unionByName(cells(lower, "asset_i > asset_j")).unionByName(own)


def ols(df: DataFrame, *keys: str) -> DataFrame:
    """Per keys: alpha, beta, r2, n of y on x."""
    good = df.filter("x is not null and y is not null")
    return good.groupBy(*keys).agg(F.regr_intercept("y", "x").alias("alpha"), F.regr_slope("y", "x").alias("beta"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))


def ols_through_origin(df: DataFrame, *keys: str) -> DataFrame:
    good = df.filter("x is not null and y is not null")
    return good.groupBy(*keys).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("beta"), F.count("*").alias("n"))


def ols_many(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> dict[str, float]:
    """Coefficients by normal equations: one aggregate row of moments, solved on the driver. r2 as well."""
    import numpy as np

    good = df.select(y, *xs).dropna()
    cols = (["1"] if intercept else []) + xs
    term = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    names = [*cols, y]
    row = good.agg(*(F.sum(term(a) * term(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), F.avg(y).alias("mean"), F.count("*").alias("n")).first()
    k = len(cols)
    m = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    b = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    sse = m[k, k] - 2 * b @ m[:k, k] + b @ m[:k, :k] @ b
    total = m[k, k] - row["n"] * (row["mean"] or 0.0) ** 2
    return dict(zip(["alpha" if c == "1" else c for c in cols], b.tolist(), strict=True)) | {"r2": 1 - sse / total if total > 0 else float("nan"), "n": float(row["n"])}


def polynomial(df: DataFrame, order: int) -> DataFrame:
    """df with x^2 … x^order."""
    return df.withColumns({f"x{p}": F.pow("x", F.lit(p)) for p in range(2, order + 1)})


def equation_text(fit: DataFrame, digits: int = 2) -> DataFrame:
    """y = beta x + alpha, R2 = … as text."""
    text = F.format_string(f"y=%+.{digits}fx%+.{digits}f, R2=%.0f%%%%", F.col("beta"), F.col("alpha"), F.col("r2") * 100)
    return fit.withColumn("equation", text)


def tensor_mean(cov: DataFrame) -> DataFrame:
    return cov.groupBy("asset_i", "asset_j").agg(F.avg("cov").alias("cov"))


def nearest(points: DataFrame, grid: DataFrame, larger: bool = False) -> DataFrame:
    """Each point's nearest grid value (or the next one at or above); the grid is small."""
    g = F.broadcast(grid.select(F.col("x").alias("g")))
    both = points.join(g, F.col("g") >= F.col("x") if larger else F.lit(True))
    return both.groupBy("x").agg(F.min_by("g", F.struct(F.abs(F.col("g") - F.col("x")), "g")).alias("nearest"))


def sign_agreement(xy: DataFrame) -> DataFrame:
    """1 same, -1 opposite sign, NULL where either is zero."""
    s = F.signum("x") * F.signum("y")
    return xy.withColumn("agree", F.when(s != 0, s))


def window_all(key: str = "asset") -> Window:
    return Window.partitionBy(key)
