"""Aggregates along either axis, by group, and bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import bucket, clip, clip_filled



#: name -> aggregate of a value column; missing values never count.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "sum_positive": lambda x: F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)),
    "sum_negative": lambda x: F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)),
    "mean_positive": lambda x: F.avg(F.when(x > 0, x)),
    "mean_negative": lambda x: F.avg(F.when(x < 0, x)),
    "abs_sum": lambda x: F.coalesce(F.sum(F.abs(x)), F.lit(0.0)),
    "abs_sum_positive": lambda x: F.coalesce(F.sum(F.when(x > 0, F.abs(x))), F.lit(0.0)),
    "abs_sum_negative": lambda x: F.coalesce(F.sum(F.when(x < 0, F.abs(x))), F.lit(0.0)),
    "std": F.stddev_samp,
    "var": F.var_pop,
    "min": F.min,
    "max": F.max,
    "count": lambda x: F.count(x).cast("double"),
}


def aggregate(panel: DataFrame, axis: str = "asset", *names: str) -> DataFrame:
    """One row for each asset (axis asset) or date (axis ts), a column for each aggregate."""
    return panel.groupBy(axis).agg(*(AGGREGATES[n](F.col("value")).alias(n) for n in names))


def clipped(panel: DataFrame, axis: str, low: float, high: float, drop: bool = False) -> DataFrame:
    """Sum and mean after clipping to the bounds (or dropping what is beyond)."""
    x = clip_filled(F.col("value"), low, high) if drop else clip(F.col("value"), low, high)
    return panel.groupBy(axis).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.avg(x).alias("mean"))


def weighted_mean(panel: DataFrame, weights: DataFrame, axis: str = "ts") -> DataFrame:
    """Weights (asset, weight) are renormalised over what is observed."""
    both = panel.join(weights, "asset")
    seen = F.when(F.col("value").isNotNull(), F.col("weight"))
    return both.groupBy(axis).agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum(seen)).alias("value"), F.sum(F.col("weight") * F.col("value")).alias("sum"))


def last_by(panel: DataFrame, axis: str = "asset", skip_missing: bool = True) -> DataFrame:
    order = F.when(F.col("value").isNotNull(), F.col("ts")) if skip_missing else F.col("ts")
    return panel.groupBy(axis).agg(F.max_by("value", order).alias("value"))


def median_mad(panel: DataFrame, axis: str = "asset", scale: float = 1.0, zeros_to_null: bool = False) -> DataFrame:
    """median, median absolute deviation, and their ratio."""
    x = F.when(F.col("value") != 0, F.col("value")) if zeros_to_null else F.col("value")
    panel = panel.withColumn("value", x)
    med = panel.groupBy(axis).agg(F.median("value").alias("median"))
    out = panel.join(med, axis).groupBy(axis, "median").agg((F.median(F.abs(F.col("value") - F.col("median"))) * scale).alias("mad"))
    return out.withColumn("ratio", F.try_divide(F.col("median"), F.col("mad")))


def across(panels: Sequence[DataFrame], agg: str = "mean") -> DataFrame:
    """Cell by cell over several panels."""
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out.groupBy("ts", "asset").agg(AGGREGATES[agg](F.col("value")).alias("value"))


def by_group(panel: DataFrame, groups: DataFrame, agg: str = "sum") -> DataFrame:
    """ts, grp, value over a dimension (asset, grp), which has a row an asset and is joined as Spark decides."""
    return panel.join(groups, "asset").groupBy("ts", "grp").agg(AGGREGATES[agg](F.col("value")).alias("value"))


def by_group_with_total(panel: DataFrame, groups: DataFrame, agg: str = "sum", total: str = "Total") -> DataFrame:
    """Groups and a total of each date, in one rollup."""
    out = panel.join(groups, "asset").rollup("ts", "grp").agg(AGGREGATES[agg](F.col("value")).alias("value"), F.grouping("ts").alias("_t"), F.grouping("grp").alias("_g"))
    return out.filter("_t = 0").select("ts", F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col("grp")).alias("grp"), "value")


def group_average_fill(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Every value becomes its group's mean of the date."""
    own = Window.partitionBy("ts", "grp")
    return panel.join(groups, "asset").withColumn("value", F.avg("value").over(own))


def against_universe(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """ts, grp, median of the group, and median of all assets."""
    own = panel.join(groups, "asset").groupBy("ts", "grp").agg(F.median("value").alias("value"))
    return own.join(panel.groupBy("ts").agg(F.median("value").alias("universe")), "ts")


def one_hot(groups: DataFrame, names: list[str] | None = None) -> DataFrame:
    return groups.groupBy("asset").pivot("grp", names).agg(F.lit(1.0)).fillna(0.0)


def group_members(groups: DataFrame) -> DataFrame:
    return groups.groupBy("grp").agg(F.array_sort(F.collect_list("asset")).alias("assets"))


def cut(df: DataFrame, column: str, edges: Sequence[float], open_ends: bool = True, names: Sequence[str] | None = None) -> DataFrame:
    """df with `bin`: right-closed intervals of fixed edges; open ends take everything beyond."""
    bounds = [float("-inf"), *edges, float("inf")] if open_ends else list(edges)
    names = names or [f"({a:g}, {b:g}]" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return df.withColumn("bin", bucket(F.col(column), bounds, names, lowest=not open_ends))


def cut_quantiles(df: DataFrame, column: str, n: int) -> DataFrame:
    """df with `bin` Q1..Qn by quantile edges of the column."""
    edges = df.agg(F.percentile(column, F.array(*(F.lit(i / n) for i in range(n + 1)))).alias("_e"))
    named = bucket(F.col(column), [F.col("_e")[i] for i in range(n + 1)], [f"Q{i + 1}" for i in range(n)])
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", named).drop("_e")


def histogram(df: DataFrame, column: str, low: float, high: float, n: int) -> DataFrame:
    """bin, left, count over n equal bins of [low, high]; the last one is closed."""
    width = (high - low) / n
    b = F.least(F.floor((F.col(column) - low) / width), F.lit(n - 1)).cast("int")
    out = df.filter(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("left", low + F.col("bin") * width)


def years_hue(df: DataFrame) -> DataFrame:
    return df.withColumn("hue", F.year("ts").cast("string"))


def year_ranges_hue(df: DataFrame, starts: Sequence[int]) -> DataFrame:
    """Labels like 2005-2009 of the range that starts at or before the year."""
    out = F.lit(None).cast("string")
    for a, b in zip(starts, [*starts[1:], None], strict=True):
        out = F.when((F.year("ts") >= a) & (F.lit(True) if b is None else F.year("ts") < b), F.lit(f"{a}-{'' if b is None else b - 1}")).otherwise(out)
    return df.withColumn("hue", out)
