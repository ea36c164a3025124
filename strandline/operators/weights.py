"""Cross-sectional weights, ranks and scores of each date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import clip
from strandline.operators.calendars import asof_backward

DATE = Window.partitionBy
V = "value"


def equal_weight(panel: DataFrame) -> DataFrame:
    """1 / n over the observed assets of a date; others 0."""
    n = F.count(V).over(DATE("ts"))
    return panel.withColumn(V, F.when(F.col(V).isNotNull(), F.try_divide(F.lit(1.0), n)).otherwise(0.0))


def sum_to_one(panel: DataFrame) -> DataFrame:
    return panel.withColumn(V, F.coalesce(F.try_divide(F.col(V), F.sum(V).over(DATE("ts"))), F.lit(0.0)))


def long_only(panel: DataFrame) -> DataFrame:
    """Positive parts, summing to 1."""
    return sum_to_one(panel.withColumn(V, F.when(F.col(V) > 0, F.col(V)).otherwise(0.0)))


def scaled_by(panel: DataFrame, factors: DataFrame, norm: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Values times factors (asset, factor); with norm divided by the date's (and the group's) sum."""
    out = panel.join(factors, "asset").withColumn(V, F.col(V) * F.col("factor")).drop("factor")
    if groups is not None:
        out = out.join(groups, "asset")
    keys = ("ts",) if groups is None else ("ts", "grp")
    return out.withColumn(V, F.try_divide(F.col(V), F.sum(V).over(DATE(*keys)))) if norm else out


def top_bottom(panel: DataFrame, n: int, bottom: bool = True) -> DataFrame:
    """+1 for the n largest of a date, -1 for the n smallest, else 0; ties by asset."""
    seen = panel.filter("value is not null")
    up = F.row_number().over(DATE("ts").orderBy(F.col(V).desc(), "asset"))
    down = F.row_number().over(DATE("ts").orderBy(F.col(V), F.col("asset").desc()))
    mark = F.when(up <= n, 1.0)
    mark = mark.when(down <= n, -1.0) if bottom else mark
    return seen.withColumn(V, mark.otherwise(0.0))


def long_short(panel: DataFrame, quantile: float = 0.25, least: int = 1) -> DataFrame:
    """+1 for the largest share of a date, -1 for the smallest (at least `least` names each)."""
    seen = panel.filter("value is not null")
    leg = F.greatest(F.floor(F.count(V).over(DATE("ts")) * quantile), F.lit(least))
    up = F.row_number().over(DATE("ts").orderBy(F.col(V).desc(), "asset"))
    down = F.row_number().over(DATE("ts").orderBy(F.col(V), F.col("asset").desc()))
    return seen.withColumn(V, F.when(up <= leg, 1.0).when(down <= leg, -1.0).otherwise(0.0))


def cross_score(panel: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """(clipped value - mean) / population deviation of the date."""
    out = panel.withColumn(V, clip(F.col(V), low, high))
    w = DATE("ts")
    return out.withColumn(V, F.try_divide(F.col(V) - F.avg(V).over(w), F.stddev_pop(V).over(w)))


def max_score(panel: DataFrame) -> DataFrame:
    return panel.withColumn(V, F.try_divide(F.col(V), F.max(V).over(DATE("ts"))))


def composite_score(scores: list[DataFrame], penalise_missing: bool = False) -> DataFrame:
    """Mean of several score panels; missing ones are skipped, or count as 0."""
    every = reduce(DataFrame.unionByName, scores)
    x = F.coalesce(F.col(V), F.lit(0.0)) if penalise_missing else F.col(V)
    total = F.sum(x) / len(scores) if penalise_missing else F.avg(x)
    return every.groupBy("ts", "asset").agg(total.alias(V))


def select_top(scores: list[DataFrame], quantile: float = 0.75) -> DataFrame:
    """(ts, asset) whose score is at or above the date's quantile in every panel."""
    every = reduce(DataFrame.unionByName, [s.withColumn("_k", F.lit(i)) for i, s in enumerate(scores)])
    edge = every.groupBy("ts", "_k").agg(F.percentile(V, F.lit(quantile)).alias("_edge"))
    hit = every.join(edge, ["ts", "_k"]).filter(F.col(V) >= F.col("_edge"))
    return hit.groupBy("ts", "asset").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(scores)).drop("_n")


def static_schedule(prices: DataFrame, weights: DataFrame, dates: DataFrame, rescale: bool = True) -> DataFrame:
    """Static weights (asset, weight) on each date, over the assets that have a price by then; rescaled to the full exposure."""
    live = asof_backward(prices, dates)
    out = live.join(weights, "asset").select("ts", "asset", F.col("weight").alias(V))
    if not rescale:
        return out
    whole = weights.agg(F.sum("weight").alias("_whole"))
    return out.crossJoin(F.broadcast(whole)).withColumn(V, F.try_divide(F.col(V) * F.col("_whole"), F.sum(V).over(DATE("ts")))).drop("_whole")


def unknown_assets(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Weights without a price column: should be empty."""
    return weights.join(prices.select("asset").distinct(), "asset", "left_anti")
