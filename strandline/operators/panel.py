"""Long panels (ts, asset, value): nulls, alignment, fills, first and last observations, reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import finite, over_asset, running

SCHEMA = "ts date, asset string, value double"


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols or ("value",)})


def to_long(wide: DataFrame, index: str = "ts", name: str = "asset", value: str = "value") -> DataFrame:
    return wide.unpivot(index, [c for c in wide.columns if c != index], name, value)


def to_wide(panel: DataFrame, assets: list[str] | None = None) -> DataFrame:
    """One column an asset. Without the list of assets, Spark has to look for them first."""
    return panel.groupBy("ts").pivot("asset", assets).agg(F.first("value"))


def full_grid(panel: DataFrame) -> DataFrame:
    """Every asset on every date; a cell without observation is NULL. Assets are one row each, so they are sent to the dates."""
    dates, assets = panel.select("ts").distinct(), panel.select("asset").distinct()
    own = assets.agg(F.collect_set("asset").alias("assets"))
    grid = dates.crossJoin(F.broadcast(own)).select("ts", F.explode("assets").alias("asset"))
    return grid.join(panel, ["ts", "asset"], "left")


def paired(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("x", "y"), how: str = "inner") -> DataFrame:
    """Two panels side by side on (ts, asset)."""
    return a.withColumnRenamed("value", names[0]).join(b.withColumnRenamed("value", names[1]), ["ts", "asset"], how)


def against(panel: DataFrame, series: DataFrame, name: str = "x") -> DataFrame:
    """A panel next to one series on ts."""
    return panel.join(series.select("ts", F.col("value").alias(name)), "ts")


def common_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("ts").distinct(), "ts", "left_semi")


def ffill(panel: DataFrame, *keys: str) -> DataFrame:
    return panel.withColumn("value", F.last("value", ignorenulls=True).over(running(*keys)))


def bounds() -> tuple[Column, Column]:
    """First and last date with a value, of each asset."""
    own = Window.partitionBy("asset")
    seen = F.when(F.col("value").isNotNull(), F.col("ts"))
    return F.min(seen).over(own), F.max(seen).over(own)


def ffill_between(panel: DataFrame) -> DataFrame:
    """Forward fill from the first to the last observation only."""
    first, last = bounds()
    filled = F.last("value", ignorenulls=True).over(running())
    return panel.withColumns({"_f": first, "_l": last, "_v": filled}).withColumn("value", F.when(F.col("ts").between(F.col("_f"), F.col("_l")), F.col("_v"))).drop("_f", "_l", "_v")


def ffill_not_positive(panel: DataFrame) -> DataFrame:
    return ffill(panel.withColumn("value", F.when(F.col("value") > 0, F.col("value"))))


def fill_leading_with_median(panel: DataFrame, zeros_too: bool = False) -> DataFrame:
    """Missing values before an asset's first one become the date's median over assets."""
    value = F.when(F.col("value") != 0, F.col("value")) if zeros_too else F.col("value")
    panel = panel.withColumn("value", value)
    medians = panel.groupBy("ts").agg(F.median("value").alias("_median"))
    first, _ = bounds()
    out = panel.withColumn("_first", first).join(medians, "ts")
    return out.withColumn("value", F.when(F.col("_first").isNull() | (F.col("ts") < F.col("_first")), F.coalesce("value", "_median")).otherwise(F.col("value"))).drop("_first", "_median")


def first_last(panel: DataFrame) -> DataFrame:
    """asset, first_ts, first_value, last_ts, last_value over observed rows."""
    seen = panel.filter("value is not null")
    return seen.groupBy("asset").agg(F.min("ts").alias("first_ts"), F.min_by("value", "ts").alias("first_value"), F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"))


def drop_before_first(panel: DataFrame, oldest: bool = True) -> DataFrame:
    """Rows from the earliest (or the latest) first observation of all assets on."""
    pick = F.min if oldest else F.max
    start = first_last(panel).agg(pick("first_ts").alias("_start"))
    return panel.crossJoin(F.broadcast(start)).filter("ts >= _start").drop("_start")


def missing_ratio(panel: DataFrame, zero_cutoff: float = 1e-12) -> DataFrame:
    """Share of rows that are missing or zero, after the first observation."""
    first, _ = bounds()
    bad = F.col("value").isNull() | (F.abs("value") < zero_cutoff)
    return panel.withColumn("_first", first).filter("ts >= _first").groupBy("asset").agg(F.avg(bad.cast("double")).alias("missing_ratio"))


def indicator(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.col("value").isNotNull().cast("double"))


def joint_indicator(*panels: DataFrame) -> DataFrame:
    """1 where all panels have a value."""
    every = reduce(DataFrame.unionByName, [p.select("ts", "asset", F.col("value").isNotNull().cast("double").alias("value")) for p in panels])
    return every.groupBy("ts", "asset").agg((F.sum("value") == len(panels)).cast("double").alias("value"))


def duplicates(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ts", "asset").agg(F.count("*").alias("n")).filter("n > 1")


def append_series(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Both, newer rows winning on equal (ts, asset)."""
    return newer.unionByName(older.join(newer.select("ts", "asset"), ["ts", "asset"], "left_anti"))


def overlap_difference(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Largest difference on shared rows, for checks before appending."""
    return paired(newer, older).groupBy("asset").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"), F.count("*").alias("n_overlap"))


def backfill_prices(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Older prices put before the newer ones of each asset, scaled to meet the first newer price."""
    first = newer.filter("value is not null").groupBy("asset").agg(F.min("ts").alias("_first"), F.min_by("value", "ts").alias("_new"))
    joined = older.join(first, "asset").filter("ts <= _first and value is not null")
    anchor = joined.groupBy("asset").agg(F.max_by("value", "ts").alias("_old"))
    back = joined.join(anchor, "asset").filter("ts < _first").select("ts", "asset", (F.col("value") * F.try_divide(F.col("_new"), F.col("_old"))).alias("value"))
    return newer.unionByName(back)


def last_score(panel: DataFrame) -> DataFrame:
    """Share of an asset's values below its last one."""
    own = Window.partitionBy("asset")
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).over(own)
    return panel.withColumn("_last", last).groupBy("asset").agg(F.avg(F.when(F.col("value").isNotNull(), (F.col("value") < F.col("_last")).cast("double"))).alias("score"))


def trimmed_norm(panel: DataFrame, cut: float = 0.0, zero_mean: bool = False) -> DataFrame:
    """(value - mean over assets between the cut quantiles) / standard deviation, by date."""
    q = panel.groupBy("ts").agg(F.percentile("value", F.lit(cut)).alias("_lo"), F.percentile("value", F.lit(1 - cut)).alias("_hi"), F.stddev_samp("value").alias("_std"))
    mean = panel.join(q, "ts").filter(F.col("value").between(F.col("_lo"), F.col("_hi"))).groupBy("ts").agg(F.avg("value").alias("_mean"))
    out = panel.join(q, "ts").join(mean, "ts", "left")
    centre = F.lit(0.0) if zero_mean else F.col("_mean")
    return out.withColumn("value", F.try_divide(F.col("value") - centre, F.col("_std"))).drop("_lo", "_hi", "_std", "_mean")


def warmup_to_null(panel: DataFrame, periods: int) -> DataFrame:
    """The first observed values of each asset become NULL."""
    n = F.count("value").over(running())
    return panel.withColumn("value", F.when(n > periods, F.col("value")))


def shift(panel: DataFrame, n: int) -> DataFrame:
    return panel.withColumn("value", F.lag("value", n).over(over_asset()) if n >= 0 else F.lead("value", -n).over(over_asset()))


def signed_pairs(observations: DataFrame, signal: DataFrame) -> DataFrame:
    """Observations next to signals, with the sign of the signal as hue."""
    hue = F.when(F.col("signal") > 0, F.lit("positive")).when(F.col("signal") < 0, F.lit("negative")).otherwise(F.lit("zero"))
    return paired(signal, observations, ("signal", "observation")).withColumn("hue", hue)
