"""Bootstrap: index tables by sample, gathered by joins, recompounded by windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.kernels import bootstrap_indices

INDEX = "sample_id long, pos int, src_pos int"


def index_table(spark: SparkSession, kind: str, n: int, samples: int, length: int | None = None, block: int = 20, seed: int = 1, least: int = 1) -> DataFrame:
    """sample_id, pos, src_pos; every sample has a seed of its own, so reruns and lost tasks give the same rows."""
    size = length or n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                yield pd.DataFrame({"sample_id": s, "pos": np.arange(size), "src_pos": bootstrap_indices(kind, n, size, block, seed * 1_000_003 + int(s), least)})

    return spark.range(samples).mapInPandas(run, INDEX)


def positions(panel: DataFrame) -> DataFrame:
    """The panel with src_pos: the number of its date, from 0."""
    dates = panel.select("ts").distinct().withColumn("src_pos", F.row_number().over(Window.orderBy("ts")) - 1)
    return panel.join(dates, "ts")


def resample(panel: DataFrame, index: DataFrame) -> DataFrame:
    """sample_id, pos, asset, value: rows of one date stay together."""
    return index.join(positions(panel).select("src_pos", "asset", "value"), "src_pos").select("sample_id", "pos", "asset", "value")


def price_paths(returns: DataFrame, index: DataFrame, log: bool = False, start: float = 1.0) -> DataFrame:
    w = Window.partitionBy("sample_id", "asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = resample(returns, index)
    path = F.exp(F.sum("value").over(w)) if log else F.product(1 + F.col("value")).over(w)
    return r.withColumn("value", start * path)


def together(prices: DataFrame, fundamentals: DataFrame, index: DataFrame) -> DataFrame:
    """Returns compounded and fundamentals picked by one index."""
    a = price_paths(prices, index).withColumnRenamed("value", "price")
    b = resample(fundamentals, index).withColumnRenamed("value", "fundamental")
    return a.join(b, ["sample_id", "pos", "asset"])


def ar1_fit(panel: DataFrame) -> DataFrame:
    """asset, beta, intercept over complete pairs of neighbours."""
    x = F.lag("value").over(Window.partitionBy("asset").orderBy("ts"))
    return panel.withColumn("x", x).groupBy("asset").agg(F.regr_slope("value", "x").alias("beta"), F.regr_intercept("value", "x").alias("intercept"))


def ar1_residuals(panel: DataFrame) -> DataFrame:
    x = F.lag("value").over(Window.partitionBy("asset").orderBy("ts"))
    out = panel.withColumn("x", x).filter("x is not null and value is not null").join(ar1_fit(panel), "asset")
    return out.select("ts", "asset", (F.col("value") - F.col("intercept") - F.col("beta") * F.col("x")).alias("value"))


def ar1_paths(panel: DataFrame, index: DataFrame, positive: bool = False) -> DataFrame:
    """AR(1) paths of resampled residuals, from each asset's first value."""
    fit = ar1_fit(panel).join(panel.groupBy("asset").agg(F.min_by("value", "ts").alias("first")), "asset")
    draws = resample(ar1_residuals(panel), index).join(fit, "asset")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        out, x = np.empty(len(g)), float(g["first"].iloc[0])
        b, a = float(g["beta"].iloc[0]), float(g["intercept"].iloc[0])
        for i, e in enumerate(g["value"].to_numpy(float)):
            out[i] = x
            x = a + b * x + e
            x = max(x, 1e-8) if positive else x
        return g.assign(value=out)[["sample_id", "pos", "asset", "value"]]

    return draws.groupBy("sample_id", "asset").applyInPandas(run, "sample_id long, pos int, asset string, value double")
