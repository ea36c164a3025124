"""Frequencies: periods a year, spacing tiers, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expressions import over_asset

#: Periods a year by alias; business days count 252.
PERIODS = {"B": 252.0, "C": 252.0, "D": 365.0, "W": 52.0, "M": 12.0, "ME": 12.0, "MS": 12.0, "BM": 12.0, "BME": 12.0, "BMS": 12.0, "Q": 4.0, "QE": 4.0, "QS": 4.0, "BQ": 4.0, "BQE": 4.0, "SE": 2.0, "Y": 1.0, "YE": 1.0, "YS": 1.0, "A": 1.0, "BYE": 1.0, "h": 8760.0, "H": 8760.0}
#: Largest median spacing in days, periods a year, label.
TIERS = [(1.5, 260.0, "daily"), (8.0, 52.0, "weekly"), (32.0, 12.0, "monthly"), (93.0, 4.0, "quarterly"), (float("inf"), 1.0, "annual")]


def annualisation_factor(freq: str, calendar_days: bool = False, trading_days: float = 252.0) -> float:
    """Periods a year of an alias such as B, W-WED, ME, 2QE, M-FRI; a leading number divides."""
    found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-\w+)?", freq)
    if not found or found[2] not in PERIODS:
        raise ValueError(f"unknown frequency {freq!r}")
    periods = PERIODS[found[2]]
    if found[2] in ("B", "C"):
        periods = 365.0 if calendar_days else trading_days
    return periods / int(found[1] or 1)


def conversion_factor(freq: str, to: str) -> float:
    return annualisation_factor(freq) / annualisation_factor(to)


def tier(spacing: Column, what: int = 1) -> Column:
    """Periods a year (1) or label (2) of a median spacing in days."""
    out = F.lit(TIERS[-1][what])
    for bound in reversed(TIERS[:-1]):
        out = F.when(spacing <= bound[0], F.lit(bound[what])).otherwise(out)
    return F.when(spacing.isNotNull(), out)


def spacing_tiers(panel: DataFrame) -> DataFrame:
    """asset, spacing, periods_per_year, label by the median days between observations."""
    gaps = panel.filter("value is not null").withColumn("gap", F.datediff("ts", F.lag("ts").over(over_asset())))
    out = gaps.groupBy("asset").agg(F.median("gap").alias("spacing"))
    return out.select("asset", "spacing", tier(F.col("spacing")).alias("periods_per_year"), tier(F.col("spacing"), 2).alias("label"))
