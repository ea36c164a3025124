"""A seeded synthetic market: factor-driven prices with data defects, made in Spark by asset."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUIRKS = ("clean", "gaps", "late_start", "fat_tails", "stale", "delisted", "smoothed", "monthly")


@dataclass(frozen=True)
class Instrument:
    ticker: str
    group: str
    vol: float
    drift: float
    beta: float
    quirk: str = "clean"


UNIVERSE = [
    Instrument("EQ_A", "Equities", 0.16, 0.07, 1.0), Instrument("EQ_B", "Equities", 0.2, 0.08, 1.1, "gaps"), Instrument("EQ_C", "Equities", 0.25, 0.06, 1.2, "late_start"),
    Instrument("BD_A", "Bonds", 0.05, 0.03, -0.1), Instrument("BD_B", "Bonds", 0.07, 0.04, 0.2, "fat_tails"), Instrument("CM_A", "Commodities", 0.18, 0.03, 0.3, "stale"),
    Instrument("CM_B", "Commodities", 0.22, 0.02, 0.4, "delisted"), Instrument("AL_A", "Alternatives", 0.08, 0.05, 0.5, "smoothed"), Instrument("AL_B", "Alternatives", 0.1, 0.06, 0.4, "monthly"),
]


def groups(spark: SparkSession, universe: list[Instrument] | None = None) -> DataFrame:
    return spark.createDataFrame([(i.ticker, i.group) for i in universe or UNIVERSE], "asset string, grp string")


def prices(spark: SparkSession, universe: list[Instrument] | None = None, start: str = "2005-01-03", end: str = "2015-12-31", seed: int = 7, quirks: bool = True) -> DataFrame:
    """ts, asset, value on business days. Every asset has a seed of its own; the market factor is shared."""
    universe = universe or UNIVERSE
    specs = {i.ticker: (n, i) for n, i in enumerate(universe)}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, spec = specs[g["asset"].iloc[0]]
        dates = pd.bdate_range(start, end)
        market = np.random.default_rng(seed).standard_normal(len(dates))
        rng = np.random.default_rng(seed * 1000 + n + 1)
        own = rng.standard_t(4, len(dates)) / np.sqrt(2) if quirks and spec.quirk == "fat_tails" else rng.standard_normal(len(dates))
        share = min(abs(spec.beta) * 0.16 / spec.vol, 0.95)
        shock = np.sign(spec.beta) * share * market + np.sqrt(1 - share**2) * own
        r = spec.drift / 252 + spec.vol / np.sqrt(252) * shock
        if quirks and spec.quirk == "smoothed":
            for t in range(1, len(r)):
                r[t] = 0.35 * r[t - 1] + 0.65 * r[t]
        p = 100 * np.cumprod(1 + r)
        if quirks:
            if spec.quirk == "gaps":
                p[rng.random(len(p)) < 0.015] = np.nan
            elif spec.quirk == "late_start":
                p[: len(p) // 4] = np.nan
            elif spec.quirk == "stale":
                for t in np.flatnonzero(rng.random(len(p)) < 0.12):
                    p[t] = p[t - 1] if t else p[t]
            elif spec.quirk == "delisted":
                p[int(len(p) * 0.9) :] = np.nan
            elif spec.quirk == "monthly":
                last = pd.Series(dates).dt.to_period("M").duplicated(keep="last").to_numpy()
                p[last] = np.nan
        return pd.DataFrame({"ts": dates.date, "asset": spec.ticker, "value": p})

    names = spark.createDataFrame([(i.ticker,) for i in universe], "asset string")
    out = names.groupBy("asset").applyInPandas(run, "ts date, asset string, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def benchmark(panel: DataFrame, weights: dict[str, float], name: str = "benchmark") -> DataFrame:
    """A daily rebalanced mix of assets."""
    from strandline.operators.returns import nav, to_returns

    share = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(w))))
    r = to_returns(panel.filter(F.col("asset").isin(*weights)), zero_first=True)
    total = r.groupBy("ts").agg(F.sum(F.col("value") * share[F.col("asset")]).alias("value"))
    return nav(total.select("ts", F.lit(name).alias("asset"), "value"), init_value=100.0)
