"""Currencies: spots are units of the base per unit of a currency, rates are annual decimals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import clip, over_asset
from strandline.operators.calendars import asof_backward
from strandline.operators.ewm import cross_xy, ewm_vol
from strandline.operators.returns import nav, to_returns


@dataclass(frozen=True)
class FxRates:
    """spots and rates, long: ts, asset (the currency), value."""

    spots: DataFrame
    rates: DataFrame

    def cross(self, local: str, reference: str) -> DataFrame:
        """Units of reference for one unit of local."""
        a = self.spots.filter(F.col("asset") == local).select("ts", F.col("value").alias("a"))
        b = self.spots.filter(F.col("asset") == reference).select("ts", F.col("value").alias("b"))
        return a.join(b, "ts").select("ts", F.lit(local + reference).alias("asset"), F.try_divide(F.col("a"), F.col("b")).alias("value"))

    def rate(self, currency: str) -> DataFrame:
        return self.rates.filter(F.col("asset") == currency)

    def forward_premium(self, local: str, reference: str, dt: float) -> DataFrame:
        """(1 + dt r_local) / (1 + dt r_reference) - 1."""
        a = self.rate(local).select("ts", F.col("value").alias("a"))
        b = self.rate(reference).select("ts", F.col("value").alias("b"))
        return a.join(b, "ts").select("ts", F.lit(local + reference).alias("asset"), ((1 + dt * F.col("a")) / (1 + dt * F.col("b")) - 1).alias("value"))

    def total_return(self, local: str, reference: str, dt: float) -> DataFrame:
        """NAV of spot moves and the carry of the period before."""
        spot = to_returns(self.cross(local, reference), zero_first=True).select("ts", "asset", F.col("value").alias("s"))
        carry = self.forward_premium(local, reference, dt).select("ts", F.col("value").alias("c"))
        both = spot.join(carry, "ts").withColumn("value", F.col("s") + F.coalesce(F.lag("c").over(over_asset()), F.lit(0.0)))
        return nav(both.select("ts", "asset", "value"))

    def cash_nav(self, currency: str) -> DataFrame:
        """Compounded short rate, lagged one period; the first return is 0."""
        w = over_asset()
        dt = F.datediff("ts", F.lag("ts").over(w)) / 365.0
        r = self.rate(currency).withColumn("value", F.coalesce(F.lag("value").over(w) * dt, F.lit(0.0)))
        return nav(r)

    def cash_in(self, local: str, reference: str) -> DataFrame:
        """Local cash in units of the reference."""
        c = self.cash_nav(local).select("ts", F.col("value").alias("n"))
        return self.cross(local, reference).join(c, "ts").select("ts", "asset", (F.col("value") * F.col("n")).alias("value"))

    def carry_nav(self, local: str, reference: str, dt: float, causal: bool = True) -> DataFrame:
        """NAV of the carry, scaled to the spot's volatility by moments seen so far (or of the whole sample)."""
        spot = to_returns(self.cross(local, reference)).select("ts", "asset", F.col("value").alias("s"))
        both = spot.join(self.forward_premium(local, reference, dt).select("ts", F.col("value").alias("c")), "ts")
        w = over_asset().rowsBetween(Window.unboundedPreceding, 0) if causal else Window.partitionBy("asset")
        scale = F.try_divide(F.stddev_samp("s").over(w), F.stddev_samp("c").over(w))
        return nav(both.select("ts", "asset", F.coalesce(F.col("c") * scale, F.lit(0.0)).alias("value")))

    def in_reference(self, prices: DataFrame, currencies: DataFrame, reference: str) -> DataFrame:
        """Prices of assets (currencies: asset, ccy) in the reference, by the spots as of each date."""
        dates = prices.select("ts").distinct()
        spots = asof_backward(self.spots, dates)
        base = spots.filter(F.col("asset") == reference).select("ts", F.col("value").alias("b"))
        local = spots.select("ts", F.col("asset").alias("ccy"), F.col("value").alias("a"))
        out = prices.join(currencies, "asset").join(local, ["ts", "ccy"]).join(base, "ts")
        return out.select("ts", "asset", (F.col("value") * F.try_divide(F.col("a"), F.col("b"))).alias("value"))


def hedged_return(local: Column, fx: Column, forward_before: Column, hedge_before: Column | float) -> Column:
    """r (1 + fx) + (1 - h) fx - h fwd, hedge and forward of yesterday."""
    h = hedge_before if isinstance(hedge_before, Column) else F.lit(float(hedge_before))
    return local * (1 + fx) + (1 - h) * fx - h * forward_before


def hedged_performance(asset: DataFrame, fx: DataFrame, forward: DataFrame, hedge: float = 1.0) -> DataFrame:
    """ts, asset, local, fx, value (hedged return), nav of one asset in the reference currency."""
    a = to_returns(asset).select("ts", "asset", F.col("value").alias("local"))
    f = to_returns(fx).select("ts", F.col("value").alias("fx"))
    p = forward.select("ts", F.col("value").alias("fwd"))
    both = a.join(f, "ts").join(p, "ts").withColumn("fwd", F.lag("fwd").over(over_asset()))
    out = both.withColumn("value", hedged_return(F.col("local"), F.col("fx"), F.col("fwd"), hedge))
    w = over_asset().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("nav", F.product(1 + F.coalesce("value", F.lit(0.0))).over(w)).select("ts", "asset", "local", "fx", "value", "nav")


def futures_returns(prices: DataFrame, spots: DataFrame, n: int = 1) -> DataFrame:
    """r_local (1 + r_fx): spots by asset."""
    w = over_asset()
    both = prices.join(spots.withColumnRenamed("value", "s"), ["ts", "asset"])
    r, x = (F.try_divide(F.col(c), F.lag(c, n).over(w)) - 1 for c in ("value", "s"))
    return both.withColumn("value", r * (1 + x)).drop("s")


def cash_returns(prices: DataFrame, spots: DataFrame, n: int = 1) -> DataFrame:
    """(1 + r)(1 + fx) - 1."""
    w = over_asset()
    both = prices.join(spots.withColumnRenamed("value", "s"), ["ts", "asset"])
    return both.withColumn("value", F.try_divide(F.col("value") * F.col("s"), F.lag(F.col("value") * F.col("s"), n).over(w)) - 1).drop("s")


def vol_and_beta(asset: DataFrame, fx: DataFrame, span: float, af: float) -> DataFrame:
    """ts, fx_vol, beta of the asset on the currency."""
    x = to_returns(fx).select("ts", F.col("value").alias("x"))
    y = to_returns(asset).select("ts", "asset", F.col("value").alias("y"))
    b = cross_xy(y.join(x, "ts").filter("x is not null and y is not null"), span).select("ts", F.col("value").alias("beta"))
    v = ewm_vol(to_returns(fx), span, af=af).select("ts", F.col("value").alias("fx_vol"))
    return v.join(b, "ts")


def optimal_hedge(estimates: DataFrame, carry: DataFrame, risk_aversion: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """ts, optimal = 1 - carry / (2 a vol^2) + beta, max_carry, beta_hedge, each clipped. carry: ts, value (annual)."""
    both = estimates.join(carry.select("ts", F.col("value").alias("c")), "ts")
    tilt = F.try_divide(F.col("c"), 2 * risk_aversion * F.col("fx_vol") * F.col("fx_vol"))
    return both.select("ts", clip(1 - tilt + F.col("beta"), low, high).alias("optimal"), clip(1 - tilt, low, high).alias("max_carry"), clip(1 + F.col("beta"), low, high).alias("beta_hedge"))
