"""Portfolios: backtests (parallel over portfolios), exposures, turnover, costs, attribution."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions.kernels import average_cost, held_units
from strandline.operators.calendars import asof_backward, rebalance_flags
from strandline.operators.ewm import cross_xy
from strandline.operators.panel import nan_to_null
from strandline.operators.returns import nav, to_returns, total_return

LEDGER = "portfolio string, ts date, asset string, price double, weight double, units double, cost double, nav double, cash double, is_rebalancing boolean"


def by_date() -> WindowSpec:
    return Window.partitionBy("portfolio", "ts")


def by_asset() -> WindowSpec:
    return Window.partitionBy("portfolio", "asset").orderBy("ts")


@dataclass(frozen=True)
class Costs:
    """Rates a year (funding, fee, carry) and a share of traded value (trading)."""

    funding: float = 0.0
    fee: float = 0.0
    carry: float = 0.0
    trading: float = 0.0


def placed_weights(prices: DataFrame, weights: DataFrame, lag: int = 0) -> DataFrame:
    """Weights (portfolio, ts, asset, value) on the price dates at or after their own, `lag` observations later."""
    order = Window.orderBy("ts")
    grid = prices.select("ts").distinct().withColumn("n", F.row_number().over(order))
    marks = weights.select("ts").distinct().withColumn("traded", F.lit(None).cast("int"))
    both = grid.select("ts", F.col("n").alias("traded")).unionByName(marks)
    found = both.withColumn("at", F.first("traded", ignorenulls=True).over(Window.orderBy("ts", F.col("traded").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)))
    snap = found.select("ts", (F.col("at") + lag).alias("n")).groupBy("ts").agg(F.max("n").alias("n"))
    on = weights.join(snap, "ts").join(grid.withColumnRenamed("ts", "traded_ts"), "n")
    return on.select("portfolio", F.col("traded_ts").alias("ts"), "asset", "value")


def colliding_weights(placed: DataFrame) -> DataFrame:
    """Two sets of weights on one traded date: an error in the inputs, so this should be empty."""
    return placed.groupBy("portfolio", "ts", "asset").agg(F.count("*").alias("n")).filter("n > 1")


def backtest(prices: DataFrame, weights: DataFrame, costs: Costs | None = None, nav0: float = 100.0, lag: int = 0) -> DataFrame:
    """The ledger of held units. weights: portfolio, ts, asset, value; a portfolio rebalances on its weights' dates."""
    c = costs or Costs()
    placed = placed_weights(prices, weights, lag)
    start = placed.groupBy("portfolio").agg(F.min("ts").alias("_start"))
    used = placed.select("portfolio", "asset").distinct().join(start, "portfolio")
    rows = prices.withColumnRenamed("value", "price").join(used, "asset").filter("ts >= _start").drop("_start")
    rows = rows.join(placed.withColumnRenamed("value", "w"), ["portfolio", "ts", "asset"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = g["portfolio"].iloc[0]
        p = g.pivot(index="ts", columns="asset", values="price").sort_index().ffill()
        w = g.pivot(index="ts", columns="asset", values="w").reindex(index=p.index, columns=p.columns)
        flags = w.notna().any(axis=1).to_numpy()
        days = np.concatenate([[0.0], np.diff(pd.DatetimeIndex(p.index).to_numpy()).astype("timedelta64[D]").astype(float)]) / 365.0
        t, n = p.shape
        out = held_units(p.to_numpy(float), w.fillna(0.0).to_numpy(float), flags, c.funding * days, c.fee * days, np.full((t, n), c.carry) * days[:, None], np.full((t, n), c.trading), nav0)
        return pd.DataFrame({
            "portfolio": name, "ts": np.repeat(p.index.to_numpy(), n), "asset": np.tile(p.columns.to_numpy(), t), "price": p.to_numpy().reshape(-1), "weight": out["weights"].reshape(-1), "units": out["units"].reshape(-1),
            "cost": out["costs"].reshape(-1), "nav": np.repeat(out["nav"], n), "cash": np.repeat(out["cash"], n), "is_rebalancing": np.repeat(flags, n),
        })

    return nan_to_null(rows.groupBy("portfolio").applyInPandas(run, LEDGER), "price")


def backtest_fixed(prices: DataFrame, weights: DataFrame, freq: str, costs: Costs | None = None, nav0: float = 100.0) -> DataFrame:
    """Fixed weights (portfolio, asset, weight) put on again at a frequency."""
    dates = rebalance_flags(prices, freq).filter("flag").select("ts")
    return backtest(prices, dates.crossJoin(weights).select("portfolio", "ts", "asset", F.col("weight").alias("value")), costs, nav0)


def portfolio_nav(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("portfolio", "ts").agg(F.first("nav").alias("value")).select("ts", F.col("portfolio").alias("asset"), "value")


def instrument_pnl(ledger: DataFrame, net: bool = False) -> DataFrame:
    """Return contribution of each instrument: yesterday's weight times today's return, less cost over NAV."""
    r = F.try_divide(F.col("price"), F.lag("price").over(by_asset())) - 1
    pnl = F.coalesce(F.lag("weight").over(by_asset()) * r, F.lit(0.0))
    cost = F.col("cost") / F.col("nav") if net else F.lit(0.0)
    return ledger.select("portfolio", "ts", "asset", (pnl - cost).alias("value"))


def attribution(ledger: DataFrame, total: str = "Total") -> DataFrame:
    """Summed contributions of instruments and of the portfolio, in one set of groupings."""
    out = instrument_pnl(ledger).rollup("portfolio", "asset").agg(F.sum("value").alias("value"), F.grouping("portfolio").alias("_p"), F.grouping("asset").alias("_a"))
    return out.filter("_p = 0").select("portfolio", F.when(F.col("_a") == 1, F.lit(total)).otherwise(F.col("asset")).alias("asset"), "value")


def attribution_tails(rows: DataFrame, most: int) -> DataFrame:
    """The extremes of (asset, value), one row an asset, and everything between as one row. With one sign only: the largest by size."""
    sides = rows.agg((F.min("value") >= 0).alias("_pos"), (F.max("value") <= 0).alias("_neg"))
    n_up = most // 2
    high, low = [F.col("value").desc(), F.col("asset")], [F.col("value"), F.col("asset").desc()]
    # Only as many rows as asked for are ever ordered on one task; the rest is aggregated where it lies.
    top = rows.orderBy(*high).limit(most).withColumn("_u", F.row_number().over(Window.orderBy(*high))).select("asset", "_u")
    bottom = rows.orderBy(*low).limit(most).withColumn("_d", F.row_number().over(Window.orderBy(*low))).select("asset", "_d")
    ranked = rows.join(top, "asset", "left").join(bottom, "asset", "left").crossJoin(F.broadcast(sides))
    keep = F.when(F.col("_pos"), F.col("_u") <= most).when(F.col("_neg"), F.col("_d") <= most).otherwise((F.col("_u") <= n_up) | (F.col("_d") <= most - n_up))
    return ranked.groupBy(F.when(keep, F.col("asset")).otherwise(F.lit("Other")).alias("asset")).agg(F.sum("value").alias("value"))


def cumulative_attribution(ledger: DataFrame) -> DataFrame:
    return instrument_pnl(ledger).withColumn("value", F.sum("value").over(by_asset().rowsBetween(Window.unboundedPreceding, 0)))


def instrument_navs(ledger: DataFrame, constant_trade_level: bool = False) -> DataFrame:
    w = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    path = 1 + F.sum("value").over(w) if constant_trade_level else F.product(1 + F.col("value")).over(w)
    return instrument_pnl(ledger).withColumn("value", path)


def group_navs(ledger: DataFrame, groups: DataFrame, total: str = "Total") -> DataFrame:
    """NAVs of groups and of everything, from summed contributions."""
    own = instrument_pnl(ledger).join(groups, "asset").rollup("portfolio", "ts", "grp").agg(F.sum("value").alias("value"), F.grouping("ts").alias("_t"), F.grouping("grp").alias("_g"))
    own = own.filter("_t = 0").select("portfolio", "ts", F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col("grp")).alias("asset"), "value")
    return own.withColumn("value", F.product(1 + F.col("value")).over(by_asset().rowsBetween(Window.unboundedPreceding, 0)))


def exposures(ledger: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """net, long, short and gross weights by date (and group)."""
    out = ledger if groups is None else ledger.join(groups, "asset")
    w = F.col("weight")
    keys = ["portfolio", "ts", *([] if groups is None else ["grp"])]
    return out.groupBy(*keys).agg(F.sum(w).alias("net"), F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0.0)).alias("long"), F.coalesce(F.sum(F.when(w < 0, w)), F.lit(0.0)).alias("short"), F.sum(F.abs(w)).alias("gross"))


def turnover(ledger: DataFrame, roll: int | None = None, units: bool = True) -> DataFrame:
    """|units traded| price over gross exposure (or |change of weight|), by portfolio and date; optionally summed over the last rows."""
    traded = F.abs(F.col("units") - F.coalesce(F.lag("units").over(by_asset()), F.lit(0.0))) * F.col("price")
    each = F.try_divide(traded, F.sum(F.abs(F.col("units") * F.col("price"))).over(by_date())) if units else F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by_asset()), F.lit(0.0)))
    out = ledger.withColumn("_t", each).groupBy("portfolio", "ts").agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("value"))
    return _rolled(out, roll)


def costs(ledger: DataFrame, roll: int | None = None) -> DataFrame:
    """Costs over NAV by portfolio and date."""
    return _rolled(ledger.groupBy("portfolio", "ts").agg((F.sum("cost") / F.first("nav")).alias("value")), roll)


def _rolled(out: DataFrame, roll: int | None) -> DataFrame:
    if not roll:
        return out
    w = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(1 - roll, 0)
    return out.withColumn("value", F.when(F.count("value").over(w) == roll, F.sum("value").over(w)))


def investable(ledger: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    return ledger.groupBy("portfolio", "ts").agg(F.count("price").alias("priced"), F.count(F.when(F.abs("weight") > tolerance, 1)).alias("held"))


def instrument_table(ledger: DataFrame) -> DataFrame:
    """Mean weight, total return and their product for each instrument."""
    ends = ledger.filter("price is not null").groupBy("portfolio", "asset").agg(F.avg("weight").alias("mean_weight"), (F.try_divide(F.max_by("price", "ts"), F.min_by("price", "ts")) - 1).alias("total_return"))
    return ends.withColumn("contribution", F.col("mean_weight") * F.col("total_return"))


def pnl_risk_attribution(ledger: DataFrame) -> DataFrame:
    """Share of each instrument's deviation of non-zero contributions."""
    out = instrument_pnl(ledger).groupBy("portfolio", "asset").agg(F.stddev_pop(F.when(F.col("value") != 0, F.col("value"))).alias("std"))
    return out.withColumn("share", F.try_divide(F.col("std"), F.sum("std").over(Window.partitionBy("portfolio"))))


def participation(ledger: DataFrame, sizes: DataFrame, level: float, traded: bool = False) -> DataFrame:
    """Exposure (or trades) at a trade level over market capitalisation (or volume): sizes: ts, asset, value."""
    x = F.abs(F.col("units") - F.coalesce(F.lag("units").over(by_asset()), F.lit(0.0))) * F.col("price") / F.col("nav") if traded else F.abs(F.col("weight"))
    own = ledger.withColumn("_x", x)
    return own.join(sizes.withColumnRenamed("value", "_size"), ["ts", "asset"]).select("portfolio", "ts", "asset", F.try_divide(F.col("_x") * level, F.col("_size")).alias("value"))


def realised_pnl(ledger: DataFrame) -> DataFrame:
    """Average cost, realised and mark-to-market profit of each position."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        avg, real, mtm = average_cost(g["price"].to_numpy(float), g["units"].to_numpy(float))
        return g.assign(avg_cost=avg, realised=real, mtm=mtm)[["portfolio", "ts", "asset", "avg_cost", "realised", "mtm"]]

    return ledger.select("portfolio", "ts", "asset", "price", "units").groupBy("portfolio", "asset").applyInPandas(run, "portfolio string, ts date, asset string, avg_cost double, realised double, mtm double")


def distribution_yield(ledger: DataFrame, dividends: DataFrame, roll: int = 12) -> DataFrame:
    """Dividends per unit times units over NAV, by month, and the sum over the last months."""
    paid = ledger.join(dividends.withColumnRenamed("value", "_d"), ["ts", "asset"]).withColumn("value", F.col("_d") * F.col("units") / F.col("nav"))
    m = paid.groupBy("portfolio", F.last_day("ts").alias("ts")).agg(F.sum("value").alias("value"))
    w = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(1 - roll, 0)
    return m.withColumn("rolling", F.sum("value").over(w))


def benchmark_betas(ledger: DataFrame, benchmark: DataFrame, span: float) -> DataFrame:
    """portfolio, ts, value: sum of weights times EWM betas to one benchmark."""
    px = ledger.select("ts", "asset", F.col("price").alias("value")).distinct()
    x = to_returns(benchmark).select("ts", F.col("value").alias("x"))
    y = to_returns(px).select("ts", "asset", F.col("value").alias("y"))
    beta = cross_xy(y.join(x, "ts").filter("x is not null and y is not null"), span).withColumnRenamed("value", "_b")
    return ledger.join(beta, ["ts", "asset"]).groupBy("portfolio", "ts").agg(F.sum(F.col("weight") * F.col("_b")).alias("value"))


def beta_attribution(portfolio_returns: DataFrame, benchmark_returns: DataFrame, betas: DataFrame) -> DataFrame:
    """portfolio, ts, explained (yesterday's beta times the benchmark) and residual. betas: portfolio, ts, value."""
    w = Window.partitionBy("portfolio").orderBy("ts")
    b = betas.withColumn("b", F.lag("value").over(w)).select("portfolio", "ts", "b")
    r = portfolio_returns.select(F.col("asset").alias("portfolio"), "ts", F.col("value").alias("r"))
    x = benchmark_returns.select("ts", F.col("value").alias("x"))
    out = r.join(b, ["portfolio", "ts"]).join(x, "ts").withColumn("explained", F.col("b") * F.col("x"))
    return out.select("portfolio", "ts", "explained", (F.col("r") - F.col("explained")).alias("residual"))


def nav_panel(ledger: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """NAVs of all portfolios, with benchmark prices as of their dates."""
    own = portfolio_nav(ledger)
    return own if benchmark is None else own.unionByName(asof_backward(benchmark, own.select("ts").distinct()))


def aligned(a: DataFrame, b: DataFrame, value: str = "weight") -> DataFrame:
    """Two portfolios' values on one grid (ts, asset); absent ones are 0."""
    x, y = a.select("ts", "asset", F.col(value).alias("strategy")), b.select("ts", "asset", F.col(value).alias("benchmark"))
    return x.join(y, ["ts", "asset"], "full").fillna(0.0, ["strategy", "benchmark"])


def tracking_table(strategy: DataFrame, benchmark: DataFrame, af: float) -> DataFrame:
    """Realised tracking error and information ratio of NAV differences: strategy and benchmark as (ts, asset, value) of one series each."""
    a, b = (to_returns(x).select("ts", F.col("value").alias(n)) for x, n in ((strategy, "a"), (benchmark, "b")))
    d = a.join(b, "ts").withColumn("d", F.col("a") - F.col("b")).filter("d is not null")
    return d.agg((F.stddev_samp("d") * af**0.5).alias("te"), F.try_divide(F.avg("d") * af**0.5, F.stddev_samp("d")).alias("ir"), F.count("*").alias("n"))


def brinson(weights: DataFrame, pnl: DataFrame, groups: DataFrame) -> DataFrame:
    """ts, grp, allocation, selection, interaction and active.

    weights, pnl: ts, asset, strategy, benchmark. Group sums; allocation (ws - wb) pnl_b, selection wb (pnl_s - pnl_b), the rest is interaction.
    """
    g = lambda df, p: df.join(groups, "asset").groupBy("ts", "grp").agg(F.sum("strategy").alias(f"{p}s"), F.sum("benchmark").alias(f"{p}b"))
    both = g(weights, "w").join(g(pnl, "p"), ["ts", "grp"])
    out = both.withColumns({"allocation": (F.col("ws") - F.col("wb")) * F.col("pb"), "selection": F.col("wb") * (F.col("ps") - F.col("pb")), "active": F.col("ps") - F.col("pb")})
    return out.select("ts", "grp", "allocation", "selection", (F.col("active") - F.col("allocation") - F.col("selection")).alias("interaction"), "active")


def brinson_totals(table: DataFrame, total: str = "Total") -> DataFrame:
    """Sums over dates by group, and of everything."""
    sums = [F.sum(c).alias(c) for c in ("allocation", "selection", "interaction", "active")]
    return table.rollup("grp").agg(*sums).select(F.coalesce("grp", F.lit(total)).alias("grp"), "allocation", "selection", "interaction", "active")


def overlay_curve(prices: DataFrame, base: str, overlay: str, freq: str, steps: int = 11, top: float = 1.0) -> DataFrame:
    """Portfolios of a base asset plus 0 … top of an overlay, all backtested at once; their returns and volatilities."""
    spark = prices.sparkSession
    rows = [(f"{overlay}:{top * i / (steps - 1):.2f}", a, w) for i in range(steps) for a, w in ((base, 1.0), (overlay, top * i / (steps - 1)))]
    ledger = backtest_fixed(prices, spark.createDataFrame(rows, "portfolio string, asset string, weight double"), freq)
    navs = portfolio_nav(ledger)
    vol = to_returns(navs).groupBy("asset").agg(F.stddev_samp("value").alias("vol"))
    return total_return(navs).select("asset", "total_return", "pa_return").join(vol, "asset")


def additive_nav(pnl: DataFrame) -> DataFrame:
    return nav(pnl, additive=True)
