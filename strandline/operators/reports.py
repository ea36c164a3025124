"""Factsheets: the tables of a report as one set of queries that share their resampled panels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.annualisation import annualisation_factor, spacing_tiers
from strandline.operators import correlation, figures, performance, portfolio, regimes, risk, rolling
from strandline.operators.calendars import TimePeriod, resample_last
from strandline.operators.panel import against
from strandline.operators.returns import to_returns, total_return

#: Reporting frequency -> frequency of volatility, of regressions, of regimes, rolling periods, EWM span.
GRIDS = {"daily": ("W-FRI", "ME", "ME", 52, 52), "weekly": ("W-FRI", "ME", "QE", 52, 52), "monthly": ("ME", "QE", "QE", 12, 24), "quarterly": ("QE", "QE", "QE", 4, 8)}


@dataclass(frozen=True)
class Config:
    freq_vol: str = "ME"
    freq_reg: str = "QE"
    freq_regime: str = "QE"
    roll: int = 12
    span: int = 24
    quantiles: tuple[float, ...] = regimes.QUANTILES

    @property
    def af(self) -> float:
        return annualisation_factor(self.freq_vol)


def make_config(reporting: str, long_period: bool = True, **changes: object) -> Config:
    if reporting not in GRIDS:
        raise ValueError(f"unknown reporting frequency {reporting!r}")
    vol, reg, regime, roll, span = GRIDS[reporting]
    return Config(**({"freq_vol": vol, "freq_reg": reg, "freq_regime": regime, "roll": roll if long_period else max(roll // 2, 3), "span": span} | changes))


def too_fine(prices: DataFrame, reporting: str) -> DataFrame:
    """Assets observed more rarely than the reporting frequency: should be empty."""
    order = {"daily": 260.0, "weekly": 52.0, "monthly": 12.0, "quarterly": 4.0}
    return spacing_tiers(prices).filter(F.col("periods_per_year") < order[reporting])


@dataclass
class Report:
    """Named tables; nothing runs until one is used."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, table: DataFrame) -> Report:
        self.tables[name] = table
        return self

    def save(self, path: str, format: str = "parquet") -> None:
        for name, table in self.tables.items():
            table.write.mode("overwrite").format(format).save(f"{path}/{name}")

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def multi_assets(prices: DataFrame, benchmark: DataFrame, config: Config, period: TimePeriod | None = None) -> Report:
    """Performance, drawdowns, rolling statistics, periodic returns, correlations and regimes of a price panel."""
    prices = period.locate(prices) if period else prices
    benchmark = period.locate(benchmark) if period else benchmark
    r = to_returns(resample_last(prices, config.freq_vol)).filter("value is not null")
    b = to_returns(resample_last(benchmark, config.freq_regime)).filter("value is not null")
    rr = to_returns(resample_last(prices, config.freq_regime)).filter("value is not null")
    reg = regimes.quantile_regimes(b, config.quantiles)
    sampled = regimes.in_regimes(rr, reg)
    out = Report()
    out.add("performance", performance.ra_perf_table(prices, config.freq_vol, config.af))
    out.add("benchmark", performance.benchmark_table(prices, benchmark, config.freq_reg, annualisation_factor(config.freq_reg)))
    out.add("drawdowns", performance.drawdown_episodes(prices))
    out.add("under_water", performance.time_under_water(prices))
    out.add("rolling_sharpe", rolling.rolling_sharpes(resample_last(prices, config.freq_vol), config.roll, config.af))
    out.add("rolling_vol", rolling.rolling_vols(resample_last(prices, config.freq_vol), config.roll, config.af))
    out.add("months", performance.periodic_returns(prices))
    out.add("periods", figures.periodic_table(prices, config.freq_reg))
    out.add("correlation", correlation.pairwise(r))
    out.add("regimes", regimes.regime_sharpe(sampled, annualisation_factor(config.freq_regime)))
    out.add("regime_regressions", figures.regime_regressions(rr, b, reg))
    out.add("scatter", figures.scatter(against(rr, b).withColumnRenamed("value", "y"), "asset"))
    out.add("history", figures.price_history(prices))
    return out


def strategy(ledger: DataFrame, groups: DataFrame, benchmark: DataFrame, config: Config, period: TimePeriod | None = None) -> Report:
    """A portfolio's NAV against a benchmark, exposures, turnover, costs and attribution."""
    ledger = period.locate(ledger) if period else ledger
    navs = portfolio.nav_panel(ledger, benchmark)
    out = multi_assets(navs, benchmark, config)
    out.add("exposures", portfolio.exposures(ledger)).add("group_exposures", portfolio.exposures(ledger, groups))
    out.add("turnover", portfolio.turnover(ledger, config.roll)).add("costs", portfolio.costs(ledger, config.roll))
    out.add("attribution", portfolio.attribution(ledger)).add("group_navs", portfolio.group_navs(ledger, groups))
    out.add("instruments", portfolio.instrument_table(ledger)).add("investable", portfolio.investable(ledger))
    out.add("pnl_risk", portfolio.pnl_risk_attribution(ledger))
    return out


def strategy_benchmark(ledgers: DataFrame, a: str, b: str, groups: DataFrame, config: Config) -> Report:
    """Two portfolios: NAVs, active weights, tracking error and Brinson attribution."""
    first, second = (ledgers.filter(F.col("portfolio") == n) for n in (a, b))
    w = portfolio.aligned(first, second)
    pnl = portfolio.aligned(portfolio.instrument_pnl(first), portfolio.instrument_pnl(second), "value")
    table = portfolio.brinson(w, pnl, groups)
    navs = portfolio.portfolio_nav(ledgers)
    x, y = (navs.filter(F.col("asset") == n) for n in (a, b))
    out = Report()
    out.add("performance", performance.ra_perf_table(navs, config.freq_vol, config.af)).add("active_weights", w)
    out.add("brinson", table).add("brinson_totals", portfolio.brinson_totals(table))
    out.add("tracking", portfolio.tracking_table(x, y, config.af)).add("ewm_tracking", risk.realised_tracking_error(x, y, config.span, config.af))
    out.add("turnover", portfolio.turnover(ledgers, config.roll)).add("costs", portfolio.costs(ledgers, config.roll))
    return out


def multi_strategy(ledgers: DataFrame, benchmark: DataFrame, config: Config) -> Report:
    """Several portfolios side by side."""
    out = multi_assets(portfolio.nav_panel(ledgers, benchmark), benchmark, config)
    out.add("exposures", portfolio.exposures(ledgers)).add("turnover", portfolio.turnover(ledgers, config.roll)).add("attribution", portfolio.attribution(ledgers))
    return out


def overlays(prices: DataFrame, principal: str, candidates: list[str], freq: str = "QE", steps: int = 11) -> DataFrame:
    """Curves of every candidate overlay on one principal."""
    out = None
    for c in candidates:
        part = portfolio.overlay_curve(prices, principal, c, freq, steps).withColumn("overlay", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def weight_changes(ledger: DataFrame, rows: int = 1) -> DataFrame:
    """portfolio, asset, before, now, change over the last rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("portfolio", "asset").orderBy("ts")
    last = ledger.groupBy("portfolio").agg(F.max("ts").alias("_last"))
    out = ledger.withColumn("before", F.lag("weight", rows).over(w)).join(last, "portfolio").filter("ts = _last")
    return out.select("portfolio", "asset", "before", F.col("weight").alias("now"), (F.col("weight") - F.coalesce("before", F.lit(0.0))).alias("change"))


def factsheet(data: DataFrame, benchmark: DataFrame, reporting: str = "monthly", period: TimePeriod | None = None, groups: DataFrame | None = None) -> Report:
    """The report that fits the data: prices, one portfolio's ledger, or several."""
    config = make_config(reporting)
    if "portfolio" not in data.columns:
        return multi_assets(data, benchmark, config, period)
    if groups is not None:
        return strategy(data, groups, benchmark, config, period)
    return multi_strategy(period.locate(data) if period else data, benchmark, config)


def draw(table: DataFrame, kind: str, path: str, x: str = "ts", y: str = "value", hue: str | None = "asset", limit: int = 100_000) -> None:
    """A line, bar or scatter figure of a table of at most `limit` rows, on the driver; needs matplotlib."""
    rows = table.select(*[c for c in (x, y, hue) if c]).limit(limit + 1).toPandas().sort_values(x)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows to draw: aggregate them first")
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("figures need matplotlib") from e
    fig, ax = plt.subplots()
    plot: dict[str, Callable] = {"line": ax.plot, "bar": ax.bar, "scatter": ax.scatter}
    for name, part in rows.groupby(hue) if hue else [(y, rows)]:
        plot[kind](part[x], part[y], label=str(name))
    ax.legend()
    fig.savefig(path)
    plt.close(fig)


def total_returns(prices: DataFrame) -> DataFrame:
    return total_return(prices).select("asset", "total_return", "pa_return")
