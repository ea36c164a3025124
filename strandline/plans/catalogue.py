"""All registered queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import expressions as x
from strandline.functions.annualisation import spacing_tiers
from strandline.operators import aggregates as ag
from strandline.operators import bootstrap as bs
from strandline.operators import calendars as cal
from strandline.operators import correlation as co
from strandline.operators import ewm, figures, fx, panel, portfolio, regimes, replay, reports, returns, risk, rolling, signals, unsmoothing, weights
from strandline.operators import performance as pf
from strandline.plans import panels as p
from strandline.plans import sql as s
from strandline.session import shared_dir
from strandline.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Sums of doubles depend on their order, so results are rounded: half away from zero on the scaled double, without negative zero."""
    scale = 10.0**digits
    near = lambda v: F.signum(v) * F.floor(F.least(F.abs(v), F.lit(1e12)) * scale + 0.5).cast("double") / scale + 0.0
    round_ = lambda v: F.when(F.abs(v) < 1e12, near(v)).otherwise(v)
    return df.select(*(round_(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: rounded(f(spark, d))
        if sql:
            SQL[key] = sql
        return f

    return register


def register(key: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    query(sql, key)(f)


# --- panels, returns, resampling -----------------------------------------------------------------------------

register("panel_vwap", p.px, s.q(s.PX, f"SELECT ts, asset, {s.r('value')} AS value FROM px"))
for kind, expr in (("relative", "value / lag(value) OVER w - 1"), ("log", "ln(value) - ln(lag(value) OVER w)"), ("difference", "value - lag(value) OVER w")):
    register(f"returns_{kind}", lambda sp, d, kind=kind: returns.to_returns(p.px(sp, d), kind), s.q(s.PX, f"SELECT ts, asset, {s.r(expr)} AS value FROM px WINDOW w AS (PARTITION BY asset ORDER BY ts)"))
for key, freq in (("month_end", "ME"), ("quarter", "QE"), ("w_fri", "W-FRI"), ("year_end", "YE"), ("half_year", "SE"), ("business_day", "B"), ("last_friday", "M-FRI"), ("third_friday", "Q-3FRI")):
    register(f"resample_{key}", lambda sp, d, freq=freq: cal.resample_last(p.px(sp, d), freq), s.q(s.PX, s.calendar(freq), s.asof("px", "cal", "m"), f"SELECT ts, asset, {s.r('value')} AS value FROM m"))
register("period_label", lambda sp, d: cal.period_label(p.px(sp, d)), s.q(s.PX, "SELECT strftime(min(ts), '%d%b%Y') || ':' || strftime(max(ts), '%d%b%Y') AS label FROM px"))
register("resample_with_tail", lambda sp, d: cal.with_tail(cal.resample_last(p.px(sp, d), "QE"), p.px(sp, d), "avg"), s.q(s.PX, s.calendar("QE"), s.asof("px", "cal", "m"), f"SELECT ts, asset, {s.r('value')} AS value FROM m UNION ALL SELECT (SELECT max(ts) FROM px), asset, {s.r('avg(value)')} FROM px WHERE ts > (SELECT max(ts) FROM m) GROUP BY asset"))
for agg, expr in (("sum", "sum(value)"), ("avg", "avg(value)"), ("last", "arg_max(value, ts)"), ("min", "min(value)"), ("max", "max(value)")):
    register(f"resample_{agg}_month", lambda sp, d, agg=agg: cal.resample_agg(p.px(sp, d), "ME", agg), s.q(s.PX, f"SELECT last_day(ts) AS ts, asset, {s.r(expr)} AS value FROM px GROUP BY 1, 2"))
register("resample_every_n", lambda sp, d: cal.resample_every(p.px(sp, d), 10), s.q(s.PX, "n AS (SELECT *, (row_number() OVER (PARTITION BY asset ORDER BY ts DESC) - 1) // 10 AS b FROM px)", f"SELECT max(ts) AS ts, asset, {s.r('sum(value)')} AS value FROM n GROUP BY asset, b"))
register("resample_at_quarters", lambda sp, d: cal.resample_at(p.px(sp, d), cal.schedule(cal.date_range(p.px(sp, d)), "QE")), s.q(s.PX, s.calendar("QE"), "w AS (SELECT ts AS e, coalesce(lag(ts) OVER (ORDER BY ts), DATE '0001-01-01') AS b FROM cal)", f"SELECT e AS ts, asset, {s.r('sum(value)')} AS value FROM px JOIN w ON px.ts > w.b AND px.ts <= w.e GROUP BY 1, 2"))
register("quarterly_compounded", lambda sp, d: returns.quarterly(p.monthly_returns(sp, d)), s.q(s.PX, s.ME, s.MR, f"SELECT CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ts, asset, {s.r('product(1 + value) - 1')} AS value FROM mr GROUP BY 1, 2"))
register("asof_forward_dates", lambda sp, d: cal.asof_forward(cal.schedule(cal.date_range(p.px(sp, d)), "ME"), p.px(sp, d)), s.q(s.PX, s.calendar("ME"), "SELECT c.ts AS sched, min(px.ts) AS ts FROM cal c JOIN px ON px.ts >= c.ts GROUP BY 1"))
register("rebalance_flags", lambda sp, d: cal.rebalance_flags(p.px(sp, d), "QE"), s.q(s.PX, s.calendar("QE"), "h AS (SELECT c.ts AS sched, min(px.ts) AS ts FROM cal c JOIN px ON px.ts >= c.ts GROUP BY 1)", "SELECT DISTINCT px.ts, px.ts IN (SELECT ts FROM h) AS flag FROM px"))
register("sample_windows", lambda sp, d: cal.sample_windows(cal.schedule(cal.date_range(p.px(sp, d)), "QE")).withColumn("sample", F.col("sample").cast("long")), s.q(s.PX, s.calendar("QE"), "x AS (SELECT lag(ts) OVER (ORDER BY ts) AS start, ts FROM cal)", "SELECT row_number() OVER (ORDER BY ts) AS sample, start, ts AS \"end\" FROM x WHERE start IS NOT NULL"))
register("spacing_tiers", lambda sp, d: spacing_tiers(p.monthly(sp, d)), s.q(s.PX, s.ME, "g AS (SELECT asset, date_diff('day', lag(ts) OVER (PARTITION BY asset ORDER BY ts), ts) AS gap FROM m), n AS (SELECT asset, median(gap)::DOUBLE AS spacing FROM g GROUP BY 1)", "SELECT asset, spacing, CASE WHEN spacing <= 1.5 THEN 260.0 WHEN spacing <= 8 THEN 52.0 WHEN spacing <= 32 THEN 12.0 WHEN spacing <= 93 THEN 4.0 ELSE 1.0 END::DOUBLE AS periods_per_year, CASE WHEN spacing <= 1.5 THEN 'daily' WHEN spacing <= 8 THEN 'weekly' WHEN spacing <= 32 THEN 'monthly' WHEN spacing <= 93 THEN 'quarterly' ELSE 'annual' END AS label FROM n"))
register("unpivot_panel", lambda sp, d: panel.to_long(panel.to_wide(p.monthly(sp, d), ["A", "N", "R"])), s.q(s.PX, s.ME, f"SELECT t.ts, a.asset, {s.r('m.value')} AS value FROM (SELECT DISTINCT ts FROM m) t CROSS JOIN (VALUES ('A'), ('N'), ('R')) a(asset) LEFT JOIN m ON m.ts = t.ts AND m.asset = a.asset"))

# --- alignment, nulls ----------------------------------------------------------------------------------------


def _grid(sp: SparkSession, d: str) -> DataFrame:
    return panel.full_grid(p.px_supp(sp, d))


register("full_grid", _grid, s.q(s.SUPP, s.GRID, f"SELECT ts, asset, {s.r('value')} AS value FROM grid"))
register("first_last_valid", lambda sp, d: panel.first_last(_grid(sp, d)), s.q(s.SUPP, f"SELECT asset, min(ts) AS first_ts, {s.r('arg_min(value, ts)')} AS first_value, max(ts) AS last_ts, {s.r('arg_max(value, ts)')} AS last_value FROM supp GROUP BY asset"))
register("ffill_between", lambda sp, d: panel.ffill_between(_grid(sp, d)), s.q(s.SUPP, s.GRID, "b AS (SELECT asset, min(ts) AS f, max(ts) AS l FROM supp GROUP BY 1)", f"SELECT g.ts, g.asset, CASE WHEN g.ts BETWEEN b.f AND b.l THEN {s.r('last_value(g.value IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.ts)')} END AS value FROM grid g JOIN b ON b.asset = g.asset"))
register("fill_leading_cross_median", lambda sp, d: panel.fill_leading_with_median(_grid(sp, d)), s.q(s.SUPP, s.GRID, "b AS (SELECT asset, min(ts) AS f FROM supp GROUP BY 1), md AS (SELECT ts, median(value) AS md FROM grid GROUP BY 1)", f"SELECT g.ts, g.asset, CASE WHEN g.ts < b.f THEN {s.r('coalesce(g.value, md.md)')} ELSE {s.r('g.value')} END AS value FROM grid g JOIN b ON b.asset = g.asset JOIN md ON md.ts = g.ts"))
register("missing_ratio", lambda sp, d: panel.missing_ratio(_grid(sp, d)), s.q(s.SUPP, s.GRID, "b AS (SELECT asset, min(ts) AS f FROM supp GROUP BY 1)", f"SELECT g.asset, {s.r('avg(CASE WHEN g.value IS NULL OR abs(g.value) < 1e-12 THEN 1.0 ELSE 0.0 END)')} AS missing_ratio FROM grid g JOIN b ON b.asset = g.asset WHERE g.ts >= b.f GROUP BY 1"))
register("last_score", lambda sp, d: panel.last_score(p.px_supp(sp, d)), s.q(s.SUPP, "l AS (SELECT asset, arg_max(value, ts) AS l FROM supp GROUP BY 1)", f"SELECT supp.asset, {s.r('avg(CASE WHEN value < l THEN 1.0 ELSE 0.0 END)')} AS score FROM supp JOIN l ON l.asset = supp.asset GROUP BY 1"))
register("warmup_to_null", lambda sp, d: panel.warmup_to_null(p.px_supp(sp, d), 3), s.q(s.SUPP, f"SELECT ts, asset, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY ts) > 3 THEN {s.r('value')} END AS value FROM supp"))
register("trimmed_norm", lambda sp, d: panel.trimmed_norm(p.px_supp(sp, d), 0.1), s.q(s.SUPP, "e AS (SELECT ts, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, stddev_samp(value) AS sd FROM supp GROUP BY 1), t AS (SELECT supp.ts, avg(value) AS m FROM supp JOIN e ON e.ts = supp.ts WHERE value BETWEEN lo AND hi GROUP BY 1)", f"SELECT supp.ts, asset, {s.r('(value - m) / nullif(sd, 0)')} AS value FROM supp JOIN e ON e.ts = supp.ts LEFT JOIN t ON t.ts = supp.ts"))

# --- NAVs, leverage, excess ----------------------------------------------------------------------------------

register("nav_geometric", lambda sp, d: returns.nav(p.monthly_returns(sp, d)), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('product(1 + value) OVER (PARTITION BY asset ORDER BY ts)')} AS value FROM mr"))
register("nav_arithmetic", lambda sp, d: returns.nav(p.monthly_returns(sp, d), additive=True), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('1 + sum(value) OVER (PARTITION BY asset ORDER BY ts)')} AS value FROM mr"))
register("nav_log", lambda sp, d: returns.log_nav(p.monthly_returns(sp, d, "log")), s.q(s.PX, s.ME, f"SELECT ts, asset, {s.r('value / first_value(value) OVER w')} AS value FROM m WINDOW w AS (PARTITION BY asset ORDER BY ts) QUALIFY row_number() OVER w > 1"))
register("total_return", lambda sp, d: returns.total_return(p.px(sp, d)), s.q(s.PX, s.ENDS, f"SELECT asset, first_ts, {s.r('first_value')} AS first_value, last_ts, {s.r('last_value')} AS last_value, {s.r('tr')} AS total_return, {s.r('yrs')} AS years, {s.r(s.PA)} AS pa_return FROM ends"))
register("portfolio_returns", lambda sp, d: returns.portfolio_returns(p.w_prio(sp, d), returns.to_returns(p.px_prio(sp, d))), s.q(s.PRIO, s.WPRIO, "r AS (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM prio), l AS (SELECT ts, asset, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS w FROM wprio)", f"SELECT r.ts, 'portfolio' AS asset, {s.r('sum(w * r)')} AS value FROM r JOIN l ON l.ts = r.ts AND l.asset = r.asset GROUP BY 1"))
register("excess_returns", lambda sp, d: returns.excess_returns(p.monthly_returns(sp, d), p.rate(sp, d)), s.q(s.PX, s.ME, s.MR, s.RATE, "lr AS (SELECT ts, lag(value) OVER (ORDER BY ts) AS rf FROM rate), dd AS (SELECT ts, date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS days FROM (SELECT DISTINCT ts FROM mr))", f"SELECT mr.ts, asset, {s.r('value - coalesce(rf * days / 365.0::DOUBLE, 0)')} AS value FROM mr JOIN dd ON dd.ts = mr.ts JOIN lr ON lr.ts = mr.ts"))
register("delever", lambda sp, d: returns.delever(p.monthly_returns(sp, d), 0.5, 0.03, 12), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('(value + 0.5 * 0.03 / 12) / 1.5')} AS value FROM mr"))
register("lever", lambda sp, d: returns.lever(p.monthly_returns(sp, d), 0.5, 0.03, 12), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('1.5 * value - 0.5 * 0.03 / 12')} AS value FROM mr"))
register("implied_leverage", lambda sp, d: returns.implied_leverage(returns.lever(p.monthly_returns(sp, d), 0.5, 0.03, 12), p.monthly_returns(sp, d)), s.q(s.PX, s.ME, s.MR, f"SELECT asset, {s.r('regr_slope(1.5 * value - 0.00125, value) - 1')} AS leverage FROM mr GROUP BY 1"))
register("fees_hwm", lambda sp, d: returns.net_of_fees(p.monthly_returns(sp, d)), s.RECURSIONS["fees_hwm"])
register("sampled_vols", lambda sp, d: returns.sampled_vols(returns.to_returns(p.px(sp, d), "log", drop_first=True), cal.sample_windows(cal.schedule(cal.date_range(p.px(sp, d)), "QE")), 365.0).drop("sample"), s.q(s.PX, s.calendar("QE"), "wd AS (SELECT lag(ts) OVER (ORDER BY ts) AS b, ts AS e FROM cal), lr AS (SELECT ts, asset, ln(value) - ln(lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS v FROM px)", f"SELECT asset, e AS ts, {s.r('sqrt(365.0::DOUBLE) * CASE WHEN count(*) >= 20 THEN stddev_samp(v) ELSE sqrt(avg(v * v)) END')} AS value FROM lr JOIN wd ON lr.ts BETWEEN wd.b AND wd.e WHERE v IS NOT NULL GROUP BY 1, 2"))

# --- performance ---------------------------------------------------------------------------------------------

register("perf_table", lambda sp, d: pf.performance_table(p.px(sp, d)), s.q(s.PX, s.ENDS, f"SELECT asset, first_ts AS start_date, last_ts AS end_date, {s.r('first_value')} AS start_price, {s.r('last_value')} AS end_price, n AS num_obs, {s.r('yrs')} AS years, {s.r('tr')} AS total_return, {s.r(s.PA)} AS pa_return, {s.r(f'ln(1 + {s.PA})')} AS log_pa_return FROM ends"))
register("risk_table", lambda sp, d: pf.risk_table(p.px(sp, d)), s.q(s.PX, s.ME, s.RISK, f"SELECT risk.asset, {', '.join(f'{s.r(c)} AS {c}' for c in s.RISK_COLUMNS)} FROM risk JOIN dd2 ON dd2.asset = risk.asset"))
register("ra_perf_table", lambda sp, d: pf.ra_perf_table(p.px(sp, d)), s.q(s.PX, s.ME, s.RISK, s.ENDS, f"all_ AS (SELECT *, {s.PA} AS pa_return FROM ends JOIN risk USING (asset) JOIN dd2 USING (asset))", s.RA_SELECT))
register("drawdown", lambda sp, d: pf.drawdowns(p.monthly(sp, d)), s.q(s.PX, s.ME, s.DD, f"SELECT ts, asset, {s.r('dd')} AS value FROM dd"))
register("time_under_water", lambda sp, d: pf.time_under_water(p.monthly(sp, d)).withColumn("days", F.col("days").cast("long")), s.q(s.PX, s.ME, s.DD, s.ISLANDS, f"SELECT ts, asset, {s.r('dd')} AS drawdown, row_number() OVER (PARTITION BY asset, isl ORDER BY ts) - 1 AS days FROM isl"))
register("drawdown_episodes", lambda sp, d: pf.drawdown_episodes(p.monthly(sp, d), 5).withColumn("position", F.col("position").cast("long")).withColumns({c: F.col(c).cast("long") for c in ("days_dd", "days_to_trough", "days_recovery")}), s.q(s.PX, s.ME, s.DD, s.ISLANDS, s.EPISODES, f"SELECT asset, position, start, trough, \"end\", recovered, {s.r('max_dd')} AS max_dd, date_diff('day', start, \"end\") AS days_dd, date_diff('day', start, trough) AS days_to_trough, CASE WHEN recovered THEN date_diff('day', trough, \"end\") END AS days_recovery FROM ranked WHERE position <= 5"))
register("max_current_drawdown", lambda sp, d: pf.max_current_drawdown(p.px(sp, d)), s.q(s.PX, s.ME.replace("m AS", "unused AS"), "m AS (SELECT * FROM px)", s.DD, f"SELECT asset, {s.r('min(dd)')} AS max_dd, {s.r('arg_max(dd, ts)')} AS current_dd FROM dd GROUP BY 1"))
register("drawdown_distribution", lambda sp, d: pf.drawdown_distribution(p.monthly(sp, d)), s.q(s.PX, s.ME, s.DD, f"SELECT asset, {s.r('avg(dd)')} AS avg_dd, {s.r('quantile_cont(dd, 0.1)')} AS q_dd, {s.r('min(dd)')} AS max_dd FROM dd GROUP BY 1"))
register("descriptive", lambda sp, d: pf.descriptive_by_frequency(p.monthly_returns(sp, d)), s.q(s.PX, s.ME, s.MR, f"SELECT asset, {s.r('avg(value)')} AS mean, {s.r('stddev_samp(value)')} AS std, {s.r('quantile_cont(value, 0.16)')} AS q16, {s.r('median(value)')} AS median, {s.r('quantile_cont(value, 0.84)')} AS q84 FROM mr GROUP BY 1"))
register("describe", lambda sp, d: pf.describe(p.monthly_returns(sp, d), 12.0), s.q(s.PX, s.ME, s.MR, "l AS (SELECT asset, arg_max(value, ts) AS lv FROM mr GROUP BY 1)", f"SELECT mr.asset, {s.r('avg(value) * 12')} AS mean, {s.r('stddev_samp(value) * sqrt(12.0::DOUBLE)')} AS std, {s.r('avg(value) * sqrt(count(*)) / stddev_samp(value)')} AS t_stat, {s.r('skewness(value)')} AS skewness, {s.r('kurtosis(value)')} AS kurtosis, {s.r('min(value)')} AS min, {s.r('max(value)')} AS max, {s.r('any_value(lv)')} AS last, {s.r('avg(CASE WHEN value <= lv THEN 1.0 ELSE 0.0 END)')} AS rank FROM mr JOIN l ON l.asset = mr.asset GROUP BY 1"))
register("beta_alpha_r2", lambda sp, d: pf.benchmark_table(p.px(sp, d), p.bench(sp, d)), s.q(s.PX, s.BENCH, s.calendar("QE"), s.asof("px", "cal", "qm"), s.asof("bench", "cal", "qb"), s.BETA, f"SELECT asset, {s.r('a * 4')} AS alpha, {s.r('beta')} AS beta, {s.r('r2')} AS r2, n, {s.r('a / sqrt(syy * (1 - r2) / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx))')} AS t_alpha FROM fit"))
register("beta_p_values", lambda sp, d: pf.with_p_values(pf.benchmark_table(p.px(sp, d), p.bench(sp, d))))
register("pivot_year_month", lambda sp, d: pf.periodic_returns(p.px(sp, d)), s.q(s.PX, s.ME, s.MR, "SELECT asset, CAST(year(ts) AS INTEGER) AS year, " + ", ".join(f"{s.r(f'max(CASE WHEN month(ts) = {i} THEN value END)')} AS {n}" for i, n in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], 1)) + f", {s.r('product(1 + value) - 1')} AS total FROM mr GROUP BY 1, 2"))

# --- rolling -------------------------------------------------------------------------------------------------

register("rolling_return", lambda sp, d: rolling.rolling_returns(p.monthly(sp, d), 12), s.q(s.PX, s.ME, f"SELECT ts, asset, {s.r('value / lag(value, 12) OVER (PARTITION BY asset ORDER BY ts) - 1')} AS value FROM m"))
register("rolling_pa", lambda sp, d: rolling.rolling_pa(p.monthly(sp, d), 24), s.q(s.PX, s.ME, f"SELECT ts, asset, {s.r('''(value / lag(value, 24) OVER w) ** (1.0::DOUBLE / (date_diff('day', lag(ts, 24) OVER w, ts) / 365.25::DOUBLE)) - 1''')} AS value FROM m WINDOW w AS (PARTITION BY asset ORDER BY ts)"))
_W12 = "WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 11 PRECEDING)"
for key, f, expr in (
    ("vol", lambda sp, d: rolling.rolling_vols(p.monthly(sp, d), 12, 12.0), "stddev_samp(value) OVER w * sqrt(12.0::DOUBLE)"),
    ("sharpe", lambda sp, d: rolling.rolling_sharpes(p.monthly(sp, d), 12, 12.0), "sqrt(12.0::DOUBLE) * (exp(avg(value) OVER w) - 1) / stddev_samp(value) OVER w"),
):
    register(f"rolling_{key}", f, s.q(s.PX, s.ME, s.MLR, f"SELECT ts, asset, CASE WHEN count(value) OVER w = 12 THEN {s.r(expr)} END AS value FROM mlr {_W12}"))
register("rolling_skew", lambda sp, d: rolling.rolling_skews(p.monthly(sp, d), 12), s.q(s.PX, s.ME, s.MLR, f"SELECT ts, asset, CASE WHEN count(value) OVER w = 12 THEN {s.r('skewness(value) OVER w * 10 / sqrt(12 * 11.0::DOUBLE)')} END AS value FROM mlr {_W12}"))
for what, expr in (("mean", "avg(value) OVER w"), ("sum", "sum(value) OVER w"), ("min", "min(value) OVER w"), ("max", "max(value) OVER w")):
    register(f"rolling_{what}", lambda sp, d, what=what: rolling.rolling(p.monthly(sp, d), 12, what), s.q(s.PX, s.ME, f"SELECT ts, asset, CASE WHEN count(value) OVER w = 12 THEN {s.r(expr)} END AS value FROM m {_W12}"))

# --- regimes -------------------------------------------------------------------------------------------------


def _bench_returns(sp: SparkSession, d: str) -> DataFrame:
    return returns.to_returns(cal.resample_last(p.bench(sp, d), "ME")).filter("value is not null")


def _sampled(sp: SparkSession, d: str) -> DataFrame:
    return regimes.in_regimes(p.monthly_returns(sp, d), regimes.quantile_regimes(_bench_returns(sp, d)))


register("regimes_quantile", lambda sp, d: regimes.quantile_regimes(_bench_returns(sp, d)), s.q(s.PX, s.BENCH, s.calendar("ME"), s.asof("bench", "cal", "bm"), s.REGIME, f"SELECT ts, {s.r('x')} AS x, regime FROM reg"))
register("regimes_sign", lambda sp, d: regimes.sign_regimes(_bench_returns(sp, d)), s.q(s.PX, s.BENCH, s.calendar("ME"), s.asof("bench", "cal", "bm"), s.REGIME, f"SELECT ts, {s.r('x')} AS x, CASE WHEN x < 0 THEN 'negative' ELSE 'positive' END AS regime FROM reg"))
register("regimes_volatility", lambda sp, d: regimes.volatility_regimes(rolling.rolling_vols(cal.resample_last(p.bench(sp, d), "ME"), 6, 12.0).filter("value is not null").select("ts", "value")), s.q(s.PX, s.BENCH, s.calendar("ME"), s.asof("bench", "cal", "bm"), "lr AS (SELECT ts, ln(value) - ln(lag(value) OVER (ORDER BY ts)) AS v FROM bm), vv AS (SELECT ts, CASE WHEN count(v) OVER w = 6 THEN stddev_samp(v) OVER w * sqrt(12.0::DOUBLE) END AS x FROM lr WHERE v IS NOT NULL WINDOW w AS (ORDER BY ts ROWS 5 PRECEDING)), e AS (SELECT quantile_cont(x, 0.33) AS a, quantile_cont(x, 0.66) AS b FROM vv)", f"SELECT ts, {s.r('x')} AS x, CASE WHEN x <= a THEN 'low' WHEN x <= b THEN 'medium' ELSE 'high' END AS regime FROM vv, e WHERE x IS NOT NULL"))
_REG = (s.PX, s.BENCH, s.calendar("ME"), s.asof("px", "cal", "m"), s.asof("bench", "cal", "bm"), s.MR, s.REGIME, s.MEANS)
register("regime_means", lambda sp, d: regimes.regime_means(_sampled(sp, d)), s.q(*_REG, f"SELECT asset, regime, {s.r('mean')} AS mean, n, {s.r('freq')} AS frequency FROM means"))
register("regime_pa_table", lambda sp, d: regimes.regime_pa(_sampled(sp, d), 12.0, returns.total_return(p.monthly(sp, d))), s.q(*_REG, s.ENDS.replace("FROM px", "FROM m"), f"c AS (SELECT *, exp(12 * freq * mean) - 1 AS c FROM means), t AS (SELECT asset, {s.PA} AS pa FROM ends)", f"SELECT c.asset, regime, {s.r('mean')} AS mean, n, {s.r('freq')} AS frequency, {s.r('c + freq * (t.pa - sum(c) OVER (PARTITION BY c.asset))')} AS pa FROM c JOIN t ON t.asset = c.asset"))
register("regime_sharpe", lambda sp, d: regimes.regime_sharpe(_sampled(sp, d), 12.0), s.q(*_REG, f"SELECT asset, regime, {s.r('mean')} AS mean, n, {s.r('freq')} AS frequency, {s.r('sqrt(12.0::DOUBLE) * freq * mean / sd')} AS sharpe FROM means"))
register("regime_table", lambda sp, d: regimes.regime_table(_sampled(sp, d), 12.0), s.q(*_REG, "z AS (SELECT asset, regime, sqrt(12.0::DOUBLE) * freq * mean / sd AS v FROM means)", f"SELECT asset, {', '.join(s.r(f'''max(CASE WHEN regime = '{n}' THEN v END)''') + f' AS {n}' for n in regimes.NAMES)}, {s.r('sum(v)')} AS total FROM z GROUP BY 1"))

# --- correlation ---------------------------------------------------------------------------------------------

register("corr_pairs", lambda sp, d: co.pairwise(p.monthly_returns(sp, d)), s.q(s.PX, s.ME, s.MR, f"SELECT a.asset AS asset_i, b.asset AS asset_j, count(*) AS n, {s.r('covar_samp(a.value, b.value)')} AS cov, {s.r('covar_pop(a.value, b.value)')} AS cov_pop, {s.r('corr(a.value, b.value)')} AS corr FROM mr a JOIN mr b ON a.ts = b.ts AND a.asset <= b.asset GROUP BY 1, 2"))
_PATH = "v AS (SELECT ts, asset, value - avg(value) OVER (PARTITION BY asset) AS v FROM mr), l AS (SELECT asset, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3 FROM v WINDOW w AS (PARTITION BY asset ORDER BY ts))"
_ACF = _PATH + ", a AS (SELECT asset, sum(v * l1) / sum(v * v) AS r1, sum(v * l2) / sum(v * v) AS r2, sum(v * l3) / sum(v * v) AS r3 FROM l GROUP BY 1 HAVING count(*) > 6)"
# Of the equations of three lags, by determinants.
_PACF = _PATH + ", a AS (SELECT asset, sum(v * l1) / sum(v * v) * count(*) / (count(*) - 1) AS r1, sum(v * l2) / sum(v * v) * count(*) / (count(*) - 2) AS r2, sum(v * l3) / sum(v * v) * count(*) / (count(*) - 3) AS r3 FROM l GROUP BY 1 HAVING count(*) > 6), b AS (SELECT asset, r1 AS p1, (r2 - r1 ** 2) / (1 - r1 ** 2) AS p2, (r3 - 2 * r1 * r2 - r1 ** 2 * r3 + r1 * r2 ** 2 + r1 ** 3) / (1 - 2 * r1 ** 2 + 2 * r1 ** 2 * r2 - r2 ** 2) AS p3 FROM a)"
register("bridged_returns", lambda sp, d: unsmoothing.bridged(returns.to_returns(p.monthly(sp, d).filter(F.month("ts") % 3 == 0)), returns.to_returns(cal.resample_last(p.bench(sp, d), "ME")).filter("value is not null"), 12, 12.0), s.BRIDGE)
register("ewm_vol_floored", lambda sp, d: ewm.ewm_vol(p.monthly_returns(sp, d), 12, floor_quantile=0.3, floor_rows=24), s.VOL_FLOOR)
register("returns_transform_rolling", lambda sp, d: ewm.returns_transform(p.monthly_returns(sp, d, "log"), "rolling", 6), s.ROLLED)
register("autocorr_path", lambda sp, d: co.path_autocorrelations(p.monthly_returns(sp, d), 3), s.q(s.PX, s.ME, s.MR, _ACF, " UNION ALL ".join(f"SELECT asset, {k} AS lag, {s.r(f'r{k}')} AS corr FROM a" for k in (1, 2, 3))))
register("partial_autocorr", lambda sp, d: co.path_autocorrelations(p.monthly_returns(sp, d), 3, partial=True), s.q(s.PX, s.ME, s.MR, _PACF, " UNION ALL ".join(f"SELECT asset, {k} AS lag, {s.r(f'p{k}')} AS corr FROM b" for k in (1, 2, 3))))
register("partial_autocorr_bands", lambda sp, d: co.path_bands(co.path_autocorrelations(p.monthly_returns(sp, d), 3, partial=True)), s.q(s.PX, s.ME, s.MR, _PACF, " UNION ALL ".join(f"SELECT {k} AS lag, {s.r(f'avg(p{k})')} AS mean, {s.r(f'stddev_pop(p{k})')} AS std FROM b" for k in (1, 2, 3))))


@query(s.q(s.PX, s.ME, s.MR, f"SELECT a.asset AS asset_i, b.asset AS asset_j, {s.r('CASE WHEN a.asset < b.asset THEN corr(a.value, b.value) WHEN a.asset > b.asset THEN covar_samp(a.value, b.value) ELSE stddev_samp(a.value) END')} AS value FROM mr a JOIN mr b ON a.ts = b.ts GROUP BY a.asset, b.asset"))
def upper_lower_matrix(sp: SparkSession, d: str) -> DataFrame:
    r = p.monthly_returns(sp, d)
    both = co.mirrored(co.pairwise(r))
    cells = lambda c: both.select("asset_i", "asset_j", F.col(c).alias("value"))
    return co.upper_lower(cells("corr"), cells("cov"), r.groupBy("asset").agg(F.stddev_samp("value").alias("value")))


register("autocorr_lags", lambda sp, d: co.autocorrelations(p.monthly_returns(sp, d), [1, 2, 3]), s.q(s.PX, s.ME, s.MR, "l AS (SELECT asset, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3 FROM mr WINDOW w AS (PARTITION BY asset ORDER BY ts))", " UNION ALL ".join(f"SELECT asset, {k} AS lag, {s.r(f'corr(value, l{k})')} AS corr FROM l GROUP BY 1" for k in (1, 2, 3))))
register("corr_with_pivot", lambda sp, d: co.with_pivot(p.monthly_returns(sp, d), "A"), s.q(s.PX, s.ME, s.MR, f"SELECT b.asset, {s.r('sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))')} AS corr FROM mr a JOIN mr b ON a.ts = b.ts WHERE a.asset = 'A' GROUP BY 1"))
register("ols_on_benchmark", lambda sp, d: co.ols(panel.against(p.monthly_returns(sp, d), _bench_returns(sp, d)).withColumnRenamed("value", "y"), "asset"), s.q(s.PX, s.BENCH, s.calendar("ME"), s.asof("px", "cal", "m"), s.asof("bench", "cal", "bm"), s.MR, s.REGIME, f"SELECT asset, {s.r('regr_intercept(value, x)')} AS alpha, {s.r('regr_slope(value, x)')} AS beta, {s.r('regr_r2(value, x)')} AS r2, count(*) AS n FROM mr JOIN reg ON reg.ts = mr.ts GROUP BY 1"))

# --- cross-section -------------------------------------------------------------------------------------------

register("zscore_cross_section", lambda sp, d: weights.cross_score(p.px_supp(sp, d)), s.q(s.SUPP, f"SELECT ts, asset, {s.r('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)')} AS value FROM supp WINDOW w AS (PARTITION BY ts)"))
register("max_score", lambda sp, d: weights.max_score(p.px_supp(sp, d)), s.q(s.SUPP, f"SELECT ts, asset, {s.r('value / max(value) OVER (PARTITION BY ts)')} AS value FROM supp"))
register("equal_weight", lambda sp, d: weights.equal_weight(_grid(sp, d)), s.q(s.SUPP, s.GRID, f"SELECT ts, asset, CASE WHEN value IS NULL THEN 0.0 ELSE {s.r('1.0::DOUBLE / count(value) OVER (PARTITION BY ts)')} END::DOUBLE AS value FROM grid"))
register("long_only_weight", lambda sp, d: weights.long_only(returns.to_returns(p.px_supp(sp, d)).filter("value is not null")), s.q(s.SUPP, "sr AS (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS v FROM supp), g AS (SELECT ts, asset, greatest(v, 0) AS v FROM sr WHERE v IS NOT NULL)", f"SELECT ts, asset, {s.r('coalesce(v / nullif(sum(v) OVER (PARTITION BY ts), 0), 0)')} AS value FROM g"))
register("top_bottom_n", lambda sp, d: weights.top_bottom(p.px_supp(sp, d), 5), s.q(s.SUPP, "SELECT ts, asset, CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY value DESC, asset) <= 5 THEN 1.0 WHEN row_number() OVER (PARTITION BY ts ORDER BY value, asset DESC) <= 5 THEN -1.0 ELSE 0.0 END::DOUBLE AS value FROM supp"))
register("long_short", lambda sp, d: weights.long_short(p.px_supp(sp, d), 0.1), s.q(s.SUPP, "n AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY ts) * 0.1::DOUBLE), 1) AS leg, row_number() OVER (PARTITION BY ts ORDER BY value DESC, asset) AS u, row_number() OVER (PARTITION BY ts ORDER BY value, asset DESC) AS dn FROM supp)", "SELECT ts, asset, CASE WHEN u <= leg THEN 1.0 WHEN dn <= leg THEN -1.0 ELSE 0.0 END::DOUBLE AS value FROM n"))
register("static_weight_schedule", lambda sp, d: weights.static_schedule(p.px(sp, d), sp.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "asset string, weight double"), cal.schedule(cal.date_range(p.px(sp, d)), "QE")), s.q(s.PX, s.calendar("QE"), s.asof("px", "cal", "m"), "w(asset, w) AS (VALUES ('A', 0.5::DOUBLE), ('N', 0.3), ('R', 0.2))", f"SELECT ts, m.asset, {s.r('w / sum(w) OVER (PARTITION BY ts)')} AS value FROM m JOIN w ON w.asset = m.asset"))
register("aggregates_by_asset", lambda sp, d: ag.aggregate(p.monthly_returns(sp, d), "asset", "mean", "median", "sum", "sum_positive", "sum_negative", "mean_positive", "mean_negative", "abs_sum", "std", "min", "max", "count"), s.q(s.PX, s.ME, s.MR, f"SELECT asset, {s.AGGS} FROM mr GROUP BY 1"))
register("aggregates_by_date", lambda sp, d: ag.aggregate(p.monthly_returns(sp, d), "ts", "mean", "median", "sum", "sum_positive", "sum_negative", "mean_positive", "mean_negative", "abs_sum", "std", "min", "max", "count"), s.q(s.PX, s.ME, s.MR, f"SELECT ts, {s.AGGS} FROM mr GROUP BY 1"))
register("clipped_aggregates", lambda sp, d: ag.clipped(p.monthly_returns(sp, d), "asset", -0.05, 0.05), s.q(s.PX, s.ME, s.MR, "c AS (SELECT asset, greatest(-0.05::DOUBLE, least(0.05, value)) AS v FROM mr)", f"SELECT asset, {s.r('sum(v)')} AS sum, {s.r('avg(v)')} AS mean FROM c GROUP BY 1"))
register("weighted_mean", lambda sp, d: ag.weighted_mean(p.monthly_returns(sp, d), sp.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "asset string, weight double")), s.q(s.PX, s.ME, s.MR, "w(asset, w) AS (VALUES ('A', 0.5::DOUBLE), ('N', 0.3), ('R', 0.2))", f"SELECT ts, {s.r('sum(w * value) / sum(w)')} AS value, {s.r('sum(w * value)')} AS sum FROM mr JOIN w ON w.asset = mr.asset GROUP BY 1"))
register("median_mad", lambda sp, d: ag.median_mad(p.px_supp(sp, d)), s.q(s.SUPP, "md AS (SELECT asset, median(value) AS md FROM supp GROUP BY 1), e AS (SELECT supp.asset, any_value(md) AS md, median(abs(value - md)) AS mad FROM supp JOIN md ON md.asset = supp.asset GROUP BY 1)", f"SELECT asset, {s.r('md')} AS median, {s.r('mad')} AS mad, {s.r('md / nullif(mad, 0)')} AS ratio FROM e"))
register("group_sum", lambda sp, d: ag.by_group(p.px_supp(sp, d), p.groups(sp, d)), s.q(s.SUPP, s.GROUPS, f"SELECT ts, grp, {s.r('sum(value)')} AS value FROM supp JOIN g ON g.asset = supp.asset GROUP BY 1, 2"))
register("group_rollup_total", lambda sp, d: ag.by_group_with_total(p.px_supp(sp, d), p.groups(sp, d), "mean"), s.q(s.SUPP, s.GROUPS, f"SELECT ts, coalesce(grp, 'Total') AS grp, {s.r('avg(value)')} AS value FROM supp JOIN g ON g.asset = supp.asset GROUP BY GROUPING SETS ((ts, grp), (ts))"))
register("group_median", lambda sp, d: ag.against_universe(p.px_supp(sp, d), p.groups(sp, d)), s.q(s.SUPP, s.GROUPS, "u AS (SELECT ts, median(value) AS u FROM supp GROUP BY 1)", f"SELECT supp.ts, grp, {s.r('median(value)')} AS value, {s.r('any_value(u)')} AS universe FROM supp JOIN g ON g.asset = supp.asset JOIN u ON u.ts = supp.ts GROUP BY 1, 2"))
register("group_average_fill", lambda sp, d: ag.group_average_fill(p.px_supp(sp, d), p.groups(sp, d)).select("ts", "asset", "grp", "value"), s.q(s.SUPP, s.GROUPS, f"SELECT ts, supp.asset, grp, {s.r('avg(value) OVER (PARTITION BY ts, grp)')} AS value FROM supp JOIN g ON g.asset = supp.asset"))
register("cut_fixed_edges", lambda sp, d: ag.cut(p.read(sp, d, "events").select("event_id", "value"), "value", [10.0, 50.0, 100.0]).groupBy("bin").agg(F.count("*").alias("n")), "SELECT CASE WHEN value <= 10 THEN '(-inf, 10]' WHEN value <= 50 THEN '(10, 50]' WHEN value <= 100 THEN '(50, 100]' ELSE '(100, inf]' END AS bin, count(*) AS n FROM events GROUP BY 1")
register("cut_quantiles", lambda sp, d: ag.cut_quantiles(p.read(sp, d, "events").select("value"), "value", 4).groupBy("bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), f"WITH e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT CASE WHEN value <= a THEN 'Q1' WHEN value <= b THEN 'Q2' WHEN value <= c THEN 'Q3' ELSE 'Q4' END AS bin, count(*) AS n, {s.r('avg(value)')} AS mean FROM events, e GROUP BY 1")
register("histogram", lambda sp, d: ag.histogram(p.read(sp, d, "events"), "value", 0.0, 200.0, 20), "SELECT CAST(least(floor(value / 10), 19) AS INTEGER) AS bin, count(*) AS n, least(floor(value / 10), 19) * 10.0::DOUBLE AS \"left\" FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1, 3")

# --- bars ----------------------------------------------------------------------------------------------------

register("ohlc_bars", lambda sp, d: rolling.bars(p.ticks(sp, d)).withColumn("ts", F.col("ts").cast("date")), s.q(s.BARS, f"SELECT ts, asset, {', '.join(f'{s.r(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, n FROM bars"))
for kind, expr in s.OHLC.items():
    register(f"ohlc_{kind}", lambda sp, d, kind=kind: rolling.bar_variance(rolling.bars(p.ticks(sp, d)).withColumn("ts", F.col("ts").cast("date")), kind), s.q(s.BARS, f"SELECT ts, asset, {s.r(expr)} AS value FROM bars"))
register("ohlc_vol", lambda sp, d: rolling.bar_vol(rolling.bars(p.ticks(sp, d)).withColumn("ts", F.col("ts").cast("date")), "parkinson", 365.0), s.q(s.BARS, f"v AS (SELECT asset, last_day(ts) AS month, {s.OHLC['parkinson']} AS v FROM bars)", f"SELECT asset, month, {s.r('sqrt(avg(v) * 365)')} AS vol FROM v GROUP BY 1, 2"))

# --- signals -------------------------------------------------------------------------------------------------


def _pairs(sp: SparkSession, d: str, horizon: int = 1) -> DataFrame:
    r = returns.to_returns(p.px_supp(sp, d)).filter("value is not null")
    return signals.signal_pairs(r, r, horizon)


register("signal_pairs", _pairs, s.q(s.SUPP, s.PAIRS, f"SELECT ts, asset, {s.r('z')} AS z, {s.r('r')} AS r FROM pairs"))
register("ic_series", lambda sp, d: signals.information_coefficients(_pairs(sp, d)), s.q(s.SUPP, s.PAIRS, s.IC, f"SELECT ts, {s.r('ic')} AS ic FROM ic"))
register("ic_ir", lambda sp, d: signals.ic_information_ratio(signals.information_coefficients(_pairs(sp, d))), s.q(s.SUPP, s.PAIRS, s.IC, "gp AS (SELECT ic, date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM ic)", f"SELECT {s.r('avg(ic)')} AS mean, {s.r('stddev_samp(ic)')} AS std, {s.r('avg(ic) / stddev_samp(ic) * sqrt(365.25::DOUBLE / median(gap))')} AS ir, {s.r('avg(ic) / stddev_samp(ic) * sqrt(count(*))')} AS t, {s.r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, count(*) AS n FROM gp"))
register("per_asset_beta", lambda sp, d: signals.per_asset_betas(_pairs(sp, d), 5).select("asset", "n", "beta"), s.q(s.SUPP, s.PAIRS, f"SELECT asset, count(*) AS n, {s.r('sum(z * r) / nullif(sum(z * z), 0)')} AS beta FROM pairs GROUP BY 1 HAVING count(*) >= 5"))
register("signal_pooled", lambda sp, d: signals.pooled(_pairs(sp, d).withColumn("horizon", F.lit(1)), "horizon"), s.q(s.SUPP, s.PAIRS, "k AS (SELECT sum(z * z) AS zz, sum(z * r) AS zr, sum(r * r) AS rr, count(*) AS n FROM pairs)", f"SELECT 1 AS horizon, n, {s.r('zr / zz')} AS beta, {s.r('zr * zr / (zz * rr)')} AS r2, {s.r('zr / zz / sqrt((rr - zr * zr / zz) / (n - 1) / zz)')} AS t FROM k"))

# --- exponentially weighted ----------------------------------------------------------------------------------

register("ewm_mean", lambda sp, d: ewm.ewm_mean(p.monthly_returns(sp, d), 12), s.q(s.PX, s.ME, s.MR, s.EWM, f"SELECT ts, asset, {s.r('v')} AS value FROM e", recursive=True))
register("ewm_mean_native", lambda sp, d: ewm.ewm_mean_sql(p.monthly_returns(sp, d), 12), s.q(s.PX, s.ME, s.MR, s.EWM, f"SELECT ts, asset, {s.r('v')} AS value FROM e", recursive=True))
register("ewm_vol", lambda sp, d: ewm.ewm_vol(p.monthly_returns(sp, d), 12, af=12.0), s.q(s.PX, s.ME, s.MR, s.EWM.replace("SELECT ts, asset, value,", "SELECT ts, asset, value * value AS value,"), f"SELECT ts, asset, {s.r('sqrt(12 * v)')} AS value FROM e", recursive=True))


def _xy(sp: SparkSession, d: str) -> DataFrame:
    return panel.against(p.monthly_returns(sp, d), _bench_returns(sp, d)).withColumnRenamed("value", "y")


for key, f in {
    "ewm_beta": lambda sp, d: ewm.cross_xy(_xy(sp, d), 12),
    "ewm_corr": lambda sp, d: ewm.cross_xy(_xy(sp, d), 12, "corr"),
    "ewm_beta_alpha": lambda sp, d: ewm.beta_alpha(_xy(sp, d), 12),
    "ewm_long_short": lambda sp, d: ewm.long_short(p.monthly_returns(sp, d), 24, 6),
    "ewm_newey_west": lambda sp, d: ewm.newey_west_vol(p.monthly_returns(sp, d), 12, 2, 12.0),
    "ewm_up_down": lambda sp, d: ewm.up_down_vol(p.monthly_returns(sp, d), 12, 12.0),
    "ewm_sharpe": lambda sp, d: ewm.ewm_sharpe(p.monthly_returns(sp, d), 12, af=12.0),
    "ewm_sharpe_mean": lambda sp, d: ewm.ewm_sharpe(p.monthly_returns(sp, d), 12, 0, 12.0),
    "ewm_sharpe_deviation": lambda sp, d: ewm.ewm_sharpe(p.monthly_returns(sp, d), 12, 2, 12.0),
    "ewm_unit_std": lambda sp, d: ewm.unit_std(p.monthly_returns(sp, d), 12),
    "ewm_score": lambda sp, d: ewm.ewm_score(p.monthly_returns(sp, d), 12),
    "ewm_winsorise": lambda sp, d: ewm.winsorise(p.monthly_returns(sp, d), 12),
    "ewm_winsor_markov": lambda sp, d: ewm.winsorise_markov(p.monthly_returns(sp, d), 12, 2.0, 0.0, 0.0004),
    "ewm_correlation": lambda sp, d: ewm.covariance_tensor(p.monthly_returns(sp, d), 12, corr=True, every=12),
    "ewm_covariance_vol_norm": lambda sp, d: ewm.covariance_tensor(p.monthly_returns(sp, d), 12, vol_norm=True, every=12),
    "ewm_covariance_newey_west": lambda sp, d: ewm.covariance_last(p.monthly_returns(sp, d), 12, 2),
    "ewm_factor_betas": lambda sp, d: ewm.factor_betas(p.monthly_returns(sp, d).filter("asset = 'A'"), p.monthly_returns(sp, d).filter("asset <> 'A'"), 12, 6),
    "ewm_vector_autocorr": lambda sp, d: ewm.vector_autocorr(p.monthly_returns(sp, d), 12),
    "ewm_matrix_autocorr": lambda sp, d: ewm.matrix_autocorr(p.monthly_returns(sp, d), 12),
    "pca_r2": lambda sp, d: ewm.pca_r2(p.monthly_returns(sp, d), 24, 12),
    "ra_returns": lambda sp, d: ewm.ra_returns(p.monthly_returns(sp, d), 12, 0.1, 12.0),
    "ra_momentum": lambda sp, d: ewm.ra_momentum(p.monthly_returns(sp, d), 6, 12),
    "rolling_ra": lambda sp, d: ewm.rolling_ra(p.monthly_returns(sp, d), 6, 12),
    "signal_convolution": lambda sp, d: ewm.signal_convolution(p.monthly_returns(sp, d), p.monthly_returns(sp, d), 3, 24),
    "unsmooth_ar1": lambda sp, d: unsmoothing.ar(p.monthly_returns(sp, d)),
    "unsmooth_glm": lambda sp, d: unsmoothing.glm(p.monthly_returns(sp, d)),
    "unsmooth_factor_lag": lambda sp, d: unsmoothing.factor_lag(p.monthly_returns(sp, d), _bench_returns(sp, d)),
    "unsmooth_joint": lambda sp, d: unsmoothing.joint(p.monthly_returns(sp, d), _bench_returns(sp, d)),
    "dimson_betas": lambda sp, d: unsmoothing.dimson_betas(p.monthly_returns(sp, d), _bench_returns(sp, d)),
    "bootstrap_stationary": lambda sp, d: bs.index_table(sp, "stationary", 60, 20, block=6),
    "bootstrap_iid": lambda sp, d: bs.index_table(sp, "iid", 60, 20),
    "bootstrap_fixed_block": lambda sp, d: bs.index_table(sp, "fixed", 60, 20, block=6),
    "bootstrap_price_paths": lambda sp, d: bs.price_paths(p.monthly_returns(sp, d), bs.index_table(sp, "stationary", 60, 5, block=6)),
    "bootstrap_ar1_paths": lambda sp, d: bs.ar1_paths(p.monthly_returns(sp, d), bs.index_table(sp, "iid", 60, 5)),
}.items():
    register(key, f, s.RECURSIONS.get(key))
register("filter_outliers", lambda sp, d: ewm.filter_outliers(p.monthly_returns(sp, d), 0.2, -0.2, 2.0), s.q(s.PX, s.ME, s.MR, "f AS (SELECT ts, asset, CASE WHEN value BETWEEN -0.2 AND 0.2 THEN value END AS v FROM mr), z AS (SELECT *, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM f WINDOW w AS (PARTITION BY asset))", f"SELECT ts, asset, CASE WHEN abs(v - mu) <= 2 * sd THEN {s.r('v')} END AS value FROM z"))
register("demeaned_insample", lambda sp, d: ewm.rolling_demeaned(p.monthly_returns(sp, d), "insample"), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('value - avg(value) OVER (PARTITION BY asset)')} AS value FROM mr"))
register("demeaned_expanding", lambda sp, d: ewm.rolling_demeaned(p.monthly_returns(sp, d), "expanding"), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('value - avg(value) OVER (PARTITION BY asset ORDER BY ts)')} AS value FROM mr"))
register("ar1_fit", lambda sp, d: bs.ar1_fit(p.monthly_returns(sp, d)), s.q(s.PX, s.ME, s.MR, "l AS (SELECT asset, value, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS x FROM mr)", f"SELECT asset, {s.r('regr_slope(value, x)')} AS beta, {s.r('regr_intercept(value, x)')} AS intercept FROM l GROUP BY 1"))

# --- portfolios and risk -------------------------------------------------------------------------------------


def _ledger(sp: SparkSession, d: str, trading: float = 0.001) -> DataFrame:
    w = p.w_prio(sp, d).withColumn("portfolio", F.lit("p")).select("portfolio", "ts", "asset", "value")
    return portfolio.backtest(p.px_prio(sp, d), w, portfolio.Costs(trading=trading))


def _cov(sp: SparkSession, d: str) -> DataFrame:
    r = returns.to_returns(p.px_prio(sp, d)).filter("value is not null")
    last = r.agg(F.max("ts").alias("ts"))
    return co.mirrored(co.pairwise(r).select("asset_i", "asset_j", "cov")).crossJoin(F.broadcast(last)).select("ts", "asset_i", "asset_j", "cov")


def _weights_now(sp: SparkSession, d: str) -> DataFrame:
    w = p.w_prio(sp, d)
    return w.join(F.broadcast(w.agg(F.max("ts").alias("ts"))), "ts", "left_semi")


def _equal(sp: SparkSession, d: str) -> DataFrame:
    return weights.equal_weight(_weights_now(sp, d))


_COV = (s.PRIO, s.WPRIO, s.COV)
register("portfolio_vol", lambda sp, d: risk.portfolio_vol(_cov(sp, d), _weights_now(sp, d)), s.q(*_COV, f"SELECT (SELECT max(ts) FROM prio) AS ts, {s.r('sqrt(sum(a.w * c * b.w))')} AS value FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j"))
register("tracking_error", lambda sp, d: risk.tracking_error(_cov(sp, d), _weights_now(sp, d), _equal(sp, d)), s.q(*_COV, f"SELECT (SELECT max(ts) FROM prio) AS ts, {s.r('sqrt(greatest(sum(a.d * c * b.d), 0))')} AS value FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j"))
register("marginal_te", lambda sp, d: risk.marginal_tracking_error(_cov(sp, d), _weights_now(sp, d), _equal(sp, d)), s.q(*_COV, "e AS (SELECT i AS asset, any_value(a.d) * sum(c * b.d) AS e FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j GROUP BY 1)", f"SELECT (SELECT max(ts) FROM prio) AS ts, asset, {s.r('CASE WHEN sum(e) OVER () > 0 THEN e / sqrt(sum(e) OVER ()) ELSE 0 END')} AS value FROM e"))
register("risk_contribution", lambda sp, d: risk.contribution_ratios(_cov(sp, d), _weights_now(sp, d)), s.q(*_COV, "e AS (SELECT i AS asset, any_value(a.w) * sum(c * b.w) AS e FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j GROUP BY 1)", f"SELECT (SELECT max(ts) FROM prio) AS ts, asset, {s.r('e / sum(e) OVER ()')} AS value FROM e"))
register("group_risk", lambda sp, d: risk.by_group(risk.contribution_ratios(_cov(sp, d), _weights_now(sp, d)), _weights_now(sp, d).select("asset", F.when(F.col("asset") < "3", "high").otherwise("low").alias("grp"))), s.q(*_COV, "e AS (SELECT i AS asset, any_value(a.w) * sum(c * b.w) AS e FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j GROUP BY 1), sh AS (SELECT asset, e / sum(e) OVER () AS v FROM e)", f"SELECT (SELECT max(ts) FROM prio) AS ts, CASE WHEN asset < '3' THEN 'high' ELSE 'low' END AS grp, {s.r('sum(v)')} AS value FROM sh GROUP BY 2"))
register("benchmark_beta", lambda sp, d: risk.benchmark_beta(_cov(sp, d), _weights_now(sp, d), _equal(sp, d)), s.q(*_COV, f"SELECT (SELECT max(ts) FROM prio) AS ts, {s.r('sum(a.w * c * b.q) / sum(a.q * c * b.q)')} AS value FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j"))
register("value_at_risk", lambda sp, d: risk.value_at_risk(_cov(sp, d), _weights_now(sp, d)), s.q(*_COV, f"SELECT (SELECT max(ts) FROM prio) AS ts, {s.r('2.3263::DOUBLE * sqrt(sum(a.w * c * b.w))')} AS value FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j"))
register("cov_to_corr", lambda sp, d: co.cov_to_corr(_cov(sp, d)).select("ts", "asset_i", "asset_j", "corr"), s.q(*_COV, f"SELECT (SELECT max(ts) FROM prio) AS ts, x.i AS asset_i, x.j AS asset_j, {s.r('x.c / sqrt(a.c * b.c)')} AS corr FROM cv x JOIN cv a ON a.i = x.i AND a.j = x.i JOIN cv b ON b.i = x.j AND b.j = x.j"))
register("brinson", lambda sp, d: portfolio.brinson(*_brinson_inputs(sp, d)), s.q(s.PRIO, s.WPRIO, s.BRINSON, f"SELECT ts, grp, {s.r('(ws - wb) * pb')} AS allocation, {s.r('wb * (ps - pb)')} AS selection, {s.r('ps - pb - (ws - wb) * pb - wb * (ps - pb)')} AS interaction, {s.r('ps - pb')} AS active FROM gb"))
register("brinson_totals", lambda sp, d: portfolio.brinson_totals(portfolio.brinson(*_brinson_inputs(sp, d))), s.q(s.PRIO, s.WPRIO, s.BRINSON, f"SELECT coalesce(grp, 'Total') AS grp, {s.r('sum((ws - wb) * pb)')} AS allocation, {s.r('sum(wb * (ps - pb))')} AS selection, {s.r('sum(ps - pb - (ws - wb) * pb - wb * (ps - pb))')} AS interaction, {s.r('sum(ps - pb)')} AS active FROM gb GROUP BY ROLLUP (grp)"))


def _brinson_inputs(sp: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = p.w_prio(sp, d)
    both = w.select("ts", "asset", F.col("value").alias("strategy"), F.lit(0.2).alias("benchmark"))
    r = returns.to_returns(p.px_prio(sp, d)).filter("value is not null").withColumnRenamed("value", "r")
    lag = both.withColumn("ls", F.lag("strategy").over(Window.partitionBy("asset").orderBy("ts"))).filter("ls is not null")
    pnl = lag.join(r, ["ts", "asset"]).select("ts", "asset", (F.col("ls") * F.col("r")).alias("strategy"), (0.2 * F.col("r")).alias("benchmark"))
    groups = w.select("asset").distinct().withColumn("grp", F.when(F.col("asset") < "3", "high").otherwise("low"))
    return both, pnl, groups


for key, f in {
    "backtest_ledger": lambda sp, d: _ledger(sp, d),
    "backtest_nav": lambda sp, d: portfolio.portfolio_nav(_ledger(sp, d)),
    "backtest_fixed": lambda sp, d: portfolio.portfolio_nav(portfolio.backtest_fixed(p.px(sp, d), sp.createDataFrame([("p", "A", 0.5), ("p", "N", 0.5)], "portfolio string, asset string, weight double"), "QE")),
    "turnover": lambda sp, d: portfolio.turnover(_ledger(sp, d), 12),
    "costs": lambda sp, d: portfolio.costs(_ledger(sp, d), 12),
    "instrument_pnl": lambda sp, d: portfolio.instrument_pnl(_ledger(sp, d)),
    "attribution": lambda sp, d: portfolio.attribution(_ledger(sp, d)),
    "attribution_tails": lambda sp, d: portfolio.attribution_tails(portfolio.attribution(_ledger(sp, d)).filter("asset <> 'Total'").select("asset", "value"), 2),
    "instrument_navs": lambda sp, d: portfolio.instrument_navs(_ledger(sp, d)),
    "exposures": lambda sp, d: portfolio.exposures(_ledger(sp, d)),
    "investable": lambda sp, d: portfolio.investable(_ledger(sp, d)),
    "instrument_table": lambda sp, d: portfolio.instrument_table(_ledger(sp, d)),
    "pnl_risk_attribution": lambda sp, d: portfolio.pnl_risk_attribution(_ledger(sp, d)),
    "realised_pnl": lambda sp, d: portfolio.realised_pnl(_ledger(sp, d)),
    "portfolio_benchmark_betas": lambda sp, d: portfolio.benchmark_betas(_ledger(sp, d), p.px_prio(sp, d).groupBy("ts").agg(F.avg("value").alias("value")).select("ts", F.lit("b").alias("asset"), "value"), 12),
    "overlay_curve": lambda sp, d: portfolio.overlay_curve(p.px(sp, d), "A", "N", "QE", 5),
    "discrete_replay": lambda sp, d: replay.daily_positions(_replay(sp, d)),
}.items():
    register(key, f, s.LEDGERS.get(key))


class BuyAndTrim:
    """Buys ten units of each asset at first and sells one whenever its price has doubled since."""

    def __init__(self) -> None:
        self.entry: dict[str, float] = {}

    def on_bar(self, ts: object, prices: dict[str, float], state: replay.State) -> list[replay.Order]:
        out = []
        for asset, price in sorted(prices.items()):
            if asset not in self.entry:
                self.entry[asset] = price
                out.append(replay.Order(asset, 10.0, "entry"))
            elif price > 2 * self.entry[asset] and state.units.get(asset, 0) > 1:
                self.entry[asset] = price
                out.append(replay.Order(asset, -1.0, "trim"))
        return out


def _replay(sp: SparkSession, d: str) -> DataFrame:
    prices = p.monthly(sp, d).withColumn("replay", F.lit("r"))
    return replay.replay_frame(prices, lambda name: BuyAndTrim(), 1e6, replay.FullFill(0.001, 0.0005))


# --- currencies ----------------------------------------------------------------------------------------------


def _fx(sp: SparkSession, d: str) -> fx.FxRates:
    rates = p.rate(sp, d)
    return fx.FxRates(p.monthly(sp, d), rates.withColumn("asset", F.lit("A")).unionByName(rates.withColumn("asset", F.lit("N")).withColumn("value", F.col("value") / 2)))


register("fx_cross", lambda sp, d: _fx(sp, d).cross("A", "N"), s.q(s.PX, s.ME, f"SELECT a.ts, 'AN' AS asset, {s.r('a.value / b.value')} AS value FROM m a JOIN m b ON a.ts = b.ts WHERE a.asset = 'A' AND b.asset = 'N'"))
register("fx_forward", lambda sp, d: _fx(sp, d).forward_premium("A", "N", 1 / 12), s.q(s.PX, s.ME, s.RATE, f"SELECT ts, 'AN' AS asset, {s.r('(1 + value / 12) / (1 + value / 24) - 1')} AS value FROM rate"))
register("fx_hedged_return", lambda sp, d: fx.hedged_performance(p.monthly(sp, d).filter("asset = 'R'"), _fx(sp, d).cross("A", "N"), _fx(sp, d).forward_premium("A", "N", 1 / 12), 0.5).drop("nav").filter("value is not null"), s.q(s.PX, s.ME, s.RATE, "c AS (SELECT a.ts, a.value / b.value AS v FROM m a JOIN m b ON a.ts = b.ts WHERE a.asset = 'A' AND b.asset = 'N'), z AS (SELECT m.ts, m.asset, m.value / lag(m.value) OVER w - 1 AS l, c.v / lag(c.v) OVER w - 1 AS f, lag((1 + rate.value / 12) / (1 + rate.value / 24) - 1) OVER w AS p FROM m JOIN c ON c.ts = m.ts JOIN rate ON rate.ts = m.ts WHERE m.asset = 'R' WINDOW w AS (ORDER BY m.ts))", f"SELECT ts, asset, {s.r('l')} AS local, {s.r('f')} AS fx, {s.r('l * (1 + f) + 0.5 * f - 0.5 * p')} AS value FROM z WHERE l IS NOT NULL"))
for key, f in {
    "fx_total_return": lambda sp, d: _fx(sp, d).total_return("A", "N", 1 / 12),
    "fx_cash_nav": lambda sp, d: _fx(sp, d).cash_nav("A"),
    "fx_carry_nav": lambda sp, d: _fx(sp, d).carry_nav("A", "N", 1 / 12),
    "fx_optimal_hedge": lambda sp, d: fx.optimal_hedge(fx.vol_and_beta(p.monthly(sp, d).filter("asset = 'R'"), _fx(sp, d).cross("A", "N"), 12, 12.0), _fx(sp, d).forward_premium("A", "N", 1.0), 5.0),
}.items():
    register(key, f)

# --- scalar expressions --------------------------------------------------------------------------------------

register("format_strings", lambda sp, d: p.monthly_returns(sp, d).select("ts", "asset", x.percent_text(F.round("value", 6), 4).alias("percent"), x.date_text(F.col("ts"), "yyyyMMdd").alias("day"), F.concat(F.year("ts").cast("string"), F.lit("Q"), F.quarter("ts").cast("string")).alias("quarter")), s.q(s.PX, s.ME, s.MR, "SELECT ts, asset, printf('%.4f%%', round(value, 6) * 100) AS percent, strftime(ts, '%Y%m%d') AS day, concat(year(ts), 'Q', quarter(ts)) AS quarter FROM mr"))
register("date_functions", lambda sp, d: p.px(sp, d).select("ts").distinct().select("ts", F.weekday("ts").alias("weekday"), x.is_leap(F.year("ts")).alias("leap"), x.month_days(F.year("ts"), F.month("ts")).alias("days"), x.shift_year(F.col("ts")).alias("next_year")), s.q(s.PX, "SELECT DISTINCT ts, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, (year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0)) AS leap, CAST(day(last_day(ts)) AS INTEGER) AS days, CAST(ts + INTERVAL 12 MONTH AS DATE) AS next_year FROM px"))
register("signal_map_laplace", lambda sp, d: p.monthly_returns(sp, d).withColumn("value", x.laplace_weight(F.col("value"), 0.0, 0.1)), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, CASE WHEN value < 0 THEN {s.r('exp(value / 0.1) - 1')} ELSE {s.r('1 - exp(-value / 0.1)')} END AS value FROM mr"))
register("signal_map_normal", lambda sp, d: p.monthly_returns(sp, d).withColumn("value", x.normal_weight(F.col("value"), 0.0, 0.1)))
register("signal_map_exp_tail", lambda sp, d: p.monthly_returns(sp, d).withColumn("value", x.exp_tail_weight(F.col("value") * 40, 0.01, 0.05, 0.5, 0.3, 1.0, 2.0, 3.0)), s.q(s.PX, s.ME, s.MR, "v40 AS (SELECT ts, asset, value * 40 AS value FROM mr)", f"SELECT ts, asset, {s.r(s.EXP_TAIL)} AS value FROM v40"))

# --- figures and reports -------------------------------------------------------------------------------------

_XY = (s.PX, s.BENCH, s.calendar("ME"), s.asof("px", "cal", "m"), s.asof("bench", "cal", "bm"), s.MR, s.REGIME, "xy AS (SELECT mr.ts, asset, value AS y, x FROM mr JOIN reg ON reg.ts = mr.ts)")
_IQR = "value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
register("figure_box", lambda sp, d: figures.box(p.read(sp, d, "events").select("event_type", "value"), "value", "event_type"), s.q("q AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)", f"SELECT q.event_type, any_value(n) AS n, {s.r('any_value(mean)')} AS mean, {s.r('any_value(q1)')} AS q1, {s.r('any_value(md)')} AS median, {s.r('any_value(q3)')} AS q3, {s.r(f'min(value) FILTER ({_IQR})')} AS low, {s.r(f'max(value) FILTER ({_IQR})')} AS high FROM events JOIN q ON q.event_type = events.event_type GROUP BY 1"))
register("figure_error_bars", lambda sp, d: figures.error_bars(p.read(sp, d, "events"), "value", "event_type"), f"SELECT event_type, {s.r('avg(value)')} AS mean, {s.r('stddev_samp(value) / sqrt(count(value))')} AS error FROM events GROUP BY 1")
register("figure_density", lambda sp, d: figures.density(p.monthly_returns(sp, d), 20), s.q(s.PX, s.ME, s.MR, "z AS (SELECT asset, min(value) AS lo, max(value) AS hi, stddev_samp(value) * count(*) ** (-0.2::DOUBLE) AS h, count(*) AS n FROM mr GROUP BY 1), gr AS (SELECT asset, h, n, lo + i * (hi - lo) / 19 AS x FROM z, range(20) t(i))", f"SELECT mr.asset, {s.r('x')} AS x, {s.r('sum(exp(-0.5 * ((x - value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS y FROM mr JOIN gr ON gr.asset = mr.asset GROUP BY mr.asset, x"))
register("figure_histogram_2d", lambda sp, d: figures.histogram_2d(_xy(sp, d), "x", "y", (-1.0, 1.0, -1.0, 1.0), 8), s.q(*_XY, "SELECT CAST(least(floor((x + 1) / 0.25), 7) AS INTEGER) AS ix, CAST(least(floor((y + 1) / 0.25), 7) AS INTEGER) AS iy, count(*) AS n FROM xy WHERE x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 GROUP BY 1, 2"))
register("figure_qq", lambda sp, d: figures.qq(p.monthly_returns(sp, d)))
register("figure_xy_qq", lambda sp, d: figures.xy_qq(p.monthly_returns(sp, d).filter("asset = 'A'"), p.monthly_returns(sp, d).filter("asset = 'N'"), 5), s.q(s.PX, s.ME, s.MR, " UNION ALL ".join(f"SELECT {k / 4}::DOUBLE AS p, {s.r(f'quantile_cont(value, {k / 4}) FILTER (asset = {chr(39)}A{chr(39)})')} AS x, {s.r(f'quantile_cont(value, {k / 4}) FILTER (asset = {chr(39)}N{chr(39)})')} AS y FROM mr" for k in range(5))))
register("figure_scatter", lambda sp, d: figures.scatter(_xy(sp, d), "asset"), s.q(*_XY, "f AS (SELECT asset, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, count(*) AS n, avg(x) AS mx, var_pop(x) AS vx, regr_syy(y, x) AS syy FROM xy GROUP BY 1)", f"SELECT ts, xy.asset, {s.r('x')} AS x, {s.r('y')} AS y, {s.r('a + b * x')} AS fit, {s.r('1.96 * sqrt(syy * (1 - r2) / (n - 2)) * sqrt(1.0::DOUBLE / n + (x - mx) ** 2 / (n * vx))')} AS band FROM xy JOIN f ON f.asset = xy.asset"))
register("figure_stacked", lambda sp, d: figures.stacked(p.w_prio(sp, d)), s.q(s.PRIO, s.WPRIO, f"SELECT ts, asset, {s.r('value')} AS value, {s.r('sum(value) OVER (PARTITION BY ts ORDER BY asset)')} AS top, {s.r('sum(value) OVER (PARTITION BY ts)')} AS total FROM wprio"))
register("figure_legend_stats", lambda sp, d: figures.legend_stats(p.monthly_returns(sp, d)).drop("missing"), s.q(s.PX, s.ME, s.MR, f"SELECT asset, {s.r('arg_min(value, ts)')} AS first, {s.r('avg(value)')} AS avg, {s.r('arg_max(value, ts)')} AS last, {s.r('min(value)')} AS min, {s.r('max(value)')} AS max, {s.r('stddev_samp(value)')} AS std, {s.r('skewness(value)')} AS skew, {s.r('kurtosis(value)')} AS kurt, {s.r('avg(value) / stddev_samp(value)')} AS t_stat FROM mr GROUP BY 1"))
register("figure_top_bottom", lambda sp, d: figures.top_bottom(returns.total_return(p.px_supp(sp, d)).select("asset", F.col("total_return").alias("value")).filter("value is not null"), 5), s.q(s.SUPP, "tr AS (SELECT asset, arg_max(value, ts) / arg_min(value, ts) - 1 AS value FROM supp GROUP BY 1 HAVING count(*) > 1)", f"(SELECT asset, {s.r('tr.value')} AS value, 'top' AS side FROM tr ORDER BY tr.value DESC, asset LIMIT 5) UNION ALL (SELECT asset, {s.r('tr.value')} AS value, 'bottom' AS side FROM tr ORDER BY tr.value, asset LIMIT 5)"))
register("figure_best_worst", lambda sp, d: figures.best_worst(p.px(sp, d), "ME", 3), s.q(s.PX, s.ME, s.MR, "n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY value DESC, ts) AS b, row_number() OVER (PARTITION BY asset ORDER BY value, ts) AS w FROM mr)", f"SELECT ts, asset, {s.r('value')} AS value, CASE WHEN b <= 3 THEN 'best' ELSE 'worst' END AS side FROM n WHERE b <= 3 OR w <= 3"))
register("figure_drawdown_paths", lambda sp, d: figures.drawdown_paths(p.monthly(sp, d), 2))
register("figure_quantile_table", lambda sp, d: figures.quantile_table(_xy(sp, d), "x", "y", 4), s.q(*_XY, "e AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM xy)", f"SELECT CASE WHEN x <= a THEN 'Q1' WHEN x <= b THEN 'Q2' WHEN x <= c THEN 'Q3' ELSE 'Q4' END AS bin, count(*) AS n, {s.r('avg(xy.x)')} AS x, {s.r('avg(y)')} AS mean, {s.r('stddev_samp(y)')} AS std FROM xy, e GROUP BY 1"))
register("figure_periodic_table", lambda sp, d: figures.periodic_table(p.px(sp, d), "ME"), s.q(s.PX, s.ME, s.MR, f"SELECT asset, CAST(ts AS VARCHAR) AS period, {s.r('value')} AS value FROM mr UNION ALL SELECT asset, 'Total', {s.r('product(1 + value) - 1')} FROM mr GROUP BY 1"))
register("figure_annual_matrix", lambda sp, d: figures.annual_matrix(p.px(sp, d)), s.q(s.PX, "y AS (SELECT asset, CAST(year(ts) AS INTEGER) AS y, arg_max(value, ts) AS v, max(ts) AS t FROM px GROUP BY 1, 2), z AS (SELECT a.asset, a.y AS first_year, b.y AS last_year, (b.v / a.v) ** (1.0::DOUBLE / (date_diff('day', a.t, b.t) / 365.25::DOUBLE)) - 1 AS v FROM y a JOIN y b ON a.asset = b.asset AND a.y < b.y)", f"SELECT asset, first_year, last_year, {s.r('v')} AS value FROM z"))
register("figure_regime_regressions", lambda sp, d: figures.regime_regressions(p.monthly_returns(sp, d), _bench_returns(sp, d), regimes.quantile_regimes(_bench_returns(sp, d))), s.q(*_XY, f"SELECT xy.asset, regime, {s.r('regr_intercept(y, xy.x)')} AS alpha, {s.r('regr_slope(y, xy.x)')} AS beta, {s.r('regr_r2(y, xy.x)')} AS r2, count(*) AS n FROM xy JOIN reg ON reg.ts = xy.ts GROUP BY 1, 2"))
register("figure_price_history", lambda sp, d: figures.price_history(p.px_supp(sp, d)).withColumn("longest_gap", F.col("longest_gap").cast("long")), s.q(s.SUPP, "g AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY asset ORDER BY ts), ts) AS gap FROM supp)", "SELECT asset, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, max(gap) AS longest_gap FROM g GROUP BY 1"))
register("figure_heat_shades", lambda sp, d: figures.heat_shades(p.monthly_returns(sp, d), "value", 5, "asset"), s.q(s.PX, s.ME, s.MR, f"SELECT ts, asset, {s.r('value')} AS value, CAST(least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 5), 4) AS INTEGER) AS shade FROM mr WINDOW w AS (PARTITION BY asset)"))
register("figure_labels", lambda sp, d: figures.labels(pf.ra_perf_table(p.px(sp, d))))


def _prio_groups(sp: SparkSession, d: str) -> DataFrame:
    return p.w_prio(sp, d).select("asset").distinct().withColumn("grp", F.when(F.col("asset") < "3", "high").otherwise("low"))


def _prio_bench(sp: SparkSession, d: str) -> DataFrame:
    return p.px_prio(sp, d).groupBy("ts").agg(F.avg("value").alias("value")).select("ts", F.lit("bench").alias("asset"), "value")


def _two(sp: SparkSession, d: str) -> DataFrame:
    a = p.w_prio(sp, d).withColumn("portfolio", F.lit("a"))
    b = weights.equal_weight(p.w_prio(sp, d)).withColumn("portfolio", F.lit("b"))
    return portfolio.backtest(p.px_prio(sp, d), a.unionByName(b).select("portfolio", "ts", "asset", "value"))


#: A monthly factsheet has the monthly tables above, and quarterly ones of the same form.
_QUARTERLY = {key: SQL[key].replace(s.calendar("ME"), s.calendar("QE")).replace("sqrt(12.0::DOUBLE)", "sqrt(4.0::DOUBLE)") for key in ("regime_sharpe", "figure_periodic_table", "figure_scatter")}
_SHEET_SQL = {"performance": SQL["ra_perf_table"], "regimes": _QUARTERLY["regime_sharpe"], "correlation": SQL["corr_pairs"], "rolling_sharpe": SQL["rolling_sharpe"], "periods": _QUARTERLY["figure_periodic_table"], "scatter": _QUARTERLY["figure_scatter"]}
for name in ("performance", "regimes", "correlation", "rolling_sharpe", "periods", "scatter"):
    register(f"factsheet_{name}", lambda sp, d, name=name: reports.factsheet(p.px(sp, d), p.bench(sp, d), "monthly")[name], _SHEET_SQL[name])
for name in ("attribution", "turnover", "performance", "group_exposures"):
    register(f"strategy_factsheet_{name}", lambda sp, d, name=name: reports.strategy(_ledger(sp, d), _prio_groups(sp, d), _prio_bench(sp, d), reports.make_config("monthly"))[name], s.LEDGERS.get(f"strategy_factsheet_{name}"))
for name in ("brinson_totals", "tracking", "ewm_tracking", "active_weights"):
    register(f"strategy_benchmark_{name}", lambda sp, d, name=name: reports.strategy_benchmark(_two(sp, d), "a", "b", _prio_groups(sp, d), reports.make_config("monthly"))[name])
register("multi_strategy_performance", lambda sp, d: reports.multi_strategy(_two(sp, d), _prio_bench(sp, d), reports.make_config("monthly"))["performance"])
register("weight_changes", lambda sp, d: reports.weight_changes(_ledger(sp, d)), s.LEDGERS["weight_changes"])

# --- factor models, signals, further risk --------------------------------------------------------------------


def _loadings(sp: SparkSession, d: str) -> DataFrame:
    """Betas of priorities on two factors, on the last date."""
    w = _weights_now(sp, d)
    k = F.substring("asset", 1, 1).cast("double")
    return w.select("ts", "asset", F.lit("f1").alias("factor"), (1 + 0.1 * k).alias("beta")).unionByName(w.select("ts", "asset", F.lit("f2").alias("factor"), (0.5 - 0.1 * k).alias("beta")))


def _factor_cov(sp: SparkSession, d: str) -> DataFrame:
    one = _weights_now(sp, d).select("ts").distinct()
    rows = sp.createDataFrame([("f1", "f1", 0.04), ("f1", "f2", 0.01), ("f2", "f1", 0.01), ("f2", "f2", 0.02)], "asset_i string, asset_j string, cov double")
    return one.crossJoin(F.broadcast(rows)).select("ts", "asset_i", "asset_j", "cov")


def _residual(sp: SparkSession, d: str) -> DataFrame:
    return _weights_now(sp, d).select("ts", "asset", (0.01 * F.substring("asset", 1, 1).cast("double")).alias("var"))


_FACTOR = (s.PRIO, s.WPRIO, "wn AS (SELECT ts, asset, value AS w, CAST(asset[1] AS DOUBLE) AS k FROM wprio WHERE ts = (SELECT max(ts) FROM wprio)), e AS (SELECT any_value(ts) AS ts, sum(w * (1 + 0.1 * k)) AS e1, sum(w * (0.5 - 0.1 * k)) AS e2, sum(w * w * 0.01 * k) AS rv FROM wn)")
def _moving(sp: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loadings by quarter ends, returns of two factors (the mean of all assets, a rate) and monthly returns."""
    r = p.monthly_returns(sp, d)
    at = r.filter(F.month("ts") % 3 == 0).select("ts", "asset")
    beta = lambda f, b: at.select("ts", "asset", F.lit(f).alias("factor"), b.alias("beta"))
    loadings = beta("market", 1 + 0.01 * F.month("ts")).unionByName(beta("rate", 0.5 - 0.02 * F.month("ts")))
    market = r.groupBy("ts").agg(F.avg("value").alias("value")).select("ts", F.lit("market").alias("asset"), "value")
    return loadings, market.unionByName(p.rate(sp, d)), r


def _alpha_sql(lag: int) -> str:
    """al: returns less what loadings known before explain."""
    return (
        f"dt AS (SELECT ts, lag(ts, {lag}) OVER (ORDER BY ts) AS known FROM (SELECT DISTINCT ts FROM mr)), ld AS (SELECT DISTINCT ts, 1 + 0.01 * month(ts) AS b1, 0.5 - 0.02 * month(ts) AS b2 FROM mr WHERE month(ts) % 3 = 0), "
        "bt AS (SELECT dt.ts, arg_max(b1, ld.ts) AS b1, arg_max(b2, ld.ts) AS b2 FROM dt LEFT JOIN ld ON ld.ts <= dt.known GROUP BY 1), "
        "al AS (SELECT mr.ts, mr.asset, mr.value - (b1 * f.m + b2 * rate.value) AS alpha, b1 * f.m + b2 * rate.value AS explained FROM mr JOIN bt ON bt.ts = mr.ts JOIN (SELECT ts, avg(value) AS m FROM mr GROUP BY 1) f ON f.ts = mr.ts JOIN rate ON rate.ts = mr.ts)"
    )


for lag in (0, 1):
    register(f"factor_alpha_lag{lag}", lambda sp, d, lag=lag: risk.factor_alpha(*_moving(sp, d), lag=lag), s.q(s.PX, s.ME, s.MR, s.RATE, _alpha_sql(lag), f"SELECT ts, asset, {s.r('alpha')} AS alpha, {s.r('explained')} AS explained FROM al"))
register("ewm_covariance", lambda sp, d: ewm.covariance_tensor(p.monthly_returns(sp, d), 12, every=12), s.EWM_COV)
register("realised_tracking_error", lambda sp, d: risk.realised_tracking_error(p.monthly(sp, d), cal.resample_last(p.bench(sp, d), "ME"), 12, 12.0), s.REALISED_TE)
register(
    "residual_correlations", lambda sp, d: risk.residual_correlations(*_moving(sp, d), span=12),
    s.q(s.PX, s.ME, s.MR, s.RATE, _alpha_sql(0), "an AS (SELECT * FROM al WHERE alpha IS NOT NULL)", s.weighted_products("an", "alpha", "rc", 12), "lc AS (SELECT * FROM rc WHERE ts = (SELECT max(ts) FROM rc))", "rr AS (SELECT a.i, a.j, a.c / sqrt(x.c * y.c) AS corr FROM lc a JOIN lc x ON x.i = a.i AND x.j = a.i JOIN lc y ON y.i = a.j AND y.j = a.j)", f"SELECT i AS asset_i, j AS asset_j, {s.r('corr')} AS corr, {s.r('0.5 * avg(corr - CASE WHEN i = j THEN 1 ELSE 0 END) OVER (PARTITION BY i)')} AS mean_corr FROM rr"),
)
register("factor_exposures", lambda sp, d: risk.factor_exposures(_loadings(sp, d), _weights_now(sp, d)), s.q(*_FACTOR, f"SELECT ts, 'f1' AS asset, {s.r('e1')} AS value FROM e UNION ALL SELECT ts, 'f2', {s.r('e2')} FROM e"))
register("factor_risk", lambda sp, d: risk.factor_risk(_loadings(sp, d), _factor_cov(sp, d), _residual(sp, d), _weights_now(sp, d)), s.q(*_FACTOR, "v AS (SELECT ts, 0.04::DOUBLE * e1 * e1 + 0.02 * e1 * e2 + 0.02 * e2 * e2 AS sv, rv FROM e)", f"SELECT ts, {s.r('sqrt(sv)')} AS systematic, {s.r('sqrt(rv)')} AS residual, {s.r('sqrt(sv + rv)')} AS total FROM v"))
register("factor_contributions", lambda sp, d: risk.factor_contributions(_loadings(sp, d), _factor_cov(sp, d), _residual(sp, d), _weights_now(sp, d)), s.q(*_FACTOR, "v AS (SELECT ts, e1 * (0.04::DOUBLE * e1 + 0.01 * e2) AS a, e2 * (0.01::DOUBLE * e1 + 0.02 * e2) AS b, rv FROM e)", f"SELECT ts, 'f1' AS factor, {s.r('a / (a + b + rv)')} AS value FROM v UNION ALL SELECT ts, 'f2', {s.r('b / (a + b + rv)')} FROM v UNION ALL SELECT ts, 'idiosyncratic', {s.r('rv / (a + b + rv)')} FROM v"))
register("marginal_active_risk", lambda sp, d: risk.marginal_active_risk(_loadings(sp, d), _factor_cov(sp, d), _residual(sp, d), _weights_now(sp, d), _equal(sp, d)), s.MARGINAL_ACTIVE)
register("group_tracking_error", lambda sp, d: risk.group_tracking_error(_cov(sp, d), _weights_now(sp, d), _equal(sp, d), _prio_groups(sp, d)), s.q(*_COV, "gg AS (SELECT *, CASE WHEN asset < '3' THEN 'high' ELSE 'low' END AS grp FROM wn)", f"SELECT (SELECT max(ts) FROM prio) AS ts, a.grp, {s.r('sqrt(greatest(sum(a.d * c * b.d), 0))')} AS value FROM cv JOIN gg a ON a.asset = i JOIN gg b ON b.asset = j AND b.grp = a.grp GROUP BY 2"))
register("benchmark_loadings", lambda sp, d: risk.benchmark_loadings(_cov(sp, d), _equal(sp, d)), s.q(*_COV, "z AS (SELECT i AS asset, sum(c * b.q) AS s FROM cv JOIN wn b ON b.asset = j GROUP BY 1), v AS (SELECT sum(a.q * c * b.q) AS v FROM cv JOIN wn a ON a.asset = i JOIN wn b ON b.asset = j)", f"SELECT (SELECT max(ts) FROM prio) AS ts, asset, {s.r('s / v')} AS value FROM z, v"))
register("independent_var", lambda sp, d: risk.independent_var(returns.to_returns(p.px_prio(sp, d)).filter("value is not null"), p.w_prio(sp, d), 12), s.INDEPENDENT_VAR)
register("information_ratio", lambda sp, d: risk.information_ratio(p.monthly_returns(sp, d), 12.0), s.q(s.PX, s.ME, s.MR, f"SELECT asset, {s.r('stddev_samp(value) * sqrt(12.0::DOUBLE)')} AS te, {s.r('avg(value) * sqrt(12.0::DOUBLE) / stddev_samp(value)')} AS ir FROM mr GROUP BY 1"))
register("signal_changes", lambda sp, d: co.ols(signals.signal_changes(p.px_prio(sp, d), p.w_prio(sp, d)), "asset"), s.q(s.PRIO, s.WPRIO, "c AS (SELECT prio.asset, prio.value - lag(prio.value) OVER w AS x, wprio.value - lag(wprio.value) OVER w AS y FROM prio JOIN wprio ON wprio.ts = prio.ts AND wprio.asset = prio.asset WINDOW w AS (PARTITION BY prio.asset ORDER BY prio.ts))", f"SELECT asset, {s.r('regr_intercept(y, x)')} AS alpha, {s.r('regr_slope(y, x)')} AS beta, {s.r('regr_r2(y, x)')} AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM c GROUP BY 1"))
register("current_signal_by_group", lambda sp, d: signals.current_by_group(p.px_supp(sp, d), p.groups(sp, d)), s.q(s.SUPP, s.GROUPS, f"SELECT supp.asset, {s.r('arg_max(value, ts)')} AS value, any_value(grp) AS grp FROM supp JOIN g ON g.asset = supp.asset GROUP BY 1"))
_SCORES = "z AS (SELECT ts, asset, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS a, value / max(value) OVER w AS b FROM supp WINDOW w AS (PARTITION BY ts))"
register("composite_score", lambda sp, d: weights.composite_score([weights.cross_score(p.px_supp(sp, d)), weights.max_score(p.px_supp(sp, d))]), s.q(s.SUPP, _SCORES, f"SELECT ts, asset, {s.r('CASE WHEN a IS NULL THEN b ELSE (a + b) / 2 END')} AS value FROM z"))
register("select_top", lambda sp, d: weights.select_top([weights.max_score(p.px_supp(sp, d)), p.px_supp(sp, d).withColumn("value", -F.col("value"))], 0.4), s.q(s.SUPP, "z AS (SELECT ts, asset, value / max(value) OVER (PARTITION BY ts) AS a, -value AS b FROM supp), e AS (SELECT ts, quantile_cont(a, 0.4) AS ea, quantile_cont(b, 0.4) AS eb FROM z GROUP BY 1)", "SELECT z.ts, asset FROM z JOIN e ON e.ts = z.ts WHERE a >= ea AND b >= eb"))
register("backfill_prices", lambda sp, d: panel.backfill_prices(p.monthly(sp, d).filter("ts >= date '1996-01-01'"), p.monthly(sp, d).filter("ts < date '1996-02-01'").withColumn("value", F.col("value") * 2)), s.q(s.PX, s.ME, "nw AS (SELECT * FROM m WHERE ts >= DATE '1996-01-01'), od AS (SELECT ts, asset, value * 2 AS value FROM m WHERE ts < DATE '1996-02-01'), f AS (SELECT asset, min(ts) AS t, arg_min(value, ts) AS v FROM nw GROUP BY 1), a AS (SELECT od.asset, arg_max(od.value, od.ts) AS o FROM od JOIN f ON f.asset = od.asset AND od.ts <= f.t GROUP BY 1)", f"SELECT ts, asset, {s.r('value')} AS value FROM nw UNION ALL SELECT od.ts, od.asset, {s.r('od.value * f.v / a.o')} FROM od JOIN f ON f.asset = od.asset JOIN a ON a.asset = od.asset WHERE od.ts < f.t"))
register("append_series", lambda sp, d: panel.append_series(p.monthly(sp, d).filter("ts >= date '1996-01-01'"), p.monthly(sp, d).filter("ts < date '1996-06-01'")), s.q(s.PX, s.ME, f"SELECT ts, asset, {s.r('value')} AS value FROM m"))
register("fixed_maturity_rolls", lambda sp, d: cal.roll_schedule(p.px(sp, d).select("ts").distinct(), cal.schedule(cal.date_range(p.px(sp, d)), "Q-3FRI"), 5), s.q(s.PX, s.calendar("Q-3FRI"), "SELECT px.ts, min(cal.ts) AS expiry FROM (SELECT DISTINCT ts FROM px) px JOIN cal ON date_diff('day', px.ts, cal.ts) >= 5 GROUP BY 1"))
register("train_live_samples", lambda sp, d: cal.train_live(cal.schedule(cal.date_range(p.px(sp, d)), "QE"), 4), s.q(s.PX, s.calendar("QE"), "z AS (SELECT lag(ts, 4) OVER w AS start, ts AS train_end, lead(ts) OVER w AS live_end FROM cal WINDOW w AS (ORDER BY ts))", "SELECT * FROM z WHERE start IS NOT NULL AND live_end IS NOT NULL"))
register("net_nav_of_prices", lambda sp, d: returns.net_of_fees(returns.to_returns(p.monthly(sp, d), zero_first=True), 0.01, 0.1, "QE"), s.RECURSIONS["net_nav_of_prices"])

# --- streams: the events table read as a stream to its end ---------------------------------------------------


def _stream(sp: SparkSession, d: str) -> DataFrame:
    schema = p.read(sp, d, "events").schema
    return sp.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), "value")


def drained(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, into files of the shared folder, and reads them.

    Every partition has a state store, opened and written for every batch: there are two of them a core at most.
    Rows are narrow, so Arrow batches may have more of them than those of texts (see session.BATCHES).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    parts = "spark.sql.shuffle.partitions"
    settings = {parts: min(int(spark.conf.get(parts)), 2 * spark.sparkContext.defaultParallelism), "spark.sql.execution.arrow.maxRecordsPerBatch": 1 << 16}
    own = {k: spark.conf.get(k) for k in settings}
    try:  # a stream keeps the settings that it starts with
        for k, v in settings.items():
            spark.conf.set(k, v)
        run = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


register("stream_bars", lambda sp, d: drained(stateful.bars(_stream(sp, d), "1 day", "1 hour"), "stream_bars").withColumn("ts", F.col("ts").cast("date")), s.q(s.BARS, f"SELECT ts, asset, {', '.join(f'{s.r(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, n FROM bars WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"))
register("stream_ewm", lambda sp, d: drained(stateful.ewm(_stream(sp, d), 20, "1 hour"), "stream_ewm"))
register("stream_drawdown", lambda sp, d: drained(stateful.drawdown(_stream(sp, d), "1 hour"), "stream_drawdown"))
