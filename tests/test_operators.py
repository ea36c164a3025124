"""Boundaries, invariants and independence of row order."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import expressions as x
from strandline.operators import aggregates, calendars, ewm, fx, panel, performance, portfolio, regimes, replay, returns, risk, rolling
from strandline.plans import panels

from .conftest import SF

D = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(10)]


def frame(spark, values, asset="a"):
    return spark.createDataFrame([(d, asset, v) for d, v in zip(D, values, strict=False)], panel.SCHEMA)


def values(df):
    return [r.value for r in df.orderBy("ts").collect()]


def test_returns_mask_missing_and_not_positive_prices(spark):
    assert values(returns.to_returns(frame(spark, [100.0, None, 110.0, -1.0, 121.0]))) == [None, None, pytest.approx(0.1), None, pytest.approx(-122.0)]
    assert values(returns.to_returns(frame(spark, [100.0, 110.0]), zero_first=True)) == [0.0, pytest.approx(0.1)]


def test_total_loss_compounds_to_zero(spark):
    assert values(returns.nav(frame(spark, [0.1, -1.0, 0.5]))) == [pytest.approx(1.1), 0.0, 0.0]


def test_total_return_boundaries(spark):
    r = returns.total_return(frame(spark, [None, 100.0, 120.0, None])).first()
    assert r.total_return == pytest.approx(0.2) and r.pa_return == pytest.approx(0.2)
    assert returns.total_return(frame(spark, [100.0])).first().total_return is None


def test_drawdown_episode_edges(spark):
    r = performance.drawdown_episodes(frame(spark, [100.0, 90.0, 95.0, 100.0, 105.0, 84.0, 90.0])).orderBy("position").collect()
    assert [(e.start, e.trough, e.end, e.recovered) for e in r] == [(D[4], D[5], D[6], False), (D[0], D[1], D[3], True)]
    assert [round(e.max_dd, 10) for e in r] == [-0.2, -0.1]


def test_ffill_stays_inside_history(spark):
    assert values(panel.ffill_between(frame(spark, [None, 1.0, None, 2.0, None]))) == [None, 1.0, 1.0, 2.0, None]


def test_rolling_needs_full_windows(spark):
    assert values(rolling.rolling(frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]), 3)) == [None, None, None, None, None, 5.0]


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.5, 3.0, 4.0)], "v double")
    assert [r.bin for r in aggregates.cut(df, "v", [2.0, 3.0], names=["low", "mid", "high"]).collect()] == ["low", "low", "mid", "mid", "high"]


def test_regimes_need_different_edges(spark):
    assert {r.regime for r in regimes.quantile_regimes(frame(spark, [1.0] * 9)).collect()} == {None}


def test_regime_sharpe_is_additive(spark):
    m = panels.monthly_returns(spark, SF)
    reg = regimes.quantile_regimes(m.filter("asset = 'A'"))
    parts = regimes.regime_sharpe(regimes.in_regimes(m, reg), 12.0).groupBy("asset").agg(F.sum("sharpe").alias("s"))
    whole = m.join(reg.filter("regime is not null").select("ts"), "ts").groupBy("asset").agg((math.sqrt(12) * F.avg("value") / F.stddev_samp("value")).alias("w"))
    assert all(r.s == pytest.approx(r.w) for r in parts.join(whole, "asset").collect())


def test_euler_contributions_sum_to_volatility(spark):
    cov = spark.createDataFrame([(D[0], i, j, c) for i, j, c in (("a", "a", 0.04), ("a", "b", 0.01), ("b", "a", 0.01), ("b", "b", 0.09))], "ts date, asset_i string, asset_j string, cov double")
    w = spark.createDataFrame([(D[0], "a", 0.6), (D[0], "b", 0.4)], panel.SCHEMA)
    assert risk.marginal(cov, w).agg(F.sum("value")).first()[0] == pytest.approx(risk.portfolio_vol(cov, w).first().value)
    assert risk.asymmetric(cov).count() == 0
    zero = w.withColumn("value", F.lit(0.0))
    assert [r.value for r in risk.marginal(cov, zero).collect()] == [0.0, 0.0]


def test_lever_inverts_delever(spark):
    r = frame(spark, [0.01, -0.02, 0.03])
    back = returns.lever(returns.delever(r, 0.5, 0.03, 12), 0.5, 0.03, 12)
    assert values(back) == pytest.approx([0.01, -0.02, 0.03])


def test_hedge_identity(spark):
    """Fully hedged with a zero forward, only the local return and its cross term are left."""
    df = spark.createDataFrame([(0.02, 0.05, 0.0)], "l double, f double, p double")
    assert df.select(fx.hedged_return(F.col("l"), F.col("f"), F.col("p"), 1.0)).first()[0] == pytest.approx(0.02 * 1.05)


def test_shuffled_input_gives_equal_results(spark):
    p = panels.px(spark, SF)
    mixed = p.orderBy(F.rand(3)).repartition(7)
    for f in (returns.to_returns, performance.drawdowns, lambda q: calendars.resample_last(q, "ME"), lambda q: ewm.ewm_mean(q, 10)):
        a, b = ({(r.ts, r.asset): r.value for r in f(q).collect()} for q in (p, mixed))
        assert a.keys() == b.keys() and all((a[i] is None and b[i] is None) or a[i] == pytest.approx(b[i]) for i in a)


def test_weights_are_placed_on_next_price_and_lag_counts_observations(spark):
    prices = spark.createDataFrame([(D[i], "a", 100.0 + i) for i in (0, 2, 4, 6)], panel.SCHEMA)
    w = spark.createDataFrame([("p", D[1], "a", 1.0), ("p", D[4], "a", 0.5), ("p", D[9], "a", 0.1)], "portfolio string, ts date, asset string, value double")
    at = lambda lag: sorted((r.ts, r.value) for r in portfolio.placed_weights(prices, w, lag).collect())
    assert at(0) == [(D[2], 1.0), (D[4], 0.5)] and at(1) == [(D[4], 1.0), (D[6], 0.5)]


def test_contributions_reconcile_with_nav(spark):
    class Buy:
        def on_bar(self, ts, prices, state):
            return [replay.Order("a", 5.0)] if not state.units["a"] and not state.pending else []

    p = frame(spark, [10.0, 11.0, 12.0, 11.5]).withColumn("replay", F.lit("r"))
    fill = replay.FullFill(0.01, 0.002)
    states, trades = (replay.replay_frame(p, lambda n: Buy(), 1000.0, fill, which) for which in ("states", "trades"))
    nav = [r.nav for r in states.orderBy("ts").collect()]
    paid = 5 * 11 * 1.01
    assert nav[1] == pytest.approx(1000 - paid - paid * 0.002 + 55)
    got = [r.v for r in replay.contributions(states, trades, p).groupBy("ts").agg(F.sum("value").alias("v")).orderBy("ts").collect()]
    assert got == pytest.approx([nav[i] / nav[i - 1] - 1 for i in range(1, 4)], abs=1e-11)
    orders = replay.replay_frame(p, lambda n: Buy(), 1000.0, fill, "orders").collect()
    assert [(o.status, o.decision_time, o.fill_time) for o in orders] == [("FILLED", D[0], D[1])]


def test_periods_and_calendars(spark):
    one = spark.createDataFrame([(dt.date(2020, 1, 15), dt.date(2020, 12, 31))], "start date, end date")
    dates = lambda f: [r.ts for r in calendars.schedule(one, f).orderBy("ts").collect()]
    assert dates("QE") == [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)]
    assert dates("Q-3FRI")[0] == dt.date(2020, 3, 20) and dates("M-FRI")[:2] == [dt.date(2020, 1, 31), dt.date(2020, 2, 28)]
    assert len(dates("2ME")) == 6 and dates("SE") == [dt.date(2020, 6, 30), dt.date(2020, 12, 31)]
    assert all(d.weekday() == 2 for d in dates("W-WED")) and all(d.weekday() < 5 for d in dates("B"))
    p = frame(spark, [1.0, 2.0, 3.0, 4.0])
    assert values(calendars.TimePeriod("2020-01-02", "2020-01-03").locate(p)) == [2.0, 3.0]
    assert values(calendars.TimePeriod("2020-01-02", "2020-01-03").fill_outside(p)) == [0.0, 0.0, 0.0, 0.0]
    assert values(calendars.truncate_before(p, "2020-01-03")) == [3.0, 4.0]


def test_text_round_trip(spark):
    df = spark.createDataFrame([(0.1234,), (None,), (-1.5,)], "v double")
    out = df.select(x.percent_text(F.col("v")).alias("p"), x.number_text(F.col("v"), 1, True).alias("n")).select("p", "n", x.text_number(F.col("p")).alias("b")).collect()
    assert [(r.p, r.b) for r in out] == [("12.34%", 0.1234), ("", None), ("-150.00%", -1.5)]


def test_outside_normal_quantile_and_weight(spark):
    from strandline.operators.figures import normal_quantile

    df = spark.createDataFrame([(0.001,), (0.025,), (0.5,), (0.975,)], "p double")
    assert [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()] == pytest.approx([-3.0902323, -1.9599640, 0.0, 1.9599640], abs=1e-6)
    assert spark.createDataFrame([(1.959964,)], "v double").select(x.normal_weight(F.col("v"))).first()[0] == pytest.approx(0.95, abs=1e-6)


def test_containers(spark):
    from strandline.functions import containers as c

    assert c.intersection("abc", "cxb") == ["c", "b"] and c.difference("abc", "cxb") == ["x"] and c.union("ab", "bc") == ["a", "b", "c"]
    assert list(c.flat({"a": [1, (2, "xy")], "b": 3})) == [1, 2, "xy", 3] and c.first_to([1, 2, 3], 3) == [3, 1, 2]
    assert c.repeated("abca") == ["a"] and c.number_in("A3") == (3, "A") and c.halves({1: 1, 2: 2, 3: 3}) == ({1: 1, 2: 2}, {3: 3})
    assert c.Dots(a=1).a == 1 and c.by_name(c.ValueType, "percent") is c.ValueType.PERCENT
    for bad in (lambda: c.require_subset("ab", "c"), lambda: c.require_unique("aa")):
        with pytest.raises(ValueError):
            bad()
    df = c.Shown("Return", c.ValueType.PERCENT).tag(spark.createDataFrame([("a", 0.5)], "asset string, r double"), "r")
    assert c.text_table(c.as_text(df)).split() == ["asset", "Return", "a", "50.00%"]


def test_append_and_overlap(spark):
    new, old = frame(spark, [1.0, 2.0, 3.0]), frame(spark, [9.0, 2.5]).unionByName(spark.createDataFrame([(D[8], "a", 7.0)], panel.SCHEMA))
    assert values(panel.append_series(new, old)) == [1.0, 2.0, 3.0, 7.0]
    r = panel.overlap_difference(new, old).first()
    assert (r.max_diff, r.n_overlap) == (8.0, 2)
    assert panel.duplicates(new.unionByName(old)).count() == 2
