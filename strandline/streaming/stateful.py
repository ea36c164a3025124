"""Streaming forms: windowed bars with a watermark, EWM state, running drawdown, order replay as a state machine."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions.kernels import decay
from strandline.operators.replay import Execution, FullFill, State, Strategy


def bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour", key: str = "asset") -> DataFrame:
    """open, high, low, close, n in tumbling windows; rows later than the delay are dropped by the watermark."""
    out = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), key)
    out = out.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("ts"), key, "open", "high", "low", "close", "n")


def sliding_mean(ticks: DataFrame, width: str, slide: str, delay: str, key: str = "asset") -> DataFrame:
    out = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), key).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "value", "n")


def sessions(ticks: DataFrame, gap: str, delay: str, key: str = "asset") -> DataFrame:
    out = ticks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "value")


#: Rows of a frame that goes out.
_FRAME = 1 << 17


def _ordered(many: Callable[[tuple, np.ndarray], tuple[tuple, dict]], start: tuple):
    """Rows wait until the watermark has passed them and are then taken in time order (of one time: by value), so that late ones do no harm.

    many: the state and values in order -> the state after them, and columns. Times are microseconds; waiting rows are kept as two arrays.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, core, at = pickle.loads(state.get[0]) if state.exists else (np.empty(0, np.int64), np.empty(0), start, None)
        times, values = [times], [values]
        for f in frames:
            t, v = f["at"].to_numpy(np.int64), f["value"].to_numpy(np.float64)
            late = slice(None) if at is None else t > at
            times.append(t[late])
            values.append(v[late])
        times, values = np.concatenate(times), np.concatenate(values)
        passed = times <= state.getCurrentWatermarkMs() * 1000
        ready = np.flatnonzero(passed)
        ready = ready[np.lexsort((values[ready], times[ready]))]
        out = {"at": times[ready], "asset": key[0]}
        if len(ready):
            core, columns = many(core, values[ready])
            out, at = out | columns, int(times[ready[-1]])
        times, values = times[~passed], values[~passed]
        state.update((pickle.dumps((times, values, core, at)),))
        if len(times):
            state.setTimeoutTimestamp(max(int(times.min()) // 1000, state.getCurrentWatermarkMs()) + 1)
        for i in range(0, len(ready), _FRAME):
            yield pd.DataFrame({c: x if c == "asset" else x[i : i + _FRAME] for c, x in out.items()})

    return run


def _running(f: Callable[[float, float], float], before: float | None, values: np.ndarray) -> np.ndarray:
    """The value after each one; before: that of earlier ones, if there were any."""
    return np.array(list(accumulate(values.tolist(), f, initial=before))[before is not None :])


def _applied(ticks: DataFrame, delay: str, many: Callable, start: tuple, schema: str) -> DataFrame:
    marked = ticks.select("ts", "asset", "value").withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    out = marked.groupBy("asset").applyInPandasWithState(_ordered(many, start), f"at long, asset string, {schema}", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.timestamp_micros("at").alias("ts"), *out.columns[1:])


def ewm(ticks: DataFrame, span: float, delay: str = "0 seconds") -> DataFrame:
    """The EWM mean of each asset, seeded by its first value."""
    d = decay(span)

    def many(core: tuple, values: np.ndarray) -> tuple[tuple, dict]:
        s = _running(lambda s, v: d * s + (1 - d) * v, core[0], values)
        return (float(s[-1]),), {"value": s}

    return _applied(ticks, delay, many, (None,), "value double")


def drawdown(ticks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Running peak and drawdown."""

    def many(core: tuple, values: np.ndarray) -> tuple[tuple, dict]:
        peak = _running(max, core[0], values)
        return (float(peak[-1]),), {"peak": peak, "value": np.divide(values, peak, out=np.full(len(values), np.nan), where=peak != 0) - 1}

    return _applied(ticks, delay, many, (None,), "peak double, value double")


def replay(ticks: DataFrame, strategy: Strategy, cash: float, execution: Execution | None = None, delay: str = "0 seconds") -> DataFrame:
    """Each asset's own book: orders of one tick are filled at the next."""
    execution = execution or FullFill()

    def step(core: tuple, v: float) -> tuple[tuple, dict]:
        name, money, units, pending = core
        for order in pending:
            trade = execution.fill(order, v)
            if trade is not None:
                units += trade.quantity
                money -= trade.quantity * trade.executed + trade.cost
        nav = money + units * v
        pending = tuple(strategy.on_bar(None, {name: v}, State(None, money, nav, {name: units})))
        return (name, money, units, pending), {"cash": money, "units": units, "nav": nav}

    def many(core: tuple, values: np.ndarray) -> tuple[tuple, dict]:
        rows = []
        for v in values.tolist():
            core, row = step(core, v)
            rows.append(row)
        return core, {c: np.array([x[c] for x in rows], np.float64) for c in rows[0]}

    return _applied(ticks, delay, many, ("asset", cash, 0.0, ()), "cash double, units double, nav double")
