"""Order-driven replay: orders decided on one bar are filled on the next; one group a replay."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    ticker: str
    quantity: float
    reason: str = ""

    def __post_init__(self) -> None:
        if not math.isfinite(self.quantity) or self.quantity == 0:
            raise ValueError("an order needs a finite quantity other than zero")


@dataclass(frozen=True)
class Trade:
    ticker: str
    quantity: float
    reference: float
    executed: float
    cost: float


@dataclass(frozen=True)
class State:
    """What a strategy sees after the bar's fills."""

    ts: object
    cash: float
    nav: float
    units: dict[str, float] = field(default_factory=dict)
    pending: Sequence[Order] = ()


class Strategy(Protocol):
    def on_bar(self, ts: object, prices: dict[str, float], state: State) -> Sequence[Order]: ...


class Execution(Protocol):
    def fill(self, order: Order, price: float) -> Trade | None: ...


@dataclass(frozen=True)
class FullFill:
    """Everything at the reference price, moved by slippage, with a cost on the traded value."""

    slippage: float = 0.0
    cost: float = 0.0

    def fill(self, order: Order, price: float) -> Trade | None:
        executed = price * (1 + math.copysign(self.slippage, order.quantity))
        return Trade(order.ticker, order.quantity, price, executed, abs(order.quantity * executed) * self.cost)


@dataclass
class Ledgers:
    orders: list[dict]
    trades: list[dict]
    states: list[dict]


def replay(dates: Sequence, tickers: Sequence[str], prices: np.ndarray, strategy: Strategy, cash: float, execution: Execution) -> Ledgers:
    """Fill what is pending, mark, show the state, ask the strategy, queue its orders. An order without a price waits; at the end it is unfilled."""
    out, units, last, pending = Ledgers([], [], []), dict.fromkeys(tickers, 0.0), {}, []
    for i, ts in enumerate(dates):
        now = {t: float(p) for t, p in zip(tickers, prices[i], strict=True) if np.isfinite(p)}
        last |= now
        waiting = []
        for number, order in pending:
            trade = execution.fill(order, now[order.ticker]) if order.ticker in now else None
            if trade is None:
                waiting.append((number, order))
                continue
            units[order.ticker] += trade.quantity
            cash -= trade.quantity * trade.executed + trade.cost
            out.orders[number] |= {"status": "FILLED", "fill_time": ts}
            out.trades.append({"order_id": number, "ts": ts, "asset": trade.ticker, "quantity": trade.quantity, "reference": trade.reference, "executed": trade.executed, "cost": trade.cost})
        pending = waiting
        nav = cash + sum(u * last.get(t, 0.0) for t, u in units.items())
        out.states.append({"ts": ts, "cash": cash, "nav": nav, "units": dict(units)})
        for order in strategy.on_bar(ts, dict(now), State(ts, cash, nav, dict(units), tuple(o for _, o in pending))):
            if order.ticker not in units:
                raise ValueError(f"unknown ticker {order.ticker}")
            out.orders.append({"order_id": len(out.orders), "decision_time": ts, "asset": order.ticker, "quantity": order.quantity, "reason": order.reason, "status": "PENDING", "fill_time": None})
            pending.append((len(out.orders) - 1, order))
    for number, _ in pending:
        out.orders[number]["status"] = "UNFILLED"
    return out


SCHEMAS = {
    "orders": "replay string, order_id int, decision_time date, asset string, quantity double, reason string, status string, fill_time date",
    "trades": "replay string, order_id int, ts date, asset string, quantity double, reference double, executed double, cost double",
    "states": "replay string, ts date, cash double, nav double, units map<string,double>",
}


def replay_frame(prices: DataFrame, make: Callable[[str], Strategy], cash: float = 1e6, execution: Execution | None = None, ledger: str = "states") -> DataFrame:
    """One ledger of every replay. prices: replay, ts, asset, value; make gives the strategy of a replay's name."""
    execution, columns = execution or FullFill(), [c.split()[0] for c in SCHEMAS[ledger].split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = g["replay"].iloc[0]
        wide = g.pivot(index="ts", columns="asset", values="value").sort_index()
        found = replay(list(wide.index), list(wide.columns), wide.to_numpy(float), make(name), cash, execution)
        return pd.DataFrame([{"replay": name} | row for row in getattr(found, ledger)], columns=columns)

    return prices.groupBy("replay").applyInPandas(run, SCHEMAS[ledger])


def daily_positions(states: DataFrame) -> DataFrame:
    """replay, ts, asset, units, nav from the states' maps."""
    return states.select("replay", "ts", "nav", F.explode("units").alias("asset", "units"))


def contributions(states: DataFrame, trades: DataFrame, prices: DataFrame) -> DataFrame:
    """replay, ts, asset, value: held profit, fill-to-mark profit and cost over yesterday's NAV; sums to the NAV's return."""
    from pyspark.sql import Window

    pos = daily_positions(states).join(prices.withColumnRenamed("value", "price"), ["replay", "ts", "asset"], "left")
    w = Window.partitionBy("replay", "asset").orderBy("ts")
    pos = pos.withColumn("price", F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.coalesce(F.lag("units").over(w) * (F.col("price") - F.lag("price").over(w)), F.lit(0.0))
    pos = pos.withColumn("held", held).withColumn("before", F.lag("nav").over(w))
    filled = trades.groupBy("replay", "ts", "asset").agg(F.sum(F.col("quantity") * F.col("executed")).alias("paid"), F.sum("quantity").alias("q"), F.sum("cost").alias("c"))
    both = pos.join(filled, ["replay", "ts", "asset"], "left").fillna(0.0, ["paid", "q", "c"])
    return both.select("replay", "ts", "asset", F.try_divide(F.col("held") + F.col("q") * F.col("price") - F.col("paid") - F.col("c"), F.col("before")).alias("value")).filter("value is not null")
