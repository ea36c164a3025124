"""Panels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.calendars import period_end, resample_last
from strandline.operators.returns import to_returns


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    """A sum in whole cents: exact, so it does not depend on the order of rows."""
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def vwap() -> Column:
    return cents("l_extendedprice").cast("double") / (100 * F.sum(F.col("l_quantity").cast("long"))).cast("double")


def px(spark: SparkSession, d: str, by: str = "l_returnflag") -> DataFrame:
    """Volume-weighted daily prices by return flag (or another column of lineitem)."""
    line = read(spark, d, "lineitem")
    return line.groupBy(F.col("l_shipdate").cast("date").alias("ts"), F.col(by).cast("string").alias("asset")).agg(vwap().alias("value"))


def bench(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    return line.groupBy(F.col("l_shipdate").cast("date").alias("ts")).agg(vwap().alias("value")).select("ts", F.lit("bench").alias("asset"), "value")


def px_supp(spark: SparkSession, d: str) -> DataFrame:
    """Month-end prices by supplier: a ragged panel."""
    line = read(spark, d, "lineitem")
    return line.groupBy(period_end(F.col("l_shipdate").cast("date"), "ME").alias("ts"), F.col("l_suppkey").cast("string").alias("asset")).agg(vwap().alias("value"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    """asset (supplier), grp (region)."""
    s, n, r = (read(spark, d, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.select(F.col("s_suppkey").cast("string").alias("asset"), F.col("r_name").alias("grp"))


def px_prio(spark: SparkSession, d: str) -> DataFrame:
    """Mean order value by month end and priority."""
    o = read(spark, d, "orders")
    return o.groupBy(period_end(F.col("o_orderdate").cast("date"), "ME").alias("ts"), F.col("o_orderpriority").alias("asset")).agg((cents("o_totalprice").cast("double") / (100 * F.count("*")).cast("double")).alias("value"))


def w_prio(spark: SparkSession, d: str) -> DataFrame:
    """Share of each priority in a month's order value."""
    o = read(spark, d, "orders")
    s = o.groupBy(period_end(F.col("o_orderdate").cast("date"), "ME").alias("ts"), F.col("o_orderpriority").alias("asset")).agg(cents("o_totalprice").cast("double").alias("s"))
    t = s.groupBy("ts").agg(F.sum("s").alias("t"))
    return s.join(t, "ts").select("ts", "asset", (F.col("s") / F.col("t")).alias("value"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("ts", F.col("event_type").alias("asset"), "value")


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return resample_last(px(spark, d), "ME")


def monthly_returns(spark: SparkSession, d: str, kind: str = "relative") -> DataFrame:
    return to_returns(monthly(spark, d), kind).filter("value is not null")


def rate(spark: SparkSession, d: str) -> DataFrame:
    """A smooth annual rate by month end: 2 % plus 0.1 % for each month of the year."""
    return monthly(spark, d).select("ts").distinct().select("ts", F.lit("rate").alias("asset"), (0.02 + 0.001 * F.month("ts")).alias("value"))
