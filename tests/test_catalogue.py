"""Every registered query runs; those with SQL give what DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.plans import catalogue

from .conftest import SF


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)[:10] if hasattr(v, "year") else v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = tables.sql(catalogue.SQL[name])
    names, rows = ordered(df.columns, df.collect())
    expected, others = ordered(want.columns, want.fetchall())
    assert names == expected and len(rows) == len(others)
    for a, b in zip(rows, others, strict=True):
        assert all(x == y or isinstance(x, float) and y is not None and abs(x - float(y)) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(df.collect()[0])


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [q for q in sorted(catalogue.SQL) if q.startswith("ohlc_")])
def test_bars_with_prices_of_zero_equal_sql(spark, tmp_path, name):
    """Lows, opens, closes and whole bars of zero: the logarithms are infinite, not missing."""
    bars = {"low": [2.0, 0.0, 3.0], "open": [0.0, 2.0, 3.0], "close": [2.0, 3.0, 0.0], "all": [0.0, 0.0, 0.0], "none": [2.0, 4.0, 3.0]}
    rows = [(f"2024-01-{d:02d} 0{i}:00:00", asset, v if d == 2 else 1.0 + i) for asset, values in bars.items() for d in (1, 2, 3) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df, want = catalogue.QUERIES[name](spark, str(tmp_path)), con.sql(catalogue.SQL[name])
    exact = lambda columns, rows: sorted(tuple((c, str(v)[:10] if hasattr(v, "year") else v if v is None or isinstance(v, str) else str(float(v))) for c, v in sorted(zip(columns, r, strict=True))) for r in rows)
    assert exact(df.columns, df.collect()) == exact(want.columns, want.fetchall())
