"""Files, the synthetic market, and streams against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import performance, returns, rolling
from strandline.sources import files, synthetic
from strandline.streaming import stateful


def test_csv_parquet_and_keys(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.5), (dt.date(2020, 1, 2), "b", None)], "ts date, asset string, value double")
    files.save(df, str(tmp_path / "c"), "csv")
    assert sorted(files.load_panel_csv(spark, str(tmp_path / "c")).collect()) == sorted(df.collect())
    files.save_keyed({"x": df, "y": df.filter("asset = 'a'")}, str(tmp_path / "k"))
    back = files.load_keyed(spark, str(tmp_path / "k"))
    assert {k: v.count() for k, v in back.items()} == {"x": 2, "y": 1}
    assert any(f.endswith("key=x") for f in files.list_files(spark, str(tmp_path / "k")))


@pytest.mark.parametrize("keep,value", [("last", 9.0), ("first", 1.0)])
def test_upsert(spark, tmp_path, keep, value):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    files.save(old, str(tmp_path / "u"))
    files.update(spark, spark.createDataFrame([(1, 9.0), (3, 3.0)], "k int, v double"), str(tmp_path / "u"), ["k"], keep)
    assert {r.k: r.v for r in files.load(spark, str(tmp_path / "u")).collect()} == {1: value, 2: 2.0, 3: 3.0}


def test_feather(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0)], "k int, v double")
    files.save_feather(df, str(tmp_path / "f"))
    files.append_feather(spark, spark.createDataFrame([(2, 2.0)], "k int, v double"), str(tmp_path / "f"), ["k"])
    assert files.load_feather(spark, str(tmp_path / "f")).count() == 2


def test_synthetic_market_is_seeded_and_has_its_defects(spark):
    a = synthetic.prices(spark, end="2007-12-31")
    b = synthetic.prices(spark, end="2007-12-31")
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    n = {r.asset: r.n for r in a.groupBy("asset").agg(F.count("value").alias("n")).collect()}
    assert n["EQ_A"] > n["EQ_B"] > n["EQ_C"] and n["AL_B"] < 40
    assert performance.ra_perf_table(a).count() == 9
    bench = synthetic.benchmark(a, {"EQ_A": 0.6, "BD_A": 0.4})
    assert returns.total_return(bench).first().first_value == pytest.approx(100.0)


def ticks(spark, tmp_path, rows):
    path = str(tmp_path / "ticks")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "ts timestamp, asset string, value double").coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema("ts timestamp, asset string, value double").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def finished(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


T = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i) for i in range(40)]


def test_streaming_ewm_and_drawdown_take_late_rows_in_order(spark, tmp_path):
    data = [(t, "a", 100.0 + (i * 7) % 11) for i, t in enumerate(T)]
    mixed = [data[:10] + [data[11]], [data[10], *data[12:25]], data[25:]]
    got = {r.ts: r.value for r in finished(spark, stateful.ewm(ticks(spark, tmp_path, mixed), 5, "30 minutes"), "ewm_out").collect()}
    s = None
    for t, _, v in data:
        s = v if s is None else (1 - 2 / 6) * s + 2 / 6 * v
        if t in got:
            assert got[t] == pytest.approx(s)
    assert len(got) >= 30
    dd = finished(spark, stateful.drawdown(ticks(spark, tmp_path / "d", mixed), "30 minutes"), "dd_out").collect()
    assert all(r.value <= 0 and r.peak >= 100 for r in dd)


def test_streaming_bars_equal_batch(spark, tmp_path):
    data = [(t, "a", 100.0 + (i * 7) % 11) for i, t in enumerate(T)]
    live = {r.ts: tuple(r) for r in finished(spark, stateful.bars(ticks(spark, tmp_path, [data[:20], data[20:]]), "1 hour", "10 minutes"), "bars_out").collect()}
    batch = {r.ts: tuple(r) for r in rolling.bars(spark.createDataFrame(data, "ts timestamp, asset string, value double"), "1 hour").collect()}
    assert live and all(batch[t] == v for t, v in live.items())


def test_drained_streams_stay_out_of_the_driver_and_equal_a_loop(spark, tmp_path):
    """Results are files, not the driver's memory; ties go by value; a peak of zero gives no drawdown instead of an error."""
    from strandline.plans.catalogue import drained

    data = [(T[0] + dt.timedelta(minutes=i // 2), f"a{i % 3}", 0.0 if i < 6 else 100.0 + (i * 7919) % 1009) for i in range(6000)]
    settings = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    live = {name: drained(f(ticks(spark, tmp_path / name, [data])), name) for name, f in (("files_ewm", lambda t: stateful.ewm(t, 5, "30 minutes")), ("files_dd", lambda t: stateful.drawdown(t, "30 minutes")))}
    assert {k: spark.conf.get(k) for k in settings} == settings
    assert all(x.inputFiles() for x in live.values())
    want, state, mark = {"files_ewm": [], "files_dd": []}, {}, data[-1][0] - dt.timedelta(minutes=30)
    for t, a, v in sorted(data, key=lambda r: (r[1], r[0], r[2])):
        if t <= mark:
            s, peak = state.get(a, (v, v))
            s, peak = (s if a not in state else (1 - 2 / 6) * s + 2 / 6 * v), max(peak, v)
            state[a] = s, peak
            want["files_ewm"].append((t, a, s))
            want["files_dd"].append((t, a, peak, v / peak - 1 if peak else None))
    for name, df in live.items():
        got = sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])
        assert [r[:2] for r in got] == [r[:2] for r in sorted(want[name], key=lambda r: r[:2])]
        short = lambda rows: sorted((*r[:2], *("-" if x is None else f"{x:.9f}" for x in r[2:])) for r in rows)
        assert short(got) == short(want[name])
