"""Schedules, as-of joins, resampling, sample windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import over_asset, running

#: Week days as Spark's next_day takes them.
DAYS = {"MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"}


@dataclass(frozen=True)
class TimePeriod:
    """An inclusive window; either side may be open."""

    start: str | None = None
    end: str | None = None

    def predicate(self, ts: str = "ts") -> Column:
        out = F.lit(True)
        if self.start:
            out = out & (F.col(ts) >= F.lit(self.start).cast("date"))
        if self.end:
            out = out & (F.col(ts) <= F.lit(self.end).cast("date"))
        return out

    def locate(self, panel: DataFrame) -> DataFrame:
        """The rows inside; the predicate reaches the scan."""
        return panel.filter(self.predicate())

    def fill_outside(self, panel: DataFrame, fill: float = 0.0) -> DataFrame:
        """fill at and beyond the bounds."""
        out = F.lit(False)
        if self.start:
            out = out | (F.col("ts") <= F.lit(self.start).cast("date"))
        if self.end:
            out = out | (F.col("ts") >= F.lit(self.end).cast("date"))
        return panel.withColumn("value", F.when(out, F.lit(fill)).otherwise(F.col("value")))

    def shifted(self, start_days: int = 0, end_days: int = 0) -> TimePeriod:
        """Sides moved by days, back if negative; an open side stays open."""
        return TimePeriod(_moved(self.start, start_days), _moved(self.end, end_days))

    def years_to_end(self, n: int) -> TimePeriod:
        """The n years up to the end (29 February counts as the 28th); the same period if the end is open."""
        if not self.end:
            return self
        end = date.fromisoformat(self.end)
        day = 28 if (end.month, end.day) == (2, 29) else end.day
        return TimePeriod(end.replace(year=end.year - n, day=day).isoformat(), self.end)

    def years(self, today: date | None = None) -> float:
        """Length in years of 365 days; an open end is today."""
        if not self.start:
            raise ValueError("the start is open")
        end = date.fromisoformat(self.end) if self.end else today or date.today()
        return (end - date.fromisoformat(self.start)).days / 365.0

    def label(self, separator: str = " - ", next_day: bool = False, pattern: str = "%d%b%Y") -> str:
        """Both sides as text, nothing for an open one; next_day: from the day after the start."""
        sides = (_moved(self.start, int(next_day)), self.end)
        return separator.join(date.fromisoformat(x).strftime(pattern) if x else "" for x in sides)


def _moved(day: str | None, days: int) -> str | None:
    return (date.fromisoformat(day) + timedelta(days)).isoformat() if day else None


def year_to_date(today: date, offset: int = -1) -> TimePeriod:
    """From the last day of the year before to today plus the offset in days."""
    end = today + timedelta(offset)
    return TimePeriod(date(end.year - 1, 12, 31).isoformat(), end.isoformat())


def period_label(panel: DataFrame, separator: str = ":", pattern: str = "ddMMMyyyy") -> DataFrame:
    """label: the first and the last date of a panel, in one row."""
    ends = date_range(panel)
    return ends.select(F.concat(F.date_format("start", pattern), F.lit(separator), F.date_format("end", pattern)).alias("label"))


def with_tail(resampled: DataFrame, panel: DataFrame, agg: str = "last") -> DataFrame:
    """A resampled panel, and one row an asset, on the panel's last date, of what comes after the resampled dates: its last value, sum, avg, min or max."""
    ends = panel.agg(F.max("ts").alias("_last")).crossJoin(resampled.agg(F.max("ts").alias("_done")))
    rest = panel.crossJoin(ends).filter("ts > _done")
    value = F.max_by("value", "ts") if agg == "last" else getattr(F, agg)("value")
    return resampled.select("ts", "asset", "value").unionByName(rest.groupBy("asset").agg(F.max("_last").alias("ts"), value.alias("value")).select("ts", "asset", "value"))


def truncate_before(panel: DataFrame, start: str) -> DataFrame:
    """Rows from start on, and the last row before it if start itself is no row."""
    at = panel.agg(F.coalesce(F.max(F.when(F.col("ts") <= F.lit(start).cast("date"), F.col("ts"))), F.lit(start).cast("date")).alias("_at"))
    return panel.crossJoin(F.broadcast(at)).filter("ts >= _at").drop("_at")


def date_range(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end"))


def schedule(spans: DataFrame, freq: str) -> DataFrame:
    """Dates `ts` of a frequency between `start` and `end` of the one row of spans.

    D, B, W-FRI, ME, QE, SE (half years), YE, M-FRI and Q-FRI (last Friday), Q-3FRI (third Friday of the quarter's last month);
    a leading number takes every n-th.
    """
    n = int("".join(c for c in freq if c.isdigit() and freq.index(c) == 0) or 1)
    name = freq.lstrip("0123456789")
    head, _, tail = name.partition("-")
    day = tail[-3:] if tail[-3:] in DAYS else "FRI"
    month = lambda k: F.explode(F.sequence(F.trunc("start", "month"), F.col("end"), F.expr(f"interval {k} month"))).alias("m")
    if head in ("D", "B"):
        out = spans.select(F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("ts"), "start", "end")
        out = out.filter(F.weekday("ts") < 5) if head == "B" else out
    elif head == "W":
        first = F.next_day(F.date_sub("start", 1), day if tail else "SUN")
        out = spans.select(first.alias("first"), "start", "end").filter("first <= end").select(F.explode(F.sequence("first", "end", F.expr("interval 7 day"))).alias("ts"), "start", "end")
    else:
        out = spans.select(month(1), "start", "end")
        every = {"M": 1, "ME": 1, "Q": 3, "QE": 3, "SE": 6, "Y": 12, "YE": 12}[head]
        out = out.filter(F.month("m") % every == 0)
        ts = F.last_day("m")
        if tail.startswith("3"):
            ts = F.date_add(F.next_day(F.date_sub("m", 1), day), 14)
        elif tail:
            ts = F.date_sub(F.next_day(F.last_day("m"), day), 7)
        out = out.select(ts.alias("ts"), "start", "end").filter("ts between start and end")
    if n > 1:
        out = out.withColumn("_n", F.row_number().over(Window.orderBy("ts"))).filter(F.col("_n") % n == 0)
    return out.select("ts")


def asof_backward(panel: DataFrame, dates: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Each asset's last value at or before each date. The calendar is small: rows find their next date by one broadcast range."""
    assets = panel.select("asset").distinct()
    every = dates.select("ts").distinct().crossJoin(assets).select("ts", "asset", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_mark"))
    rows = panel.select("ts", "asset", "value", F.lit(0).alias("_mark"))
    w = Window.partitionBy("asset").orderBy("ts", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(every).withColumn("value", F.last("value", ignorenulls=True).over(w)).filter("_mark = 1").drop("_mark")
    return out if keep_nulls else out.filter("value is not null")


def asof_forward(dates: DataFrame, observed: DataFrame) -> DataFrame:
    """sched, ts: for each date the first observed date at or after it."""
    marks = dates.select(F.col("ts").alias("at"), F.lit(True).alias("mark")).unionByName(observed.select(F.col("ts").alias("at"), F.lit(False).alias("mark")).distinct())
    w = Window.orderBy("at", F.col("mark").desc()).rowsBetween(0, Window.unboundedFollowing)
    seen = F.first(F.when(~F.col("mark"), F.col("at")), ignorenulls=True).over(w)
    return marks.withColumn("ts", seen).filter("mark and ts is not null").select(F.col("at").alias("sched"), "ts")


def resample_last(panel: DataFrame, freq: str) -> DataFrame:
    """As-of values on a calendar from the first to the last date of the panel; nothing before an asset's first value."""
    return asof_backward(panel, schedule(date_range(panel), freq))


def period_end(ts: Column, freq: str) -> Column:
    """The end of the calendar period that holds a date."""
    if freq in ("ME", "M"):
        return F.last_day(ts)
    if freq in ("QE", "Q"):
        return F.last_day(F.add_months(F.trunc(ts, "quarter"), 2))
    if freq in ("YE", "Y"):
        return F.make_date(F.year(ts), F.lit(12), F.lit(31))
    if freq.startswith("W"):
        return F.next_day(F.date_sub(ts, 1), freq[2:] or "SUN")
    raise ValueError(freq)


def resample_agg(panel: DataFrame, freq: str, agg: str = "sum") -> DataFrame:
    """Calendar buckets: sum, avg, last, min, max, count or product of (1 + value) less 1."""
    v = F.col("value")
    how = {"sum": F.sum(v), "avg": F.avg(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v).cast("double"), "last": F.max_by(v, F.when(v.isNotNull(), F.col("ts"))), "compound": F.product(1 + v) - 1}[agg]
    return panel.groupBy(period_end(F.col("ts"), freq).alias("ts"), "asset").agg(how.alias("value"))


def resample_every(panel: DataFrame, n: int, agg: str = "sum") -> DataFrame:
    """Buckets of n rows counted from the right: ts is a bucket's last date."""
    from_right = F.row_number().over(Window.partitionBy("asset").orderBy(F.col("ts").desc())) - 1
    how = {"sum": F.sum("value"), "avg": F.avg("value"), "last": F.max_by("value", "ts"), "compound": F.product(1 + F.col("value")) - 1}[agg]
    return panel.withColumn("_b", F.floor(from_right / n)).groupBy("asset", "_b").agg(F.max("ts").alias("ts"), how.alias("value")).drop("_b")


def resample_at(panel: DataFrame, dates: DataFrame, agg: str = "sum") -> DataFrame:
    """Aggregates between neighbouring dates; each is closed on the right. Rows after the last date go."""
    cal = dates.select(F.col("ts").alias("to")).distinct().withColumn("since", F.coalesce(F.lag("to").over(Window.orderBy("to")), F.lit("0001-01-01").cast("date")))
    how = {"sum": F.sum("value"), "avg": F.avg("value"), "last": F.max_by("value", "ts"), "compound": F.product(1 + F.col("value")) - 1}[agg]
    return panel.join(F.broadcast(cal), (F.col("ts") > F.col("since")) & (F.col("ts") <= F.col("to"))).groupBy(F.col("to").alias("ts"), "asset").agg(how.alias("value"))


def sample_windows(dates: DataFrame, overlap: int = 0) -> DataFrame:
    """sample, start, end between neighbouring dates; overlap: starts so many dates earlier."""
    w = Window.orderBy("ts")
    return dates.withColumn("start", F.lag("ts", 1 + overlap).over(w)).filter("start is not null").select(F.row_number().over(w).alias("sample"), "start", F.col("ts").alias("end"))


def split_by_windows(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with their sample. Windows are closed on both sides, so a boundary row belongs to two."""
    return panel.join(F.broadcast(windows), F.col("ts").between(F.col("start"), F.col("end")))


def rebase_samples(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample", "asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return samples.withColumn("value", F.try_divide(F.col("value"), F.first("value", ignorenulls=True).over(w)))


def sample_positions(samples: DataFrame) -> DataFrame:
    return samples.withColumn("pos", F.row_number().over(Window.partitionBy("sample", "asset").orderBy("ts")))


def rebalance_flags(panel: DataFrame, freq: str, warmup: int = 0) -> DataFrame:
    """ts, flag: is a date of the panel the first on or after a scheduled one? The first `warmup` flags are off."""
    dates = panel.select("ts").distinct()
    hits = asof_forward(schedule(date_range(panel), freq), dates).select("ts").distinct().withColumn("_n", F.row_number().over(Window.orderBy("ts"))).filter(F.col("_n") > warmup)
    return dates.join(hits, "ts", "left").select("ts", F.col("_n").isNotNull().alias("flag"))


def roll_schedule(dates: DataFrame, expiries: DataFrame, min_days: int = 0) -> DataFrame:
    """ts, expiry: the nearest expiry that is at least min_days away."""
    pairs = dates.join(F.broadcast(expiries.select(F.col("ts").alias("expiry"))), F.datediff("expiry", "ts") >= min_days)
    return pairs.groupBy("ts").agg(F.min("expiry").alias("expiry"))


def train_live(dates: DataFrame, roll: int) -> DataFrame:
    """start, train_end, live_end: each date with `roll` dates of history trains until it and is live until the next."""
    w = Window.orderBy("ts")
    out = dates.select(F.lag("ts", roll).over(w).alias("start"), F.col("ts").alias("train_end"), F.lead("ts").over(w).alias("live_end"))
    return out.filter("start is not null and live_end is not null")


def rates_by_days(rates: DataFrame, dates: DataFrame, lag: int = 1, days: float = 365.0) -> DataFrame:
    """ts, value: an annual rate, lagged on its own grid, as of each date, times the days since the date before; 0 at first."""
    lagged = rates.select("ts", F.lit("rate").alias("asset"), F.lag("value", lag).over(Window.orderBy("ts")).alias("value"))
    on = asof_backward(lagged, dates, keep_nulls=True)
    dt = F.datediff("ts", F.lag("ts").over(over_asset()))
    return on.select("ts", F.coalesce(F.col("value") * dt / days, F.lit(0.0)).alias("value"))


def ffill_calendar(panel: DataFrame, dates: DataFrame) -> DataFrame:
    return asof_backward(panel, dates, keep_nulls=True)


def empty_schedule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ts date")


def observed_at(panel: DataFrame, date: str) -> DataFrame:
    """Each asset's latest observation at or before one date."""
    return panel.filter((F.col("ts") <= F.lit(date).cast("date")) & F.col("value").isNotNull()).groupBy("asset").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def running_count() -> Column:
    return F.count("value").over(running())
