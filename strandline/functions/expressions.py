"""Column factories: everything here stays inside Catalyst expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

CALENDAR_DAYS, ACT365 = 365.25, 365.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def over_asset(*keys: str, order: str = "ts") -> WindowSpec:
    """The rows of one asset in time order."""
    return Window.partitionBy(*(keys or ("asset",))).orderBy(order)


def running(*keys: str, order: str = "ts") -> WindowSpec:
    return over_asset(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    """The last n rows, the current one included."""
    return over_asset(*keys, order=order).rowsBetween(1 - n, 0)


def finite(x: Column | str, fill: float | None = None) -> Column:
    """NULL (or fill) for NaN and infinities."""
    x = col(x)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    out = F.when(~bad, x)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def ratio(a: Column, b: Column, fill: float | None = None) -> Column:
    """a / b; NULL (or fill) where b is zero."""
    out = F.try_divide(a, b)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL."""
    if low is not None:
        x = F.when(x < low, F.lit(float(low))).otherwise(x)
    return x if high is None else F.when(x > high, F.lit(float(high))).otherwise(x)


def clip_filled(x: Column, low: float, high: float) -> Column:
    """Values out of bounds become NULL instead of the bound."""
    return F.when((x >= low) & (x <= high), x)


def skew_unbiased(x: Column) -> Column:
    """Sample skewness with small-sample correction; needs three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def kurt_unbiased(x: Column) -> Column:
    """Excess kurtosis with small-sample correction; needs four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / (F.greatest(n - 2, F.lit(1.0)) * F.greatest(n - 3, F.lit(1.0))))


def years_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / F.lit(CALENDAR_DAYS)


def per_annum(total: Column, years: Column, annualize_short: bool = False) -> Column:
    """Annual return of a total return: compounded beyond a year, else the total (or the total by years)."""
    short = F.try_divide(total, years) if annualize_short else total
    return F.when(1 + total <= 0, F.lit(None)).when(years > 1, F.pow(1 + total, F.try_divide(F.lit(1.0), years)) - 1).when(years > 0, short).otherwise(F.lit(0.0))


def sampled_vol(r: Column, rows: Column) -> Column:
    """Standard deviation from 20 rows on, root mean square below."""
    return F.when(rows >= 20, F.stddev_samp(r)).otherwise(F.sqrt(F.avg(r * r)))


def sharpe(r: Column, af: float) -> Column:
    return F.try_divide(F.lit(math.sqrt(af)) * F.avg(r), F.stddev_samp(r))


def average_rank(value: Column, *keys: str) -> Column:
    """Ranks from 1 within keys, ties get their mean."""
    own = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def bucket(x: Column, edges: Sequence[Column | float], names: Sequence[str], lowest: bool = True) -> Column:
    """The name of the right-closed interval between neighbouring edges that holds x; the first one holds its left end too."""
    edges = [e if isinstance(e, Column) else F.lit(float(e)) for e in edges]
    out = F.lit(None).cast("string")
    for i in reversed(range(len(names))):
        left = (x >= edges[i]) if lowest and i == 0 else (x > edges[i])
        out = F.when(left & (x <= edges[i + 1]), F.lit(names[i])).otherwise(out)
    return out


def float_ln(x: Column) -> Column:
    """Natural logarithm of a double as floating point has it: -inf at zero, NaN below, where Spark's is NULL."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.ln(x))


def ohlc_variance(kind: str, o: Column, h: Column, low: Column, c: Column, previous: Column | None = None) -> Column:
    """Variance of a bar: parkinson, garman_klass, rogers_satchell or close_to_close; infinite (or NaN) if a price in it is zero."""
    o, h, low, c = (float_ln(x) for x in (o, h, low, c))
    if kind == "parkinson":
        return F.pow(h - low, F.lit(2)) / (4 * math.log(2))
    if kind == "garman_klass":
        return 0.5 * F.pow(h - low, F.lit(2)) - (2 * math.log(2) - 1) * F.pow(c - o, F.lit(2))
    if kind == "rogers_satchell":
        return (h - c) * (h - o) + (low - c) * (low - o)
    if kind == "close_to_close":
        return F.pow(c - float_ln(previous), F.lit(2))
    raise ValueError(kind)


def laplace_weight(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    """Laplace distribution function scaled to [-1, 1]."""
    z = (x - loc) / scale
    return F.when(z < 0, F.exp(z) - 1).otherwise(1 - F.exp(-z))


def exp_tail_weight(x: Column, loc: float = 0.0, scale: float = 1.0, slope_right: float = 0.5, slope_left: float = 0.5, tail_level: float = 1.0, decay_right: float | None = None, decay_left: float | None = None) -> Column:
    """Rises from the location to the tail level as 1 - exp(-z^2 / s) on either side; beyond the level, exponential decay where both are given."""
    if tail_level <= slope_right or tail_level <= slope_left:
        raise ValueError("the tail level must be above both slopes")
    width = lambda slope: 1.5625 * scale / math.log(tail_level / (tail_level - slope))
    z2 = (x - loc) * (x - loc)
    rise = lambda slope: tail_level * (1 - F.exp(-z2 / width(slope)))
    out = F.when(x < loc, -rise(slope_left)).otherwise(rise(slope_right))
    if decay_right is None or decay_left is None:
        return out
    left, right = x + (tail_level - min(loc, 0.0)), x - (tail_level + max(loc, 0.0))
    return out * F.when(right > 0, F.exp(-right / decay_right)).when(left < 0, F.exp(left / decay_left)).otherwise(1.0)



def normal_weight(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    """2 Phi(z) - 1, by a rational approximation of erf (absolute error below 1.2e-7) that stays in the JVM."""
    z = F.abs((x - loc) / scale) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * z)
    # A published Chebyshev fit of the complementary error function.
    coefs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        poly = poly * t + c
    erf = 1 - t * F.exp(poly - z * z)
    return F.when(x >= loc, erf).otherwise(-erf)


# --- dates ---------------------------------------------------------------------------------------------------


def quarter_label(ts: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(ts).cast("string"), F.lit("-"), F.date_format(ts, "yy"))


def is_leap(year: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29


def month_days(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def whole_months(a: Column, b: Column) -> Column:
    """Whole months from b to a."""
    return F.floor(F.months_between(a, b)).cast("int")


def shift_year(ts: Column, years: int = 1) -> Column:
    return F.add_months(ts, 12 * years)


def time_to_maturity(maturity: Column, now: Column, floor_zero: bool = True, days: float = ACT365) -> Column:
    out = (F.unix_timestamp(maturity) - F.unix_timestamp(now)) / F.lit(86400.0 * days)
    return F.greatest(out, F.lit(0.0)) if floor_zero else out


# --- strings -------------------------------------------------------------------------------------------------


def percent_text(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", x * 100)).otherwise(F.lit(""))


def number_text(x: Column, digits: int = 2, thousands: bool = False) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%{',' if thousands else ''}.{digits}f", x)).otherwise(F.lit(""))


def date_text(ts: Column, pattern: str = "ddMMMyyyy") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit(""))


def text_number(x: Column) -> Column:
    """A formatted number read back: percents, thousands and blanks."""
    plain = F.regexp_replace(F.trim(x), "[,%]", "")
    out = F.expr("NULL").cast("double") if plain is None else plain.try_cast("double")
    return F.when(F.trim(x).endswith("%"), out / 100).otherwise(out)


def with_interval(x: Column, ci: Column, digits: int = 2, sep: str = " ± ") -> Column:
    return F.concat(number_text(x, digits), F.lit(sep), number_text(ci, digits))


def joined(*parts: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *parts)


def letter(index: Column, capital: bool = True) -> Column:
    """1 is A, 26 is Z."""
    return F.char(index.cast("int") + (64 if capital else 96))
