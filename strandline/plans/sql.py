"""Building blocks of the SQL that queries are checked against."""

from __future__ import annotations


def r(expression: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({expression}, {digits}) + 0)"


def q(*parts: str, recursive: bool = False) -> str:
    """Common table expressions, and the last part selects."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts[:-1])} {parts[-1]}"


PX = "px AS (SELECT CAST(l_shipdate AS DATE) AS ts, l_returnflag AS asset, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / (100 * sum(CAST(l_quantity AS BIGINT)))::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"
BENCH = "bench AS (SELECT CAST(l_shipdate AS DATE) AS ts, 'bench' AS asset, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / (100 * sum(CAST(l_quantity AS BIGINT)))::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"
SUPP = "supp AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS ts, CAST(l_suppkey AS VARCHAR) AS asset, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / (100 * sum(CAST(l_quantity AS BIGINT)))::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"
GRID = "grid AS (SELECT t.ts, a.asset, supp.value FROM (SELECT DISTINCT ts FROM supp) t CROSS JOIN (SELECT DISTINCT asset FROM supp) a LEFT JOIN supp ON supp.ts = t.ts AND supp.asset = a.asset)"
GROUPS = "g AS (SELECT CAST(s_suppkey AS VARCHAR) AS asset, r_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
PRIO = "prio AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS ts, o_orderpriority AS asset, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (100 * count(*))::DOUBLE AS value FROM orders GROUP BY 1, 2)"
WPRIO = "wprio AS (SELECT ts, asset, v / sum(v) OVER (PARTITION BY ts) AS value FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS ts, o_orderpriority AS asset, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS v FROM orders GROUP BY 1, 2))"


def calendar(freq: str) -> str:
    """cal(ts) between the first and the last date of px."""
    when = {
        "ME": "d = last_day(d)", "QE": "d = last_day(d) AND month(d) % 3 = 0", "YE": "month(d) = 12 AND day(d) = 31", "SE": "d = last_day(d) AND month(d) % 6 = 0", "W-FRI": "isodow(d) = 5", "B": "isodow(d) < 6",
        "M-FRI": "isodow(d) = 5 AND month(d + 7) <> month(d)", "Q-3FRI": "isodow(d) = 5 AND month(d) % 3 = 0 AND day(d) BETWEEN 15 AND 21",
    }[freq]
    return f"cal AS (SELECT d AS ts FROM (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM px), (SELECT max(ts) FROM px), INTERVAL 1 DAY)) AS DATE) AS d) WHERE {when})"


def asof(panel: str, dates: str, name: str) -> str:
    return f"{name} AS (SELECT c.ts, a.asset, v.value FROM {dates} c CROSS JOIN (SELECT DISTINCT asset FROM {panel}) a ASOF JOIN {panel} v ON v.asset = a.asset AND c.ts >= v.ts)"


ME = f"{calendar('ME')}, {asof('px', 'cal', 'm')}"
MR = "mr AS (SELECT * FROM (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS value FROM m) WHERE value IS NOT NULL)"
MLR = "mlr AS (SELECT * FROM (SELECT ts, asset, ln(value) - ln(lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS value FROM m) WHERE value IS NOT NULL)"
RATE = "rate AS (SELECT DISTINCT ts, 0.02::DOUBLE + 0.001::DOUBLE * month(ts) AS value FROM m)"
ENDS = "ends AS (SELECT asset, min(ts) AS first_ts, arg_min(value, ts) AS first_value, max(ts) AS last_ts, arg_max(value, ts) AS last_value, count(*) AS n, arg_max(value, ts) / arg_min(value, ts) - 1 AS tr, date_diff('day', min(ts), max(ts)) / 365.25::DOUBLE AS yrs FROM px GROUP BY 1)"
PA = "(CASE WHEN yrs > 1 THEN (1 + tr) ** (1.0::DOUBLE / yrs) - 1 WHEN yrs > 0 THEN tr ELSE 0 END)"
DD = "dd AS (SELECT ts, asset, value, value / max(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS dd FROM m)"
ISLANDS = "isl AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts) AS isl, lead(ts) OVER (PARTITION BY asset ORDER BY ts) AS nxt FROM dd)"
EPISODES = "ep AS (SELECT asset, isl, min(ts) AS start, arg_min(ts, (dd, ts)) AS trough, min(dd) AS max_dd, max(ts) AS lastd, arg_max_null(nxt, ts) AS rec, count(*) AS n FROM isl GROUP BY 1, 2), ranked AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY max_dd, start) AS position, start, trough, coalesce(rec, lastd) AS \"end\", rec IS NOT NULL AS recovered, max_dd FROM ep WHERE n > 1)"
RISK = (
    "lr AS (SELECT ts, asset, ln(value) - ln(lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS l, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS sr FROM m), "
    "risk AS (SELECT asset, stddev_samp(l) * sqrt(12.0::DOUBLE) AS vol, CASE WHEN count(*) FILTER (l < 0) >= 2 THEN stddev_samp(l) FILTER (l < 0) * sqrt(12.0::DOUBLE) ELSE 0 END AS downside_vol, skewness(l) AS skewness, kurtosis(l) AS kurtosis, min(l) AS worst, max(l) AS best, sqrt(12.0::DOUBLE) * avg(sr) / stddev_samp(sr) AS sharpe_arithmetic FROM lr WHERE l IS NOT NULL GROUP BY 1), "
    "dd1 AS (SELECT ts, asset, value / max(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS dd FROM px), dd2 AS (SELECT asset, min(dd) AS max_dd, arg_max(dd, ts) AS current_dd FROM dd1 GROUP BY 1)"
)
RISK_COLUMNS = ["vol", "downside_vol", "skewness", "kurtosis", "worst", "best", "sharpe_arithmetic", "max_dd", "current_dd"]
RA_SELECT = (
    "SELECT asset, first_ts AS start_date, last_ts AS end_date, " + r("first_value") + " AS start_price, " + r("last_value") + " AS end_price, n AS num_obs, " + r("yrs") + " AS years, " + r("tr") + " AS total_return, "
    + r("pa_return") + " AS pa_return, " + r("ln(1 + pa_return)") + " AS log_pa_return, " + ", ".join(f"{r(c)} AS {c}" for c in RISK_COLUMNS) + ", " + r("pa_return") + " AS pa_excess_return, "
    + r("pa_return / vol") + " AS sharpe_pa, " + r("ln(1 + pa_return) / vol") + " AS sharpe_log, " + r("pa_return / vol") + " AS sharpe_excess, " + r("pa_return / nullif(downside_vol, 0)") + " AS sortino, " + r("-pa_return / nullif(max_dd, 0)") + " AS calmar FROM all_"
)
BETA = (
    "ry AS (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS y FROM qm), rx AS (SELECT ts, value / lag(value) OVER (ORDER BY ts) - 1 AS x FROM qb), "
    "fit AS (SELECT asset, regr_slope(y, x) AS beta, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM ry JOIN rx ON rx.ts = ry.ts WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1)"
)
REGIME = "bx AS (SELECT * FROM (SELECT ts, value / lag(value) OVER (ORDER BY ts) - 1 AS x FROM bm) WHERE x IS NOT NULL), be AS (SELECT quantile_cont(x, 0.16) AS a, quantile_cont(x, 0.84) AS b FROM bx), reg AS (SELECT ts, x, CASE WHEN x <= a THEN 'bear' WHEN x <= b THEN 'normal' ELSE 'bull' END AS regime FROM bx, be)"
MEANS = "sp AS (SELECT asset, regime, value FROM mr JOIN reg ON reg.ts = mr.ts), sd AS (SELECT asset, stddev_samp(value) AS sd, count(*) AS total FROM sp GROUP BY 1), means AS (SELECT sp.asset, regime, avg(value) AS mean, count(*) AS n, count(*) / any_value(total)::DOUBLE AS freq, any_value(sd) AS sd FROM sp JOIN sd ON sd.asset = sp.asset GROUP BY 1, 2)"
AGGS = ", ".join(
    f"{r(e)} AS {n}"
    for n, e in (
        ("mean", "avg(value)"), ("median", "median(value)"), ("sum", "sum(value)"), ("sum_positive", "coalesce(sum(value) FILTER (value > 0), 0)"), ("sum_negative", "coalesce(sum(value) FILTER (value < 0), 0)"),
        ("mean_positive", "avg(value) FILTER (value > 0)"), ("mean_negative", "avg(value) FILTER (value < 0)"), ("abs_sum", "sum(abs(value))"), ("std", "stddev_samp(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(value)::DOUBLE"),
    )
)
BARS = "bars AS (SELECT CAST(ts AS DATE) AS ts, event_type AS asset, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events e GROUP BY CAST(e.ts AS DATE), event_type)"
OHLC = {
    "parkinson": "(ln(high) - ln(low)) ** 2 / (4 * ln(2))",
    "garman_klass": "0.5 * (ln(high) - ln(low)) ** 2 - (2 * ln(2) - 1) * (ln(close) - ln(open)) ** 2",
    "rogers_satchell": "(ln(high) - ln(close)) * (ln(high) - ln(open)) + (ln(low) - ln(close)) * (ln(low) - ln(open))",
    "close_to_close": "(ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY ts))) ** 2",
}
PAIRS = (
    "sr AS (SELECT * FROM (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS v FROM supp) WHERE v IS NOT NULL), lg AS (SELECT ts, asset, lag(v) OVER (PARTITION BY asset ORDER BY ts) AS z, v AS r FROM sr), "
    "pairs AS (SELECT * FROM (SELECT ts, asset, (z - avg(z) OVER w) / nullif(stddev_samp(z) OVER w, 0) AS z, (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) AS r FROM lg WHERE z IS NOT NULL WINDOW w AS (PARTITION BY ts)) WHERE z IS NOT NULL AND r IS NOT NULL)"
)
IC = "rk AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY z) + (count(*) OVER (PARTITION BY ts, z) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY ts ORDER BY r) + (count(*) OVER (PARTITION BY ts, r) - 1) / 2.0::DOUBLE AS b FROM pairs), ic AS (SELECT ts, corr(a, b) AS ic FROM rk GROUP BY 1 HAVING count(*) >= 3)"
EWM = (
    "n AS (SELECT ts, asset, value, row_number() OVER (PARTITION BY asset ORDER BY ts) AS k FROM mr), "
    "e AS (SELECT ts, asset, k, value AS v FROM n WHERE k = 1 UNION ALL SELECT n.ts, n.asset, n.k, (1 - 2.0::DOUBLE / 13) * e.v + 2.0::DOUBLE / 13 * n.value FROM e JOIN n ON n.asset = e.asset AND n.k = e.k + 1)"
)
COV = (
    "pr AS (SELECT * FROM (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS v FROM prio) WHERE v IS NOT NULL), cv AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.v, b.v) AS c FROM pr a JOIN pr b ON a.ts = b.ts GROUP BY 1, 2), "
    "wn AS (SELECT asset, value AS w, 1.0::DOUBLE / count(*) OVER () AS q, value - 1.0::DOUBLE / count(*) OVER () AS d FROM wprio WHERE ts = (SELECT max(ts) FROM wprio))"
)
BRINSON = (
    "pr AS (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS v FROM prio), lw AS (SELECT ts, asset, value AS w, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS ls, CASE WHEN asset < '3' THEN 'high' ELSE 'low' END AS grp FROM wprio), "
    "gw AS (SELECT ts, grp, sum(w) AS ws, sum(0.2::DOUBLE) AS wb FROM lw GROUP BY 1, 2), gp AS (SELECT lw.ts, grp, sum(ls * v) AS ps, sum(0.2::DOUBLE * v) AS pb FROM lw JOIN pr ON pr.ts = lw.ts AND pr.asset = lw.asset WHERE ls IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2), "
    "gb AS (SELECT gw.ts, gw.grp, ws, wb, ps, pb FROM gw JOIN gp ON gp.ts = gw.ts AND gp.grp = gw.grp)"
)


def rows_of(name: str, select: str) -> str:
    """Rows of select(ts, asset, …) numbered in time."""
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS k FROM ({select}))"


def scan_of(name: str, rows: str, first: dict[str, str], step: dict[str, str]) -> str:
    """A recursion over numbered rows: columns of the first row (n), then from the row (n) and the state (e)."""
    a, b = (", ".join(f"{e} AS {c}" for c, e in x.items()) for x in (first, step))
    return f"{name} AS (SELECT n.ts, n.asset, n.k, {a} FROM {rows} n WHERE n.k = 1 UNION ALL SELECT n.ts, n.asset, n.k, {b} FROM {name} e JOIN {rows} n ON n.asset = e.asset AND n.k = e.k + 1)"


def lam(span: float) -> str:
    return f"(1 - 2.0::DOUBLE / {span + 1})"


def ewm_of(name: str, rows: str, span: float, **values: tuple[str, str]) -> str:
    """EWM means of expressions over n, each with its seed."""
    return scan_of(name, rows, {c: seed for c, (_, seed) in values.items()}, {c: f"{lam(span)} * e.{c} + (1 - {lam(span)}) * {v}" for c, (v, _) in values.items()})


ZERO = "0.0::DOUBLE"
XY = "bm1 AS (SELECT c.ts, v.value FROM cal c ASOF JOIN bench v ON c.ts >= v.ts), br AS (SELECT ts, value / lag(value) OVER (ORDER BY ts) - 1 AS x FROM bm1), xy AS (SELECT mr.ts, mr.asset, br.x, mr.value AS y FROM mr JOIN br ON br.ts = mr.ts WHERE br.x IS NOT NULL)"


def _over_returns(*parts: str) -> str:
    return q(PX, ME, MR, *parts, recursive=True)


def _over_pairs(value: str) -> str:
    return q(PX, BENCH, ME, MR, XY, rows_of("n0", "SELECT * FROM xy"), ewm_of("ew", "n0", 12, a=("n.x * n.y", ZERO), b=("n.x * n.x", ZERO), c=("n.y * n.y", ZERO)), f"SELECT ts, asset, {r(value)} AS value FROM ew", recursive=True)


_ROWS = rows_of("n0", "SELECT * FROM mr")
_VOL = ewm_of("vol", "n0", 12, v=("n.value * n.value", "n.value * n.value"))
_RA = f"{_VOL}, ra AS (SELECT n0.ts, n0.asset, n0.k, n0.value / lag(sqrt(v)) OVER (PARTITION BY n0.asset ORDER BY n0.k) AS value FROM n0 JOIN vol ON vol.asset = n0.asset AND vol.k = n0.k)"
_SCORE = "((n.value - e.m) / sqrt(e.v))"
_MEAN = f"({lam(12)} * e.m + (1 - {lam(12)}) * n.value)"


def _sharpe(value: str, deviation: str) -> str:
    steps = scan_of("ew", "n0", {"m": ZERO, "v": ZERO}, {"m": _MEAN, "v": f"{lam(12)} * e.v + (1 - {lam(12)}) * {deviation}"})
    return _over_returns(_ROWS, steps, f"SELECT ts, asset, {r(value)} AS value FROM ew")


def _fees(rows: str, man: float, perf: float, period: str) -> str:
    own = "PARTITION BY asset ORDER BY ts"
    flagged = f"f0 AS (SELECT ts, asset, coalesce(value, 0) AS value, coalesce(date_trunc('{period}', lead(ts) OVER ({own})) <> date_trunc('{period}', ts), true) AS c, coalesce(date_diff('day', lag(ts) OVER ({own}), ts) / 365.0::DOUBLE, 0) AS dt FROM {rows}), {rows_of('f', 'SELECT * FROM f0')}"
    gross = lambda nav: f"({nav} * (1 + n.value) * (1 - {man} * n.dt))"
    paid = lambda nav, mark: f"CASE WHEN n.c AND {gross(nav)} > {mark} THEN {gross(nav)} - {perf} * ({gross(nav)} - {mark}) ELSE {gross(nav)} END"
    raised = lambda nav, mark: f"CASE WHEN n.c AND {gross(nav)} > {mark} THEN {gross(nav)} - {perf} * ({gross(nav)} - {mark}) ELSE {mark} END"
    steps = scan_of("path", "f", {"nav": paid("1.0::DOUBLE", "1.0::DOUBLE"), "mark": raised("1.0::DOUBLE", "1.0::DOUBLE")}, {"nav": paid("e.nav", "e.mark"), "mark": raised("e.nav", "e.mark")})
    return f"{flagged}, {steps}"


#: The SQL of ordered recursions, from their definitions.
RECURSIONS = {
    "ewm_beta": _over_pairs("CASE WHEN b > 0 THEN a / b END"),
    "ewm_corr": _over_pairs("CASE WHEN b * c > 0 THEN a / sqrt(b * c) END"),
    "ewm_long_short": _over_returns(
        _ROWS, ewm_of("fast", "n0", 6, v=("n.value", ZERO)), ewm_of("slow", "n0", 24, v=("n.value", ZERO)), f"w AS (SELECT {lam(6)} AS b, {lam(24)} AS a)",
        f"SELECT fast.ts, fast.asset, {r('(fast.v - slow.v) / sqrt((1 - b) / (1 + b) + (1 - a) / (1 + a) - 2 * (1 - a) * (1 - b) / (1 - a * b))')} AS value FROM fast JOIN slow ON slow.asset = fast.asset AND slow.k = fast.k, w",
    ),
    "ewm_sharpe": _sharpe("CASE WHEN v > 0 THEN sqrt(12.0::DOUBLE) * m / sqrt(v) END", "n.value ** 2"),
    "ewm_sharpe_mean": _sharpe("12 * m", "n.value ** 2"),
    "ewm_sharpe_deviation": _sharpe("CASE WHEN v > 0 THEN sqrt(12.0::DOUBLE) * m / sqrt(v) END", f"(n.value - {_MEAN}) ** 2"),
    "ewm_up_down": _over_returns(
        rows_of("n0", "SELECT *, avg(value * value) FILTER (value > 0) OVER (PARTITION BY asset) AS u, avg(value * value) FILTER (value < 0) OVER (PARTITION BY asset) AS d FROM mr"),
        scan_of("ew", "n0", {"u": "n.u", "d": "n.d"}, {c: f"CASE WHEN n.value {sign} 0 THEN {lam(12)} * e.{c} + (1 - {lam(12)}) * n.value ** 2 ELSE e.{c} END" for c, sign in (("u", ">"), ("d", "<"))}),
        f"SELECT ts, asset, {r('sqrt(12 * u)')} AS up, {r('sqrt(12 * d)')} AS down FROM ew",
    ),
    "ewm_unit_std": _over_returns(
        _ROWS, _VOL, rows_of("z", "SELECT n0.ts, n0.asset, n0.value / sqrt(v) AS value FROM n0 JOIN vol ON vol.asset = n0.asset AND vol.k = n0.k"), ewm_of("ew", "z", 12, v=("n.value", ZERO)),
        f"SELECT ts, asset, {r(f'v * sqrt((1 + {lam(12)}) / (1 - {lam(12)}))')} AS value FROM ew",
    ),
    "ewm_winsor_markov": _over_returns(
        _ROWS,
        scan_of("ew", "n0", {"m": ZERO, "v": "0.0004::DOUBLE", "c": "NULL::DOUBLE", "z": ZERO}, {
            "m": f"CASE WHEN abs({_SCORE}) >= 2 THEN e.m ELSE {_MEAN} END", "v": f"CASE WHEN abs({_SCORE}) >= 2 THEN e.v ELSE {lam(12)} * e.v + (1 - {lam(12)}) * (n.value - {_MEAN}) ** 2 END",
            "c": f"CASE WHEN abs({_SCORE}) >= 2 THEN e.c ELSE n.value END", "z": _SCORE,
        }),
        f"SELECT ts, asset, {r('c')} AS value, {r('m')} AS mean, {r('v')} AS variance, {r('z')} AS score FROM ew",
    ),
    "ra_returns": _over_returns(_ROWS, _RA, f"SELECT ts, asset, {r('value * 0.1 / sqrt(12.0::DOUBLE)')} AS value FROM ra"),
    "ra_momentum": _over_returns(
        _ROWS, _RA, rows_of("z", "SELECT ts, asset, value FROM ra WHERE value IS NOT NULL"), ewm_of("ew", "z", 6, v=("n.value", ZERO)),
        f"SELECT n0.ts, n0.asset, {r(f'v * sqrt((1 + {lam(6)}) / (1 - {lam(6)}))')} AS value FROM n0 LEFT JOIN ew ON ew.asset = n0.asset AND ew.ts = n0.ts",
    ),
    "rolling_ra": _over_returns(_ROWS, _RA, f"SELECT ts, asset, {r('CASE WHEN count(value) OVER w = 6 THEN sum(value) OVER w / sqrt(6.0::DOUBLE) END')} AS value FROM ra WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"),
    "fees_hwm": _over_returns(_fees("mr", 0.02, 0.2, "year"), f"SELECT ts, asset, {r('nav')} AS value FROM path"),
    "net_nav_of_prices": q(PX, ME, "zr AS (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS value FROM m)", _fees("zr", 0.01, 0.1, "quarter"), f"SELECT ts, asset, {r('nav')} AS value FROM path", recursive=True),
}
EXP_TAIL = (
    "CASE WHEN value < 0.01 THEN -1 ELSE 1 END * (1 - exp(-((value - 0.01) ** 2) / (1.5625 * 0.05 / ln(1.0::DOUBLE / (1 - CASE WHEN value < 0.01 THEN 0.3 ELSE 0.5 END)))))"
    " * CASE WHEN value - 1 - 0.01 > 0 THEN exp(-(value - 1 - 0.01) / 2) WHEN value + 1 < 0 THEN exp((value + 1) / 3) ELSE 1 END"
)


_VALUE = "(e.v * d.sh + e.cash)"
_PAID = f"(0.001::DOUBLE * list_sum([abs({_VALUE} * x[1] - e.v * x[2]) for x in list_zip(d.w, d.h)]))"
#: The ledger of monthly rebalancing to wprio at 0.1 % of the traded value: v is the value before costs, h an old position's value over v.
LEDGER = (
    "gd AS (SELECT t.ts, a.asset, last_value(prio.value IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY t.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price, coalesce(wprio.value, 0) AS w FROM (SELECT DISTINCT ts FROM prio) t CROSS JOIN (SELECT DISTINCT asset FROM prio) a LEFT JOIN prio ON prio.ts = t.ts AND prio.asset = a.asset LEFT JOIN wprio ON wprio.ts = t.ts AND wprio.asset = a.asset), "
    "gh AS (SELECT *, coalesce(lag(w) OVER o * price / lag(price) OVER o, 0) AS h FROM gd WINDOW o AS (PARTITION BY asset ORDER BY ts)), "
    "dy AS (SELECT *, row_number() OVER (ORDER BY ts) AS k FROM (SELECT ts, list(w ORDER BY asset) AS w, list(h ORDER BY asset) AS h, sum(w) AS sw, sum(h) AS sh FROM gh GROUP BY ts)), "
    f"path AS (SELECT ts, k, 100.0::DOUBLE AS v, 0.0::DOUBLE AS paid, 100 * (1 - sw) AS cash, NULL::DOUBLE AS before FROM dy WHERE k = 1 UNION ALL SELECT d.ts, d.k, {_VALUE}, {_PAID}, {_VALUE} * (1 - d.sw) - {_PAID}, e.v FROM path e JOIN dy d ON d.k = e.k + 1), "
    "ledger AS (SELECT 'p' AS portfolio, gh.ts, asset, price, w * v / (v - paid) AS weight, coalesce(v * w / price, 0) AS units, CASE WHEN before IS NULL THEN 0 ELSE 0.001::DOUBLE * abs(v * w - before * h) END AS cost, v - paid AS nav, cash FROM gh JOIN path ON path.ts = gh.ts), "
    "pnl AS (SELECT portfolio, ts, asset, coalesce(lag(weight) OVER o * (price / lag(price) OVER o - 1), 0) AS value FROM ledger WINDOW o AS (PARTITION BY asset ORDER BY ts))"
)


def _of_ledger(*parts: str) -> str:
    return q(PRIO, WPRIO, LEDGER, *parts, recursive=True)


def _rolled(value: str) -> str:
    return f"SELECT portfolio, ts, {r(f'CASE WHEN count({value}) OVER o = 12 THEN sum({value}) OVER o END')} AS value FROM byd WINDOW o AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


_EXPOSURES = f"{r('sum(weight)')} AS net, {r('coalesce(sum(weight) FILTER (weight > 0), 0)')} AS long, {r('coalesce(sum(weight) FILTER (weight < 0), 0)')} AS short, {r('sum(abs(weight))')} AS gross"
_ATTRIBUTION = _of_ledger(f"SELECT portfolio, coalesce(asset, 'Total') AS asset, {r('sum(value)')} AS value FROM pnl GROUP BY GROUPING SETS ((portfolio, asset), (portfolio))")
_TURNOVER = _of_ledger(
    "tr AS (SELECT *, abs(units - coalesce(lag(units) OVER (PARTITION BY asset ORDER BY ts), 0)) * price AS traded FROM ledger), byd AS (SELECT portfolio, ts, sum(traded) / sum(abs(units * price)) AS t FROM tr GROUP BY 1, 2)", _rolled("t")
)
LEDGERS = {
    "backtest_ledger": _of_ledger("SELECT portfolio, ts, asset, " + ", ".join(f"{r(c)} AS {c}" for c in ("price", "weight", "units", "cost", "nav", "cash")) + ", true AS is_rebalancing FROM ledger"),
    "backtest_nav": _of_ledger(f"SELECT DISTINCT ts, portfolio AS asset, {r('nav')} AS value FROM ledger"),
    "turnover": _TURNOVER,
    "costs": _of_ledger("byd AS (SELECT portfolio, ts, sum(cost) / any_value(nav) AS c FROM ledger GROUP BY 1, 2)", _rolled("c")),
    "instrument_pnl": _of_ledger(f"SELECT portfolio, ts, asset, {r('value')} AS value FROM pnl"),
    "attribution": _ATTRIBUTION,
    "attribution_tails": _of_ledger(
        "a AS (SELECT asset, sum(value) AS value FROM pnl GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY value DESC, asset) AS u, row_number() OVER (ORDER BY value, asset DESC) AS d, min(value) OVER () >= 0 AS pos, max(value) OVER () <= 0 AS neg FROM a)",
        f"SELECT CASE WHEN CASE WHEN pos THEN u <= 2 WHEN neg THEN d <= 2 ELSE u <= 1 OR d <= 1 END THEN asset ELSE 'Other' END AS asset, {r('sum(value)')} AS value FROM b GROUP BY 1",
    ),
    "instrument_navs": _of_ledger(f"SELECT portfolio, ts, asset, {r('product(1 + value) OVER (PARTITION BY asset ORDER BY ts)')} AS value FROM pnl"),
    "exposures": _of_ledger(f"SELECT portfolio, ts, {_EXPOSURES} FROM ledger GROUP BY 1, 2"),
    "investable": _of_ledger("SELECT portfolio, ts, count(price) AS priced, count(*) FILTER (abs(weight) > 1e-6) AS held FROM ledger GROUP BY 1, 2"),
    "instrument_table": _of_ledger(
        "i AS (SELECT portfolio, asset, avg(weight) AS w, arg_max(price, ts) / arg_min(price, ts) - 1 AS t FROM ledger WHERE price IS NOT NULL GROUP BY 1, 2)", f"SELECT portfolio, asset, {r('w')} AS mean_weight, {r('t')} AS total_return, {r('w * t')} AS contribution FROM i"
    ),
    "pnl_risk_attribution": _of_ledger("i AS (SELECT portfolio, asset, stddev_pop(value) FILTER (value <> 0) AS std FROM pnl GROUP BY 1, 2)", f"SELECT portfolio, asset, {r('std')} AS std, {r('std / sum(std) OVER ()')} AS share FROM i"),
    "weight_changes": _of_ledger(
        "c AS (SELECT *, lag(weight) OVER (PARTITION BY asset ORDER BY ts) AS b FROM ledger)", f"SELECT portfolio, asset, {r('b')} AS before, {r('weight')} AS now, {r('weight - coalesce(b, 0)')} AS change FROM c WHERE ts = (SELECT max(ts) FROM ledger)"
    ),
    "strategy_factsheet_attribution": _ATTRIBUTION,
    "strategy_factsheet_turnover": _TURNOVER,
    "strategy_factsheet_group_exposures": _of_ledger(f"SELECT portfolio, ts, CASE WHEN asset < '3' THEN 'high' ELSE 'low' END AS grp, {_EXPOSURES} FROM ledger GROUP BY 1, 2, 3"),
}
BRIDGE = q(
    PX, ME, BENCH, asof("bench", "cal", "bm"),
    rows_of("pn", "SELECT * FROM (SELECT ts, asset, value / lag(value) OVER (ORDER BY ts) - 1 AS value FROM bm) WHERE value IS NOT NULL"),
    scan_of("pe", "pn", {"v": "value", "mu": "value", "q": "value * value"}, {"v": "n.value", "mu": f"{lam(12)} * e.mu + (1 - {lam(12)}) * n.value", "q": f"{lam(12)} * e.q + (1 - {lam(12)}) * n.value * n.value"}),
    "rp AS (SELECT * FROM (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS v FROM m WHERE month(ts) % 3 = 0) WHERE v IS NOT NULL)",
    "rx AS (SELECT ts, asset, sum(v) OVER (PARTITION BY asset ORDER BY ts) AS x FROM rp), rc AS (SELECT ts, asset, x, lead(x) OVER w AS nx, lead(ts) OVER w AS nt FROM rx WINDOW w AS (PARTITION BY asset ORDER BY ts))",
    "st AS (SELECT asset, min(ts) AS t0, stddev_pop(v) AS sd FROM rp GROUP BY 1), z AS (SELECT pe.ts, st.asset, sd, (v - mu) / sqrt(q) AS b FROM pe JOIN st ON pe.ts >= t0)",
    "zb AS (SELECT ts, asset, sd, (b - avg(b) OVER (PARTITION BY asset)) / stddev_pop(b) OVER (PARTITION BY asset) AS b FROM z)",
    "j AS (SELECT zb.ts, zb.asset, sd, b, x, nx, nt, date_diff('day', rc.ts, zb.ts) AS gone, date_diff('day', zb.ts, nt) AS rest FROM zb ASOF JOIN rc ON rc.asset = zb.asset AND zb.ts >= rc.ts)",
    "c AS (SELECT ts, asset, CASE WHEN gone = 0 THEN x WHEN nt IS NOT NULL THEN (rest * x + gone * nx) / (gone + rest) + 1.15::DOUBLE * sd * sqrt(gone * rest / 12.0::DOUBLE / (gone + rest)) * b END AS c FROM j)",
    f"SELECT ts, asset, {r('c - lag(c) OVER (PARTITION BY asset ORDER BY ts)')} AS value FROM c", recursive=True,
)
VOL_FLOOR = q(
    PX, ME, MR, rows_of("vn", "SELECT * FROM mr"),
    scan_of("ve", "vn", {"q": "value * value"}, {"q": f"{lam(12)} * e.q + (1 - {lam(12)}) * n.value * n.value"}),
    "vl AS (SELECT ts, asset, q, list_sort(list(q) OVER (PARTITION BY asset ORDER BY ts ROWS 23 PRECEDING)) AS l FROM ve)",
    f"SELECT ts, asset, {r('sqrt(CASE WHEN len(l) >= 4 THEN greatest(q, l[1 + CAST(floor(0.3::DOUBLE * (len(l) - 1)) AS INT)]) ELSE q END)')} AS value FROM vl", recursive=True,
)
ROLLED = q(
    PX, ME, MLR, "ro AS (SELECT ts, asset, sum(value) OVER w AS v, count(*) OVER w AS c FROM mlr WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 5 PRECEDING))",
    rows_of("rn", "SELECT ts, asset, v FROM ro WHERE c = 6"),
    scan_of("re", "rn", {"v": "v", "q": "v * v"}, {"v": "n.v", "q": f"{lam(6)} * e.q + (1 - {lam(6)}) * n.v * n.v"}),
    "rw AS (SELECT ts, asset, (exp(v) - 1) / lag(sqrt(q)) OVER (PARTITION BY asset ORDER BY ts) AS value FROM re)",
    f"SELECT mlr.ts, mlr.asset, {r('rw.value')} AS value FROM mlr LEFT JOIN rw ON rw.ts = mlr.ts AND rw.asset = mlr.asset", recursive=True,
)


def weighted_products(source: str, value: str, name: str, span: float) -> str:
    """name(ts, i, j, c): the zero-seeded EWM covariance at every twelfth date from the last back, as a weighted sum of products."""
    return (
        f"{name}_d AS (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts DESC) - 1 AS back FROM (SELECT DISTINCT ts FROM {source})) WHERE back % 12 = 0), {name}_a AS (SELECT DISTINCT asset FROM {source}), "
        f"{name}_p AS (SELECT a.ts, a.asset AS i, b.asset AS j, a.{value} * b.{value} AS v, row_number() OVER (PARTITION BY a.asset, b.asset ORDER BY a.ts) AS k FROM {source} a JOIN {source} b ON b.ts = a.ts), "
        f"{name} AS (SELECT d.ts, x.asset AS i, y.asset AS j, coalesce((1 - {lam(span)}) * {lam(span)} ** max(k) * sum(v / {lam(span)} ** k), 0) AS c FROM {name}_d d CROSS JOIN {name}_a x CROSS JOIN {name}_a y LEFT JOIN {name}_p p ON p.i = x.asset AND p.j = y.asset AND p.ts <= d.ts GROUP BY 1, 2, 3)"
    )


EWM_COV = q(PX, ME, MR, weighted_products("mr", "value", "ec", 12), f"SELECT ts, i AS asset_i, j AS asset_j, {r('c')} AS cov FROM ec")
REALISED_TE = q(
    PX, ME, MR, BENCH, asof("bench", "cal", "bm"),
    rows_of("tn", "SELECT mr.ts, mr.asset, mr.value - b.value AS value FROM mr JOIN (SELECT ts, value / lag(value) OVER (ORDER BY ts) - 1 AS value FROM bm) b ON b.ts = mr.ts WHERE b.value IS NOT NULL"),
    scan_of("te", "tn", {"q": "value * value"}, {"q": f"{lam(12)} * e.q + (1 - {lam(12)}) * n.value * n.value"}),
    f"SELECT ts, asset, {r('sqrt(12.0::DOUBLE * q)')} AS value FROM te", recursive=True,
)
INDEPENDENT_VAR = q(
    PRIO, WPRIO, rows_of("pn", "SELECT * FROM (SELECT ts, asset, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS value FROM prio) WHERE value IS NOT NULL"),
    scan_of("pv", "pn", {"q": "value * value"}, {"q": f"{lam(12)} * e.q + (1 - {lam(12)}) * n.value * n.value"}),
    f"SELECT pv.ts, {r('2.3263::DOUBLE * sqrt(sum(q * w.value ** 2))')} AS value FROM pv JOIN wprio w ON w.ts = pv.ts AND w.asset = pv.asset GROUP BY 1", recursive=True,
)
MARGINAL_ACTIVE = q(
    PRIO, WPRIO, "wn AS (SELECT ts, asset, value - 1.0::DOUBLE / count(*) OVER () AS d, CAST(asset[1] AS DOUBLE) AS k FROM wprio WHERE ts = (SELECT max(ts) FROM wprio))",
    "ex AS (SELECT sum(d * (1 + 0.1 * k)) AS e1, sum(d * (0.5 - 0.1 * k)) AS e2, sum(d * d * 0.01 * k) AS rv FROM wn)",
    "tv AS (SELECT 0.04::DOUBLE * e1 + 0.01 * e2 AS g1, 0.01::DOUBLE * e1 + 0.02 * e2 AS g2, sqrt(0.04::DOUBLE * e1 * e1 + 0.02 * e1 * e2 + 0.02 * e2 * e2 + rv) AS total FROM ex)",
    f"SELECT ts, asset, {r('((1 + 0.1 * k) * g1 + (0.5 - 0.1 * k) * g2) / nullif(total, 0)')} AS factor_part, {r('d * 0.01 * k / nullif(total, 0)')} AS residual_part FROM wn, tv",
)
