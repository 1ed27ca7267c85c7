"""Registered queries of bar shaping and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import indicators as C
from .registry import query

DAY = "CAST(session_date AS VARCHAR) AS session_date"
WIN = "(PARTITION BY symbol ORDER BY bar_idx)"


def day(df, c="session_date"):
    return df.withColumn(c, F.col(c).cast("string"))


# ---------------------------------------------------------------- bars


@query("b01_session_date", "ticks", sql="SELECT symbol, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS session_date, count(*) AS n FROM ticks GROUP BY ALL")
def b01(t):
    """Exchange-local dates; the exchange is 5:30 ahead."""
    return day(t.ticks.select("symbol", B.session_date(F.col("ts"), "Asia/Kolkata").alias("session_date")).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n")))


@query("b02_day_id", "bars", sql=f"SELECT symbol, {DAY}, day_id, count(*) AS n FROM bars GROUP BY symbol, session_date, day_id")
def b02(t):
    return day(t.bars.groupBy("symbol", "session_date", "day_id").agg(F.count(F.lit(1)).alias("n")))


@query("b03_bar_idx", "bars", sql="SELECT symbol, bar_idx, R6(open) AS open, R6(high) AS high, R6(low) AS low, R6(close) AS close, volume FROM bars")
def b03(t):
    return t.bars.select("symbol", "bar_idx", "open", "high", "low", "close", "volume")


@query("b04_dedup_by_time", sql="SELECT symbol, count(*) AS n, CAST(sum(ltq) AS BIGINT) AS ltq FROM (SELECT event_type AS symbol, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ltq, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY symbol")
def b04(t):
    minute = t.ticks.withColumn("first_ts", F.col("ts")).withColumn("ts", F.date_trunc("minute", "ts"))
    return B.dedup_by_time(minute, ["first_ts", "event_id"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("ltq").alias("ltq"))


def _resample(name, minutes):
    off = B.OPEN_MINUTE % minutes
    edge = f"CAST(floor((epoch(date_trunc('minute', ts)) / 60 - {off}) / {minutes}) AS BIGINT)"
    one = "SELECT symbol, date_trunc('minute', ts) AS ts, arg_min(ltp, ts) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, ts) AS close, CAST(sum(ltq) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2"
    sql = f"SELECT symbol, {edge} AS slot, R6(arg_min(open, ts)) AS open, R6(max(high)) AS high, R6(min(low)) AS low, R6(arg_max(close, ts)) AS close, sum(volume) AS volume, count(*) AS parts FROM minute_bars GROUP BY 1, 2"

    @query(name, "ticks", sql=sql, extra={"minute_bars": one})
    def run(t):
        out = B.resample(B.bars_from_ticks(t.ticks, "1 minute"), minutes)
        return out.withColumn("slot", F.floor((F.unix_timestamp("ts") / 60 - off) / minutes)).drop("ts")


for _n in (3, 5, 10, 15, 30, 60):
    _resample(f"b05_resample_{_n}min", _n)


@query(
    "b06_split_adjust", "daily", "corp_actions",
    sql="""SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, R6(any_value(close) / coalesce(product(c.value), 1)) AS close, R6(round(any_value(volume) * coalesce(product(c.value), 1))) AS volume, R6(coalesce(product(c.value), 1)) AS ratio
    FROM daily d LEFT JOIN corp_actions c ON d.symbol = c.symbol AND c.type = 'split' AND d.date < c.date GROUP BY d.symbol, d.date""",
)
def b06(t):
    return day(B.back_adjust(t.daily, t.corp_actions).select("symbol", "date", "close", "volume", "ratio"), "date")


@query("b07_daily_collapse", "bars", sql=f"SELECT symbol, {DAY}, R6(arg_max(close, ts)) AS close FROM bars GROUP BY symbol, session_date")
def b07(t):
    return day(t.bars.groupBy("symbol", "session_date").agg(F.max_by("close", "ts").alias("close")))


SESSIONS = "SELECT symbol, session_date, min(day_id) AS day_id, min(bar_idx) AS start_idx, arg_min(open, bar_idx) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_idx) AS close, sum(volume) AS volume, count(*) AS bars FROM bars GROUP BY symbol, session_date"


@query("b08_session_bars", "bars", sql=f"SELECT symbol, {DAY}, day_id, start_idx, R6(open) AS open, R6(high) AS high, R6(low) AS low, R6(close) AS close, volume, bars FROM ({SESSIONS})")
def b08(t):
    return day(B.session_bars(t.bars).drop("tf"))


PRIOR = "SELECT symbol, session_date, open AS session_open, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, lag(close) OVER w AS prev_close FROM sessions WINDOW w AS (PARTITION BY symbol ORDER BY session_date)"


@query("b09_prior_session", "bars", extra={"sessions": SESSIONS, "prior": PRIOR}, sql="SELECT symbol, bar_idx, R6(session_open) AS session_open, R6(prev_high) AS prev_high, R6(prev_low) AS prev_low, R6(prev_close) AS prev_close FROM bars JOIN prior USING (symbol, session_date)")
def b09(t):
    return B.with_prior_session(t.bars).select("symbol", "bar_idx", "session_open", "prev_high", "prev_low", "prev_close")


@query(
    "b10_close_returns", "daily",
    sql="""SELECT symbol, CAST(date AS VARCHAR) AS date, R6(ret) AS ret FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM (
      SELECT symbol, date, close / base - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS base FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM daily) WHERE n <= 61) WHERE base > 0)) WHERE c >= 3""",
)
def b10(t):
    return day(B.close_returns(t.daily), "date")


@query("b11_recent_window", "bars", sql="SELECT symbol, count(*) AS n, R6(avg(close)) AS mean_close FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last FROM bars) WHERE ts >= last - INTERVAL 10 DAY GROUP BY symbol")
def b11(t):
    return B.recent_window(t.bars, 10).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"))


@query("b12_last_sessions", "bars", sql=f"SELECT symbol, {DAY}, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r FROM bars) WHERE r <= 5 GROUP BY symbol, session_date")
def b12(t):
    return day(B.last_sessions(t.bars, 5).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n")))


@query("b13_cumulative_volume", "bars", sql="SELECT symbol, bar_idx, sum(greatest(volume, 0.0)) OVER (PARTITION BY symbol, session_date ORDER BY bar_idx) AS cum_volume FROM bars")
def b13(t):
    return B.cumulative_volume(t.bars).select("symbol", "bar_idx", "cum_volume")


@query("b14_usable_bars", "daily", sql="SELECT symbol, count(*) AS n FROM daily WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND isfinite(close) GROUP BY symbol")
def b14(t):
    return B.usable(t.daily).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


_M = "(hour(ts) * 60 + minute(ts))"


@query(
    "b15_market_hours", "ticks",
    sql=f"""SELECT phase, square_off, count(*) AS n FROM (SELECT CASE WHEN {_M} BETWEEN 540 AND 547 OR ({_M} = 548 AND floor(second(ts)) = 0) THEN 'pre_open'
      WHEN {_M} BETWEEN 555 AND 929 OR ({_M} = 930 AND floor(second(ts)) = 0) THEN 'open' ELSE 'closed' END AS phase,
      CASE WHEN {_M} BETWEEN 900 AND 914 THEN 'warn' WHEN {_M} BETWEEN 915 AND 919 THEN 'danger' ELSE 'none' END AS square_off FROM ticks) GROUP BY 1, 2""",
)
def b15(t):
    return t.ticks.groupBy(B.session_phase(F.col("ts")).alias("phase"), B.square_off_flag(F.col("ts")).alias("square_off")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- indicators

TAIL, PRE = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"
#: All windowed indicators, as SQL over ``bars``, ``sessions`` and ``prior``.
IND0 = f"""SELECT b.*, session_open, prev_high, prev_low, prev_close, row_number() OVER (PARTITION BY symbol, session_date ORDER BY bar_idx) AS nth,
  CASE WHEN count(*) OVER t = 20 THEN avg(close) OVER t END AS mean20, CASE WHEN count(*) OVER t = 20 THEN stddev_pop(close) OVER t END AS sd20,
  CASE WHEN sum(volume) OVER d > 0 THEN sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d ELSE close END AS vwap,
  CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END AS don_hi, CASE WHEN count(*) OVER p = 20 THEN min(low) OVER p END AS don_lo,
  CASE WHEN count(*) OVER p = 20 AND avg(volume) OVER p > 0 THEN volume / avg(volume) OVER p END AS rvol,
  (prev_high + prev_low + prev_close) / 3 AS cpr, CASE WHEN prev_close > 0 THEN (session_open / prev_close - 1) * 100 END AS gap_pct,
  lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS pc
  FROM bars b JOIN prior USING (symbol, session_date)
  WINDOW t AS (PARTITION BY symbol ORDER BY bar_idx {TAIL}), p AS (PARTITION BY symbol ORDER BY bar_idx {PRE}), d AS (PARTITION BY symbol, session_date ORDER BY bar_idx)"""
IND = """SELECT *, mean20 + 2 * sd20 AS bb_up, mean20 - 2 * sd20 AS bb_lo, vwap + 2 * sd20 AS vwap_up, vwap - 2 * sd20 AS vwap_lo,
  CASE WHEN sd20 > 0 THEN (close - mean20) / sd20 END AS z20,
  CASE WHEN nth > 1 THEN max(CASE WHEN nth <= 1 THEN high END) OVER (PARTITION BY symbol, session_date) END AS or_hi,
  CASE WHEN nth > 1 THEN min(CASE WHEN nth <= 1 THEN low END) OVER (PARTITION BY symbol, session_date) END AS or_lo,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM ind0"""
EXTRA = {"sessions": SESSIONS, "prior": PRIOR, "ind0": IND0, "ind": IND}


def _indicator(name, *columns):
    cols = ", ".join(f"R6({c}) AS {c}" for c in columns)

    @query(name, "bars", extra=EXTRA, sql=f"SELECT symbol, bar_idx, {cols} FROM ind")
    def run(t):
        return C.windowed(t.bars).select("symbol", "bar_idx", *columns)


_indicator("c04_rolling_mean_std", "mean20", "sd20")
_indicator("c05_bollinger", "bb_up", "bb_lo")
_indicator("c08_session_vwap", "vwap")
_indicator("c09_vwap_bands", "vwap_up", "vwap_lo")
_indicator("c10_donchian", "don_hi", "don_lo")
_indicator("c11_relative_volume", "rvol")
_indicator("c12_zscore", "z20")
_indicator("c13_pivot_gap", "cpr", "gap_pct")
_indicator("c14_opening_range", "or_hi", "or_lo")

EMA = """SELECT b.symbol, b.bar_idx, s.e FROM bars b JOIN (SELECT symbol, avg(close) AS e FROM bars WHERE bar_idx < {p} GROUP BY symbol HAVING count(*) = {p}) s USING (symbol) WHERE b.bar_idx = {p} - 1
  UNION ALL SELECT b.symbol, b.bar_idx, e.e + 2.0 / ({p} + 1) * (b.close - e.e) FROM {name} e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1"""
WILDER = """SELECT b.symbol, b.bar_idx, s.g, s.l FROM steps b JOIN (SELECT symbol, avg({g}) AS g, avg({l}) AS l FROM steps WHERE bar_idx BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14) s USING (symbol) WHERE b.bar_idx = 14
  UNION ALL SELECT b.symbol, b.bar_idx, (e.g * 13 + b.{g}) / 14, (e.l * 13 + b.{l}) / 14 FROM {name} e JOIN steps b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1"""
STEPS = """SELECT symbol, bar_idx, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS pc FROM bars)"""


@query("c01_ema", "bars", extra={f"e{p}": EMA.format(p=p, name=f"e{p}") for p in (9, 21, 50)}, sql="SELECT b.symbol, b.bar_idx, R6(e9.e) AS ema9, R6(e21.e) AS ema21, R6(e50.e) AS ema50 FROM bars b LEFT JOIN e9 USING (symbol, bar_idx) LEFT JOIN e21 USING (symbol, bar_idx) LEFT JOIN e50 USING (symbol, bar_idx)")
def c01(t):
    return C.recursive(t.bars).select("symbol", "bar_idx", "ema9", "ema21", "ema50")


@query("c02_rsi", "bars", extra={"steps": STEPS, "w": WILDER.format(g="up", l="down", name="w")}, sql="SELECT b.symbol, b.bar_idx, R6(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END) AS rsi14 FROM bars b LEFT JOIN w USING (symbol, bar_idx)")
def c02(t):
    return C.recursive(t.bars).select("symbol", "bar_idx", "rsi14")


@query("c03_atr", "bars", extra={"steps": STEPS, "w": WILDER.format(g="tr", l="tr", name="w")}, sql="SELECT b.symbol, b.bar_idx, R6(g) AS atr14 FROM bars b LEFT JOIN w USING (symbol, bar_idx)")
def c03(t):
    return C.recursive(t.bars).select("symbol", "bar_idx", "atr14")


MACD_SIGNAL = """SELECT m.symbol, m.bar_idx, s.e FROM macd m JOIN (SELECT symbol, avg(m) AS e FROM macd WHERE bar_idx BETWEEN 25 AND 33 GROUP BY symbol HAVING count(*) = 9) s USING (symbol) WHERE m.bar_idx = 33
  UNION ALL SELECT m.symbol, m.bar_idx, e.e + 0.2 * (m.m - e.e) FROM sig e JOIN macd m ON m.symbol = e.symbol AND m.bar_idx = e.bar_idx + 1"""


@query(
    "c06_macd", "bars", extra={"e12": EMA.format(p=12, name="e12"), "e26": EMA.format(p=26, name="e26"), "macd": "SELECT symbol, bar_idx, e12.e - e26.e AS m FROM e12 JOIN e26 USING (symbol, bar_idx)", "sig": MACD_SIGNAL},
    sql="SELECT b.symbol, b.bar_idx, R6(m) AS macd, R6(e) AS macd_signal FROM bars b LEFT JOIN macd USING (symbol, bar_idx) LEFT JOIN sig USING (symbol, bar_idx)",
)
def c06(t):
    return C.recursive(t.bars).select("symbol", "bar_idx", "macd", "macd_signal")


def fading_sql(source, x, p, first, at, keep, gain):
    """A recursive mean as a running sum of weighted values (of a series of a few thousand bars)."""
    return f"""SELECT symbol, bar_idx, pow({keep!r}, bar_idx - {at}) * seed + {gain!r} * pow({keep!r}, bar_idx) * coalesce(sum(CASE WHEN bar_idx > {at} THEN {x} / pow({keep!r}, bar_idx) END) OVER (PARTITION BY symbol ORDER BY bar_idx), 0) AS e FROM (
      SELECT symbol, bar_idx, {x}, avg(CASE WHEN bar_idx BETWEEN {first} AND {at} THEN {x} END) OVER (PARTITION BY symbol) AS seed FROM {source}) WHERE bar_idx >= {at}"""


def ema_sql(source, x, p, first):
    """EMA of column ``x`` of ``source`` from its ``first`` row on."""
    return fading_sql(source, x, p, first, first + p - 1, 1 - 2 / (p + 1), 2 / (p + 1))


def rma_sql(x, p=14):
    """Wilder's mean of a column of ``moves``."""
    return fading_sql("moves", x, p, 1, p, (p - 1) / p, 1 / p)


MOVES = """SELECT symbol, bar_idx, high, low, close, pc, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS pc FROM bars)"""
TREND = "SELECT symbol, bar_idx, (high + low) / 2 + 3.0 * e AS u, (high + low) / 2 - 3.0 * e AS d, close, pc FROM moves JOIN rma10 USING (symbol, bar_idx)"
SUPER = """SELECT symbol, bar_idx, u AS upper, d AS lower, 1.0 AS side FROM trend WHERE bar_idx = 10
  UNION ALL SELECT symbol, bar_idx, upper, lower, CASE WHEN close > upper THEN 1.0 WHEN close < lower THEN -1.0 ELSE side END FROM (
    SELECT t.symbol, t.bar_idx, t.close, s.side, CASE WHEN t.u < s.upper OR t.pc > s.upper THEN t.u ELSE s.upper END AS upper, CASE WHEN t.d > s.lower OR t.pc < s.lower THEN t.d ELSE s.lower END AS lower
    FROM super s JOIN trend t ON t.symbol = s.symbol AND t.bar_idx = s.bar_idx + 1)"""
X_SUPER = {"moves": MOVES, "rma10": rma_sql("tr", 10), "trend": TREND, "super": SUPER}


@query("c07_supertrend", "bars", extra=X_SUPER, sql="SELECT b.symbol, b.bar_idx, CAST(side AS DOUBLE) AS st_dir FROM bars b LEFT JOIN super s USING (symbol, bar_idx)")
def c07(t):
    return C.recursive(t.bars).select("symbol", "bar_idx", "st_dir")


FINAL = """SELECT symbol, arg_max(g, bar_idx) AS atr FROM w GROUP BY symbol"""


@query("c15_final_wilder", "bars", extra={"steps": STEPS, "w": WILDER.format(g="tr", l="tr", name="w"), "e200": EMA.format(p=200, name="e200")}, sql=f"SELECT s.symbol, R6(a.atr) AS atr, R6(e.ema) AS ema FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN ({FINAL}) a USING (symbol) LEFT JOIN (SELECT symbol, arg_max(e, bar_idx) AS ema FROM e200 GROUP BY symbol) e USING (symbol)")
def c15(t):
    return C.final_wilder(t.bars, "bar_idx").drop("tf")


@query("c16_year_range", "daily", sql="SELECT symbol, R6(max(high)) AS high_52w, R6(min(low)) AS low_52w FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM daily) WHERE n <= 252 GROUP BY symbol")
def c16(t):
    return C.year_range(t.daily)


HIST = """SELECT symbol, CAST(CASE WHEN w > 0 THEN least(floor((tp - lo) / w), 99) ELSE 0 END AS INT) AS bin, sum(volume) AS volume FROM (SELECT symbol, tp, volume, min(tp) OVER s AS lo, (max(tp) OVER s - min(tp) OVER s) / 100 AS w FROM (
  SELECT symbol, (high + low + close) / 3 AS tp, volume, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r FROM bars) WHERE r <= 25 WINDOW s AS (PARTITION BY symbol)) GROUP BY 1, 2"""


@query("c17_volume_histogram", "bars", sql=HIST)
def c17(t):
    return C.volume_histogram(t.bars).select("symbol", "bin", "volume")


#: The value area grows by one bin a step; the last step of a symbol has it.
X_AREA = {
    "placed": """SELECT symbol, CAST(CASE WHEN w > 0 THEN least(floor((tp - lo) / w), 99) ELSE 0 END AS INT) AS bin, volume, lo, w FROM (SELECT symbol, tp, volume, min(tp) OVER s AS lo, (max(tp) OVER s - min(tp) OVER s) / 100 AS w FROM (
      SELECT symbol, (high + low + close) / 3 AS tp, volume, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r FROM bars) WHERE r <= 25 WINDOW s AS (PARTITION BY symbol))""",
    "binned": "SELECT symbol, bin, sum(volume) AS volume FROM placed GROUP BY symbol, bin",
    "profile": """SELECT s.symbol, list(coalesce(volume, 0.0) ORDER BY i) AS v, sum(volume) AS total, CAST(arg_max(i, struct_pack(a := coalesce(volume, 0.0), b := i)) AS INT) AS top, any_value(lo) AS lo, any_value(w) AS w
      FROM (SELECT symbol, min(lo) AS lo, min(w) AS w FROM placed GROUP BY symbol) s CROSS JOIN (SELECT unnest(range(100)) AS i) LEFT JOIN binned b ON b.symbol = s.symbol AND b.bin = i GROUP BY s.symbol""",
    "grown": """SELECT symbol, 0 AS step, top AS a, top AS b, v[top + 1] AS s FROM profile UNION ALL SELECT symbol, step + 1, CASE WHEN up THEN a ELSE a - 1 END, CASE WHEN up THEN b + 1 ELSE b END, s + CASE WHEN up THEN v[b + 2] ELSE v[a] END FROM (
      SELECT g.*, p.v, g.b < 99 AND (g.a = 0 OR p.v[g.b + 2] >= p.v[g.a]) AS up FROM grown g JOIN profile p USING (symbol) WHERE g.s < 0.7 * p.total AND NOT (g.a = 0 AND g.b = 99))""",
    "area": "SELECT symbol, lo + (top + 0.5) * w AS poc, lo + (arg_max(b, step) + 1) * w AS vah, lo + arg_max(a, step) * w AS val FROM grown JOIN profile USING (symbol) GROUP BY symbol, lo, w, top",
}


@query("c17_value_area", "bars", extra=X_AREA, sql="SELECT symbol, R6(poc) AS poc, R6(vah) AS vah, R6(val) AS val FROM area")
def c17b(t):
    return C.value_area(C.volume_histogram(t.bars))


TAILS = """SELECT symbol, x, rn, idx, x / lag(x) OVER u - 1 AS ret, x / max(x) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd, lag(x, 252) OVER u AS ya, lag(x, 21) OVER u AS b21, lag(x, 63) OVER u AS b63
  FROM (SELECT symbol, date, adj_close AS x, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx FROM daily) WINDOW u AS (PARTITION BY symbol ORDER BY date)"""


@query("c18_tails_returns", "daily", extra={"t": TAILS}, sql="""SELECT symbol, count(*) AS bars, R6(max(CASE WHEN rn = 1 THEN x END)) AS last, R6(avg(CASE WHEN rn <= 200 THEN x END)) AS sma, R6(max(CASE WHEN rn = 1 THEN (x / b21 - 1) * 100 END)) AS ret_21,
  R6(max(CASE WHEN rn = 1 THEN (x / b63 - 1) * 100 END)) AS ret_63, R6(max(CASE WHEN rn = 1 THEN (x / ya - 1) * 100 END)) AS ret_252, R6((pow(arg_max(x, idx) / arg_min(x, idx), 252.0 / count(*)) - 1) * 100) AS cagr FROM t GROUP BY symbol""")
def c18(t):
    return C.daily_tails(t.daily).select("symbol", "bars", "last", "sma", "ret_21", "ret_63", "ret_252", "cagr")


@query("c19_max_drawdown", "daily", extra={"t": TAILS}, sql="SELECT symbol, R6(min(dd) * -100) AS max_dd_pct FROM t GROUP BY symbol")
def c19(t):
    return C.daily_tails(t.daily).select("symbol", "max_dd_pct")


@query("c20_volatility", "daily", extra={"t": TAILS}, sql="SELECT symbol, R6(stddev_pop(ret) * sqrt(252.0) * 100) AS vol_pct FROM t GROUP BY symbol")
def c20(t):
    return C.daily_tails(t.daily).select("symbol", "vol_pct")


@query("c21_consistency", "daily", extra={"t": TAILS}, sql="SELECT symbol, R6(avg(CASE WHEN idx >= 252 AND (idx - 252) % 21 = 0 AND ya IS NOT NULL THEN CAST(x > ya AS DOUBLE) END)) AS consistency FROM t GROUP BY symbol")
def c21(t):
    return C.daily_tails(t.daily).select("symbol", "consistency")


@query("c22_off_high", "daily", extra={"t": TAILS}, sql="SELECT symbol, R6((max(CASE WHEN rn = 1 THEN x END) / max(CASE WHEN rn <= 252 THEN x END) - 1) * 100) AS off_high_pct FROM t GROUP BY symbol")
def c22(t):
    return C.daily_tails(t.daily).select("symbol", "off_high_pct")


@query("c23_floor_pivots", "bars", extra={"sessions": SESSIONS}, sql="""SELECT symbol, R6(p) AS p, R6(2*p-l) AS r1, R6(p+h-l) AS r2, R6(h+2*(p-l)) AS r3, R6(2*p-h) AS s1, R6(p-(h-l)) AS s2, R6(l-2*(h-p)) AS s3
  FROM (SELECT symbol, high AS h, low AS l, (high + low + close) / 3 AS p FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS n FROM sessions WHERE open > 0 AND high > 0 AND low > 0 AND close > 0) WHERE n = 1)""")
def c23(t):
    return C.floor_pivots(B.session_bars(t.bars))
