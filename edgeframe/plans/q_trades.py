"""Registered queries of signals, outcomes, trade statistics, validation, scores and edge pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs, mathx
from ..operators import bootstrap as BS
from ..operators import indicators as C
from ..operators import outcomes as E
from ..operators import signals as D
from ..operators import tradestats as TS
from ..operators import validation as V
from . import pipelines as P
from .q_bars import EXTRA, day
from .registry import query

# ---------------------------------------------------------------- SQL of the shared steps

_PREV = {c: f"lag({c}) OVER w" for c in ("close", "vwap", "bb_lo", "bb_up", "or_hi", "or_lo", "don_hi", "don_lo", "z20", "vwap_lo", "vwap_up", "cpr", "rvol", "prev_high", "prev_low")}
IND2 = "SELECT *, " + ", ".join(f"{v} AS p_{c}" for c, v in _PREV.items()) + ", CASE WHEN count(tr) OVER a = 14 THEN avg(tr) OVER a END AS atr FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx), a AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


def _x(op, x, y):
    up = op == "up"
    py = f"p_{y}" if isinstance(y, str) else y
    return f"p_{x} {'<=' if up else '>='} {py} AND {x} {'>' if up else '<'} {y}"


RULES = {
    "vwap_cross": (_x("up", "close", "vwap"), _x("down", "close", "vwap")),
    "bollinger_reversion": (_x("up", "close", "bb_lo"), _x("down", "close", "bb_up")),
    "orb_15m": (_x("up", "close", "or_hi"), _x("down", "close", "or_lo")),
    "donchian_breakout": (_x("up", "close", "don_hi"), _x("down", "close", "don_lo")),
    "zscore_reversion": (_x("up", "z20", -2.0), _x("down", "z20", 2.0)),
    "vwap_band_reversion": (_x("up", "close", "vwap_lo"), _x("down", "close", "vwap_up")),
    "cpr_pivot": (_x("up", "close", "cpr"), _x("down", "close", "cpr")),
    "gap_and_go": ("nth = 1 AND gap_pct > 0.5 AND close >= open", "nth = 1 AND gap_pct < -0.5 AND close < open"),
    "rvol_breakout": (_x("up", "rvol", 2.0) + " AND close >= open", _x("up", "rvol", 2.0) + " AND close < open"),
    "prev_day_breakout": (_x("up", "close", "prev_high"), _x("down", "close", "prev_low")),
}


def sig_sql(names):
    """Signals of the named rules over ``ind2``."""
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT symbol, session_date, bar_idx AS entry_idx, close AS entry, atr, '{n}' AS strategy, CASE WHEN coalesce({RULES[n][0]}, false) THEN 'BUY' WHEN coalesce({RULES[n][1]}, false) THEN 'SELL' END AS direction FROM ind2) WHERE direction IS NOT NULL"
        for n in names
    )


SIG = sig_sql(RULES)
CONFIGS = [(1.0, 1.5), (1.5, 2.0), (0.75, 2.0)]
COST = costs.reference_fraction()


def ent_sql(pairs):
    """Entries of every signal in every configuration."""
    rows = ", ".join(f"('k{k:g}_rr{r:g}', {k}, {r})" for k, r in pairs)
    return f"SELECT s.*, c.*, CASE WHEN direction = 'BUY' THEN 1.0 ELSE -1.0 END AS sg, c.k * atr AS risk FROM sig s CROSS JOIN (VALUES {rows}) c(config_id, k, rr) WHERE atr > 0"


ENT = ent_sql(CONFIGS)
HITS = """SELECT e.*, b.bar_idx, b.close AS bc, CASE WHEN sg > 0 THEN b.low <= entry - risk ELSE b.high >= entry + risk END AS hs, CASE WHEN sg > 0 THEN b.high >= entry + rr * risk ELSE b.low <= entry - rr * risk END AS ht,
  greatest(CASE WHEN sg > 0 THEN entry - b.low ELSE b.high - entry END, 0) / risk AS adv FROM ent e JOIN bars b ON e.symbol = b.symbol AND e.session_date = b.session_date AND b.bar_idx > e.entry_idx"""
GRP = "symbol, session_date, strategy, direction, config_id"
EXITS = f"SELECT {GRP}, entry_idx, coalesce(min(CASE WHEN hs OR ht THEN bar_idx END), max(bar_idx)) AS exit_idx FROM hits GROUP BY {GRP}, entry_idx"
TOUCH = f"""SELECT h.symbol, h.session_date, h.strategy, h.direction, h.config_id, h.entry_idx, any_value(x.exit_idx) AS exit_idx, any_value(entry) AS entry, any_value(risk) AS risk, any_value(rr) AS rr,
  max(CASE WHEN h.bar_idx = x.exit_idx THEN CASE WHEN hs THEN entry - sg * risk WHEN ht THEN entry + sg * rr * risk ELSE bc END END) AS exit_price, bool_or(h.bar_idx = x.exit_idx AND hs AND ht) AS ambiguous, max(adv) AS mae_r, any_value(sg) AS sg
  FROM hits h JOIN exits x USING ({GRP}, entry_idx) WHERE h.bar_idx <= x.exit_idx GROUP BY {", ".join("h." + g.strip() for g in GRP.split(","))}, h.entry_idx"""
TOUCH_R = f"SELECT *, sg * (exit_price - entry) / risk - {COST!r} * entry / risk AS r FROM touch0"
NEXT = f"SELECT a.*, (SELECT min(b.entry_idx) FROM touch b WHERE b.symbol = a.symbol AND b.session_date = a.session_date AND b.strategy = a.strategy AND b.direction = a.direction AND b.config_id = a.config_id AND b.entry_idx > a.exit_idx) AS nxt, row_number() OVER (PARTITION BY {GRP} ORDER BY entry_idx) AS rn FROM touch a"
CHAIN = f"""SELECT {GRP}, entry_idx, nxt FROM nexts WHERE rn = 1
  UNION ALL SELECT n.symbol, n.session_date, n.strategy, n.direction, n.config_id, n.entry_idx, n.nxt FROM chain c JOIN nexts n ON n.symbol = c.symbol AND n.session_date = c.session_date AND n.strategy = c.strategy AND n.direction = c.direction AND n.config_id = c.config_id AND n.entry_idx = c.nxt"""
TRADES = f"SELECT t.* FROM touch t JOIN chain c USING ({GRP}, entry_idx)"
X_SIG = EXTRA | {"ind2": IND2, "sig": SIG}
X_TOUCH = X_SIG | {"ent": ENT, "hits": HITS, "exits": EXITS, "touch0": TOUCH, "touch": TOUCH_R}
X_TRADES = X_TOUCH | {"nexts": NEXT, "chain": CHAIN, "trades": TRADES}
K4 = "symbol, strategy, direction, config_id"
STATS = f"""SELECT {K4}, count(*) AS n, avg(CAST(r > 0 AS DOUBLE)) * 100 AS win_pct, avg(r) AS expectancy, coalesce(avg(CASE WHEN r > 0 THEN r END), 0) AS avg_win, coalesce(avg(CASE WHEN r <= 0 THEN r END), 0) AS avg_loss,
  CASE WHEN sum(CASE WHEN r <= 0 THEN -r ELSE 0 END) > 0 THEN least(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / sum(CASE WHEN r <= 0 THEN -r ELSE 0 END), 99) WHEN sum(CASE WHEN r > 0 THEN r ELSE 0 END) > 0 THEN 99 ELSE 0 END AS profit_factor,
  sum(r) AS total_r FROM trades GROUP BY {K4}"""
CURVE = f"SELECT *, greatest(max(equity) OVER w, 0) AS peak FROM (SELECT *, sum(r) OVER w AS equity, sum(CAST(r > 0 AS INT)) OVER w AS wins_before, row_number() OVER w AS nth, row_number() OVER (PARTITION BY {K4} ORDER BY entry_idx DESC) AS from_end FROM trades WINDOW w AS (PARTITION BY {K4} ORDER BY entry_idx)) WINDOW w AS (PARTITION BY {K4} ORDER BY entry_idx)"
SHARPE = f"SELECT {K4}, count(*) AS n, coalesce(stddev_samp(r), 0) AS sd, CASE WHEN coalesce(stddev_samp(r), 0) > 0 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sharpe FROM trades GROUP BY {K4}"
X_STATS = X_TRADES | {"stats": STATS, "curve": CURVE, "sharpe": SHARPE}
LEN = "SELECT symbol, count(*) AS total FROM bars GROUP BY symbol"

# ---------------------------------------------------------------- shared steps on Spark


def entries(t):
    ind = P.with_mean_atr(C.windowed(t.kept_bars))
    return D.signals(ind.withColumn("entry_idx", F.col("bar_idx")).withColumn("entry", F.col("close")), D.WINDOWED, ["symbol", "session_date", "entry_idx", "entry", "atr"])


def touch(t):
    return E.first_touch(entries(t), t.kept_bars, COST, CONFIGS)


def trades(t):
    return E.one_at_a_time(touch(t))


def lengths(t):
    return t.kept_bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------------------- signals


def _signal(name, strategy):
    @query(name, "bars", extra=X_SIG, sql=f"SELECT symbol, entry_idx AS bar_idx, strategy, direction FROM sig WHERE strategy = '{strategy}'")
    def run(t):
        return D.signals(C.windowed(t.bars), {strategy: D.WINDOWED[strategy]}, ["symbol", "bar_idx"])


for _id, _s in [("d01", "vwap_cross"), ("d05", "bollinger_reversion"), ("d07", "orb_15m"), ("d08", "donchian_breakout"), ("d09", "zscore_reversion"), ("d10", "vwap_band_reversion"), ("d11", "cpr_pivot"), ("d12", "gap_and_go"), ("d13", "rvol_breakout"), ("d17", "prev_day_breakout")]:
    _signal(f"{_id}_{_s}", _s)


def _recursive_signal(name, strategy, extra=None, sql=None):
    @query(name, "bars", extra=extra, sql=sql)
    def run(t):
        return D.signals(t.bars.join(C.recursive(t.bars).drop("tf"), ["symbol", "bar_idx"]), {strategy: D.RECURSIVE[strategy]}, ["symbol", "bar_idx"])


from .q_bars import EMA, MACD_SIGNAL, STEPS, WILDER, X_SUPER  # noqa: E402


def _cross_sql(pairs, a, b, name):
    w = "OVER (PARTITION BY symbol ORDER BY bar_idx)"
    return f"""SELECT symbol, bar_idx, '{name}' AS strategy, direction FROM (SELECT symbol, bar_idx, CASE WHEN pa <= pb AND a > b THEN 'BUY' WHEN pa >= pb AND a < b THEN 'SELL' END AS direction
    FROM (SELECT symbol, bar_idx, {a} AS a, {b} AS b, lag({a}) {w} AS pa, lag({b}) {w} AS pb FROM {pairs})) WHERE direction IS NOT NULL"""


_recursive_signal("d02_ema_cross", "ema_cross_9_21", {"e9": EMA.format(p=9, name="e9"), "e21": EMA.format(p=21, name="e21"), "j": "SELECT b.symbol, b.bar_idx, e9.e AS x, e21.e AS y FROM bars b LEFT JOIN e9 USING (symbol, bar_idx) LEFT JOIN e21 USING (symbol, bar_idx)"}, _cross_sql("j", "x", "y", "ema_cross_9_21"))
_recursive_signal(
    "d03_rsi_reversion", "rsi_reversion", {"steps": STEPS, "w": WILDER.format(g="up", l="down", name="w"), "j": "SELECT b.symbol, b.bar_idx, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS x FROM bars b LEFT JOIN w USING (symbol, bar_idx)"},
    "SELECT symbol, bar_idx, 'rsi_reversion' AS strategy, direction FROM (SELECT symbol, bar_idx, CASE WHEN p <= 30 AND x > 30 THEN 'BUY' WHEN p >= 70 AND x < 70 THEN 'SELL' END AS direction FROM (SELECT *, lag(x) OVER (PARTITION BY symbol ORDER BY bar_idx) AS p FROM j)) WHERE direction IS NOT NULL",
)
_recursive_signal("d04_macd_cross", "macd_cross", {"e12": EMA.format(p=12, name="e12"), "e26": EMA.format(p=26, name="e26"), "macd": "SELECT symbol, bar_idx, e12.e - e26.e AS m FROM e12 JOIN e26 USING (symbol, bar_idx)", "sig2": MACD_SIGNAL.replace("FROM sig e", "FROM sig2 e"), "j": "SELECT b.symbol, b.bar_idx, m AS x, e AS y FROM bars b LEFT JOIN macd USING (symbol, bar_idx) LEFT JOIN sig2 USING (symbol, bar_idx)"}, _cross_sql("j", "x", "y", "macd_cross"))
_recursive_signal("d06_supertrend", "supertrend", X_SUPER, """SELECT symbol, bar_idx, 'supertrend' AS strategy, direction FROM (SELECT symbol, bar_idx, CASE WHEN p < 0 AND side > 0 THEN 'BUY' WHEN p > 0 AND side < 0 THEN 'SELL' END AS direction
  FROM (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY bar_idx) AS p FROM super)) WHERE direction IS NOT NULL""")


@query("d14_d16_card_signals", "bars", extra=X_SIG, sql="SELECT symbol, entry_idx AS bar_idx, strategy, direction FROM sig WHERE strategy IN ('vwap_cross', 'orb_15m', 'gap_and_go', 'prev_day_breakout')")
def d14(t):
    return D.signals(C.windowed(t.bars), {k: D.WINDOWED[k] for k in D.CARD_SET.values()}, ["symbol", "bar_idx"])


# ---------------------------------------------------------------- outcomes and costs

OUT = f"{K4}, entry_idx, exit_idx"


@query("e01_first_touch", "bars", extra=X_TOUCH, sql=f"SELECT {OUT}, R6(exit_price) AS exit_price, R6(r) AS r FROM touch")
def e01(t):
    return touch(t).select(*TS.KEY, "entry_idx", "exit_idx", "exit_price", "r")


@query("e02_one_at_a_time", "bars", extra=X_TRADES, sql=f"SELECT {OUT}, R6(r) AS r FROM trades")
def e02(t):
    return trades(t).select(*TS.KEY, "entry_idx", "exit_idx", "r")


@query("e03_adverse_excursion", "bars", extra=X_TOUCH, sql=f"SELECT {OUT}, R6(mae_r) AS mae_r FROM touch")
def e03(t):
    return touch(t).select(*TS.KEY, "entry_idx", "exit_idx", "mae_r")


@query("e04_ambiguous", "bars", extra=X_TOUCH, sql=f"SELECT {K4}, count(*) AS n, CAST(sum(CAST(ambiguous AS INT)) AS BIGINT) AS ambiguous FROM touch GROUP BY {K4}")
def e04(t):
    return touch(t).groupBy(*TS.KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ambiguous").cast("int")).alias("ambiguous"))


@query("e05_intrabar", "bars", extra=X_TOUCH, sql=f"""SELECT {K4}, entry_idx, coalesce(arg_min(CASE WHEN hs THEN 'stop' ELSE 'target' END, ts) FILTER (WHERE hs OR ht), 'stop') AS first_level FROM (
  SELECT t.*, f.ts, CASE WHEN sg > 0 THEN f.ltp <= entry - risk ELSE f.ltp >= entry + risk END AS hs, CASE WHEN sg > 0 THEN f.ltp >= entry + rr * risk ELSE f.ltp <= entry - rr * risk END AS ht
  FROM touch t JOIN ticks f ON t.symbol = f.symbol AND CAST(f.ts AS DATE) = t.session_date WHERE ambiguous) GROUP BY {K4}, entry_idx""")
def e05(t):
    fine = t.ticks.select("symbol", "ts", F.to_date("ts").alias("session_date"), F.col("ltp").alias("high"), F.col("ltp").alias("low"))
    return E.resolve_intrabar(touch(t), fine).select(*TS.KEY, "entry_idx", "first_level")


@query("e06_winner_heat", "bars", extra=X_TRADES, sql=f"SELECT {K4}, len(a) AS winners, R6(a[CAST(round((len(a) - 1) * 0.5) AS INT) + 1]) AS heat_median, R6(a[CAST(round((len(a) - 1) * 0.9) AS INT) + 1]) AS heat_p90 FROM (SELECT {K4}, coalesce(list_sort(list(mae_r) FILTER (WHERE r > 0)), []) AS a FROM trades GROUP BY {K4})")
def e06(t):
    return E.winner_heat(trades(t), TS.KEY)


_LEG = "least({v} * 0.0003, 20.0)"
ITEMS_SQL = """SELECT id, entry * qty AS a, entry * qty * 1.01 AS b, direction FROM journal"""
ITEMS2 = """SELECT id, CASE WHEN direction = 'BUY' THEN a ELSE b END AS buy, CASE WHEN direction = 'BUY' THEN b ELSE a END AS sell, direction, a, b FROM items0"""
FEES = """SELECT *, least(buy * 0.0003, 20.0) + least(sell * 0.0003, 20.0) AS brokerage, sell * 0.00025 AS stt, (buy + sell) * 0.0000297 AS exchange, (buy + sell) * 0.000001 AS regulator, buy * 0.00003 AS stamp, (buy + sell) * 0.00025 AS slippage FROM items1"""


def _legs(t):
    j = t.journal.select("id", "direction", (F.col("entry") * F.col("qty")).alias("a"), (F.col("entry") * F.col("qty") * 1.01).alias("b"), "entry", "qty")
    long = F.col("direction") == "BUY"
    return j.withColumn("buy", F.when(long, F.col("a")).otherwise(F.col("b"))).withColumn("sell", F.when(long, F.col("b")).otherwise(F.col("a")))


X_FEES = {"items0": ITEMS_SQL, "items1": ITEMS2, "fees": FEES}


@query("e07_round_trip_costs", "journal", extra=X_FEES, sql="SELECT id, R6(brokerage) AS brokerage, R6(stt) AS stt, R6(exchange) AS exchange, R6(regulator) AS regulator, R6((brokerage + exchange + regulator) * 0.18) AS gst, R6(stamp) AS stamp, R6(slippage) AS slippage FROM fees")
def e07(t):
    return _legs(t).select("id", *[c.alias(k) for k, c in costs.items(F.col("buy"), F.col("sell")).items()])


@query("e08_reference_cost", "bars", sql=f"SELECT symbol, R6(avg(close * {COST!r})) AS cost_per_unit, R6(avg(close * {costs.reference_fraction(2)!r})) AS cost_2x FROM bars GROUP BY symbol")
def e08(t):
    """The reference fraction and its slippage-scaled variant, charged on every bar's close."""
    return t.bars.groupBy("symbol").agg(F.avg(F.col("close") * COST).alias("cost_per_unit"), F.avg(F.col("close") * costs.reference_fraction(2)).alias("cost_2x"))


@query("e09_net_pnl", "journal", extra=X_FEES, sql="SELECT id, R6(CASE WHEN direction = 'BUY' THEN b - a ELSE a - b END - (brokerage + stt + exchange + regulator + (brokerage + exchange + regulator) * 0.18 + stamp + slippage)) AS net FROM fees")
def e09(t):
    j = t.journal
    return j.select("id", costs.net_pnl(F.col("direction"), F.col("entry"), F.col("entry") * 1.01, F.col("qty")).alias("net"))


C2, C3 = costs.reference_fraction(2), costs.reference_fraction(3)


@query("e10_slippage_stress", "bars", extra=X_TRADES, sql=f"SELECT {K4}, R6(avg(r - {C2 - COST!r} * entry / risk)) AS expectancy_2x, R6(avg(r - {C3 - COST!r} * entry / risk)) AS expectancy_3x FROM trades GROUP BY {K4}")
def e10(t):
    return E.stressed_expectancy(trades(t), TS.KEY, {"expectancy_2x": C2, "expectancy_3x": C3}, COST)


@query("e11_cost_floor", "bars", extra=X_TRADES, sql=f"SELECT {K4}, R6(avg({COST!r} * entry / risk)) AS break_even_r, avg(r) < avg({COST!r} * entry / risk) AS stand_aside FROM trades GROUP BY {K4}")
def e11(t):
    """R that costs take on average, and whether the net edge is below it."""
    cost = COST * F.col("entry") / F.col("risk")
    return trades(t).groupBy(*TS.KEY).agg(F.avg(cost).alias("break_even_r"), (F.avg("r") < F.avg(cost)).alias("stand_aside"))


# ---------------------------------------------------------------- trade statistics


@query("f01_summary", "bars", extra=X_STATS, sql=f"SELECT {K4}, n, R6(win_pct) AS win_pct, R6(expectancy) AS expectancy, R6(avg_win) AS avg_win, R6(avg_loss) AS avg_loss FROM stats")
def f01(t):
    return TS.summary(trades(t)).select(*TS.KEY, "n", "win_pct", "expectancy", "avg_win", "avg_loss")


@query("f02_profit_factor", "bars", extra=X_STATS, sql=f"SELECT {K4}, R6(profit_factor) AS profit_factor FROM stats")
def f02(t):
    return TS.summary(trades(t)).select(*TS.KEY, "profit_factor")


@query("f03_max_drawdown", "bars", extra=X_STATS, sql=f"SELECT {K4}, R6(max(peak - equity)) AS max_dd FROM curve GROUP BY {K4}")
def f03(t):
    return TS.curve_stats(trades(t)).select(*TS.KEY, "max_dd")


@query("f04_sharpe", "bars", extra=X_STATS, sql=f"SELECT {K4}, R6(sd) AS sd, R6(round(sharpe, 3)) AS sharpe, R6(round(sharpe * sqrt(n), 3)) AS t_stat FROM sharpe")
def f04(t):
    """Ratios to three places: without spread to speak of they are huge."""
    return TS.sharpe_stats(trades(t)).select(*TS.KEY, "sd", F.round("sharpe", 3).alias("sharpe"), F.round("t_stat", 3).alias("t_stat"))


@query(
    "f05_calmar_streak_recent", "bars", extra=X_STATS | {"streak": f"SELECT {K4}, max(c) AS loss_streak FROM (SELECT {K4}, wins_before, count(*) AS c FROM curve WHERE r <= 0 GROUP BY {K4}, wins_before) GROUP BY {K4}"},
    sql=f"SELECT {K4}, R6(CASE WHEN max(peak - equity) > 0 THEN sum(r) / max(peak - equity) ELSE 0 END) AS calmar, coalesce(any_value(loss_streak), 0) AS loss_streak, R6(avg(CASE WHEN from_end <= 20 THEN CAST(r > 0 AS DOUBLE) END) * 100) AS recent_win_pct FROM curve LEFT JOIN streak USING ({K4}) GROUP BY {K4}",
)
def f05(t):
    return TS.curve_stats(trades(t)).select(*TS.KEY, "calmar", "loss_streak", "recent_win_pct")


MOMENTS = f"SELECT {K4}, avg(pow(r - m, 2)) AS m2, avg(pow(r - m, 3)) AS m3, avg(pow(r - m, 4)) AS m4 FROM (SELECT *, avg(r) OVER (PARTITION BY {K4}) AS m FROM trades) GROUP BY {K4}"


@query("f06_skew_kurt", "bars", extra=X_STATS | {"mom": MOMENTS}, sql=f"SELECT {K4}, R6(CASE WHEN m2 > 1e-18 THEN m3 / pow(m2, 1.5) ELSE 0 END) AS skew, R6(CASE WHEN m2 > 1e-18 THEN m4 / pow(m2, 2) ELSE 3 END) AS kurt FROM mom")
def f06(t):
    return TS.sharpe_stats(trades(t)).select(*TS.KEY, "skew", "kurt")


@query("f07_eligible", "bars", extra=X_STATS, sql=f"SELECT {K4}, n >= 30 AND profit_factor >= 1.2 AND expectancy > 0 AS eligible FROM stats")
def f07(t):
    return TS.summary(trades(t)).select(*TS.KEY, TS.eligible(F.col("n"), F.col("profit_factor"), F.col("expectancy")).alias("eligible"))


# ---------------------------------------------------------------- validation

SPLIT = "SELECT t.*, total, CASE WHEN entry_idx >= floor(total * CAST(0.7 AS DOUBLE)) THEN 'oos' WHEN entry_idx < floor(total * CAST(0.7 AS DOUBLE)) - floor(total * CAST(0.02 AS DOUBLE)) THEN 'is' END AS part FROM trades t JOIN len USING (symbol)"


@query("g01_purged_split", "bars", extra=X_TRADES | {"len": LEN, "split": SPLIT}, sql=f"SELECT {K4}, count(*) FILTER (WHERE part = 'is') AS is_n, R6(avg(r) FILTER (WHERE part = 'is')) AS is_expectancy, count(*) FILTER (WHERE part = 'oos') AS oos_n, R6(avg(r) FILTER (WHERE part = 'oos')) AS oos_expectancy, R6(avg(CAST(r > 0 AS DOUBLE)) FILTER (WHERE part = 'oos') * 100) AS oos_win_pct FROM split GROUP BY {K4}")
def g01(t):
    return V.split_stats(V.purged_split(trades(t), lengths(t)))


def _wf(width, last):
    return f"SELECT {K4}, CASE WHEN count(*) < 2 THEN 1.0 ELSE avg(CAST(m > 0 AS DOUBLE)) END AS s FROM (SELECT {K4}, least(floor(entry_idx / {width}), {last}) AS fold, avg(r) AS m FROM trades JOIN len USING (symbol) GROUP BY ALL) GROUP BY {K4}"


@query("g02_walk_forward", "bars", extra=X_TRADES | {"len": LEN}, sql=f"SELECT {K4}, R6(s) AS wf_consistency FROM ({_wf('greatest(ceil(total / 5.0), 1)', 4)})")
def g02(t):
    return V.walk_forward(trades(t), lengths(t))


@query("g03_trade_walk_forward", "bars", extra=X_TRADES, sql=f"SELECT {K4}, R6(avg(CAST(m > 0 AS DOUBLE))) AS wf_trades FROM (SELECT {K4}, least(nth // (n // 5), 4) AS fold, avg(r) AS m FROM (SELECT *, row_number() OVER (PARTITION BY {K4} ORDER BY entry_idx) - 1 AS nth, count(*) OVER (PARTITION BY {K4}) AS n FROM trades) WHERE n >= 5 GROUP BY ALL) GROUP BY {K4}")
def g03(t):
    return V.trade_walk_forward(trades(t))


@query("g04_robustness", "bars", extra=X_STATS, sql=f"SELECT {K4}, R6(coalesce(avg(CASE WHEN n >= 20 THEN CAST(expectancy > 0 AS DOUBLE) END) OVER (PARTITION BY symbol, strategy, direction), 1)) AS robustness FROM stats")
def g04(t):
    return V.robustness(TS.summary(trades(t))).select(*TS.KEY, "robustness")


REGIME = """SELECT index_name, date, coalesce(CASE WHEN c = 20 THEN close >= m END, close >= pc, true) AS up FROM (SELECT *, count(*) OVER t AS c, avg(close) OVER t AS m, lag(close) OVER w AS pc FROM index_daily
  WINDOW w AS (PARTITION BY index_name ORDER BY date), t AS (PARTITION BY index_name ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("g05_benchmark_regime", "index_daily", sql=f"SELECT index_name, CAST(date AS VARCHAR) AS date, up FROM ({REGIME})")
def g05(t):
    return day(V.benchmark_regime(t.index_daily).select("index_name", "date", "up"), "date")


OWN_INDEX = "SELECT 'ALL' AS index_name, session_date AS date, CAST(sum(CAST(close AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS close FROM (SELECT symbol, session_date, arg_max(close, bar_idx) AS close FROM bars GROUP BY symbol, session_date) GROUP BY session_date"


def own_index(t):
    last = t.bars.groupBy("symbol", "session_date").agg(F.max_by("close", "bar_idx").alias("close"))
    return last.groupBy(F.lit("ALL").alias("index_name"), F.col("session_date").alias("date")).agg((F.sum(F.col("close").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))).alias("close"))


@query("g06_regime_consistency", "bars", extra=X_TRADES | {"index_daily": OWN_INDEX, "regime": REGIME, "per": f"SELECT {K4}, count(*) FILTER (WHERE up) AS n_up, avg(r) FILTER (WHERE up) AS e_up, count(*) FILTER (WHERE NOT up) AS n_down, avg(r) FILTER (WHERE NOT up) AS e_down FROM trades t JOIN regime g ON t.session_date = g.date GROUP BY {K4}"}, sql=f"SELECT {K4}, n_up, n_down, CASE WHEN (n_up >= 10 AND e_up <= 0) OR (n_down >= 10 AND e_down <= 0) THEN false WHEN n_up >= 10 AND n_down >= 10 THEN true END AS regime_consistent FROM per")
def g06(t):
    return V.regime_consistency(trades(t), V.benchmark_regime(own_index(t))).select(*TS.KEY, "n_up", "n_down", "regime_consistent")


def _erf(x):
    tt = f"(1 / (1 + 0.3275911 * abs({x})))"
    return f"(sign({x}) * (1 - (((((1.061405429 * {tt} - 1.453152027) * {tt}) + 1.421413741) * {tt} - 0.284496736) * {tt} + 0.254829592) * {tt} * exp(-({x}) * ({x}))))"


def _phi(x):
    return f"(0.5 * (1 + {_erf(f'(({x}) / sqrt(2.0))')}))"


def _poly(x, coefficients):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _inverse(p, x):
    """Two nested columns: the rational approximation ``x`` of the inverse normal at ``p``, and ``x`` after a Halley step."""
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    tail = lambda v: f"({_poly(v, mathx.ACKLAM_C)} / {_poly(v, mathx.ACKLAM_D)})"
    raw = f"CASE WHEN {p} < {mathx.ACKLAM_LOW} THEN {tail(low)} WHEN {p} > {1 - mathx.ACKLAM_LOW!r} THEN -{tail(high)} ELSE {_poly(f'({q} * {q})', mathx.ACKLAM_A)} * {q} / {_poly(f'({q} * {q})', mathx.ACKLAM_B)} END"
    u = f"(({_phi(x)} - {p}) * sqrt(2 * pi()) * exp({x} * {x} / 2))"
    return raw, f"CASE WHEN {p} <= 0 THEN CAST('-inf' AS DOUBLE) WHEN {p} >= 1 THEN CAST('inf' AS DOUBLE) ELSE {x} - {u} / (1 + {x} * {u} / 2) END"


def deflated_sql(source, base="symbol"):
    """``source`` (with sharpe and n) with trials and dsr over all rows of one ``base``, in nested steps."""
    safe = lambda p: f"least(greatest({p}, 1e-300), 1 - 1e-16)"
    a_raw, a_x = _inverse("pa", "xa")
    b_raw, b_x = _inverse("pb", "xb")
    return f"""SELECT * EXCLUDE (base, m, spread, m2, m3, m4, pa, pb, xa, xb), least(greatest({_phi("z")}, 0), 1) AS dsr FROM (
      SELECT *, CASE WHEN trials = 1 THEN sharpe * sqrt(greatest(n - 1, 1)) ELSE (sharpe - spread * ((1 - 0.5772156649) * za + 0.5772156649 * zb)) * sqrt(greatest(n - 1, 1))
        / sqrt(greatest(1 - CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END * sharpe + (CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 3 END - 1) / 4 * sharpe * sharpe, 1e-9)) END AS z FROM (
      SELECT *, {a_x} AS za, {b_x} AS zb FROM (
      SELECT *, CASE WHEN trials = 1 THEN 0 ELSE {a_raw} END AS xa, {b_raw} AS xb FROM (
      SELECT *, {safe("(1 - 1.0 / trials)")} AS pa, {safe("(1 - 1.0 / (trials * 2.718281828459045))")} AS pb FROM (
      SELECT *, avg(pow(sharpe - m, 2)) OVER b AS m2, avg(pow(sharpe - m, 3)) OVER b AS m3, avg(pow(sharpe - m, 4)) OVER b AS m4 FROM (
      SELECT *, count(*) OVER b AS trials, avg(sharpe) OVER b AS m, CASE WHEN coalesce(stddev_samp(sharpe) OVER b, 0) > 0 THEN stddev_samp(sharpe) OVER b ELSE 1e-9 END AS spread
      FROM (SELECT *, {base} AS base FROM {source}) WINDOW b AS (PARTITION BY base)) WINDOW b AS (PARTITION BY base))))))"""


@query("g07_deflated_sharpe", "bars", extra=X_STATS | {"deflated": deflated_sql("sharpe")}, sql=f"SELECT {K4}, n, trials, R6(dsr) AS dsr FROM deflated")
def g07(t):
    return V.deflated_sharpe(TS.sharpe_stats(trades(t)), ["symbol"]).select(*TS.KEY, "n", "trials", "dsr")


@query("g08_normal", "bars", extra=EXTRA, sql=f"SELECT symbol, bar_idx, R6({_erf('z20')}) AS erf, R6({_phi('z20')}) AS phi, R6(CASE WHEN abs(z20) < 3 THEN z20 END) AS back FROM ind WHERE z20 IS NOT NULL AND z20 <> 0")
def g08(t):
    """erf, phi, and the inverse, which must give the z-score back (to the approximation's five places)."""
    z = F.col("z20")
    d = C.windowed(t.bars).where("z20 IS NOT NULL AND z20 <> 0").select("symbol", "bar_idx", "z20", mathx.erf(z).alias("erf"), mathx.phi(z).alias("phi"))
    d = mathx.with_phi_inv(d, F.col("phi"), "back")
    return d.select("symbol", "bar_idx", "erf", "phi", F.when(F.abs(z) < 3, F.when(F.abs(F.col("back") - z) < 1e-5, z).otherwise(F.lit(-99.0))).alias("back"))


@query("g09_wilson", "bars", extra=X_STATS, sql=f"SELECT {K4}, R6(greatest((p + 1.96*1.96/(2*n) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n))) / (1 + 1.96*1.96/n), 0) * 100) AS wilson_low FROM (SELECT *, win_pct / 100 AS p FROM stats)")
def g09(t):
    return TS.summary(trades(t)).select(*TS.KEY, mathx.wilson_low(F.col("win_pct"), F.col("n")).alias("wilson_low"))


PATHS = 5000


@query("g10_bootstrap")
def g10(t):
    return BS.bootstrap(trades(t), TS.KEY, paths=PATHS).select(*TS.KEY, "n", "prob_profit_pct", "dd_p95", "final_p05")


@query("g11_bootstrap_interval")
def g11(t):
    return BS.bootstrap(trades(t), TS.KEY, paths=PATHS).where("n >= 20").select(*TS.KEY, "n", "mean_p05", "mean_p50", "mean_p95")


@query("g12_shrunk", "bars", extra=X_STATS, sql=f"SELECT {K4}, R6(n * expectancy / (n + 40.0)) AS shrunk FROM stats")
def g12(t):
    return TS.summary(trades(t)).select(*TS.KEY, V.shrunk(F.col("n"), F.col("expectancy")).alias("shrunk"))


BLOCKS = f"SELECT g.*, coalesce(m, 0) AS m FROM (SELECT * FROM (SELECT DISTINCT {K4} FROM trades) CROSS JOIN (SELECT unnest(range(8)) AS block)) g LEFT JOIN (SELECT {K4}, CAST(least(floor(entry_idx / greatest(ceil(total / 8.0), 1)), 7) AS INT) AS block, avg(r) AS m FROM trades JOIN len USING (symbol) GROUP BY ALL) USING ({K4}, block)"


@query("g13_block_means", "bars", extra=X_TRADES | {"len": LEN, "blocks": BLOCKS}, sql=f"SELECT {K4}, block, R6(m) AS m FROM blocks")
def g13(t):
    return V.block_means(trades(t), lengths(t))


#: Means of each half of the blocks, the best configuration in it (ties: the first), its middle rank in the other half.
HALVES = "SELECT row_number() OVER (ORDER BY a, b, c, d) AS split, [a, b, c, d] AS half FROM (SELECT x.range AS a, y.range AS b, z.range AS c, w.range AS d FROM range(8) x, range(8) y, range(8) z, range(8) w WHERE x.range < y.range AND y.range < z.range AND z.range < w.range)"
PARTS = f"SELECT symbol, split, c, count(*) OVER (PARTITION BY symbol, split) AS k, ins, outs FROM (SELECT symbol, split, c, round(sum(CASE WHEN list_contains(half, block) THEN m ELSE 0 END) / 4, 12) AS ins, round(sum(CASE WHEN NOT list_contains(half, block) THEN m ELSE 0 END) / 4, 12) AS outs FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY strategy, direction, config_id) AS c FROM blocks) CROSS JOIN halves GROUP BY symbol, split, c)"
LOGITS = """SELECT symbol, split, ln(w / (1 - w)) AS logit FROM (SELECT symbol, split, least(greatest((sum(CAST(outs < best AS INT)) + 0.5 * sum(CAST(outs = best AS INT))) / any_value(k), 1e-6), 1 - 1e-6) AS w
  FROM (SELECT *, first_value(outs) OVER (PARTITION BY symbol, split ORDER BY ins DESC, c) AS best FROM parts WHERE k >= 8) GROUP BY symbol, split)"""
X_PBO = {"halves": HALVES, "parts": PARTS, "logits": LOGITS}


@query("g14_overfit_probability", "bars", extra=X_TRADES | {"len": LEN, "blocks": BLOCKS} | X_PBO, sql="SELECT symbol, count(*) AS splits, R6(avg(CAST(logit <= 0 AS DOUBLE))) AS pbo, R6(list_sort(list(logit))[CAST(count(*) // 2 AS INT) + 1]) AS logit_median FROM logits GROUP BY symbol")
def g14(t):
    return V.overfit_probability(V.block_means(trades(t), lengths(t)), ["symbol"], ["strategy", "direction", "config_id"])
