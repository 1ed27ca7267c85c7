"""Registered queries of scores and edge pipelines, over bars of several widths at once.

Their SQL names a series ``click@15min``; the last step takes symbol and timeframe apart.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import costs as FEE
from ..functions import scores
from ..operators import journal as L
from ..operators import signals as D
from ..operators import tradestats as TS
from ..sources.stage import durable
from ..sources.tables import CTES, timeframe_sql
from . import pipelines as P
from .q_bars import EXTRA, X_SUPER, ema_sql, rma_sql
from .q_trades import BLOCKS, COST, CURVE, EXITS, HITS, IND2, K4, LEN, NEXT, OWN_INDEX, REGIME, RULES, SHARPE, SPLIT, STATS, TOUCH, TOUCH_R, TRADES, X_PBO, _wf, _x, deflated_sql, ent_sql, own_index, sig_sql
from .q_trades import CHAIN as CHAIN_SQL
from .registry import query

#: Bar widths in minutes: of the scanner, finder and edge map, and of the deep dive.
SCAN, SWEEP = (15, 30, 60), (3, 5, 10, 15, 30, 60)

# ---------------------------------------------------------------- SQL

SERIES = "split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS tf"
BASE = "split_part(symbol, '@', 1)"
#: Bars whose middle is the opening range: 15 minutes, one at least.
FIRST = "greatest(15 // CAST(regexp_extract(symbol, '@([0-9]+)', 1) AS INT), 1)"
OPENING = {"ind": EXTRA["ind"].replace("nth > 1", f"nth > {FIRST}").replace("nth <= 1", f"nth <= {FIRST}")}


def _backtest_sql(widths, rules, pairs, ind2=IND2, more=None):
    return {"hbars": CTES["bars"][0], "bars": timeframe_sql(*widths)} | EXTRA | OPENING | (more or {}) | {
        "ind2": ind2, "sig": sig_sql(rules), "ent": ent_sql(pairs), "hits": HITS, "exits": EXITS, "touch0": TOUCH, "touch": TOUCH_R, "nexts": NEXT, "chain": CHAIN_SQL, "trades": TRADES, "len": LEN,
    }


STREAK = f"SELECT {K4}, max(c) AS loss_streak FROM (SELECT {K4}, wins_before, count(*) AS c FROM curve WHERE r <= 0 GROUP BY {K4}, wins_before) GROUP BY {K4}"
DRAWN = f"SELECT {K4}, max(peak - equity) AS max_dd, avg(CASE WHEN from_end <= 20 THEN CAST(r > 0 AS DOUBLE) END) * 100 AS recent_win_pct FROM curve GROUP BY {K4}"
OOS = f"SELECT {K4}, count(*) FILTER (WHERE part = 'oos') AS oos_n, avg(r) FILTER (WHERE part = 'oos') AS oos_expectancy, avg(CAST(r > 0 AS DOUBLE)) FILTER (WHERE part = 'oos') * 100 AS oos_win_pct FROM split GROUP BY {K4}"
FOLDS = f"SELECT {K4}, s AS wf_consistency FROM ({_wf('greatest(ceil(total / 5.0), 1)', 4)})"
REGIMES = f"""SELECT {K4}, CASE WHEN (n_up >= 10 AND e_up <= 0) OR (n_down >= 10 AND e_down <= 0) THEN false WHEN n_up >= 10 AND n_down >= 10 THEN true END AS regime_consistent FROM (
  SELECT {K4}, count(*) FILTER (WHERE up) AS n_up, avg(r) FILTER (WHERE up) AS e_up, count(*) FILTER (WHERE NOT up) AS n_down, avg(r) FILTER (WHERE NOT up) AS e_down FROM trades t JOIN regime g ON t.session_date = g.date GROUP BY {K4})"""
GATHERED = f"""SELECT s.*, h.sharpe, h.sharpe * sqrt(s.n) AS t_stat, d.max_dd, d.recent_win_pct, coalesce(k.loss_streak, 0) AS loss_streak, o.oos_n, o.oos_expectancy, o.oos_win_pct, f.wf_consistency, g.regime_consistent,
  coalesce(avg(CASE WHEN s.n >= 20 THEN CAST(s.expectancy > 0 AS DOUBLE) END) OVER (PARTITION BY s.symbol, s.strategy, s.direction), 1) AS robustness,
  greatest((s.win_pct / 100 + 1.96*1.96/(2*s.n) - 1.96 * sqrt(s.win_pct / 100 * (1 - s.win_pct / 100)/s.n + 1.96*1.96/(4.0*s.n*s.n))) / (1 + 1.96*1.96/s.n), 0) * 100 AS wilson_low
  FROM stats s JOIN sharpe h USING ({K4}) JOIN drawn d USING ({K4}) LEFT JOIN streak k USING ({K4}) JOIN oos o USING ({K4}) JOIN folds f USING ({K4}) LEFT JOIN regimes g USING ({K4})"""


def _check_sql(check, label):
    """The points, or the entry with its label, of the first condition of a check that holds."""
    condition = lambda c: re.sub(r"(\d)D\b", r"\1", c)
    entry = lambda name, points: f"""'{{"label":"{name}","points":{points}}}'"""
    arms = [f"WHEN {condition(c)} THEN {entry(name, points) if label else points}" for name, c, points in check]
    return f"CASE {' '.join(arms)} {'END' if label else 'ELSE 0 END'}"


LOST = " + ".join(_check_sql(c, False) for c in scores.CHECKS)
LABELS = f"'[' || concat_ws(',', {', '.join(_check_sql(c, True) for c in scores.CHECKS)}) || ']'"
BAND = "CASE WHEN confidence IS NULL THEN NULL WHEN n < 50 THEN '" + scores.PROVISIONAL + "' " + " ".join(f"WHEN confidence < {top} THEN '{name}'" for top, name in scores.BANDS) + " ELSE 'Very strong confidence' END"
SCORED = f"""SELECT *, {BAND} AS band FROM (SELECT *, CASE WHEN n >= 20 AND expectancy > 0 THEN CASE WHEN dsr < 0.5 THEN least(capped, 59) ELSE capped END END AS confidence FROM (
  SELECT *, CAST(floor(CASE WHEN n < 50 THEN least(full_, 55) ELSE full_ END) AS INT) AS capped FROM (
  SELECT *, CASE WHEN raw > 90 AND NOT (n >= 300 AND coalesce(oos_win_pct >= win_pct * 0.90, false) AND profit_factor >= 2) THEN 89 ELSE raw END AS full_ FROM (
  SELECT *, least(greatest(50 + least(greatest(12 * t_stat, 0), 45) - ({LOST}), 0), 95) AS raw, {LABELS} AS penalties FROM deflated))))"""
X_SCORED = {
    "stats": STATS, "curve": CURVE, "streak": STREAK, "drawn": DRAWN, "sharpe": SHARPE, "split": SPLIT, "oos": OOS, "folds": FOLDS, "index_daily": OWN_INDEX.replace("FROM bars", "FROM hbars"), "regime": REGIME,
    "regimes": REGIMES, "gathered": GATHERED, "deflated": deflated_sql("gathered", BASE), "scored": SCORED,
}
X = _backtest_sql(SCAN, list(D.CARD_SET.values()), P.CARD_CONFIGS) | X_SCORED
BEST = "confidence DESC NULLS LAST, round(expectancy, 9) DESC NULLS LAST"
PRICES = "SELECT symbol, arg_max(close, bar_idx) AS ltp, arg_max(a, bar_idx) AS atr FROM (SELECT symbol, bar_idx, close, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS a FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) GROUP BY symbol"
TIES = "strategy, split_part(symbol, '@', 2), config_id, direction"


def _best_sql(source, by, where):
    return f"SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {BEST}, {TIES}) AS n_ FROM {source} WHERE {where}) WHERE n_ = 1"


def _top_sql(source, k):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY {BEST}, {BASE}, strategy, config_id) AS rank FROM ({source})) WHERE rank <= {k}"


SCANNED = _top_sql(_best_sql("scored", f"{BASE}, direction", "confidence >= 50"), 10)
SIGN = "CASE WHEN direction = 'BUY' THEN 1.0 ELSE -1.0 END"
K, RR = (f"CAST(regexp_extract(config_id, '{pattern}', 1) AS DOUBLE)" for pattern in ("^k([0-9.]+)_", "_rr([0-9.]+)$"))
CAPITAL = 500_000.0


def _sized_sql(source):
    return f"""SELECT *, shares * stop_distance * {RR} AS gain_at_target, -shares * stop_distance AS loss_at_stop FROM (
      SELECT *, least(floor({CAPITAL} * 2 / 100 / nullif(stop_distance, 0)), floor({CAPITAL} * 5 / nullif(ltp, 0))) AS shares, ltp - {SIGN} * stop_distance AS stop, ltp + {SIGN} * {RR} * stop_distance AS target FROM (
      SELECT s.*, ltp, p.atr, {K} * p.atr AS stop_distance FROM ({source}) s JOIN prices p USING (symbol))) WHERE shares >= 1"""


# ---------------------------------------------------------------- shared steps on Spark


def scan_bars(t):
    return t.timeframes(*SCAN)


def kept_trades(t):
    """The trades, written once: every statistic reads them."""
    if not hasattr(t, "_trades"):
        t._trades = durable(P.card_trades(scan_bars(t)), "trades")
    return t._trades


def scored(t):
    if not hasattr(t, "_scored"):
        t._scored = durable(P.scored(kept_trades(t), P.lengths(scan_bars(t)), own_index(t)), "scored")
    return t._scored


KEYS = ["symbol", "tf", *TS.KEY[1:]]
CFG = f"{SERIES}, strategy, direction, config_id"

# ---------------------------------------------------------------- scores


@query("h01_confidence", "trending", extra=X, sql=f"SELECT {CFG}, n, confidence, band, penalties FROM scored")
def h01(t):
    return scored(t).select(*KEYS, "n", "confidence", "band", F.to_json("penalties").alias("penalties"))


@query("h02_conviction")
def h02(t):
    s = P.with_conviction(scored(t), kept_trades(t))
    return s.select(*KEYS, "agree", "conviction", "conviction_label")


@query("h02_agreement", "trending", extra=X, sql=f"SELECT {CFG}, CAST(len(list_distinct(list(CASE WHEN n >= 20 AND expectancy > 0 THEN split_part(symbol, '@', 2) END) OVER (PARTITION BY {BASE}, strategy))) AS DOUBLE) AS agree FROM scored")
def h02_agreement(t):
    """The timeframes that agree, on which conviction counts."""
    return P.with_agreement(scored(t)).select(*KEYS, "agree")


@query("h03_shortlist", "trending", extra=X, sql=f"SELECT {CFG}, coalesce(confidence >= 70 AND wilson_low >= 60 AND dsr >= 0.5, false) AS shortlist FROM scored")
def h03(t):
    return scored(t).select(*KEYS, scores.shortlist(F.col("confidence"), F.col("wilson_low"), F.col("dsr")).alias("shortlist"))


@query("h04_artifact_note", "trending", extra=X, sql=f"SELECT {CFG}, CASE WHEN dsr < 0.05 THEN printf('Deflated Sharpe %.2f: likely a selection artifact', dsr) END AS note FROM scored")
def h04(t):
    return scored(t).select(*KEYS, scores.artifact_note(F.col("dsr")).alias("note"))


@query("h05_verdict", "trending", extra=X, sql=f"SELECT {CFG}, CASE WHEN confidence IS NULL THEN 'no_edge' WHEN confidence >= 80 THEN 'shortlist' WHEN confidence >= 60 THEN 'watch' ELSE 'skip' END AS verdict FROM scored")
def h05(t):
    return scored(t).select(*KEYS, scores.verdict(F.col("confidence")).alias("verdict"))


# ---------------------------------------------------------------- edge maps


#: The recursive indicators as window sums (Supertrend alone by recursion).
X_RECURSIVE = {
    **X_SUPER, "rma14": rma_sql("tr"), "gains": rma_sql("up"), "losses": rma_sql("down"), "e9": ema_sql("bars", "close", 9, 0), "e21": ema_sql("bars", "close", 21, 0),
    "e12": ema_sql("bars", "close", 12, 0), "e26": ema_sql("bars", "close", 26, 0), "macds": "SELECT symbol, bar_idx, e12.e - e26.e AS m FROM e12 JOIN e26 USING (symbol, bar_idx)", "msig": ema_sql("macds", "m", 9, 25),
}
WIDE = """SELECT i.*, a.e AS atr14, e9.e AS ema9, e21.e AS ema21, CASE WHEN l.e = 0 THEN 100 ELSE 100 - 100 / (1 + g.e / l.e) END AS rsi14, m.m AS macd, s.e AS macd_signal, t.side AS st_dir
  FROM ind i LEFT JOIN rma14 a USING (symbol, bar_idx) LEFT JOIN e9 USING (symbol, bar_idx) LEFT JOIN e21 USING (symbol, bar_idx) LEFT JOIN gains g USING (symbol, bar_idx) LEFT JOIN losses l USING (symbol, bar_idx)
  LEFT JOIN macds m USING (symbol, bar_idx) LEFT JOIN msig s USING (symbol, bar_idx) LEFT JOIN super t USING (symbol, bar_idx) WHERE symbol IN (SELECT symbol FROM len WHERE total >= 100)"""
_MORE = ("ema9", "ema21", "rsi14", "macd", "macd_signal", "st_dir")
IND2_ALL = IND2.split("CASE WHEN count(tr)")[0] + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in _MORE) + ", atr14 AS atr FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)"
RULES.update({
    "ema_cross_9_21": (_x("up", "ema9", "ema21"), _x("down", "ema9", "ema21")), "rsi_reversion": (_x("up", "rsi14", 30.0), _x("down", "rsi14", 70.0)),
    "macd_cross": (_x("up", "macd", "macd_signal"), _x("down", "macd", "macd_signal")), "supertrend": ("p_st_dir < 0 AND st_dir > 0", "p_st_dir > 0 AND st_dir < 0"),
})
X_EDGES = _backtest_sql(SCAN, D.EDGE_SET, [(1.5, 2.0)], IND2_ALL, {"len": LEN} | X_RECURSIVE | {"wide": WIDE}) | X_SCORED | {"deflated": deflated_sql("gathered")}
X_EDGES = {k: v for k, v in X_EDGES.items() if k not in ("scored",)}
EDGE = "n >= 30 AND profit_factor >= 1.2 AND expectancy > 0"


EDGE_MAP = f"""SELECT {SERIES}, strategy, direction, n, R6(win_pct) AS win_pct, R6(expectancy) AS expectancy, R6(profit_factor) AS profit_factor, R6(avg_win) AS avg_win, R6(avg_loss) AS avg_loss,
  R6(max_dd) AS max_dd, {EDGE} AS eligible, R6(oos_expectancy) AS oos_expectancy, oos_n, R6(wf_consistency) AS wf_consistency, R6(dsr) AS dsr FROM deflated"""


@query("i02_edge_map", "trending", extra=X_EDGES, sql=EDGE_MAP)
def i02(t):
    """The thirteen strategies on both sides with Wilder ATR, one position at a time, validated, for each timeframe."""
    return P.edge_map(scan_bars(t))


#: Exits that touch both levels: the level that a minute bar of the day touched first, the stop where none or both did.
FINE = """SELECT symbol, CAST(date_trunc('minute', ts) AS DATE) AS session_date, date_trunc('minute', ts) AS ts, max(ltp) AS high, min(ltp) AS low FROM trending GROUP BY ALL"""
WON = f"""SELECT {K4}, session_date, entry_idx, coalesce(arg_min(ht AND NOT hs, ts) FILTER (WHERE hs OR ht), false) AS won FROM (
  SELECT t.*, f.ts, CASE WHEN sg > 0 THEN f.low <= entry - risk ELSE f.high >= entry + risk END AS hs, CASE WHEN sg > 0 THEN f.high >= entry + rr * risk ELSE f.low <= entry - rr * risk END AS ht
  FROM trades0 t JOIN fine f ON {BASE.replace('symbol', 't.symbol')} = f.symbol AND t.session_date = f.session_date WHERE ambiguous) GROUP BY ALL"""
MENDED = f"SELECT t.* REPLACE (CASE WHEN won THEN rr - {COST!r} * entry / risk ELSE r END AS r) FROM trades0 t LEFT JOIN won USING ({K4}, session_date, entry_idx)"
X_FINE = {}
for _name, _body in X_EDGES.items():
    X_FINE |= {"trades0": _body, "fine": FINE, "won": WON, "trades": MENDED} if _name == "trades" else {_name: _body}


@query("i02_edge_map_intrabar", "trending", extra=X_FINE, sql=EDGE_MAP)
def i02_intrabar(t):
    """The same map where minute bars decide exits that touch both levels, before any statistic."""
    return P.edge_map(scan_bars(t), finer=t.minutes)


@query("i03_edge_index", "trending", extra=X_EDGES, sql=f"SELECT {SERIES}, string_agg(strategy || ' ' || direction || ' ' || n, ', ' ORDER BY round(expectancy, 9) DESC, strategy, direction) AS edges FROM deflated WHERE {EDGE} GROUP BY symbol")
def i03(t):
    one = F.transform("edges", lambda e: F.concat_ws(" ", e["strategy"], e["direction"], e["n"].cast("string")))
    return P.edge_index(P.edge_map(scan_bars(t))).select("symbol", "tf", F.array_join(one, ", ").alias("edges"))


@query("i14_onboard", "trending", extra=X_EDGES, sql=EDGE_MAP)
def i14(t):
    """A symbol that the map does not have yet is tested and merged into it."""
    bars = scan_bars(t)
    new = bars.agg(F.min("symbol").alias("symbol"))
    old = P.edge_map(bars.join(new, "symbol", "left_anti"))
    return L.upsert(old, P.edge_map(bars.join(new, "symbol", "left_semi")), ["symbol"])


PBO = "SELECT symbol, avg(CAST(logit <= 0 AS DOUBLE)) AS pbo FROM logits GROUP BY symbol"
DIVED = _best_sql(f"(SELECT *, CAST(len(list_distinct(list(CASE WHEN n >= 20 AND expectancy > 0 THEN split_part(symbol, '@', 2) END) OVER (PARTITION BY {BASE}, strategy))) AS DOUBLE) AS agree FROM scored)", f"{BASE}, strategy", "n >= 20")


@query(
    "i04_deep_dive", "trending", extra=_backtest_sql(SWEEP, list(D.CARD_SET.values()), P.CARD_CONFIGS) | X_SCORED | {"blocks": BLOCKS} | X_PBO | {"pbo": PBO, "dived": DIVED},
    sql=f"""SELECT {SERIES}, strategy, direction, config_id, n, R6(win_pct) AS win_pct, R6(expectancy) AS expectancy, R6(profit_factor) AS profit_factor, confidence, band, R6(dsr) AS dsr, trials, R6(robustness) AS robustness, agree, R6(pbo) AS pbo,
    CASE WHEN confidence IS NULL THEN 'no_edge' WHEN confidence >= 80 THEN 'shortlist' WHEN confidence >= 60 THEN 'watch' ELSE 'skip' END AS verdict,
    row_number() OVER (PARTITION BY {BASE} ORDER BY {BEST}, strategy) = 1 AS best_overall FROM dived LEFT JOIN pbo USING (symbol)""",
)
def i04(t):
    """Six timeframes, four strategies, both sides, five configurations: 240 of each symbol."""
    return P.deep_dive(t.timeframes(*SWEEP), own_index(t))


# ---------------------------------------------------------------- scanner, finder, picks, staging


@query("i05_scanner", "trending", extra=X | {"scanned": SCANNED}, sql=f"SELECT direction, rank, {SERIES}, strategy, config_id, confidence, band, n, R6(win_pct) AS win_pct, R6(wilson_low) AS wilson_low, R6(expectancy) AS expectancy, R6(profit_factor) AS profit_factor, R6(dsr) AS dsr FROM scanned")
def i05(t):
    return P.scanner(scored(t))


def _priced(t):
    return P.scanner(scored(t)).join(P.last_prices(scan_bars(t)), ["symbol", "tf"])


@query(
    "i06_sized_scanner", "trending", extra=X | {"scanned": SCANNED, "prices": PRICES, "sized": _sized_sql("SELECT * EXCLUDE (atr) FROM (SELECT *, 0 AS atr FROM scanned)")},
    sql=f"SELECT direction, rank, {SERIES}, strategy, config_id, R6(ltp) AS ltp, R6(atr) AS atr, shares, R6(stop) AS stop, R6(target) AS target, R6(gain_at_target) AS gain_at_target, R6(loss_at_stop) AS loss_at_stop FROM sized",
)
def i06(t):
    rows = P.size_rows(_priced(t), budget=CAPITAL, risk_pct=2.0)
    return rows.select("direction", "rank", "symbol", "tf", "strategy", "config_id", "ltp", "atr", F.col("shares").cast("double").alias("shares"), "stop", "target", "gain_at_target", "loss_at_stop")


def _net_sql(level):
    """Profit after the itemised costs of ``shares`` from ltp to a level."""
    a, b = "ltp * shares", f"{level} * shares"
    long = "direction = 'BUY'"
    fees = f"(least({a} * {FEE.BROKERAGE_RATE}, {FEE.BROKERAGE_MAX}) + least({b} * {FEE.BROKERAGE_RATE}, {FEE.BROKERAGE_MAX}) + ({a} + {b}) * {FEE.EXCHANGE + FEE.REGULATOR!r}) * {1 + FEE.GST}"
    legs = f"CASE WHEN {long} THEN {b} * {FEE.STT_SELL} + {a} * {FEE.STAMP_BUY} ELSE {a} * {FEE.STT_SELL} + {b} * {FEE.STAMP_BUY} END"
    return f"(CASE WHEN {long} THEN {b} - {a} ELSE {a} - {b} END - {fees} - {legs} - ({a} + {b}) * {FEE.SLIPPAGE})"


FOUND = f"""SELECT *, {_net_sql('target')} AS net_profit, {_net_sql('stop')} AS net_loss, shares * ltp / ({CAPITAL} * 5) * 100 AS deployed_pct, CASE WHEN by_risk <= by_money THEN 'ideal' ELSE 'leverage_bound' END AS fit, confidence * least(shares / by_risk, 1.0) AS fit_score FROM (
  SELECT *, floor({CAPITAL} * 2 / 100 / stop_distance) AS by_risk, floor({CAPITAL} * 5 / ltp) AS by_money FROM ({_sized_sql(_best_sql('scored', BASE, 'confidence >= 50'))}))"""
#: One symbol is blocked, one needs caution, one is not known.
VERDICTS = [("error", "blocked", "surveillance: ASM"), ("signup", "caution", "thin liquidity"), ("click", "ok", ""), ("view", "ok", "")]
PICKED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY round(fit_score, 9) DESC, {BASE}, strategy, config_id) AS rank FROM (
  SELECT f.*, coalesce(v.verdict, 'unverified') AS tradability, CASE WHEN v.verdict = 'caution' THEN v.reason WHEN v.verdict IS NULL THEN 'not verified' END AS note FROM found f LEFT JOIN (VALUES {', '.join(map(str, VERDICTS))}) v(name, verdict, reason) ON name = {BASE.replace('symbol', 'f.symbol')})
  WHERE tradability <> 'blocked' AND expectancy > 0 AND shares > 0 AND NOT expectancy < {COST!r} * ltp / abs(ltp - stop)) WHERE rank <= 5"""
X_FOUND = X | {"prices": PRICES, "found": FOUND, "picked": PICKED}


def found(t):
    return P.finder(scored(t), P.last_prices(scan_bars(t)), capital=CAPITAL, risk_pct=2.0)


def picked(t):
    return P.picks(found(t), t.spark.createDataFrame(VERDICTS, "symbol string, verdict string, reason string"))


@query(
    "i07_finder", "trending", extra=X_FOUND,
    sql=f"""SELECT {SERIES}, strategy, direction, config_id, confidence, R6(expectancy) AS expectancy, R6(win_pct) AS win_pct, R6(wilson_low) AS wilson_low, R6(profit_factor) AS profit_factor, n, R6(ltp) AS ltp, R6(atr) AS atr, shares, by_risk AS shares_by_risk, by_money AS shares_by_money,
    R6(stop) AS stop, R6(target) AS target, R6(net_profit) AS net_profit, R6(net_loss) AS net_loss, R6(deployed_pct) AS deployed_pct, fit, R6(fit_score) AS fit_score FROM found""",
)
def i07(t):
    return found(t).withColumn("shares", F.col("shares").cast("double"))


@query("i09_picks", "trending", extra=X_FOUND, sql=f"SELECT direction, rank, {SERIES}, strategy, config_id, confidence, R6(expectancy) AS expectancy, shares, R6(net_profit) AS net_profit, R6(net_loss) AS net_loss, CAST(round(wilson_low / 10) AS INT) AS x_of_10, tradability, note FROM picked")
def i09(t):
    rows = picked(t).withColumn("shares", F.col("shares").cast("double"))
    return rows.select("direction", "rank", "symbol", "tf", "strategy", "config_id", "confidence", "expectancy", "shares", "net_profit", "net_loss", "x_of_10", "tradability", "note")


@query(
    "i10_target_feasibility", "trending", extra=X_FOUND,
    sql="""SELECT picks, 2.0::DOUBLE AS multiple, R6(g * 100) AS growth_pct, CAST(CASE WHEN g > 0 THEN least(greatest(ceil(ln(2.0) / ln(1 + g)), 0), 1000000) ELSE 0 END AS BIGINT) AS trades_needed, CASE WHEN g > 0 THEN 'aggressive' ELSE 'unrealistic' END AS label
    FROM (SELECT count(*) AS picks, coalesce(median(expectancy), 0) * 2 / 100 AS g FROM picked)""",
)
def i10(t):
    return P.target_feasibility(picked(t), 2.0, CAPITAL, 2 * CAPITAL)


STAGED = f"""SELECT *, least(floor({CAPITAL} * risk_pct / 100 / nullif(d, 0)), floor({CAPITAL} * 5 / nullif(lim, 0))) AS shares, lim - {SIGN} * d AS stop, lim + {SIGN} * {RR} * d AS target FROM (
  SELECT s.*, risk_pct, ltp - {SIGN} * 0.1 * p.atr AS lim, {K} * p.atr AS d FROM (SELECT * EXCLUDE (shares, stop, target, atr) FROM picked) s JOIN (SELECT symbol, atr FROM prices) p USING (symbol) CROSS JOIN (VALUES (0.5), (1.0), (2.0)) v(risk_pct) WHERE rank <= 5)"""


@query(
    "i11_staged_orders", "trending", extra=X_FOUND | {"staged": STAGED},
    sql=f"""SELECT direction, rank, {SERIES}, strategy, CAST(risk_pct AS DOUBLE) AS risk_pct, R6(lim) AS "limit", R6(stop) AS stop, R6(target) AS target, shares,
    printf('%s %s x%d LIMIT %.2f SL %.2f TP %.2f', direction, {BASE}, CAST(shares AS BIGINT), lim, stop, target) AS text FROM staged WHERE shares >= 1""",
)
def i11(t):
    """The picks staged at three risks, with the text of each order."""
    return P.staged(picked(t)).withColumn("shares", F.col("shares").cast("double"))


@query("i13_setup_card")
def i13(t):
    return P.setup_cards(scored(t), kept_trades(t), P.last_prices(scan_bars(t)))
