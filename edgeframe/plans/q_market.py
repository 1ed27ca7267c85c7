"""Registered queries of snapshot verdicts and of onboarding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import bars as B
from ..operators import indicators as C
from ..operators import ticks as M
from .q_bars import SESSIONS
from .q_ticks import _A, _B, with_depth
from .registry import query

SNAP = f"""SELECT t.symbol, t.event_id, t.ltp AS price, CASE WHEN t.ltp > 0 THEN (({_B}) - ({_A})) / CAST(({_B}) + ({_A}) AS DOUBLE) END AS ob, p.*, t.event_id % 50 = 0 AS blocked, t.event_id % 3 AS news FROM ticks t JOIN
  (SELECT symbol AS s, close, (high + low + close) / 3 AS p, 2 * (high + low + close) / 3 - low AS r1, (high + low + close) / 3 + high - low AS r2, 2 * (high + low + close) / 3 - high AS s1, (high + low + close) / 3 - (high - low) AS s2
   FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS n FROM sessions WHERE low > 0) WHERE n = 1) p ON p.s = t.symbol"""
MOVE = "((price - close) / close * 100)"
NEAR = "abs(price - {x}) / price < 0.004 AND {x} > 0"


def _steps(x, a, b, hi, lo):
    return f"CASE WHEN {x} > {b} THEN {hi} WHEN {x} > {a} THEN {lo} WHEN {x} < -{b} THEN -{hi} WHEN {x} < -{a} THEN -{lo} ELSE 0 END"


def near(a, b):
    return f"CASE WHEN ({NEAR.format(x=a)}) OR ({NEAR.format(x=b)}) THEN 1 ELSE 0 END"


NET = f"{_steps('ob', 0.15, 0.4, 3, 2)} + {_steps(MOVE, 0.2, 1.0, 2, 1)} + CAST(sign(price - p) AS INT) + {near('s1', 's2')} - {near('r1', 'r2')} + CASE news WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"


def snapshot(t):
    imbalance, _ = M.book()
    pivots = C.floor_pivots(B.session_bars(t.bars).where("low > 0"))
    last = B.session_bars(t.bars).where("low > 0").groupBy("symbol").agg(F.max_by("close", "session_date").alias("close"))
    rows = with_depth(t).where("ltp > 0").withColumn("imbalance", imbalance).join(pivots, "symbol").join(last, "symbol").withColumn("price", F.col("ltp"))
    news = F.when(F.col("event_id") % 3 == 0, "positive").when(F.col("event_id") % 3 == 1, "negative").otherwise("neutral")
    return rows.withColumn("move_pct", (F.col("price") - F.col("close")) / F.col("close") * 100).withColumn("news", news).withColumn("blocked", F.col("event_id") % 50 == 0)


@query("h06_lean", "bars", extra={"sessions": SESSIONS, "x": SNAP}, sql=f"SELECT event_id, net, CASE WHEN blocked THEN 'DO NOT TRADE' WHEN net >= 2 THEN 'LEAN BUY' WHEN net <= -2 THEN 'LEAN SELL' ELSE 'STAND ASIDE' END AS lean FROM (SELECT *, {NET} AS net FROM x WHERE price > 0)")
def h06(t):
    return scores.lean(snapshot(t)).select("event_id", "net", "lean")


@query("h07_book_agreement", "ticks", sql=f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN o > 0 OR b >= a ELSE o < 0 OR b < a END AS agrees FROM (SELECT event_id, ({_B}) AS b, ({_A}) AS a, (({_B}) - ({_A})) / CAST(({_B}) + ({_A}) AS DOUBLE) AS o FROM ticks WHERE ltp > 0)")
def h07(t):
    imbalance, _ = M.book()
    qty = lambda side: F.aggregate(F.col(f"depth.{side}"), F.lit(0).cast("long"), lambda a, x: a + x["qty"])
    side = F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")
    return with_depth(t).where("ltp > 0").select("event_id", scores.book_agrees(side, imbalance, qty("bids"), qty("asks")).alias("agrees"))
