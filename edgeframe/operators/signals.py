"""Entry signals as a registry of column predicates over a bar and the one before it.

A strategy is a pair of predicates (long, short) over the indicator columns; a user's own strategy is
one more entry. All strategies are read in a single pass that gives one row per signal. A missing
value on either side of a cross means no signal; a bar where both hold is a long signal only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import series

Signal = Callable[[Callable[[str], Column], Callable[[str], Column]], tuple[Column, Column]]


def up(x: str, y: str | float) -> Callable:
    def test(now, before):
        a, b = (now(y), before(y)) if isinstance(y, str) else (F.lit(y), F.lit(y))
        return (before(x) <= b) & (now(x) > a)

    return test


def down(x: str, y: str | float) -> Callable:
    def test(now, before):
        a, b = (now(y), before(y)) if isinstance(y, str) else (F.lit(y), F.lit(y))
        return (before(x) >= b) & (now(x) < a)

    return test


def _pair(long: Callable, short: Callable) -> Signal:
    return lambda now, before: (long(now, before), short(now, before))


def _gap(now, before):
    first = now("nth") == 1
    return first & (now("gap_pct") > 0.5) & (now("close") >= now("open")), first & (now("gap_pct") < -0.5) & (now("close") < now("open"))


def _rvol(now, before):
    burst = up("rvol", 2.0)(now, before)
    return burst & (now("close") >= now("open")), burst & (now("close") < now("open"))


def _flip(now, before):
    return (before("st_dir") < 0) & (now("st_dir") > 0), (before("st_dir") > 0) & (now("st_dir") < 0)


WINDOWED: dict[str, Signal] = {
    "vwap_cross": _pair(up("close", "vwap"), down("close", "vwap")),
    "bollinger_reversion": _pair(up("close", "bb_lo"), down("close", "bb_up")),
    "orb_15m": _pair(up("close", "or_hi"), down("close", "or_lo")),
    "donchian_breakout": _pair(up("close", "don_hi"), down("close", "don_lo")),
    "zscore_reversion": _pair(up("z20", -2.0), down("z20", 2.0)),
    "vwap_band_reversion": _pair(up("close", "vwap_lo"), down("close", "vwap_up")),
    "cpr_pivot": _pair(up("close", "cpr"), down("close", "cpr")),
    "gap_and_go": _gap,
    "rvol_breakout": _rvol,
    "prev_day_breakout": _pair(up("close", "prev_high"), down("close", "prev_low")),
}
RECURSIVE: dict[str, Signal] = {
    "ema_cross_9_21": _pair(up("ema9", "ema21"), down("ema9", "ema21")),
    "rsi_reversion": _pair(up("rsi14", 30.0), down("rsi14", 70.0)),
    "macd_cross": _pair(up("macd", "macd_signal"), down("macd", "macd_signal")),
    "supertrend": _flip,
}
#: The thirteen strategies of the edge map, and the four of the setup card.
EDGE_SET = [k for k in {**WINDOWED, **RECURSIVE} if k != "prev_day_breakout"]
CARD_SET = {"VWAP Trend": "vwap_cross", "Opening Range": "orb_15m", "Gap-and-Go": "gap_and_go", "Prev-Day Breakout": "prev_day_breakout"}


def signals(bars: DataFrame, strategies: dict[str, Signal], keep: list[str]) -> DataFrame:
    """strategy, direction and the ``keep`` columns, one row per signal."""
    key = series(bars)
    w = Window.partitionBy(key).orderBy("bar_idx")
    used: set[str] = set()

    def note(c: str) -> Column:
        used.add(c)
        return F.col(f"__p_{c}")

    found = []
    for name, rule in strategies.items():
        long, short = rule(F.col, note)
        side = F.when(F.coalesce(long, F.lit(False)), "BUY").when(F.coalesce(short, F.lit(False)), "SELL")
        found.append(F.when(side.isNotNull(), F.struct(F.lit(name).alias("strategy"), side.alias("direction"))))
    df = reduce(lambda d, c: d.withColumn(f"__p_{c}", F.lag(c).over(w)), sorted(used), bars)
    return df.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("s")).select(*keep, "s.*")
