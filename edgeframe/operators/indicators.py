"""Indicators: windowed ones as column expressions, recursive ones in one grouped kernel.

Windowed indicators share the window specs (symbol[, session]) so that one sort serves them all. The
recursive ones (EMA, Wilder RSI and ATR, MACD, Supertrend) need the previous value of their own
series: one task holds the few numeric columns of one (symbol, timeframe), or of a range of it when the bars
are too many for one range (``scan``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from . import ranges
from .bars import series

#: Periods of the EMAs of closes, Wilder means of moves, and the parameters of MACD's signal and Supertrend.
EMAS, WILDER = [9, 21, 50, 12, 26], [("gain", 14), ("loss", 14), ("tr", 14), ("tr", 10)]
SIGNAL, ST_PERIOD, ST_WIDTH = 9, 10, 3.0


def _series(df: DataFrame) -> WindowSpec:
    return Window.partitionBy(series(df)).orderBy("bar_idx")


def _full(w: WindowSpec, n: int, value: Column) -> Column:
    """``value`` only where its frame holds ``n`` rows."""
    return F.when(F.count(F.lit(1)).over(w) == n, value)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def true_range(df: DataFrame) -> Column:
    prev = F.lag("close").over(_series(df))
    return F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def windowed(bars: DataFrame, n: int = 20, tf_minutes: int = 60, rows_each: int = ranges.ROWS_EACH) -> DataFrame:
    """Adds mean, sd, bands, VWAP and its bands, Donchian, relative volume, z-score, pivot, gap and opening range.

    The width of a bar is that of its ``tf``, without one ``tf_minutes``. Frames over a series run on its ranges.
    """
    from .bars import with_prior_session

    key = series(bars)
    day = Window.partitionBy(*key, "session_date").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)

    def over_series(rows: DataFrame, w: WindowSpec) -> DataFrame:
        tail, prior = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-n, -1)
        return (
            rows.withColumn("mean20", _full(tail, n, F.avg("close").over(tail)))
            .withColumn("sd20", _full(tail, n, F.stddev_pop("close").over(tail)))
            .withColumn("don_hi", _full(prior, n, F.max("high").over(prior)))
            .withColumn("don_lo", _full(prior, n, F.min("low").over(prior)))
            .withColumn("rvol", _full(prior, n, F.try_divide("volume", F.avg("volume").over(prior))))
        )

    out = (
        with_prior_session(ranges.trailing(bars, key, ["bar_idx"], n, over_series, rows_each))
        .withColumn("vol", F.sum("volume").over(day))
        .withColumn("vwap", F.when(F.col("vol") > 0, F.sum(typical() * F.col("volume")).over(day) / F.nullif("vol", F.lit(0.0))).otherwise(F.col("close")))
        .withColumn("nth", F.row_number().over(Window.partitionBy(*key, "session_date").orderBy("bar_idx")))
        .drop("vol")
    )
    minutes = F.regexp_extract("tf", "^([0-9]+)", 1).cast("int") if "tf" in bars.columns else F.lit(tf_minutes)
    first = F.greatest(F.floor(F.lit(15) / minutes), F.lit(1))
    opening = lambda f, c: f(F.when(F.col("nth") <= first, F.col(c))).over(Window.partitionBy(*key, "session_date"))
    return (
        out.withColumn("bb_up", F.col("mean20") + 2 * F.col("sd20"))
        .withColumn("bb_lo", F.col("mean20") - 2 * F.col("sd20"))
        .withColumn("vwap_up", F.col("vwap") + 2 * F.col("sd20"))
        .withColumn("vwap_lo", F.col("vwap") - 2 * F.col("sd20"))
        .withColumn("z20", F.when(F.col("sd20") > 0, (F.col("close") - F.col("mean20")) / F.nullif("sd20", F.lit(0.0))))
        .withColumn("cpr", (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3)
        .withColumn("gap_pct", F.when(F.col("prev_close") > 0, (F.col("session_open") / F.col("prev_close") - 1) * 100))
        .withColumn("or_hi", F.when(F.col("nth") > first, opening(F.max, "high")))
        .withColumn("or_lo", F.when(F.col("nth") > first, opening(F.min, "low")))
    )


# ---------------------------------------------------------------- recursive


def decayed(x: np.ndarray, start: float, keep: float, gain: float, scale: float = 1e4) -> np.ndarray:
    """y[i] = keep * y[i - 1] + gain * x[i], with y before the first equal to ``start``.

    Blocks of the series are summed side by side with weights that stay within ``scale``; only what one
    block hands to the next is worked out in turn.
    """
    width = max(1, int(np.log(scale) / -np.log(keep)))
    blocks = -(-len(x) // width) or 1
    padded = np.zeros(blocks * width)
    padded[: len(x)] = x
    weight = keep ** np.arange(width)
    inside = np.cumsum(padded.reshape(blocks, width) * (gain / weight), axis=1) * weight
    handed, now, fall = np.empty(blocks), start, keep**width
    for i, last in enumerate(inside[:, -1].tolist()):
        handed[i] = now
        now = now * fall + last
    return (inside + handed[:, None] * (weight * keep)).ravel()[: len(x)]


def ema(x: np.ndarray, p: int) -> np.ndarray:
    """Seeded with the mean of the first ``p`` finite values, placed at the last of them; others carry the value on."""
    out, ok = np.full(len(x), np.nan), np.flatnonzero(np.isfinite(x))
    if len(ok) < p:
        return out
    seed, k = x[ok[:p]].mean(), 2.0 / (p + 1)
    values = np.r_[seed, decayed(x[ok[p:]], seed, 1 - k, k)]
    at = ok[p - 1]
    out[at:] = values[np.searchsorted(ok[p - 1 :], np.arange(at, len(x)), side="right") - 1]
    return out


def _wilder(x: np.ndarray, p: int) -> np.ndarray:
    """Wilder's mean of each value and those before it, from the ``p``-th on."""
    seed = x[:p].mean()
    return np.r_[seed, decayed(x[p:], seed, (p - 1) / p, 1 / p)]


def wilder_atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int = 14) -> np.ndarray:
    out = np.full(len(c), np.nan)
    if len(c) > p:
        out[p:] = _wilder(np.maximum.reduce([h[1:] - l[1:], abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])]), p)
    return out


def wilder_rsi(c: np.ndarray, p: int = 14) -> np.ndarray:
    out = np.full(len(c), np.nan)
    if len(c) > p:
        d = np.diff(c)
        out[p:] = rsi_of(_wilder(np.maximum(d, 0), p), _wilder(np.maximum(-d, 0), p))
    return out


def rsi_of(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))


def sides(u: np.ndarray, d: np.ndarray, c: np.ndarray, prev: np.ndarray, state: tuple[float, float, float] | None = None) -> list[float]:
    """The side after each bar of upper and lower bands, closes and the closes before them, from (side, upper, lower) if begun."""
    out = []
    side, upper, lower = state or (1.0, None, None)
    for up, down, close, was in zip(u.tolist(), d.tolist(), c.tolist(), prev.tolist()):
        if upper is None:
            upper, lower = up, down
        else:
            upper = up if up < upper or was > upper else upper
            lower = down if down > lower or was < lower else lower
            side = 1.0 if close > upper else -1.0 if close < lower else side
        out.append(side)
    return out


def supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int = ST_PERIOD, width: float = ST_WIDTH) -> np.ndarray:
    """+1 or -1: the side of the carried band that the close last crossed."""
    atr, mid = wilder_atr(h, l, c, p), (h + l) / 2
    out = np.full(len(c), np.nan)
    at = np.flatnonzero(np.isfinite(atr))
    out[at] = sides((mid + width * atr)[at], (mid - width * atr)[at], c[at], c[at - 1])
    return out


RECURSIVE = ["ema9", "ema21", "ema50", "rsi14", "atr14", "macd", "macd_signal", "st_dir"]


def recursive(bars: DataFrame, rows_each: int = ranges.ROWS_EACH) -> DataFrame:
    """key, bar_idx and the recursive series; undefined values are null.

    Bars that fit one range of ``rows_each`` rows take a task a series; more of them are cut into ranges, whatever the series.
    """
    key = series(bars)
    if ranges.ranges_of(bars, rows_each) > 1:
        from . import scan

        return _defined(scan.recursive(bars, key, rows_each), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        h, l, c = (pdf[k].to_numpy(float) for k in ("high", "low", "close"))
        macd = ema(c, 12) - ema(c, 26)
        series = [ema(c, 9), ema(c, 21), ema(c, 50), wilder_rsi(c), wilder_atr(h, l, c), macd, ema(macd, 9), supertrend(h, l, c)]
        return pdf[[*key, "bar_idx"]].assign(**dict(zip(RECURSIVE, series)))

    types = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    shape = ", ".join([f"{k} {types[k]}" for k in [*key, "bar_idx"]] + [f"{c} double" for c in RECURSIVE])
    out = bars.select(*key, "bar_idx", "high", "low", "close").groupBy(*key).applyInPandas(run, shape)
    return _defined(out, key)


def _defined(out: DataFrame, key: list[str]) -> DataFrame:
    return out.select(*key, "bar_idx", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in RECURSIVE])


def all_indicators(bars: DataFrame, tf_minutes: int = 60) -> DataFrame:
    return windowed(bars, tf_minutes=tf_minutes).join(recursive(bars), [*series(bars), "bar_idx"])


def final_wilder(bars: DataFrame, order: str, atr_period: int = 14, ema_period: int = 200) -> DataFrame:
    """Last Wilder ATR and last EMA of each series: each is a weighted sum over its bars, so only sums are gathered."""
    key = series(bars)
    w = Window.partitionBy(*key).orderBy(order)
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    rows = bars.select(*key, order, "close", F.when(prev.isNotNull(), tr).alias("tr"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("n"))

    def last(value: str, nth: Column, count: Column, p: int, keep: float) -> Column:
        """The first ``p`` values share what is left of the seed's weight; later ones fade by ``keep`` for every one after them."""
        weight = F.when(nth <= p, F.pow(F.lit(keep), count - p) / p).otherwise((1 - keep) * F.pow(F.lit(keep), count - nth))
        return F.when(F.max(count) >= p, F.sum(weight * F.col(value)))

    i, n = F.col("i"), F.col("n")
    atr = last("tr", i - 1, n - 1, atr_period, (atr_period - 1) / atr_period)
    return rows.groupBy(*key).agg(atr.alias("atr"), last("close", i, n, ema_period, 1 - 2 / (ema_period + 1)).alias("ema"))


def year_range(daily: DataFrame, order: str = "date", n: int = 252) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return daily.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).groupBy("symbol").agg(F.max("high").alias("high_52w"), F.min("low").alias("low_52w"))


# ---------------------------------------------------------------- volume profile


def volume_histogram(bars: DataFrame, sessions: int = 25, bins: int = 100) -> DataFrame:
    """symbol, bin, volume, lo, width over the typical prices of the last sessions."""
    from .bars import last_sessions

    by = Window.partitionBy("symbol")
    t = last_sessions(bars, sessions).select("symbol", typical().alias("tp"), "volume")
    t = t.withColumn("lo", F.min("tp").over(by)).withColumn("width", (F.max("tp").over(by) - F.col("lo")) / bins)
    place = F.when(F.col("width") > 0, F.least(F.floor((F.col("tp") - F.col("lo")) / F.nullif("width", F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    return t.withColumn("bin", place).groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"), F.min("lo").alias("lo"), F.min("width").alias("width"))


def value_area(hist: DataFrame, bins: int = 100, share: float = 0.7) -> DataFrame:
    """symbol, poc, vah, val: the heaviest bin (ties: highest) grown to ``share`` by its heavier neighbour (ties: up)."""
    per = hist.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("bin", "volume"))).alias("m"), F.sum("volume").alias("total"), F.max(F.struct("volume", "bin")).alias("top"), F.min("lo").alias("lo"), F.min("width").alias("width"))
    per = per.withColumn("v", F.expr(f"transform(sequence(0, {bins - 1}), i -> coalesce(m[i], 0D))")).withColumn("poc_bin", F.col("top.bin"))
    grow = f"""aggregate(sequence(1, {bins}), named_struct('a', poc_bin, 'b', poc_bin, 's', v[poc_bin]), (w, i) ->
        CASE WHEN w.s >= {share} * total OR (w.a = 0 AND w.b = {bins - 1}) THEN w
             WHEN w.b < {bins - 1} AND (w.a = 0 OR try_element_at(v, w.b + 2) >= v[greatest(w.a - 1, 0)]) THEN named_struct('a', w.a, 'b', w.b + 1, 's', w.s + try_element_at(v, w.b + 2))
             ELSE named_struct('a', w.a - 1, 'b', w.b, 's', w.s + v[greatest(w.a - 1, 0)]) END)"""
    per = per.withColumn("g", F.expr(grow))
    edge = lambda b, up: F.col("lo") + (F.col(b) + up) * F.col("width")
    return per.select("symbol", edge("poc_bin", 0.5).alias("poc"), edge("g.b", 1.0).alias("vah"), edge("g.a", 0.0).alias("val"))


# ---------------------------------------------------------------- tails of daily series


def daily_tails(daily: DataFrame, sma: int = 200, returns: tuple[int, ...] = (21, 63, 252), price: str = "adj_close") -> DataFrame:
    """Per symbol: last close, SMA of the last min(n, len), n-bar returns, CAGR, drawdown, volatility, off-high, consistency."""
    up, down = Window.partitionBy("symbol").orderBy("date"), Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = daily.select("symbol", "date", F.col(price).alias("x"))
    rows = rows.withColumn("rn", F.row_number().over(down)).withColumn("idx", F.row_number().over(up) - 1)
    rows = rows.withColumn("ret", F.col("x") / F.lag("x").over(up) - 1).withColumn("peak", F.max("x").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("year_ago", F.lag("x", 252).over(up)).withColumn("dd", F.col("x") / F.col("peak") - 1)
    for n in returns:
        rows = rows.withColumn(f"back_{n}", F.lag("x", n).over(up))
    hold = (F.col("idx") >= 252) & ((F.col("idx") - 252) % 21 == 0)
    last = F.col("rn") == 1
    first = F.min_by("x", "idx")
    years = F.count(F.lit(1)) / 252.0
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.max(F.when(last, F.col("x"))).alias("last"), F.avg(F.when(F.col("rn") <= sma, F.col("x"))).alias("sma"),
        *[F.max(F.when(last, (F.col("x") / F.col(f"back_{n}") - 1) * 100)).alias(f"ret_{n}") for n in returns],
        ((F.pow(F.max_by("x", "idx") / first, 1 / years) - 1) * 100).alias("cagr"),
        (F.min("dd") * -100).alias("max_dd_pct"), (F.stddev_pop("ret") * F.sqrt(F.lit(252.0)) * 100).alias("vol_pct"),
        ((F.max(F.when(last, F.col("x"))) / F.max(F.when(F.col("rn") <= 252, F.col("x"))) - 1) * 100).alias("off_high_pct"),
        F.avg(F.when(hold & F.col("year_ago").isNotNull(), (F.col("x") > F.col("year_ago")).cast("double"))).alias("consistency"),
    )


def floor_pivots(sessions: DataFrame) -> DataFrame:
    """P, R1-R3, S1-S3 from the last usable session of each symbol."""
    from .bars import usable

    last = usable(sessions).groupBy("symbol").agg(F.max_by(F.struct("high", "low", "close"), "session_date").alias("s"))
    h, l, c = F.col("s.high"), F.col("s.low"), F.col("s.close")
    p = (h + l + c) / 3
    return last.select("symbol", p.alias("p"), (2 * p - l).alias("r1"), (p + h - l).alias("r2"), (h + 2 * (p - l)).alias("r3"), (2 * p - h).alias("s1"), (p - (h - l)).alias("s2"), (l - 2 * (h - p)).alias("s3"))
