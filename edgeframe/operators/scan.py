"""Recurrences over series that are longer than a task: each range of a series is a map of the state before it.

A step of an EMA or of a Wilder mean is y -> a * y + b, and so is a run of such steps (while a series is being seeded, a step
adds x / p). A step of a Supertrend band keeps the band or replaces it by this bar's, whatever it was before, so a run of them
keeps the bands between two bounds and sends all others to a few values. A series is cut into ranges of bars; each range works
out its map alone, the maps of a series (a few numbers a range) are composed in the order of the ranges, and each range then
runs from the state that it is handed. MACD's signal and the bands need the means first, so there are two such rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import durable
from . import ranges
from .indicators import EMAS, RECURSIVE, SIGNAL, ST_PERIOD, ST_WIDTH, WILDER, decayed, rsi_of, sides

# ---------------------------------------------------------------- means


def mean_steps(x: np.ndarray, before: int, p: int, keep: float, gain: float, start: float) -> np.ndarray:
    """The state after each of the values ``x``, of which ``before`` came earlier in the series: the first ``p`` of a series add
    up to their mean, each later one is weighed in."""
    seeding = min(max(p - before, 0), len(x))
    warm = start + np.cumsum(x[:seeding] / p)
    return np.r_[warm, decayed(x[seeding:], warm[-1] if seeding else start, keep, gain)]


def mean_map(x: np.ndarray, before: int, p: int, keep: float, gain: float) -> tuple[float, float]:
    """(a, b) of all the steps of ``mean_steps`` together."""
    y = mean_steps(x, before, p, keep, gain, 0.0)
    return keep ** (len(x) - min(max(p - before, 0), len(x))), float(y[-1]) if len(y) else 0.0


def carried(values: np.ndarray, ok: np.ndarray, start: float) -> np.ndarray:
    """``values`` (one for each true of ``ok``) laid over all rows: a row without its own has the one before it."""
    return np.r_[start, values][np.cumsum(ok)]


# ---------------------------------------------------------------- bands


def band_map(u: np.ndarray, c: np.ndarray, prev: np.ndarray, fresh: bool) -> dict:
    """What a run of bars makes of an upper band B: a bar with u < B or prev > B replaces it by u; c > B is a cross.

    The bands that were replaced at a bar are one from there on. ``ways`` lists, in the order of time, which bands leave
    (below or above a threshold) and where they end: (below, threshold, final band, last bar with a cross or -1). A band
    that is on no way stays; it is crossed at the last bar if it lies below ``last``. In a ``fresh`` run the first bar sets the
    band, and is not tested.
    """
    lo, hi = -np.inf, np.inf  # bands between these are still as they were
    ways: list[tuple[bool, float, int, int]] = []
    parent, value, cross = [], [], []
    live: list[int] = []
    for i, (now, close, was) in enumerate(zip(u.tolist(), c.tolist(), prev.tolist())):
        gone = [t for t in live if now < value[t] or was > value[t]]
        start = fresh and i == 0
        below, above = not start and lo <= hi and was > lo, start or (lo <= hi and now < hi)
        if gone or below or above:
            new = len(value)
            parent.append(-1), value.append(now), cross.append(-1)
            for t in gone:
                parent[t] = new
            live = [t for t in live if parent[t] < 0] + [new]
            if below:
                ways.append((True, was, new, i - 1))
                lo = was
            if above:
                ways.append((False, -np.inf if start else now, new, -1))
                hi = -np.inf if start else now
        if not start:
            for t in live:
                if close > value[t]:
                    cross[t] = i
    # Bands that leave on one side have nothing of the other side before them, so of ways with one end the last tells enough.
    ends = {}
    for below, threshold, t, last in ways:
        while True:
            last = max(last, cross[t])
            if parent[t] < 0:
                break
            t = parent[t]
        ends.pop((below, value[t], last), None)
        ends[below, value[t], last] = {"below": below, "threshold": threshold, "band": value[t], "last": last}
    return {"ways": list(ends.values()), "last": float(c[-1]) if len(c) and not np.isnan(c[-1]) else -np.inf, "n": len(c)}


def through(band: float, run: dict) -> tuple[float, int]:
    """(band, last bar with a cross or -1) after a run."""
    for way in run["ways"]:
        if band < way["threshold"] if way["below"] else band > way["threshold"]:
            return way["band"], way["last"]
    return band, run["n"] - 1 if band < run["last"] else -1


# ---------------------------------------------------------------- ranges of a series

#: The means of a series: EMAs of its closes, then Wilder means of its moves.
MEANS = len(EMAS) + len(WILDER)
_RUN = "struct<ways:array<struct<below:boolean,threshold:double,band:double,last:long>>,last:double,n:long>"


def _means(p: pd.DataFrame) -> list[tuple[np.ndarray, int, int, float, float]]:
    """Arguments of ``mean_map`` for each mean of a range."""
    c, h, l, prev = (p[k].to_numpy(float) for k in ("close", "high", "low", "prev"))
    rows, finite = int(p["__rows"].iloc[0]), int(p["__finite"].iloc[0])
    moved = slice(1 if rows == 0 else 0, None)  # the first row of a series has no row before it
    moves = {"gain": np.maximum(c - prev, 0), "loss": np.maximum(prev - c, 0), "tr": np.maximum.reduce([h - l, abs(h - prev), abs(l - prev)])}
    out = [(c[np.isfinite(c)], finite, n, 1 - 2 / (n + 1), 2 / (n + 1)) for n in EMAS]
    return out + [(moves[k][moved], max(rows - 1, 0), n, (n - 1) / n, 1 / n) for k, n in WILDER]


def _lines(p: pd.DataFrame, start: np.ndarray) -> list[np.ndarray]:
    """Each mean at each row of a range, null before its seed is whole."""
    c, rows, finite = p["close"].to_numpy(float), int(p["__rows"].iloc[0]), int(p["__finite"].iloc[0])
    out = []
    for i, (x, before, n, keep, gain) in enumerate(_means(p)):
        y = mean_steps(x, before, n, keep, gain, start[i])
        if i < len(EMAS):
            ok = np.isfinite(c)
            out.append(np.where(finite + np.cumsum(ok) >= n, carried(y, ok, start[i]), np.nan))
        else:
            y = np.r_[np.full(len(c) - len(y), np.nan), y]
            out.append(np.where(rows + np.arange(len(c)) >= n, y, np.nan))
    return out


def _macd(lines: list[np.ndarray]) -> np.ndarray:
    return lines[EMAS.index(12)] - lines[EMAS.index(26)]


def _bands(p: pd.DataFrame, lines: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Rows with a band, upper and lower band, close and the close before."""
    atr = lines[len(EMAS) + WILDER.index(("tr", ST_PERIOD))]
    at = np.flatnonzero(np.isfinite(atr))
    mid, c, prev = (p["high"].to_numpy(float) + p["low"].to_numpy(float)) / 2, p["close"].to_numpy(float), p["prev"].to_numpy(float)
    return at, (mid + ST_WIDTH * atr)[at], (mid - ST_WIDTH * atr)[at], c[at], prev[at]


def recursive(bars: DataFrame, key: list[str], rows_each: int) -> DataFrame:
    """The rows of ``indicators.recursive``, with a task for about ``rows_each`` bars of a series."""
    mine, types = ["__range", *key], {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    keys = "__range int, " + "".join(f"{k} {types[k]}, " for k in key)
    slim = bars.select(*key, "bar_idx", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")])
    cut = ranges.with_halo(ranges.ranged(slim, key, ["bar_idx"], ranges.ranges_of(slim, rows_each)), key, ["bar_idx"], 1)
    rows = cut.withColumn("prev", F.lag("close").over(Window.partitionBy(*mine).orderBy("bar_idx"))).where("NOT __halo").drop("__halo")
    finite = F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf"))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*mine).agg(F.count(F.lit(1)).alias("__n"), F.count_if(finite).alias("__f"))
    counts = counts.select(*mine, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to) for c, to in (("__n", "__rows"), ("__f", "__finite"))])
    rows = durable(rows.join(counts, mine), "series")

    def each(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
        return df.groupBy(*mine).applyInPandas(lambda p: run(p.sort_values("bar_idx", ignore_index=True)), shape)

    def composed(maps: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
        """One row for each range of a series, a few numbers wide, in one task a series."""
        return maps.groupBy(*key).applyInPandas(lambda p: run(p.sort_values("__range", ignore_index=True)), shape)

    def head(p: pd.DataFrame) -> dict:
        return {k: p[k].iloc[0] for k in mine}

    def mean_maps(p: pd.DataFrame) -> pd.DataFrame:
        a, b = zip(*[mean_map(*m) for m in _means(p)])
        seen = int(p["__finite"].iloc[0]) + np.cumsum(np.isfinite(p["close"].to_numpy(float)))
        return pd.DataFrame([head(p) | {"a": list(a), "b": list(b), "macds": int((seen >= 26).sum())}])

    def mean_starts(p: pd.DataFrame) -> pd.DataFrame:
        now, starts = np.zeros(MEANS), []
        for a, b in zip(p["a"], p["b"]):
            starts.append(now.tolist())
            now = np.asarray(a) * now + np.asarray(b)
        return p[mine].assign(start=starts, macds=np.r_[0, np.cumsum(p["macds"].to_numpy())[:-1]])

    def late_maps(p: pd.DataFrame) -> pd.DataFrame:
        lines = _lines(p, np.asarray(p["start"].iloc[0]))
        macd = _macd(lines)
        a, b = mean_map(macd[np.isfinite(macd)], int(p["macds"].iloc[0]), SIGNAL, 1 - 2 / (SIGNAL + 1), 2 / (SIGNAL + 1))
        at, u, d, c, prev = _bands(p, lines)
        fresh = int(p["__rows"].iloc[0]) <= ST_PERIOD
        return pd.DataFrame([head(p) | {"a": a, "b": b, "upper": band_map(u, c, prev, fresh), "lower": band_map(-d, -c, -prev, fresh)}])

    def late_starts(p: pd.DataFrame) -> pd.DataFrame:
        signal, side, upper, lower, starts = 0.0, 1.0, np.inf, np.inf, []
        for a, b, up, down in zip(p["a"], p["b"], p["upper"], p["lower"]):
            starts.append((signal, side, upper, -lower))
            signal = a * signal + b
            upper, rose = through(upper, up)
            lower, fell = through(lower, down)
            side = side if max(rose, fell) < 0 else 1.0 if rose >= fell else -1.0
        return p[mine].assign(**dict(zip(("signal", "side", "upper", "lower"), map(list, zip(*starts)))))

    def values(p: pd.DataFrame) -> pd.DataFrame:
        lines = _lines(p, np.asarray(p["start"].iloc[0]))
        macd, named = _macd(lines), dict(zip([*EMAS, *WILDER], lines))
        ok = np.isfinite(macd)
        signal = mean_steps(macd[ok], int(p["macds"].iloc[0]), SIGNAL, 1 - 2 / (SIGNAL + 1), 2 / (SIGNAL + 1), p["signal"].iloc[0])
        signal = np.where(int(p["macds"].iloc[0]) + np.cumsum(ok) >= SIGNAL, carried(signal, ok, p["signal"].iloc[0]), np.nan)
        at, u, d, c, prev = _bands(p, lines)
        begun = np.isfinite(p["upper"].iloc[0])
        side = np.full(len(p), np.nan)
        side[at] = sides(u, d, c, prev, tuple(p[k].iloc[0] for k in ("side", "upper", "lower")) if begun else None)
        out = [named[9], named[21], named[50], rsi_of(named["gain", 14], named["loss", 14]), named["tr", 14], macd, signal, side]
        return p[[*key, "bar_idx"]].assign(**dict(zip(RECURSIVE, out)))

    doubles = ", ".join(f"{c} double" for c in RECURSIVE)
    starts = composed(each(rows, mean_maps, f"{keys}a array<double>, b array<double>, macds long"), mean_starts, f"{keys}start array<double>, macds long")
    rows = rows.join(durable(starts, "starts"), mine)
    late = composed(each(rows, late_maps, f"{keys}a double, b double, upper {_RUN}, lower {_RUN}"), late_starts, f"{keys}signal double, side double, upper double, lower double")
    return each(rows.join(durable(late, "starts"), mine), values, keys.removeprefix("__range int, ") + f"bar_idx {types['bar_idx']}, {doubles}")
