"""Recurrences by ranges of a series against the series as a whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeframe.operators import indicators as C
from edgeframe.operators import scan


@pytest.mark.parametrize("p", [2, 9, 50])
@pytest.mark.parametrize("cuts", [[], [1], [5, 6, 40], list(range(1, 120))])
def test_maps_of_means_compose(p, cuts):
    x = np.random.default_rng(p).normal(100, 5, 120)
    want, now, got = scan.mean_steps(x, 0, p, 1 - 2 / (p + 1), 2 / (p + 1), 0.0), 0.0, []
    np.testing.assert_allclose(want[p - 1 :], C.ema(x, p)[p - 1 :], rtol=1e-12)
    for a, b in zip([0, *cuts], [*cuts, len(x)]):
        got += scan.mean_steps(x[a:b], a, p, 1 - 2 / (p + 1), 2 / (p + 1), now).tolist()
        scale, add = scan.mean_map(x[a:b], a, p, 1 - 2 / (p + 1), 2 / (p + 1))
        now = scale * now + add
        assert now == pytest.approx(got[-1], rel=1e-12)
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("seed", range(40))
def test_map_of_bands_against_every_start(seed):
    """Small whole numbers, so that bands, closes and starts often tie."""
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 30))
    c = 20 + r.integers(-2, 3, n).cumsum().astype(float)
    u, prev = c + r.integers(0, 9, n), np.r_[float(r.integers(10, 30)), c[:-1]]
    run = scan.band_map(u, c, prev, False)
    for start in np.arange(-5, 60, 0.5):
        band, last = float(start), -1
        for i in range(n):
            band = u[i] if u[i] < band or prev[i] > band else band
            last = i if c[i] > band else last
        assert scan.through(float(start), run) == (band, last)
    fresh = scan.band_map(u, c, prev, True)
    band, last = u[0], -1
    for i in range(1, n):
        band = u[i] if u[i] < band or prev[i] > band else band
        last = i if c[i] > band else last
    assert scan.through(np.inf, fresh) == (band, last)


def walks():
    r = np.random.default_rng(5)
    lengths = {"long": 1500, "flat": 300, "rising": 300, "falling": 300, "ten": 10, "eleven": 11, "one": 1, "holes": 400, "late": 90}
    out = []
    for name, n in lengths.items():
        c = {"flat": np.full(n, 50.0), "rising": 50 + np.arange(n) * 0.3, "falling": 500 - np.arange(n) * 0.7}.get(name, 100 + r.normal(0, 1.5, n).cumsum())
        h, l = c + r.random(n), c - r.random(n)
        if name == "holes":  # the Wilder means end here, the EMAs carry on
            c[[200, 201, 350]] = np.nan
        if name == "late":
            c[:30] = np.nan
        out.append(pd.DataFrame({"symbol": name, "tf": "60min", "bar_idx": np.arange(n), "high": h, "low": l, "close": c}))
    return pd.concat(out + [out[0].assign(tf="5min", close=out[0]["close"] * 2, high=out[0]["high"] * 2, low=out[0]["low"] * 2 - 1)])


def test_ranges_of_a_series_against_the_whole(spark):
    bars = spark.createDataFrame(walks().sample(frac=1.0, random_state=1))
    want = C.recursive(bars).toPandas().sort_values(["symbol", "tf", "bar_idx"], ignore_index=True)
    for rows_each in (1000, 90, 23):
        got = C.recursive(bars, rows_each).toPandas().sort_values(["symbol", "tf", "bar_idx"], ignore_index=True)
        assert got[["symbol", "tf", "bar_idx"]].equals(want[["symbol", "tf", "bar_idx"]])
        for c in C.RECURSIVE:
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{c} {rows_each}")
    empty = bars.where("false")
    assert C.recursive(empty).count() == 0 and set(want["st_dir"].dropna()) == {1.0, -1.0}


def test_no_task_holds_a_long_series(spark):
    """One series of 200,000 bars in ranges of 10,000: the figures of a range are a few numbers."""
    walk = 100 + np.random.default_rng(1).normal(0, 0.5, 200_000).cumsum() * 0.01
    run = scan.band_map(walk + 3, walk, np.r_[walk[0], walk[:-1]], False)
    assert len(run["ways"]) < 100
    bars = spark.range(200_000).select(F.lit("a").alias("symbol"), F.lit("1min").alias("tf"), F.col("id").alias("bar_idx"), (100 + F.sin(F.col("id") / 50.0)).alias("close"))
    bars = bars.withColumn("high", F.col("close") + 0.1).withColumn("low", F.col("close") - 0.1)
    got = C.recursive(bars, 10_000).agg(F.count("*").alias("n"), F.count("ema50").alias("ema"), F.count("macd_signal").alias("signal"), F.count("st_dir").alias("st")).first()
    assert tuple(got) == (200_000, 200_000 - 49, 200_000 - 33, 200_000 - 10)


def test_windowed_frames_in_ranges(spark):
    r = np.random.default_rng(3)
    n = 600
    rows = pd.DataFrame({"symbol": np.where(r.random(n) < 0.8, "a", "b"), "tf": "60min", "close": 100 + r.normal(0, 1, n).cumsum(), "volume": r.integers(0, 9, n).astype(float)})
    rows = rows.assign(open=rows["close"], high=rows["close"] + 1, low=rows["close"] - 1, bar_idx=rows.groupby("symbol").cumcount())
    rows["day_id"] = rows["bar_idx"] // 7
    rows["session_date"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["bar_idx"] // 7, "D")).dt.date
    bars = spark.createDataFrame(rows)
    want = C.windowed(bars).orderBy("symbol", "bar_idx").toPandas()
    got = C.windowed(bars, rows_each=70).orderBy("symbol", "bar_idx").toPandas()
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
