"""What SQL does not reach, against plain loops; series of several timeframes against single ones."""

from __future__ import annotations

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeframe.operators import bars as B
from edgeframe.operators import bootstrap as BS
from edgeframe.operators import indicators as C
from edgeframe.operators import outcomes as E
from edgeframe.operators import portfolio as K
from edgeframe.operators import ticks as M
from edgeframe.operators import validation as V
from edgeframe.plans import pipelines as P
from edgeframe.sources import stage
from edgeframe.sources.tables import Tables
from edgeframe.streaming import features as S

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- series and timeframes


def test_two_timeframes_are_two_series(spark):
    """Signals, outcomes and statistics of a table of two timeframes are those of each alone."""
    both = Tables(spark, SF).timeframes(15, 60).cache()
    pick = lambda df: sorted(map(repr, df.collect()))

    def run(bars):
        t = P.card_trades(bars)
        n = P.lengths(bars)
        s = V.split_stats(V.purged_split(t, n)).join(V.walk_forward(t, n), ["symbol", "tf", "strategy", "direction", "config_id"])
        keys = ["symbol", "tf", "strategy", "direction", "config_id"]
        return [pick(x) for x in (t.select(*keys, "entry_idx", "exit_idx", F.round("r", 9)), s.select(*keys, "is_n", "oos_n", F.round("oos_expectancy", 9), "wf_consistency"), P.last_prices(bars).select("symbol", "tf", "ltp", F.round("atr", 9)))]

    whole = run(both)
    parts = [run(both.where(F.col("tf") == tf)) for tf in ("15min", "60min")]
    assert whole == [sorted(a + b) for a, b in zip(*parts)] and all(whole)


@pytest.mark.parametrize("minutes", [3, 15, 30, 60])
def test_bars_are_anchored_at_the_local_open(spark, minutes):
    """In a zone half an hour off, bars start at 09:15 local and every ``minutes`` from there."""
    start = datetime(2024, 3, 1, 3, 40)  # 09:10 in Kolkata
    rows = [("A", start + timedelta(minutes=i), float(i), float(i), float(i), float(i), 1.0) for i in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    got = {r.ts: (r.open, r.close, r.parts) for r in B.resample(bars, minutes, "Asia/Kolkata").collect()}
    want = {}
    for _, ts, price, *_ in rows:
        local = ts + timedelta(minutes=330)
        since = (local.hour * 60 + local.minute - 555) // minutes * minutes
        key = datetime(local.year, local.month, local.day) + timedelta(minutes=555 + since - 330)
        first, _, n = want.get(key, (price, price, 0))
        want[key] = (first, price, n + 1)
    assert got == want and datetime(2024, 3, 1, 3, 45) in got


def plain_ema(x, p):
    out, seen, now = [], [], None
    for v in x:
        if np.isfinite(v):
            seen.append(v)
            now = sum(seen) / p if len(seen) == p else now + 2 / (p + 1) * (v - now) if len(seen) > p else None
        out.append(np.nan if now is None else now)
    return np.array(out)


def plain_wilder(x, p):
    out, now = [], None
    for i, v in enumerate(x):
        now = sum(x[:p]) / p if i == p - 1 else (now * (p - 1) + v) / p if i >= p else None
        out.append(np.nan if now is None else now)
    return np.array(out)


@pytest.mark.parametrize("n", [0, 5, 14, 15, 60, 3000])
def test_recurrences_against_loops(n):
    r = np.random.default_rng(n)
    x = 100 + r.normal(0, 5, n).cumsum()
    h, l = x + r.random(n), x - r.random(n)
    for p in (9, 50):
        np.testing.assert_allclose(C.ema(x, p), plain_ema(x, p), rtol=1e-10)
    holes = np.where(r.random(n) < 0.2, np.nan, x)
    np.testing.assert_allclose(C.ema(holes, 9), plain_ema(holes, 9), rtol=1e-10)
    tr = np.array([max(h[i] - l[i], abs(h[i] - x[i - 1]), abs(l[i] - x[i - 1])) for i in range(1, n)])
    pad = np.full(min(n, 1), np.nan)
    np.testing.assert_allclose(C.wilder_atr(h, l, x), np.r_[pad, plain_wilder(tr, 14)], rtol=1e-10)
    up, down = plain_wilder(np.maximum(np.diff(x), 0), 14), plain_wilder(np.maximum(-np.diff(x), 0), 14)
    if n:
        np.testing.assert_allclose(C.wilder_rsi(x), np.r_[pad, 100 - 100 / (1 + up / down)], rtol=1e-8)


def test_last_values_are_sums(spark):
    """The last ATR and EMA as weighted sums are the last of the whole series, for each timeframe."""
    bars = Tables(spark, SF).timeframes(15, 60).cache()
    got = {(r.symbol, r.tf): (r.atr, r.ema) for r in C.final_wilder(bars, "bar_idx", ema_period=50).collect()}
    for key, g in bars.toPandas().groupby(["symbol", "tf"]):
        g = g.sort_values("bar_idx")
        atr, ema = C.wilder_atr(*(g[c].to_numpy() for c in ("high", "low", "close")))[-1], C.ema(g["close"].to_numpy(), 50)[-1]
        assert got[key] == (pytest.approx(atr), pytest.approx(ema))


# ---------------------------------------------------------------- streams


def plain_features(rows):
    """Every feature of each tick by its definition over all ticks before it."""
    out, delta_of, prev = [], [], None
    for i, r in enumerate(rows):
        delta = 0 if prev is None else max(r["volume_day"] - prev, 0)
        prev = r["volume_day"]
        delta_of.append(delta)
        v = sum(delta_of)
        vwap = sum(x["ltp"] * d for x, d in zip(rows, delta_of)) / v if v else r["ltp"]
        window = np.array([x["ltp"] for x in rows[max(0, i - 999) : i + 1]])
        moved = [d for d in delta_of if d > 0][-256:]
        before = [x["ltq"] for x in rows[max(0, i - 63) : i]]
        block = r["ltq"] / np.mean(before) if len(before) >= 5 and np.mean(before) > 0 else 0.0
        steps = np.sign(np.diff(window[-7:]))
        way = int(steps[0]) if len(steps) == 6 and abs(steps.sum()) == 6 else 0
        d = np.diff(window)
        rsi = 50.0
        if len(d) >= 14:
            gain, loss = np.maximum(d[:14], 0).mean(), np.maximum(-d[:14], 0).mean()
            for x in d[14:]:
                gain, loss = (gain * 13 + max(x, 0)) / 14, (loss * 13 + max(-x, 0)) / 14
            rsi = 50.0 if gain + loss == 0 else 100 * gain / (gain + loss)
        sd = window.std()
        out.append((r["event_id"], delta, vwap, window.mean(), sd, (r["ltp"] - window.mean()) / sd if sd > 0 else 0.0, moved[-1] / np.mean(moved) if moved else np.nan, rsi, block, way if block > 1 else 0, max(sd, 0.002 * r["ltp"]), int(np.median([x["latency_us"] for x in rows[max(0, i - 255) : i + 1]]))))
    return pd.DataFrame(out, columns=["event_id", "delta", "vwap", "mean", "sd", "z", "rvol", "rsi", "block", "sweep", "atr_proxy", "latency_median"])


@pytest.mark.parametrize("cuts", [[], [1], [7, 8, 400, 1100], list(range(50, 1300, 50))])
def test_stream_step_against_loops(cuts):
    r = np.random.default_rng(8)
    n = 1300
    price = np.round(100 + r.normal(0, 0.3, n).cumsum() + np.where(np.arange(n) % 90 < 12, np.arange(n) % 90 * 0.5, 0), 2)
    volume = np.where(r.random(n) < 0.1, 0, r.integers(0, 9, n)).cumsum() - np.where(np.arange(n) == 700, 50, 0)
    rows = [dict(ts=pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i), event_id=i, ltp=float(price[i]), ltq=int(r.integers(0, 50)), volume_day=int(volume[i]), latency_us=int(r.integers(0, 900)), user_id=i % 7, imbalance=0.1) for i in range(n)]
    want, state, got = plain_features(rows), None, []
    for a, b in itertools.pairwise([0, *cuts, n]):
        out, state = S.step(pd.DataFrame(rows[a:b]).sample(frac=1, random_state=1), state)
        got.append(out)
    got = pd.concat(got, ignore_index=True)
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7, equal_nan=True, err_msg=c)
    assert (got["sweep"] != 0).any() and len(state[3]) == 1000


def test_state_ends_with_its_session(spark):
    """A session's state goes when the watermark has passed its end; its features do not change for it."""
    rows = [("A", datetime(2024, 1, d, 10, m), 100.0 + m, 5, 5 * m, 1, d * 100 + m, 1, None) for d in (1, 2, 3, 4) for m in range(20)]
    ticks = spark.createDataFrame(rows, S.TICKS)
    folder = f"{stage.shared_folder(spark)}/sessions-{datetime.now().timestamp()}"
    for d in (1, 2, 3, 4):
        ticks.where(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(folder)
    q = S.tick_features(S.read_ticks(spark, folder)).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert spark.table("sessions").count() == 80 and states[-1] < 4


def test_batch_windows_against_stream_step(spark):
    """Running sums of the batch twin over a session of more ticks than the price window."""
    rows = [("A", datetime(2024, 1, 1) + timedelta(seconds=i), 500.0 + math.sin(i) * (i % 50), i % 9, i * 3, 5, i, 1, 0.0) for i in range(1500)]
    ticks = spark.createDataFrame(rows, S.TICKS)
    got = M.features(ticks).select("event_id", "mean", "sd").orderBy("event_id").toPandas()
    x = np.array([r[2] for r in rows])
    for i in (0, 1, 998, 999, 1000, 1001, 1499):
        w = x[max(0, i - 999) : i + 1]
        assert (got["mean"][i], got["sd"][i]) == (pytest.approx(w.mean()), pytest.approx(w.std(), abs=1e-6))


# ---------------------------------------------------------------- draws


def test_bootstrap_against_loops():
    """Paths, drawdowns and percentiles drawn one number at a time."""
    r, paths, seed = np.array([1.5, -1.0, 0.4, 2.0, -1.0, -1.0, 0.1]), 60, 42

    def number(i):
        z = (seed + (i + 1) * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    finals, falls = [], []
    for s in range(paths):
        equity = peak = fall = 0.0
        for k in range(len(r)):
            equity += r[int((number(s * len(r) + k) >> 11) / 2**53 * len(r))]
            peak = max(peak, equity)
            fall = max(fall, peak - equity)
        finals.append(equity)
        falls.append(fall)
    cut = lambda x, q: float(np.percentile(x, q))
    want = (100 * sum(f > 0 for f in finals) / paths, cut(falls, 95), cut(finals, 5), *(cut(np.array(finals) / len(r), q) for q in (5, 50, 95)))
    assert BS.path_stats(r, paths, seed) == pytest.approx(want)


def test_basket_losses_against_loops(spark):
    rows = [("x", "A", 100.0, 55.0, 2.0), ("x", "B", 250.0, 40.0, 1.5), ("y", "C", 10.0, 90.0, 3.0)]
    got = {r.account_id: r for r in K.basket_losses(spark.createDataFrame(rows, "account_id string, symbol string, risk double, win_pct double, rr double"), draws=50).collect()}
    u = BS.draws(42, 0, 100)
    day = sorted(sum(rr * risk if (int(u[d * 2 + i]) >> 11) / 2**53 < w / 100 else -risk for i, (_, _, risk, w, rr) in enumerate(rows[:2])) for d in range(50))
    r = got["x"]
    assert (r.names, r.expected, r.p05, r.p95) == (2, pytest.approx(sum(day) / 50), day[int(0.05 * 49 + 0.5)], day[int(0.95 * 49 + 0.5)]) and got["y"].names == 1
    assert (r.losing_pct, r.big_loss_pct) == (pytest.approx(2 * sum(d < 0 for d in day)), pytest.approx(2 * sum(d <= -175 for d in day)))


# ---------------------------------------------------------------- choices


def test_basket_against_loops(spark):
    r = np.random.default_rng(4)
    rows = [(f"a{i % 3}", f"s{i:02d}", f"sec{i % 4}", float(r.integers(1, 20)), float(r.integers(50, 400)), float(r.integers(1, 60)), 300.0) for i in range(60)]
    got = {(x.account_id, x.symbol): (x.taken, x.skipped) for x in K.basket(spark.createDataFrame(rows, "account_id string, symbol string, sector string, score double, notional double, risk double, capital double"), risk_pct=30).collect()}
    for account in {x[0] for x in rows}:
        held = []
        for x in sorted((x for x in rows if x[0] == account), key=lambda x: (-x[3], x[1])):
            why = "names" if len(held) >= 5 else "sector" if sum(h[2] == x[2] for h in held) >= 2 else "leverage" if sum(h[4] for h in held) + x[4] > 1500 else "risk" if sum(h[5] for h in held) + x[5] > 90 else ""
            held += [] if why else [x]
            assert got[account, x[1]] == (not why, why)


def test_allocation_against_loops(spark):
    r = np.random.default_rng(5)
    plans = [(f"p{i % 4}", 50_000.0 * (i % 4 + 1), f"s{i:02d}", float(r.integers(20, 900)), float(r.integers(2, 60))) for i in range(28)]
    got = {(x.plan_id, x.symbol): x for x in K.allocate(spark.createDataFrame(plans, "plan_id string, capital double, symbol string, price double, vol double")).collect()}
    for plan in {p[0] for p in plans}:
        rows = sorted((p for p in plans if p[0] == plan), key=lambda p: p[2])
        weight, fixed = {p[2]: 1 / max(p[4], 5.0) for p in rows}, set()
        while True:
            free = [s for s in weight if s not in fixed]
            scale = (1 - 0.25 * len(fixed)) / sum(1 / max(p[4], 5.0) for p in rows if p[2] in free)
            weight = {p[2]: 0.25 if p[2] in fixed else scale / max(p[4], 5.0) for p in rows}
            over = {s for s in free if weight[s] > 0.25 + 1e-12}
            if not over:
                break
            fixed |= over
        capital, shares = rows[0][1], {p[2]: math.floor(weight[p[2]] * rows[0][1] / p[3]) for p in rows}
        cash = capital - sum(shares[p[2]] * p[3] for p in rows)
        while True:  # the affordable name furthest below its slice, again and again
            below = [(capital * weight[p[2]] - shares[p[2]] * p[3], p) for p in rows if p[3] <= cash]
            if not below:
                break
            _, p = max(below, key=lambda b: b[0])
            shares[p[2]], cash = shares[p[2]] + 1, cash - p[3]
        assert cash < min(p[3] for p in rows)
        for p in rows:
            assert (got[plan, p[2]].weight, got[plan, p[2]].shares, got[plan, p[2]].cash_left) == (pytest.approx(weight[p[2]]), shares[p[2]], pytest.approx(cash))


def test_horizon_screen_against_loops(spark):
    r = np.random.default_rng(6)
    f = [(f"s{i:02d}", f"sec{i % 5}", *map(float, r.normal(0, 10, 6)), bool(i % 3 == 0)) for i in range(40)]
    got = {(x.horizon, x.symbol): (x.rank, x.score) for x in K.horizon_screen(spark.createDataFrame(f, "symbol string, sector string, " + ", ".join(f"{c} double" for c in K.FACTORS) + ", edge_backed boolean").withColumn("horizon", F.explode(F.array(*map(F.lit, K.HORIZONS))))).collect()}
    x = np.array([row[2:8] for row in f])
    z = (x - x.mean(0)) / x.std(0)
    want = {}
    for horizon, weights in K.HORIZONS.items():
        score = {row[0]: float(z[i] @ np.array(weights)) + 0.25 * row[8] for i, row in enumerate(f)}
        sectors, chosen = {}, []
        for row in sorted(f, key=lambda row: (-score[row[0]], row[0])):
            if sectors.setdefault(row[1], 0) < 2:
                sectors[row[1]] += 1
                chosen.append(row[0])
        want |= {(horizon, s): (i + 1, pytest.approx(score[s])) for i, s in enumerate(chosen[:8])}
    assert got == want


def test_buy_screen_against_loops(spark):
    signals = spark.createDataFrame([(i, 1.0, 1.0, 1.0, -5.0 if i % 4 else -50.0, float(i % 9)) for i in range(40)], "symbol long, vs50 double, vs200 double, rs_6m double, off_high double, rs_12m double")
    edges = spark.createDataFrame([(i,) for i in range(39)], "symbol long")
    held = [("x", i) for i in range(30)] + [("y", 17), ("y", 17), ("z", 99)]
    got = {(r.account_id, r.rank): r.symbol for r in K.buy_screen(signals, edges, spark.createDataFrame(held, "account_id string, symbol long"), k=5).collect()}
    order = sorted((i for i in range(39) if i % 4 and i % 9), key=lambda i: (-(i % 9), i))
    assert got == {(a, n + 1): s for a in "xyz" for n, s in enumerate([i for i in order if (a, i) not in held][:5])}


def test_rebalance_by_hand(spark):
    """Sells in whole units, tax above the exemption, as many shares of the cash as there are candidates, at most five."""
    v = [("a", "s1", 10.0, 400_000.0, 300_000.0, "Rotate out", -1.0, "Bank"), ("a", "s2", 5.0, 1000.4, -100.0, "Trim", -2.0, "Auto"), ("a", "s3", 5.0, 1000.0, 1.0, "Hold", 3.0, ""), ("b", "s4", 1.0, 5.0, 1.0, "Leader", 1.0, "Bank"), ("c", "s5", 4.0, 100.0, 1e6, "Rotate out", 1.0, "Bank")]
    df = spark.createDataFrame(v, "account_id string, symbol string, qty double, value double, unrealised double, bucket string, vs200 double, sector string")
    cand = spark.createDataFrame([("a", "n1", 1, 700.0), ("a", "n2", 2, 1e9), ("b", "n1", 1, 700.0), ("c", "n1", 1, 700.0), ("c", "n9", 6, 1.0)], "account_id string, symbol string, rank int, last double")
    assert {(r.symbol, r.shares, r.cash, r.gain) for r in K.rebalance_sells(df).collect()} == {("s1", 10, 400_000.0, 300_000.0), ("s2", 3, 600.0, -60.0), ("s5", 4, 100.0, 1e6)}
    plan = K.rebalance(df, cand)
    got = {r.account_id: r for r in plan.collect()}
    tax = (299_940 - 125_000) * 0.125
    assert set(got) == {"a", "c"} and (got["a"].cash, got["a"].tax, got["a"].to_spend, got["a"].per_name) == (400_600.0, tax, 400_600 - tax, (400_600 - tax) / 2)
    assert (got["c"].to_spend, got["c"].per_name) == (0.0, None)
    per = (400_600 - tax) / 2
    buys = K.rebalance_buys(plan, cand)
    assert {(r.account_id, r.symbol, r.amount, r.shares) for r in buys.collect()} == {("a", "n1", float(round(per)), int(per / 700)), ("a", "n2", float(round(per)), 0)}
    p = {(r.account_id, r.stage): r for r in K.rebalance_profiles(df, buys).collect()}
    assert (p["a", "before"].sectors, p["a", "after"].sectors, p["a", "before"].uptrend_pct, p["a", "after"].uptrend_pct) == (2, 2, 0.0, 100.0) and p["a", "after"].hhi < p["a", "before"].hhi


def test_basket_totals_and_unknown_sectors(spark):
    rows = [("a", f"s{i}", "" if i < 4 else "x", 10.0 - i, 100.0, 1.5, 100.0) for i in range(8)]
    b = K.basket(spark.createDataFrame(rows, "account_id string, symbol string, sector string, score double, notional double, risk double, capital double"), leverage=50, risk_pct=1.0, trade_risk_pct=8.0)
    r = K.basket_totals(b).first()
    assert (r.considered, r.positions, r.deployed, r.total_risk, r.skipped_names, r.skipped_sector, r.skipped_risk) == (8, 5, 500.0, 7.5, 3, 0, 0)


def test_horizon_features_against_loops(spark):
    """Gates and spans written out for one symbol after another."""
    import datetime as dt

    r, year = np.random.default_rng(11), 30
    series = {}
    for s in range(24):
        n = int(r.choice([64, 66, 70, 200, 310]))
        x = 100 * np.exp(np.cumsum(r.normal(0.004, 0.02, n)))
        series[f"s{s:02d}"] = (x, r.uniform(1, 9, n), 400 - n if s % 6 else 360 - n)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(int(o + i)), float(p), float(p), float(v)) for s, (x, vs, o) in series.items() for i, (p, v) in enumerate(zip(x, vs))]
    daily = spark.createDataFrame(rows, "symbol string, date date, close double, adj_close double, volume double")
    caps = {s: float(r.choice([1e10, 4e10, 3e11])) for s in series}
    symbols = spark.createDataFrame([(s, "sec", c) for s, c in caps.items()], "symbol string, sector string, market_cap_inr double")
    index = [("i", dt.date(2020, 1, 1) + dt.timedelta(i), 100.0 + i // 4) for i in range(400)]
    got = {(x.horizon, x.symbol): x for x in K.horizon_features(daily, symbols, spark.createDataFrame(index, "index_name string, date date, close double"), symbols.where("symbol < 's05'"), year=year, unit=100.0).collect()}
    want = {}
    for s, (x, vol, offset) in series.items():
        n, turn = len(x), sorted((x * vol)[-60:])
        liquid = (turn[len(turn) // 2] + turn[(len(turn) - 1) // 2]) / 2 / 100
        holds = [x[i] > x[i - year] for i in range(year, n, 21)]
        share = sum(holds) / len(holds) if holds else 0.0
        vs200 = (x[-1] / x[-200:].mean() - 1) * 100
        for h, (cap, least, hold) in K.FLOORS.items():
            y = int(h[:-1])
            if offset + n < 400 - 30 or n < max(y, 2) * year + 5 or n <= y * year:
                continue
            cagr = ((x[-1] / x[-1 - y * year]) ** (1 / y) - 1) * 100
            if cagr <= 0 or vs200 <= 0 or caps[s] / 1e7 < cap or liquid < least or share < hold:
                continue
            span = x[-y * year :]
            fall = min(0.0, min(p / max(span[: i + 1]) - 1 for i, p in enumerate(span)) * 100)
            steps = x[-y * year :] / x[-y * year - 1 : -1] - 1
            i_now, i_then = 100.0 + 399 // 4, 100.0 + (399 - y * year) // 4
            want[h, s] = (min(cagr, 60), (x[-1] / x[-1 - y * year] - i_now / i_then) * 100, vs200, fall, share * 100, math.log(caps[s] / 1e7 + 1), s < "s05", steps.std() * math.sqrt(year) * 100)
    assert len(want) > 5 and {k: tuple(got[k][c] for c in (*K.FACTORS, "edge_backed", "vol")) for k in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_clusters_of_text_symbols(spark):
    r = np.random.default_rng(7)
    names = [f"n{i:02d}" for i in range(30)]
    links = {tuple(sorted(map(str, r.choice(names, 2, False)))) for _ in range(18)}
    rho = [("x", a, a, 1.0) for a in names] + [("x", a, b, 0.7) for a, b in links] + [("x", names[0], names[29], 0.59)]
    got = {x.symbol: x.cluster for x in K.linked_clusters(spark.createDataFrame(rho, "account_id string, a string, b string, rho double")).collect()}
    label = {a: a for a in names}
    for _ in names:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_winner_heat_against_loops(spark):
    r = np.random.default_rng(9)
    rows = [("A", "s", "BUY", f"c{i % 4}", i, float(r.normal()), float(abs(r.normal()))) for i in range(90)] + [("A", "s", "BUY", "none", 1, -1.0, 0.3)]
    keys = ["symbol", "strategy", "direction", "config_id"]
    got = {x.config_id: x for x in E.winner_heat(spark.createDataFrame(rows, "symbol string, strategy string, direction string, config_id string, entry_idx int, r double, mae_r double"), keys).collect()}
    for c in ("c0", "c1", "c2", "c3"):
        won = sorted(x[6] for x in rows if x[3] == c and x[5] > 0)
        at = lambda q: won[math.floor((len(won) - 1) * q + 0.5)]
        assert (got[c].winners, got[c].heat_median, got[c].heat_p90) == (len(won), at(0.5), at(0.9))
    assert (got["none"].winners, got["none"].heat_median) == (0, None)


# ---------------------------------------------------------------- names


@pytest.mark.parametrize(
    "listed, name, symbol, how",
    [
        ([("HUDCO", "Housing & Urban Development Corporation Limited"), ("IOC", "Indian Oil Corporation Limited")], "HSG & URBAN DEV CORPN LTD", "HUDCO", "name"),
        ([("TMCV", "Tata Motors Limited"), ("IOC", "Indian Oil Corporation Limited")], "TATA MOTORS LIMITED", "TMCV", "name"),
        ([("IOC", "Indian Oil Corporation Limited")], "ioc ", "IOC", "symbol"),
        ([("IOC", "Indian Oil Corporation Limited")], "SOME UNKNOWN PVT LTD", None, "unmatched"),
        ([("CUB", "City Union Bank Limited"), ("UNIONBANK", "Union Bank of India"), ("IOC", "Indian Oil Corporation Limited")], "UNION BANK", None, "unmatched"),
        ([("TATASTEEL", "Tata Steel Limited"), ("TATAPOWER", "Tata Power Company Limited")], "TATA", None, "unmatched"),
        ([("SUZLON", "Suzlon Energy Limited")], "SUZLON ENERGY CO LTD", "SUZLON", "fuzzy"),
    ],
)
def test_names(spark, listed, name, symbol, how):
    got = K.resolve_names(spark.createDataFrame([(name,)], "name string"), spark.createDataFrame(listed, "symbol string, name string")).collect()
    assert [(r.symbol, r.how) for r in got] == [(symbol, how)]


def test_name_words(spark):
    words = {"HSG & URBAN DEV CORPN LTD": "HOUSING AND URBAN DEVELOPMENT CORPORATION LIMITED", "INDIAN RAILWAY FIN CORP L": "INDIAN RAILWAY FINANCE CORPORATION LIMITED", "TATA MOTORS PASS VEH LTD": "TATA MOTORS PASSENGER VEHICLES LIMITED"}
    got = spark.createDataFrame([(k,) for k in words], "name string").select("name", F.array_join(K.name_words(F.col("name")), " ").alias("w")).collect()
    assert {r.name: r.w for r in got} == words


def test_release(spark):
    import pathlib

    from edgeframe.sources.stage import durable

    before = set(pathlib.Path(stage.shared_folder(spark)).glob("edgeframe-released-*"))
    durable(spark.range(3).toDF("x"), "released")
    new = set(pathlib.Path(stage.shared_folder(spark)).glob("edgeframe-released-*")) - before
    assert len(new) == 1 and stage.release(spark) >= 1 and not new.pop().exists()
