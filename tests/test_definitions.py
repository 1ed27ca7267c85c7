"""Small tables with results worked out by hand from the definitions, one for each verdict and band."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edgeframe.operators import context as X
from edgeframe.operators import journal as L
from edgeframe.operators import portfolio as K
from edgeframe.operators import ticks as M
from edgeframe.operators import validation as V
from edgeframe.plans import pipelines as P

DAY = dt.date(2024, 1, 1)


def daily(spark, closes, volumes=None):
    """{symbol: closes}, one day after another; open, high and low are the close."""
    rows = [(s, DAY + dt.timedelta(i), *[float(c)] * 4, (volumes or {}).get(s, [100.0] * len(cs))[i]) for s, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_tradability(spark):
    """A measure or a delivery series blocks; very thin is high_risk; thin, low-priced or micro-cap is caution."""
    crore = {"deep": 60e7, "gsm": 60e7, "be": 60e7, "verythin": 0.5e7, "thin": 2e7, "low": 60e7, "micro": 60e7, "both": 0.5e7}
    d = daily(spark, {s: [10.0 if s == "low" else 100.0] * 3 for s in crore}, {s: [v / (10 if s == "low" else 100)] * 3 for s, v in crore.items()})
    symbols = spark.createDataFrame([(s, s, 400e7 if s == "micro" else 9000e7) for s in [*crore, "none"]], "symbol string, name string, market_cap_inr double")
    watch = spark.createDataFrame([("gsm", "GSM"), ("both", "ASM")], "symbol string, measure string")
    series = spark.createDataFrame([("be", "BE"), ("deep", "EQ")], "symbol string, series string")
    got = {r.symbol: (r.tier, r.verdict, r.intraday_ok) for r in X.tradability(d, symbols, watch, series=series).collect()}
    assert got == {
        "deep": ("deep", "ok", True), "gsm": ("deep", "blocked", False), "be": ("deep", "blocked", False), "verythin": ("very thin", "high_risk", True), "thin": ("thin", "caution", True),
        "low": ("deep", "caution", True), "micro": ("deep", "caution", True), "both": ("very thin", "blocked", False), "none": ("unknown", "ok", True),
    }
    caption = {r.symbol: (r.reason, r.caption) for r in X.tradability(d, symbols, watch, series=series).collect()}
    assert caption["both"] == ("surveillance: ASM", "under ASM · very thin liquidity") and caption["low"] == ("low-priced", "low-priced") and caption["deep"] == ("", "")


def test_data_quality(spark):
    """A jump of 3 or more is unreliable, of 1.8 or more caution, a close below one caution."""
    d = daily(spark, {"calm": [100, 110.0, 100], "jump": [100, 181.0], "fall": [100, 55.0], "tear": [100, 301.0], "penny": [1.2, 0.9], "bad": [100, 0.0, 100], "under": [100, 175.0]})
    none = spark.createDataFrame([], "symbol string, date date, type string, value double")
    got = {r.symbol: (r.verdict, r.flags) for r in X.data_quality(d, none).collect()}
    assert got == {
        "calm": ("ok", ""), "jump": ("caution", "jump"), "fall": ("caution", "jump"), "tear": ("unreliable", "discontinuity"), "penny": ("caution", "price under one"),
        "bad": ("unreliable", "bad ticks; price under one"), "under": ("ok", ""),
    }
    split = spark.createDataFrame([("fall", DAY + dt.timedelta(1), "split", 2.0)], none.schema)
    assert X.data_quality(d, split).where("symbol = 'fall'").first().verdict == "unreliable"


def test_exit_reachability(spark):
    """Blocked, then a stop at or beyond the adverse band, then size, then the name, then no band."""
    rows = [
        ("blocked", "BUY", 100.0, 80.0, 1e3, 90.0, 110.0, "blocked", 1e6), ("beyond", "BUY", 100.0, 90.0, 1e3, 90.0, 110.0, "ok", 1e6), ("inside", "BUY", 100.0, 91.0, 1e3, 90.0, 110.0, "ok", 1e6),
        ("short", "SELL", 100.0, 111.0, 1e3, 120.0, 110.0, None, None), ("other band", "SELL", 100.0, 109.0, 1e3, 120.0, 110.0, None, None), ("size", "BUY", 100.0, 91.0, 6e4, 90.0, 110.0, "ok", 1e6),
        ("at the cap", "BUY", 100.0, 91.0, 5e4, 90.0, 110.0, "ok", 1e6), ("name", "BUY", 100.0, 91.0, 1e3, 90.0, 110.0, "high_risk", 1e6), ("no band", "BUY", 100.0, 91.0, 1e3, None, 110.0, "ok", 1e6),
        ("no band, name", "BUY", 100.0, 91.0, 1e3, None, 110.0, "caution", 1e6),
    ]
    df = spark.createDataFrame(rows, "id string, side string, entry double, stop double, notional double, band_low double, band_high double, tradability string, turnover double")
    got = {r.id: r for r in X.exit_reachability(df).collect()}
    assert {k: r.exit_verdict for k, r in got.items()} == {
        "blocked": "blocked", "beyond": "unreachable_stop", "inside": "ok", "short": "unreachable_stop", "other band": "ok", "size": "caution", "at the cap": "ok", "name": "caution",
        "no band": "unknown", "no band, name": "caution",
    }
    assert (got["inside"].circuit_room_pct, got["short"].circuit_room_pct, got["size"].participation_pct, got["short"].participation_pct) == (10.0, 10.0, 6.0, None)
    assert got["no band"].stop_inside_band is None and got["size"].severity == "warn" and got["beyond"].severity == "danger"


def test_contradiction(spark):
    """Either a headline or a move of 2 percent against the side makes it cautious; for it, aligned."""
    cases = [("BUY", "negative", 0.0, "cautious"), ("BUY", "neutral", -2.0, "cautious"), ("BUY", "positive", -2.0, "cautious"), ("BUY", "positive", None, "aligned"), ("BUY", "neutral", 2.0, "aligned"), ("BUY", "neutral", 1.9, "neutral"), ("SELL", "positive", 0.0, "cautious"), ("SELL", "neutral", 2.5, "cautious"), ("SELL", "negative", 0.0, "aligned"), ("SELL", "neutral", -1.0, "neutral")]
    df = spark.createDataFrame(cases, "side string, label string, move double, want string")
    assert all(r.v == r.want for r in df.withColumn("v", X.contradiction(F.col("label"), F.col("move"), F.col("side"))).collect())


def test_light_regime(spark):
    """The last close against the mean of 20; narrow if over 60 percent of the movers went one way."""
    index = lambda name, last, n=20: [(name, DAY + dt.timedelta(i), 100.0) for i in range(n - 1)] + [(name, DAY + dt.timedelta(n), last)]
    rows = index("up", 110.0) + index("down", 90.0) + index("flat", 100.05) + index("short", 150.0, 19)
    d = daily(spark, {"a": [1.0, 2.0], "b": [1.0, 2.0], "c": [1.0, 2.0], "d": [2.0, 1.0], "e": [2.0, 1.0], "f": [1.0, 1.0]})
    got = {r.index_name: r for r in X.light_regime(spark.createDataFrame(rows, "index_name string, date date, close double"), d).collect()}
    assert {k: r.direction for k, r in got.items()} == {"up": "Up", "down": "Down", "flat": "Flat", "short": "Flat"}
    assert (got["up"].advances, got["up"].declines, got["up"].breadth_label) == (3, 2, "broad")
    assert X.light_regime(spark.createDataFrame(rows, "index_name string, date date, close double"), d.where("symbol <> 'e'")).first().breadth_label == "narrow"
    assert X.light_regime(spark.createDataFrame(rows, "index_name string, date date, close double"), d.where("symbol = 'f'")).first().breadth_label == "neutral"


def test_sector_strength(spark):
    """Labels by five sessions; a sector without an index takes the broad one; too short is unknown."""
    closes = {"lead": [100.0] * 20 + [100, 102, 103, 104, 105, 106], "flat": [50.0] * 26, "lag": [100.0] * 25 + [98.0], "new": [1.0, 2.0]}
    index = [(n, DAY + dt.timedelta(i), 100.0) for n in ("BANK", "BROAD") for i in range(26)]
    symbols = spark.createDataFrame([("lead", "Bank"), ("flat", "Other"), ("lag", "Bank"), ("new", "Bank")], "symbol string, sector string")
    own = spark.createDataFrame([("Bank", "BANK")], "sector string, index_name string")
    got = {r.symbol: r for r in X.sector_strength(daily(spark, closes), symbols, spark.createDataFrame(index, "index_name string, date date, close double"), own, "BROAD").collect()}
    assert {k: r.label for k, r in got.items()} == {"lead": "leader", "flat": "in-line", "lag": "laggard", "new": "unknown"}
    assert got["lead"].rs_5 == pytest.approx(6.0) and (got["flat"].index_name, got["flat"].broad_fallback, got["lag"].broad_fallback) == ("BROAD", True, False)


def test_governor(spark):
    """By day: open trades count, caution from 0.7 of the loss cap, the run of losses in the order of exits."""
    d1, d2 = DAY, DAY + dt.timedelta(1)
    rows = [
        ("near", 1, d1, d1, -70.0), ("hit", 2, d1, d1, -100.0), ("open", 3, d1, None, None), ("many", 4, d1, None, None), ("many", 5, d1, d2, 5.0), ("many", 6, d1, None, None),
        ("run", 7, d1, d1, 1.0), ("run", 8, d1, d1, -1.0), ("run", 9, d1, d1, -1.0), ("broken", 10, d1, d1, -1.0), ("broken", 11, d1, d1, 0.0), ("one", 12, d1, d1, -1.0),
    ]
    df = spark.createDataFrame([(*r, "Manually_Accepted") for r in rows] + [("hit", 99, d1, d1, -900.0, "Rejected")], "account_id string, id int, entry_date date, exit_date date, pnl double, state string")
    got = {(r.account_id, r.day): r for r in L.governor(df, ["account_id"], trades=4, losses=2, loss_pct=1.0, pool=1e4).collect()}
    assert {k: (r.verdict, r.reasons) for k, r in got.items()} == {
        ("near", d1): ("caution", "near daily loss, near loss run"), ("hit", d1): ("closed", "daily loss, near loss run"), ("open", d1): ("open", ""), ("many", d1): ("caution", "near trades"), ("many", d2): ("open", ""),
        ("run", d1): ("closed", "near trades, loss run"), ("broken", d1): ("open", ""), ("one", d1): ("caution", "near loss run"),
    }
    assert (got["run", d1].trades, got["run", d1].wins, got["run", d1].losses, got["run", d1].loss_run, got["open", d1].trades) == (3, 1, 2, 2, 1)


def test_style(spark):
    """Four strategies, long only, caps above zero and up to the limit."""
    edges = spark.createDataFrame([("a", "gap_and_go", "BUY", 0.2, 1.5, 50.0), ("a", "orb_15m", "BUY", 0.4, 2.5, 60.0), ("a", "vwap_cross", "BUY", 9.0, 9.0, 90.0), ("b", "orb_15m", "SELL", 1.0, 2.0, 50.0), ("big", "orb_15m", "BUY", 1.0, 2.0, 50.0)], "symbol string, strategy string, direction string, expectancy double, profit_factor double, win_pct double")
    caps = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("zero", 0.0), ("big", 101.0), *[(f"x{i}", 50.0) for i in range(19)]], "symbol string, cap_crore double")
    r = L.style_validation(edges, caps, 100.0).first()
    assert (r.universe, r.edges, r.names, r.median_expectancy, r.median_profit_factor, r.median_win_pct, r.top, r.verdict) == (21, 2, 1, pytest.approx(0.3), 2.0, 55.0, "a orb_15m, a gap_and_go", "thin, name-specific")
    assert L.style_validation(edges, caps.where("symbol IN ('a', 'b')"), 100.0).first().verdict == "name-specific"
    none = L.style_validation(edges.where("symbol = 'b'"), caps, 100.0).first()
    assert (none.verdict, none.median_expectancy, none.top) == ("no edge", 0.0, "") and L.style_validation(edges, caps, 1.0).first().verdict == "unavailable"


def test_caveat(spark):
    rows = [(49, 0.21, 0.04, -0.126, 5, 0.25, "low n, wide spread, thin OBI, OOS -0.13R (fails out-of-sample), WF 25% (inconsistent)"), (50, 0.2, -0.05, 0.1, 0, 0.2, ""), (50, 0.1, -0.2, 0.0, 3, 0.5, "OOS +0.00R (fails out-of-sample)"), (60, 0.1, 0.3, None, 1, 0.0, "WF 0% (inconsistent)")]
    df = spark.createDataFrame(rows, "n int, spread_pct double, obi double, oos_expectancy double, oos_n int, wf_consistency double, want string")
    assert [r.note for r in df.select(M.caveat().alias("note")).collect()] == [r[-1] for r in rows]


def test_exposure_kelly_and_clusters(spark):
    v = spark.createDataFrame([(1, "a", "Bank", 40.0, 40.0, 4.0), (1, "b", "Auto", 15.0, 15.0, -2.0), (1, "c", "Auto", 10.0, 10.0, 1.0), (1, "d", None, 19.0, 19.0, 0.0), (1, "e", "", 16.0, 16.0, 0.0)], "account_id int, symbol string, sector string, value double, weight double, unrealised double")
    got = {r.sector: (r.names, r.weight, r.unrealised, r.heat, r.place) for r in K.exposure(v, "sector").collect()}
    assert got == {"Bank": (1, 40.0, 4.0, "high", 1), "Unknown": (2, 35.0, 0.0, "elevated", 2), "Auto": (2, 25.0, -1.0, "elevated", 3)}
    assert [(r.sector, r.members) for r in K.sector_clusters(v).collect()] == [("Auto", "b,c")]
    df = spark.createDataFrame([(60.0, 2.0, 5.0, 5.0), (10.0, 2.0, 1.25, 2.5), (50.0, 0.9, 0.0, 0.0), (50.0, 0.0, 0.0, 0.0), (50.0, None, 0.0, 0.0)], "w double, pf double, low double, high double")
    low, high = K.kelly_band(F.col("w"), F.col("pf"))
    assert all((r.a, r.b) == (pytest.approx(r.low), pytest.approx(r.high)) for r in df.select("*", low.alias("a"), high.alias("b")).collect())


def test_regime_and_robustness(spark):
    """Both regimes need ten trades to confirm; no configuration of twenty trades is neutral."""
    days = spark.createDataFrame([(1, True), (2, False)], "date int, up boolean")
    trade = lambda name, day, r, n: [("s", name, "BUY", "c", day, r)] * n
    rows = trade("both", 1, 1.0, 10) + trade("both", 2, 1.0, 10) + trade("few", 1, 1.0, 10) + trade("few", 2, 1.0, 9) + trade("bad", 1, 1.0, 3) + trade("bad", 2, -1.0, 10) + trade("fewbad", 1, 1.0, 10) + trade("fewbad", 2, -1.0, 9)
    t = spark.createDataFrame(rows, "symbol string, strategy string, direction string, config_id string, session_date int, r double")
    assert {r.strategy: r.regime_consistent for r in V.regime_consistency(t, days).collect()} == {"both": True, "few": None, "bad": False, "fewbad": None}
    s = spark.createDataFrame([("s", "x", "BUY", "1", 19, 1.0), ("s", "y", "BUY", "1", 20, 1.0), ("s", "y", "BUY", "2", 30, -1.0)], "symbol string, strategy string, direction string, config_id string, n int, expectancy double")
    assert {(r.strategy, r.robustness) for r in V.robustness(s).collect()} == {("x", 1.0), ("y", 0.5)}


def test_swing(spark):
    """The volume of the 50 days before; scores are the ratio and 1 / (1 + distance)."""
    rising = [100.0] * 219 + [101.0]
    d = daily(spark, {"break": rising, "quiet": rising, "retest": [100.0] * 221, "far": [100.0] * 220 + [104.0], "short": rising[1:]}, {"break": [1.0] * 190 + [100.0] * 29 + [150.0], "quiet": [100.0] * 219 + [249.0], "retest": [100.0] * 221, "far": [100.0] * 221, "short": [1.0] * 218 + [9.0]})
    got = {r.symbol: r for r in P.swing_scan(d).collect()}
    assert set(got) == {"break", "quiet", "retest"}
    mean = (21 * 1.0 + 29 * 100.0) / 50
    assert (got["break"].setup, got["break"].vol_ratio, got["break"].score) == ("volume_delivery_breakout", pytest.approx(150 / mean), pytest.approx(150 / mean))
    assert (got["quiet"].setup, got["retest"].score, got["retest"].side, got["retest"].atr) == ("mean_reversion_200ema", pytest.approx(1.0), "BUY", 0.0)


def test_finder_and_picks(spark):
    """Confidence of 50, fit by the shares that money reaches, blocked names and edges below their cost left out."""
    s = spark.createDataFrame([(n, "60min", "s", d, "k1_rr2", c, e, 60.0, 48.0, 2.0, 100) for n, d, c, e in [("a", "BUY", 80, 0.5), ("b", "BUY", 90, 0.5), ("c", "SELL", 60, 0.5), ("d", "BUY", 49, 9.0), ("e", "BUY", 70, 0.5), ("f", "BUY", 75, 0.001), ("g", "BUY", 95, 0.5)]], "symbol string, tf string, strategy string, direction string, config_id string, confidence int, expectancy double, win_pct double, wilson_low double, profit_factor double, n int")
    prices = spark.createDataFrame([(n, "60min", p, a) for n, p, a in [("a", 100.0, 10.0), ("b", 1000.0, 1.0), ("c", 100.0, 10.0), ("d", 1.0, 1.0), ("e", 100.0, 10.0), ("f", 100.0, 10.0), ("g", 600_000.0, 10.0)]], "symbol string, tf string, ltp double, atr double")
    rows = P.finder(s, prices, 100_000.0, 2.0)
    got = {r.symbol: r for r in rows.collect()}
    assert set(got) == {"a", "b", "c", "e", "f"}  # d lacks confidence, of g not one share is affordable
    assert (got["a"].shares, got["a"].fit, got["a"].fit_score, got["a"].stop, got["a"].target) == (200, "ideal", 80.0, 90.0, 120.0)
    assert (got["b"].shares, got["b"].shares_by_risk, got["b"].fit, got["b"].fit_score) == (500, 2000.0, "leverage_bound", 22.5)
    assert (got["c"].stop, got["c"].target) == (110.0, 80.0) and 0 < got["c"].net_profit < 4000 and got["c"].net_loss < -2000
    known = spark.createDataFrame([("a", "caution", "thin liquidity"), ("b", "ok", ""), ("e", "blocked", "x"), ("f", "ok", "")], "symbol string, verdict string, reason string")
    chosen = P.picks(rows, known)
    # the round trip of b costs about 1.3 R, of f more than its edge
    assert {(r.direction, r.rank): (r.symbol, r.tradability, r.note, r.x_of_10) for r in chosen.collect()} == {("BUY", 1): ("a", "caution", "thin liquidity", 5), ("SELL", 1): ("c", "unverified", "not verified", 5)}
    r = P.target_feasibility(chosen, 2.0, 100.0, 140.0).first()
    assert (r.picks, r.trades_needed, r.label, r.growth_pct) == (2, 34, "reasonable", pytest.approx(1.0))  # ln 1.4 / ln 1.01 = 33.8
    assert [P.target_feasibility(chosen, 2.0, 100.0, g).first().label for g in (150.0, 300.0, 301.0)] == ["reasonable", "aggressive", "unrealistic"]
    none = P.target_feasibility(chosen.where("false"), 2.0, 100.0, 140.0).first()
    assert (none.trades_needed, none.label) == (0, "unrealistic")


def test_silent_symbols_stay_ranked(spark, tmp_path):
    """A symbol without ticks in a batch keeps its latest features, and an epoch that runs again changes nothing."""
    from edgeframe.streaming import features as S

    cols = "symbol string, event_id long, user_id long, vwap double, dev_pct double, z double, imbalance double"
    batches = [[("a", 1, 7, 10.0, 0.1, 0.0, 0.5), ("a", 2, 7, 10.0, -0.1, 0.0, 0.4), ("b", 3, 7, 10.0, 0.1, 0.0, 0.9), ("c", 4, 8, 10.0, 0.0, 0.0, 0.9)], [("a", 5, 7, 10.0, 0.1, 0.0, 0.6)], [("b", 6, 7, 10.0, 0.1, 0.0, 0.1)]]
    edges = spark.createDataFrame([(x, "BUY", 0.5, 1, "s") for x in "abc"], "symbol string, direction string, shrunk double, shares int, strategy string")
    frozen = spark.createDataFrame([(8, True)], "account_id long, frozen boolean")
    seen = {}
    step = S.rank_each_batch(edges, frozen, lambda rows, epoch: seen.setdefault(epoch, []).append({r.symbol: r.imbalance for r in rows.collect()}), str(tmp_path))
    for epoch in (0, 1, 1, 2):
        step(spark.createDataFrame(batches[epoch], cols), epoch)
    assert seen == {0: [{"a": 0.4, "b": 0.9}], 1: [{"a": 0.6, "b": 0.9}] * 2, 2: [{"a": 0.6, "b": 0.1}]}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["epoch=1", "epoch=2"]
