"""Registered queries against SQL, and golden cases of the operators."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from edgeframe import catalog
from edgeframe.functions import costs, mathx, scores
from edgeframe.operators import bars as B
from edgeframe.operators import bootstrap as BS
from edgeframe.operators import context as X
from edgeframe.operators import indicators as C
from edgeframe.operators import journal as L
from edgeframe.operators import outcomes as E
from edgeframe.operators import portfolio as K
from edgeframe.operators import signals as D
from edgeframe.operators import ticks as M
from edgeframe.operators import tradestats as TS
from edgeframe.operators import validation as V
from edgeframe.plans import pipelines as P
from edgeframe.sources import ingest as A

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
#: Trade statistics, scores and edge pipelines share long chains of SQL; a few queries stand for all in the tests.
CHAINED = [n for n in SQL if n[0] in "efgh" or n[0] == "i" and n[1:3] not in ("01", "08", "12")]
SOME = sorted(
    [n for n in SQL if n not in CHAINED]
    + ["e02_one_at_a_time", "e05_intrabar", "e07_round_trip_costs", "e09_net_pnl", "f01_summary", "f05_calmar_streak_recent", "f08_by_sector", "g01_purged_split", "g07_deflated_sharpe", "g08_normal", "g13_block_means", "g14_overfit_probability"]
    + ["h01_confidence", "h06_lean", "i02_edge_map", "i04_deep_dive", "i06_sized_scanner", "i10_target_feasibility"]
)


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(round(float(v), 6))
    return str(v)


def rows_of(pdf):
    return sorted(tuple(norm(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql(spark, name):
    """Their operators are held against loops in test_brute_force."""
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) > 0 or name == "g11_bootstrap_interval"
    if name == "h02_conviction":
        assert got.conviction.between(0, 100).all() and got.agree.between(0, 3).all()
    if name == "i13_setup_card":
        assert (got.shares >= 1).all() and not got.duplicated("symbol").any()


def test_entry(spark):
    assert "symbol" in entry.entry(spark).columns


# ---------------------------------------------------------------- golden cases


def test_wilder_atr_golden(spark):
    bars = spark.createDataFrame([("A", i, 100.0 + i, 98.0 + i, 99.0 + i) for i in range(30)], "symbol string, bar_idx int, high double, low double, close double")
    assert C.final_wilder(bars, "bar_idx").first().atr == pytest.approx(2.0)
    assert C.final_wilder(bars.where("bar_idx < 5"), "bar_idx").first().atr is None
    h, l, c = (np.arange(30.0) + x for x in (100, 98, 99))
    assert C.wilder_atr(h, l, c)[-1] == pytest.approx(2.0) and np.isnan(C.wilder_atr(h, l, c)[13])
    assert C.wilder_rsi(np.arange(20.0))[-1] == 100 and np.nanmax(C.supertrend(h, l, c)) == 1


def test_value_area_golden(spark):
    rows = [("A", f"2024-01-{1 + i // 3:02d}", 10.0 if i % 3 else 1000.0, [100.0, 100.1, 99.9][i % 3]) for i in range(75)]
    bars = spark.createDataFrame(rows, "symbol string, d string, volume double, p double").select("symbol", F.to_date("d").alias("session_date"), "volume", *[F.col("p").alias(c) for c in ("high", "low", "close")])
    r = C.value_area(C.volume_histogram(bars)).first()
    assert r.val <= r.poc <= r.vah and 99.9 < r.poc < 100.1


@pytest.mark.parametrize("bar, r, flag, mae", [((107.0, 99.0, 106.0), 2.0, False, 1 / 3), ((101.0, 96.0, 96.0), -1.0, False, 4 / 3), ((107.0, 95.0, 100.0), -1.0, True, 5 / 3)])
def test_bracket_golden(spark, bar, r, flag, mae):
    e = spark.createDataFrame([("A", "d", "s", "BUY", "c", 1.5, 2.0, 0, 100.0, 2.0)], "symbol string, session_date string, strategy string, direction string, config_id string, k double, rr double, entry_idx int, entry double, atr double")
    bars = spark.createDataFrame([("A", "d", 0, 100.0, 100.0, 100.0), ("A", "d", 1, *bar)], "symbol string, session_date string, bar_idx int, high double, low double, close double")
    t = E.first_touch(e, bars).first()
    assert (t.r, t.ambiguous) == (pytest.approx(r), flag) and t.mae_r == pytest.approx(mae)
    assert E.first_touch(e, bars.where("bar_idx = 0")).count() == 0


def test_chain(spark):
    rows = [("A", "d", "s", "BUY", "c", i, x) for i, x in [(1, 4), (2, 3), (4, 6), (5, 9), (10, 11)]]
    t = spark.createDataFrame(rows, "symbol string, session_date string, strategy string, direction string, config_id string, entry_idx int, exit_idx int")
    assert sorted(r.entry_idx for r in E.one_at_a_time(t).collect()) == [1, 5, 10]


def test_costs_golden():
    assert costs.reference_fraction() == pytest.approx(0.001324452) and costs.reference_fraction(2) == pytest.approx(0.001824452) and costs.reference_fraction(3) == pytest.approx(0.002324452)


def trades(spark, r, **more):
    cols = {"symbol": "A", "strategy": "s", "direction": "BUY", "config_id": "c"} | more
    return spark.createDataFrame([(*cols.values(), i, float(x)) for i, x in enumerate(r)], ", ".join(f"{k} string" for k in cols) + ", entry_idx int, r double")


def test_trade_stats_golden(spark):
    s = TS.summary(trades(spark, [2, -1, 2, -1])).first()
    assert (s.n, s.win_pct, s.expectancy, s.profit_factor) == (4, 50.0, 0.5, 2.0)
    c = TS.curve_stats(trades(spark, [1, -2, -1, 3, -1])).first()
    assert (c.max_dd, c.loss_streak) == (3.0, 2)
    assert TS.sharpe_stats(trades(spark, [2, 4, 4, 4, 5, 5, 7, 9])).first().sd == pytest.approx(2.13809, abs=1e-4)
    assert [TS.summary(trades(spark, r)).first().profit_factor for r in ([1, 2], [-1, -2])] == [99.0, 0.0]
    one = TS.sharpe_stats(trades(spark, [1])).first()
    assert (one.sd, one.sharpe, one.skew, one.kurt) == (0, 0, 0, 3)


def test_math_golden(spark):
    df = mathx.with_phi_inv(spark.createDataFrame([(p,) for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)], "p double"), F.col("p"), "x")
    assert all(abs(r.y - r.p) < 1e-6 for r in df.select("p", mathx.phi(F.col("x")).alias("y")).collect())
    w = spark.createDataFrame([(66.0, 80), (51.4, 80), (66.0, 10000), (0.0, 0)], "w double, n int").select((F.round(mathx.wilson_low(F.col("w"), F.col("n")) / 10)).cast("int").alias("x"))
    assert [r.x for r in w.collect()] == [6, 4, 7, 0]


def test_split_and_folds_golden(spark):
    t = trades(spark, [1.0, 0.5, 9, 9, 9, 1.5, -0.5]).withColumn("entry_idx", F.element_at(F.array(*map(F.lit, [10, 69, 70, 75, 79, 80, 95])), F.col("entry_idx") + 1))
    n = spark.createDataFrame([("A", 100)], "symbol string, total long")
    parts = {r.entry_idx: r.part for r in V.purged_split(t, n, 0.20, 0.10).collect()}
    assert [parts[i] for i in (10, 69, 70, 75, 79, 80, 95)] == ["is", "is", None, None, None, "oos", "oos"]
    w = trades(spark, [1, -1, 1, -1]).withColumn("entry_idx", F.col("entry_idx") * 30 + 2)
    assert V.walk_forward(w, n, 4).first().wf_consistency == 0.5 and V.walk_forward(w.limit(1), n, 4).first().wf_consistency == 1.0
    m = trades(spark, [1, 3, -2, -4]).withColumn("entry_idx", F.element_at(F.array(*map(F.lit, [0, 3, 4, 7])), F.col("entry_idx") + 1))
    assert [r.m for r in V.block_means(m, spark.createDataFrame([("A", 8)], "symbol string, total long"), 2).orderBy("block").collect()] == [2.0, -3.0]


def test_overfitting_golden(spark):
    def means(f):
        rows = [("A", "s", "BUY", f"c{c}", b, float(f(c, b))) for c in range(8) for b in range(8)]
        return spark.createDataFrame(rows, "symbol string, strategy string, direction string, config_id string, block int, m double")

    keys = (["symbol"], ["strategy", "direction", "config_id"])
    strong = V.overfit_probability(means(lambda c, b: 5 if c == 0 else 0.01 * c), *keys).first()
    assert strong.splits == 70 and strong.pbo < 0.05
    assert V.overfit_probability(means(lambda c, b: 8 if c == b else -1), *keys).first().pbo > 0.6


def test_confidence_golden(spark):
    row = dict(n=300, win_pct=60.0, expectancy=0.3, profit_factor=2.0, max_dd=5.0, total_r=90.0, recent_win_pct=60.0, oos_win_pct=60.0, oos_expectancy=0.3, loss_streak=3, t_stat=3.0, wf_consistency=1.0, robustness=1.0)
    df = spark.createDataFrame([{**row, "dsr": 0.8}, {**row, "dsr": 0.0}]).withColumn("regime_consistent", F.lit(None).cast("boolean"))
    got = {r.dsr: (r.confidence, r.band) for r in scores.confidence(df).collect()}
    assert got == {0.8: (86, "Strong confidence"), 0.0: (59, "Low confidence")}


def test_sizing_golden(spark):
    r = spark.range(1).select(P.sizing(F.lit(1000.0), F.lit(15.0), 500_000.0, 2.0).alias("a"), P.sizing(F.lit(60000.0), F.lit(15.0), 50_000.0, 7.0).alias("b")).first()
    assert (r.a, r.b) == (666, 4)


def test_portfolio_golden(spark):
    v = spark.createDataFrame([("x", s, 10.0, 100.0, 100.0) for s in "ABCD"], "account_id string, symbol string, qty double, avg_cost double, price double")
    c = K.concentration(K.valued(v)).first()
    assert (c.hhi, c.effective_names) == (pytest.approx(2500), pytest.approx(4.0))
    m = K.merge_holdings(spark.createDataFrame([("x", "A", 100.0, 60.0, "Groww", 1), ("x", "A", 100.0, 80.0, "Zerodha", 2)], "account_id string, symbol string, qty double, avg_cost double, broker string, pos int")).first()
    assert (m.qty, m.avg_cost, m.broker) == (200, 70, "Groww/Zerodha")
    series = [("x", s, i, float(f(i))) for s, f in {"a": lambda i: i, "b": lambda i: 2 * i, "c": lambda i: -i, "d": lambda i: 5}.items() for i in range(1, 5)]
    rho = {(r.a, r.b): r.rho for r in K.correlations(spark.createDataFrame(series, "account_id string, symbol string, session int, value double")).collect()}
    assert rho["a", "b"] == pytest.approx(1) and rho["a", "c"] == pytest.approx(-1) and rho["a", "d"] == 0 and rho["d", "d"] == 1
    links = spark.createDataFrame([("x", i, j, 0.9 if j == i + 1 else 1.0 if i == j else 0.0) for i in range(12) for j in range(i, 12)], "account_id string, a int, b int, rho double")
    assert {r.cluster for r in K.linked_clusters(links).collect()} == {0}
    w = K.capped_weights(np.array([5.0, 50, 50, 50, 50]))
    assert w.max() == pytest.approx(0.25) and w.sum() == pytest.approx(1)
    assert spark.range(1).select(X.participation_verdict(X.participation(F.lit(1000), F.lit(5000))).alias("v")).first().v == "illiquid"


def test_journal_golden(spark):
    j = spark.createDataFrame([("x", 1, "2024-01-01", 200.0), ("x", 2, "2024-01-02", -100.0), ("x", 3, "2024-01-03", 300.0), ("x", 4, None, None)], "account_id string, id int, exit_date string, pnl double")
    m = L.metrics(j, ["account_id"]).first()
    assert (round(m.win_pct, 1), m.profit_factor, m.max_drawdown) == (66.7, 5.0, 100.0)
    assert [r.equity for r in L.curve(j, ["account_id"]).orderBy("pos").collect()] == [200, 100, 400]
    b = spark.createDataFrame([("x", "A", "BUY", "Manually_Accepted", 1300.0, 100, None)], "account_id string, symbol string, direction string, state string, entry double, qty int, pnl double")
    r = L.breaker(b, spark.createDataFrame([("A", 1100.0)], "symbol string, mark double"), 1e6).first()
    assert r.result == -20000 and r.frozen


def test_split_check_golden(spark):
    d = spark.createDataFrame([("A", f"2024-01-0{i}", p) for i, p in ((1, 500.0), (2, 500.0), (3, 100.0), (4, 101.0))], "symbol string, d string, close double").select("symbol", F.to_date("d").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    a = spark.createDataFrame([("A", "2024-01-03", "split", 5.0)], "symbol string, d string, type string, value double").withColumn("date", F.to_date("d"))
    q = X.data_quality(d, a).first()
    assert (q.uncorrected, q.verdict) == (1, "unreliable")
    assert [r.close for r in B.back_adjust(d, a).orderBy("date").collect()] == [100, 100, 100, 101]


def test_order_book_golden(spark):
    side = lambda qs, p: [(float(p + i), q, 1) for i, q in enumerate(qs)]
    lv = "array<struct<price:double,qty:long,orders:long>>"
    df = spark.createDataFrame([((side([100, 100, 50, 30, 20], 95), side([40, 30, 20, 5, 5], 100)),), (([(0.0, 5, 1)], []),)], f"depth struct<bids:{lv},asks:{lv}>")
    i, s = M.book()
    got = df.select(i.alias("i"), s.alias("s")).collect()
    assert got[0].i == 0.5 and got[0].s == pytest.approx(1 / 99.5 * 100) and got[1].i is None
    r = spark.range(1).select(M.live_score(F.lit(1.0), F.lit(1.0), F.lit(True)).alias("a"), M.live_score(F.lit(1.0), F.lit(1.0), F.lit(False)).alias("b")).first()
    assert (r.a, r.b) == (2.0, 0.0)


def test_statements_golden():
    text = "My statement\nClient: X\nSymbol,ISIN,Quantity,Average Cost,Closing Price\nABC,IN1,10,\"1,500.50\",1600\nXYZ,IN2,,5,6\n"
    a, b = A.parse_holdings(text)
    assert a[:4] == ("ABC", 10.0, 1500.5, 1600.0) and b[-1] == "no quantity"
    assert next(A.parse_holdings("Stock;Qty;Buy Value\nABC;10;15000"))[:3] == ("ABC", 10.0, 1500.0)
    assert next(A.parse_holdings("ABC\t10\t1500\nDEF\t5\t20"))[:3] == ("ABC", 10.0, 1500.0)
    t = next(A.parse_trades("Symbol,Side,Qty,Entry Price,Exit Price,Realised P&L,Trade Date\nabc,Sell,5,10,8,(1.50),05-01-2024\n"))
    assert t[:8] == ("ABC", "SELL", 5.0, 10.0, 8.0, -1.5, None, "2024-01-05")
    assert A.number("(1,234.5)") == -1234.5 and A.number("x") is None and A.day_of("2024-13-01") is None


def test_stream_is_free_of_batching(spark):
    from edgeframe.plans.q_ticks import drain, stream_source
    from edgeframe.sources.tables import Tables
    from edgeframe.streaming import features as S

    t = Tables(spark, SF)
    got = []
    for files in (1, 5):
        path = stream_source(t, files)
        got.append(rows_of(drain(t, S.tick_features(S.read_ticks(spark, path))).drop("latency_median").toPandas()))
    assert got[0] == got[1] and len(got[0]) == 1000
    batch = rows_of(M.features(t.ticks).select("event_id", "delta", F.round("vwap", 6).alias("vwap"), F.round("z", 5).alias("z"), "sweep").toPandas())
    stream = rows_of(drain(t, S.tick_features(S.read_ticks(spark, path))).select("event_id", "delta", F.round("vwap", 6).alias("vwap"), F.round("z", 5).alias("z"), "sweep").toPandas())
    assert batch == stream


def test_stream_files_grow_with_the_ticks(spark, monkeypatch):
    """More rows give more files, written by more tasks, and their times follow the ticks in them."""
    from edgeframe.plans import q_ticks
    from edgeframe.sources.tables import Tables

    monkeypatch.setattr(q_ticks, "FILE_ROWS", 70, raising=False)
    t = Tables(spark, SF)
    path = Path(q_ticks.stream_source(t))
    files = sorted(path.glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(f)).agg(F.min(F.struct("ts", "event_id")), F.max(F.struct("ts", "event_id")), F.count(F.lit(1))).first() for f in files]
    assert len(files) > 8 and max(n for _, _, n in spans) <= 140 and sum(n for _, _, n in spans) == t.ticks.count()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    out = q_ticks.drain(t, q_ticks.S.tick_features(q_ticks.tick_stream(t))).select("event_id", "delta", F.round("vwap", 6).alias("vwap")).toPandas()
    assert rows_of(out) == rows_of(M.features(t.ticks).select("event_id", "delta", F.round("vwap", 6).alias("vwap")).toPandas())


def test_bootstrap_is_seeded():
    assert BS.path_stats(np.array([1.0, -1, 2, -1] * 10), 200) == BS.path_stats(np.array([1.0, -1, 2, -1] * 10), 200, at_once=7)
    assert BS.path_stats(np.ones(5), 50)[0] == 100.0


def test_rows_in_any_order(spark):
    from edgeframe.sources.tables import Tables

    bars = Tables(spark, SF).bars
    a = D.signals(C.windowed(bars), D.WINDOWED, ["symbol", "bar_idx"]).toPandas()
    b = D.signals(C.windowed(bars.orderBy(F.rand(3))), D.WINDOWED, ["symbol", "bar_idx"]).toPandas()
    assert rows_of(a) == rows_of(b)
