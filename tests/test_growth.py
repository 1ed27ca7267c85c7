"""Steps whose cost must follow the rows: each is held against a plain loop and to the shape of its plan."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeframe.operators import bootstrap
from edgeframe.operators import portfolio as K
from edgeframe.sources import ingest


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


CANDIDATE = "account_id long, symbol long, sector string, score double, notional double, risk double, capital double, win_pct double"


def candidate_rows():
    rng = random.Random(7)
    return [(a, s, rng.choice(["", None, "x", "y"]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), rng.uniform(1, 60), rng.uniform(0, 4), 40.0, 50.0 + s) for a in range(40) for s in range(a % 11 + 1)]


def chosen(rows):
    best = lambda r: (r[3] is None or r[3] != r[3], -(r[3] if r[3] is not None and r[3] == r[3] else 0), r[1])
    found = {}
    for a in {r[0] for r in rows}:
        spent = risk = taken = 0
        sectors = {}
        for r in sorted((r for r in rows if r[0] == a), key=best):
            why = "names" if taken >= 5 else "sector" if r[2] and sectors.get(r[2], 0) >= 2 else "leverage" if spent + r[4] > 200 else "risk" if risk + r[5] > 2.4 else ""
            if not why:
                spent, risk, taken = spent + r[4], risk + r[5], taken + 1
                sectors[r[2]] = sectors.get(r[2], 0) + 1
            found[a, r[1]] = (not why, why, r[7])
    return found


def test_basket_walks_accounts_over_batches(spark, small_batches):
    rows = candidate_rows()
    b = K.basket(spark.createDataFrame(rows, CANDIDATE).repartition(3), keep=("win_pct",))
    assert "FlatMapGroupsInPandas" not in plan_of(b)
    assert {(r.account_id, r.symbol): (r.taken, r.skipped, r.win_pct) for r in b.collect()} == chosen(rows)


def test_basket_totals_of_accounts_cut_by_batches(spark, small_batches):
    rows = candidate_rows()
    t = K.basket_totals(K.basket(spark.createDataFrame(rows, CANDIDATE)))
    assert "FlatMapGroupsInPandas" not in plan_of(t)
    want = chosen(rows)
    for r in t.collect():
        mine = [v for k, v in want.items() if k[0] == r.account_id]
        assert (r.considered, r.positions, r.skipped_sector) == (len(mine), sum(v[0] for v in mine), sum(v[1] == "sector" for v in mine))


def test_basket_losses_of_many_sizes_in_one_batch(spark):
    rows = [(a, s, 1.0 + a % 3 + s, 40.0 + 7 * s, 1.5 + s) for a in range(12) for s in range(a % 4 + 1)]
    d = K.basket_losses(spark.createDataFrame(rows, "account_id long, symbol long, risk double, win_pct double, rr double").coalesce(1), draws=40)
    assert "FlatMapGroupsInPandas" not in plan_of(d)
    for r in d.collect():
        mine = sorted(x for x in rows if x[0] == r.account_id)
        u = (bootstrap.draws(42, 0, 40 * len(mine)) >> np.uint64(11)) / 2.0**53
        days = [sum((x[4] if u[k * len(mine) + j] < x[3] / 100 else -1) * x[2] for j, x in enumerate(mine)) for k in range(40)]
        assert (r.names, r.expected) == (len(mine), pytest.approx(np.mean(days)))
        assert (r.p05, r.losing_pct) == (pytest.approx(sorted(days)[int(0.05 * 39 + 0.5)]), pytest.approx(np.mean([x < 0 for x in days]) * 100))


@pytest.mark.parametrize("kind, head, line", [("holdings", "Stock;Quantity;Buy Value", "s%d;2;%d"), ("trades", "Symbol,Side,Qty,Entry Price,Exit Price,Trade Date", "s%d,buy,2,%d,9,2024-01-02")])
def test_statements_leave_in_batches_of_many_files(spark, monkeypatch, kind, head, line):
    monkeypatch.setattr(ingest, "ROWS_AT_ONCE", 7)
    files = [(f"f{i}", "\n".join([head, *[line % (i, k + 1) for k in range(i % 5)]]).encode()) for i in range(30)] + [("none", None)]
    got = ingest.statements(spark.createDataFrame(files, "path string, content binary"), kind)
    assert "MapInPandas" not in plan_of(got)
    rows = got.where("warning IS NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("nth").alias("last"), F.min("symbol").alias("symbol")).collect()
    assert {r.path: (r.n, r.last, r.symbol) for r in rows} == {f"f{i}": (i % 5, i % 5 - 1, f"S{i}") for i in range(30) if i % 5}


def test_statements_are_parsed_in_tasks_cut_by_rows(spark, monkeypatch):
    from edgeframe.plans import q_sources as Q
    from edgeframe.sources import tables

    monkeypatch.setattr(tables, "LINE_ROWS", 100)
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    n = -(-t.raw("orders").count() // 100)
    for kind in ("holdings", "trades"):
        moves = [x for x in Q.statement_files(t, kind)._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x]
        assert len(moves) == 1 and f"{n}), REPARTITION_BY_NUM" in moves[0]


def test_cells_of_many_statements_are_read_as_numbers_once():
    """Marked numbers and words, which recur, are worked out once; the others need no pattern."""
    ingest._marked_number.cache_clear()
    for i in range(50):
        rows = list(ingest.parse_holdings(f"Stock;Quantity;Buy Value\nAB;2;{i}.50\nCD;(3);Rs. 1,200"))
        assert rows == [("AB", 2.0, (i + 0.5) / 2, None, None, None), ("CD", -3.0, -400.0, None, None, None)]
    assert ingest._marked_number.cache_info().misses <= 10
    assert [ingest.number(x) for x in (None, "", "9" * 40, "(" + "9" * 40 + ")", "x" * 40)] == [None, None, float("9" * 40), -float("9" * 40), None]


def test_statement_values_of_half_a_cent_equal_the_sql(spark, tmp_path):
    import duckdb

    from edgeframe import catalog

    rows = [(3674, 390953.8, "P", 1, "1-URGENT", "2024-01-02"), (5, 1234.5, "F", 2, "5-LOW", "2024-01-03")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderstatus string, o_custkey long, o_orderpriority string, day string")
    orders.selectExpr("*", "CAST(day AS timestamp) AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    name = "a11_holdings_statements"
    got = sorted((r.path, r.n, r.qty, r.value) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT path, n, qty, value FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_windows_of_ticks_equal_one_by_one():
    from edgeframe.streaming import features as S

    rng = np.random.default_rng(5)
    for x in (rng.normal(100, 5, 2500), 100 + np.cumsum(rng.choice([-1.0, 0.0, 1.0], 2500)), np.r_[np.arange(50.0), np.full(1500, 9.0), np.arange(9.0, 0, -0.01)]):
        for kept in (0, 7, 1000):
            ends = np.arange(kept + 1, len(x) + 1)
            first = np.maximum(ends - S.PRICES, 0)
            assert np.allclose(S.window_rsi(x, first, ends), [S.tick_rsi(x[a:b]) for a, b in zip(first, ends)], rtol=0, atol=1e-9)
            first = np.maximum(ends - S.DELTAS, 0)
            assert S.window_medians(np.floor(x), first, ends) == [int(np.median(np.floor(x)[a:b])) for a, b in zip(first, ends)]


def test_line_items_meet_once_by_symbol_and_by_account(spark, monkeypatch):
    """Days, closes and windows of a symbol, and merged holdings, need no further move of the rows."""
    from edgeframe.plans import q_portfolio as Q
    from edgeframe.sources import tables

    t = tables.Tables(spark, "/root/testdata/sf0.001")
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert moves(Q.last_close(t)) == moves(K.span_stats(t.steady, [1, 2], 50)) == 1
    assert moves(K.merge_holdings(t.holdings)) == moves(t.holdings)
    monkeypatch.setattr(tables, "LINE_ROWS", 500)
    assert t.line_parts() == -(-t.raw("lineitem").count() // 500)


def test_holdings_stay_by_account_until_their_basket(spark):
    """Prices, sectors, weights and the choice need no move of the holdings but the one to their accounts."""
    from edgeframe.plans import q_portfolio as Q
    from edgeframe.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        b = K.basket(Q.candidates(t))
        assert b.collect()
        assert plan_of(b).split("== Final Plan ==")[1].split("== Initial Plan ==")[0].count("Exchange hashpartitioning(account_id") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(Q.closes(t)) == rows(Q.last_close(t))
    near = lambda df: {(r.account_id, r.symbol): (r.qty, pytest.approx(r.avg_cost)) for r in df.collect()}
    assert near(K.merge_holdings(t.holdings, brokers=False)) == {k: (q, c.expected) for k, (q, c) in near(K.merge_holdings(t.holdings)).items()}


def test_closes_of_a_day_with_several_items_and_items_without_one(spark, tmp_path):
    from edgeframe.plans import q_portfolio as Q
    from edgeframe.sources.tables import Tables

    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, day string"
    rows = [(1, 1, 5, 1, 1.0, 10.0, "2024-01-02"), (1, 1, 5, 2, 1.0, 11.0, "2024-01-02"), (9, 1, 5, 1, 1.0, 12.0, "2024-01-01"), (9, 1, 5, 2, 0.0, 13.0, "2024-01-03"), (3, 1, 6, 1, 1.0, 14.0, None), (3, 1, 7, 1, 1.0, None, "2024-01-01")]
    spark.createDataFrame(rows, kinds).selectExpr("*", "CAST(day AS timestamp) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(tuple(r) for r in Q.closes(Tables(spark, str(tmp_path))).collect()) == [(5, 11.0), (7, None)]


def test_caveat_reads_the_book_and_the_session(spark):
    from edgeframe.plans import q_ticks as Q
    from edgeframe.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    thin = {r.event_id for r in Q.booked(t).where("abs(imbalance) < 0.05").collect()}
    rows = Q.m15(t).collect()
    assert {r.event_id for r in rows if "thin OBI" in r.note} == thin
    assert {r.event_id for r in rows if r.stretched} == {r.event_id for r in Q.M.features(t.ticks).where("abs(z) > 3").collect()}
