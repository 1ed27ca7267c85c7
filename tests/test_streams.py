"""Streams that depend on tables which change between batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgeframe.streaming import features as S

DAY = datetime(2024, 3, 1, 10)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def test_mapping_read_for_every_batch(spark, tmp_path):
    """A token that moves to another symbol, one that is listed late, one retired, one never listed."""
    mapping = str(tmp_path / "mapping")
    shape = "token long, symbol string, valid_from timestamp"
    spark.createDataFrame([(1, "A", at(0)), (2, "B", at(0)), (4, "D", at(0))], shape).write.parquet(f"{mapping}/v=0")
    seen, lost = {}, {}
    keep = lambda into: lambda rows, epoch: into.__setitem__(epoch, sorted((r.id, getattr(r, "symbol", None)) for r in rows.collect()))
    step = S.resolve_each_batch(lambda: spark.read.parquet(mapping), keep(seen), keep(lost))
    ticks = lambda rows: spark.createDataFrame([(i, t, at(m)) for i, t, m in rows], "id long, token long, ts timestamp")
    step(ticks([(1, 1, 0), (2, 2, 5), (3, 3, 5), (4, None, 5), (5, 4, 6), (6, 1, -1)]), 0)
    spark.createDataFrame([(1, "B", at(10)), (2, "A", at(10)), (3, "C", at(8)), (4, None, at(10))], shape).write.parquet(f"{mapping}/v=1")
    step(ticks([(7, 1, 9), (8, 1, 10), (9, 2, 10), (10, 3, 8), (11, 3, 7), (12, 4, 9), (13, 4, 10)]), 1)
    assert seen == {0: [(1, "A"), (2, "B"), (5, "D")], 1: [(7, "A"), (8, "B"), (9, "A"), (10, "C"), (12, "D")]}
    assert lost == {0: [(3, None), (4, None), (6, None)], 1: [(11, None), (13, None)]}


@pytest.mark.parametrize("cuts", [[], [4], [2, 5, 9]])
def test_breaker_on_the_stream(spark, tmp_path, cuts):
    """An account that falls to the threshold shows no row from there on, until a profit lifts it; others are untouched."""
    events = [
        ("x", 0, 1, None), ("x", 1, 2, -60.0), ("x", 2, 3, None), ("y", 2, 4, None), ("x", 3, 5, -40.0), ("x", 3, 6, None), ("x", 4, 7, None),
        ("y", 5, 8, -99.99), ("y", 5, 9, None), ("x", 6, 10, 0.01), ("x", 7, 11, None), ("z", 8, 12, None), (None, 9, 13, None),
    ]
    rows = [(a, at(m), i, p) for a, m, i, p in events]
    want, result = [], {}
    for a, _, i, p in rows:
        result[a] = result.get(a, 0.0) + (p or 0.0)
        if p is None and result[a] > -100:
            want.append(i)
    shown = {}
    sink = lambda df, epoch: shown.__setitem__(epoch, sorted(r.id for r in df.collect()))
    step = S.live_breaker(sink, str(tmp_path / "carried"), -100.0)
    bounds = [0, *cuts, len(rows)]
    for epoch, (b, e) in enumerate(zip(bounds, bounds[1:])):
        batch = spark.createDataFrame(rows[b:e], "account_id string, ts timestamp, id long, pnl double")
        step(batch, epoch)
        first = shown[epoch]
        step(batch, epoch)  # an epoch that runs again
        assert shown[epoch] == first
    got = sorted(i for ids in shown.values() for i in ids)
    assert got == sorted(set(want)) and 6 not in got and 7 not in got and 11 in got and 9 in got
    last = spark.read.parquet(f"{tmp_path}/carried/epoch={len(bounds) - 2}").select("account_id", F.col("result").cast("double")).collect()
    assert {r[0]: r[1] for r in last} == {"x": pytest.approx(-99.99), "y": pytest.approx(-99.99)}


def test_provider_feeds(spark):
    """Scores as numbers, as text and broken; articles without entities, title or source; empty, broken and unknown answers."""
    from edgeframe.sources import ingest

    rows = [
        (1, "marketaux", '{"data": [{"title": " Up ", "source": "wire", "entities": [{"sentiment_score": 0.5}, {"sentiment_score": "-0.1"}, {"sentiment_score": "x"}, {}]}, {"entities": [{"sentiment_score": 0.2}]}]}'),
        (2, "marketaux", '{"data": [{"description": "told", "entities": []}]}'),
        (3, "marketaux", '{"data": []}'), (4, "marketaux", "{}"), (5, "marketaux", "not json"), (6, "marketaux", None),
        (7, "eodhd", '[{"content": "c", "sentiment": {"polarity": 2}}, {"sentiment": {"polarity": " 1.5 "}}, {"sentiment": null}, {}]'),
        (8, "eodhd", "[]"), (9, "eodhd", '[{"title": "t", "source": " s "}]'), (10, "other", "[]"), (11, None, "[]"),
    ]
    got = {r.symbol: (r.sentiment, r.headline, r.source) for r in ingest.provider_sentiment(spark.createDataFrame(rows, "symbol long, provider string, body string")).collect()}
    none = (None, None, None)
    want = {2: (0.0, "told", "marketaux"), 3: none, 4: none, 5: none, 6: none, 7: (1.0, "c", "eodhd"), 8: none, 9: (0.0, "t", "s"), 10: none, 11: none}
    assert got.pop(1) == (pytest.approx(0.2), "Up", "wire") and got == want
