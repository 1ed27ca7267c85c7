"""The index of running extremes and the fill against loops over bars; trailing frames in ranges against whole windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeframe.operators import outcomes as E
from edgeframe.operators import ranges as R

COST = 0.0013


def sessions(seed, days=6):
    """Bars and minute bars of some sessions of different length, with gaps and ties."""
    r = random.Random(seed)
    bars, fine, i = [], [], 0
    for symbol in ("A", "B"):
        i = 0
        for day in range(days):
            price = 100.0
            for b in range(r.choice([1, 2, 3, 7, 16, 40])):
                points = [price + r.choice([-3, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(4)]
                for m, p in enumerate(points):
                    fine.append((symbol, f"2024-01-0{day + 1}", f"2024-01-0{day + 1} {10 + b // 15:02d}:{b % 15 * 4 + m:02d}:00", p + r.choice([0, 0, 2.5]), p - r.choice([0, 0, 2.5])))
                bars.append((symbol, f"2024-01-0{day + 1}", i, max(points) + 0.5, min(points) - 0.5, points[-1]))
                price, i = points[-1], i + 1
    return bars, fine


def fill(bars, entries, fine=None):
    """One position at a time, written as the definition walks the bars; entries (symbol, idx, direction, k, rr, atr)."""
    by_idx = {(b[0], b[2]): b for b in bars}
    out, free = [], {}
    for symbol, idx, direction, k, rr, atr in sorted(entries):
        group = (symbol, direction, k, rr)
        day = by_idx[symbol, idx][1]
        if idx < free.get(group, 0) or by_idx.get((symbol, idx + 1), (0, None))[1] != day or atr <= 0:
            continue
        s, entry, risk = (1 if direction == "BUY" else -1), by_idx[symbol, idx][5], k * atr
        stop, target, j, price, worst, both, proven = entry - s * risk, entry + s * rr * risk, idx + 1, None, 0.0, False, False
        hits = lambda low, high: (low <= stop, high >= target) if s > 0 else (high >= stop, low <= target)  # noqa: E731, B023
        while by_idx.get((symbol, j), (0, None))[1] == day:
            _, _, _, high, low, close = by_idx[symbol, j]
            worst = max(worst, entry - low if s > 0 else high - entry)
            a, b = hits(low, high)
            if a or b:
                price, both = stop if a else target, a and b
                if both and fine is not None:
                    for _, _, _, h, low_ in sorted(f for f in fine if f[:2] == (symbol, day)):
                        x, y = hits(low_, h)
                        if x or y:
                            price, proven = stop if x else target, True
                            break
                break
            j += 1
        if price is None:
            j, price = j - 1, close
        out.append((symbol, idx, direction, f"k{k:g}_rr{rr:g}", j, round(s * (price - entry) / risk - COST * entry / risk, 9), both, proven, round(max(worst / risk, 0), 9)))
        free[group] = j + 1
    return sorted(out)


PAIRS = [(0.5, 1.0), (1.0, 2.0), (2.0, 1.5)]


def tables(spark, seed):
    bars, fine = sessions(seed)
    r = random.Random(seed)
    signals = [(b[0], b[1], "s", r.choice(["BUY", "SELL"]), b[2], b[5], r.choice([1.0, 2.0, 0.0])) for b in bars if r.random() < 0.6]
    b = spark.createDataFrame(bars, "symbol string, session_date string, bar_idx int, high double, low double, close double")
    f = spark.createDataFrame(fine, "symbol string, session_date string, ts string, high double, low double")
    e = spark.createDataFrame(signals, "symbol string, session_date string, strategy string, direction string, entry_idx int, entry double, atr double")
    entries = [(s[0], s[4], s[3], k, rr, s[6]) for s in signals for k, rr in PAIRS]
    return bars, fine, entries, b, f, e


def rows(df, proven):
    return sorted((t.symbol, t.entry_idx, t.direction, t.config_id, t.exit_idx, round(t.r, 9), t.ambiguous, proven and t.intrabar_resolved, round(t.mae_r, 9)) for t in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_with_both_policies(spark, seed):
    bars, fine, entries, b, f, e = tables(spark, seed)
    got = E.one_at_a_time(E.first_touch(e, b, COST, PAIRS))
    assert rows(got, False) == fill(bars, entries) and any(t[6] for t in fill(bars, entries))
    assert rows(E.with_intrabar(got, f, COST), True) == fill(bars, entries, fine)


def test_configurations_do_not_multiply_the_join(spark):
    """The join of entries and bars gives at most one row for each session with a signal, whatever the configurations."""
    _, _, _, b, _, e = tables(spark, 4)
    many = [(k / 4, rr) for k in range(1, 11) for rr in (1.0, 1.5, 2.0, 3.0)]
    df = E.first_touch(e, b, COST, many)
    assert len(df.collect()) > 1000
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind.endswith("JoinExec"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    assert len(found) == 1 and 0 < found[0] <= e.where("atr > 0").select("symbol", "session_date").distinct().count()


def test_first_bar_beyond_a_level_by_doubling(spark):
    """Every level from every place of sessions of many lengths."""
    r = random.Random(5)
    bars = [(f"S{n}", "d", i, r.randrange(50, 60) + 0.0, r.randrange(40, 50) + 0.0, 50.0) for n in (2, 3, 4, 5, 8, 9, 31, 33) for i in range(n)]
    b = spark.createDataFrame(bars, "symbol string, session_date string, bar_idx int, high double, low double, close double")
    e = b.select("symbol", "session_date", F.lit("s").alias("strategy"), F.explode(F.array(F.lit("BUY"), F.lit("SELL"))).alias("direction"), F.col("bar_idx").alias("entry_idx"), F.lit(50.0).alias("entry"), F.lit(1.0).alias("atr"))
    pairs = [(float(k), 1.0) for k in range(1, 12)]
    want = fill(bars, [(s, i, d, k, rr, 1.0) for s, _, i, *_ in bars for d in ("BUY", "SELL") for k, rr in pairs])
    got = E.one_at_a_time(E.first_touch(e, b, COST, pairs))
    assert rows(got, False) == want


@pytest.mark.parametrize(("n", "ranges"), [(1, 3), (5, 4), (40, 12), (300, 9)])
def test_trailing_frames_in_ranges(spark, n, ranges):
    """Ranges shorter and longer than the frame, keys of one row to most rows."""
    r = random.Random(n)
    data = [(r.choice("aaaaaaaab") if i % 50 else f"k{i}", r.randrange(1000), i, r.randrange(100)) for i in range(800)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int")
    frame = lambda rows, w: rows.withColumn("s", F.sum("v").over(w.rowsBetween(-n, 0))).withColumn("c", F.count("v").over(w.rowsBetween(-n, 0)))
    got = R.trailing(df, ["k"], ["t", "id"], n, frame, rows_each=-(-len(data) // ranges))
    want = frame(df, Window.partitionBy("k").orderBy("t", "id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = R.trailing(df.where("false"), ["k"], ["t", "id"], n, frame)
    assert empty.count() == 0


def test_no_range_holds_a_long_key(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    rows = R.with_halo(R.ranged(df, ["k"], ["t"], R.ranges_of(df, 1000)), ["k"], ["t"], 50)
    sizes = [r["count"] for r in rows.groupBy("__range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000 and sum(sizes) == 20_000 + 50 * (len(sizes) - 1)
