"""Per-symbol features over ticks in event-time order: the batch twins of the streaming processor.

Windows are counts of ticks, not spans of time. ``history`` follows one symbol and session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICES, DELTAS, SIZES = 1000, 256, 64


def history():
    return Window.partitionBy("symbol", "session_date").orderBy("ts", "event_id")


def with_session(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("session_date", F.to_date("ts"))


def volume_delta(ticks: DataFrame) -> DataFrame:
    """Volume of each tick from the cumulative one; the first is 0, falls are 0."""
    prev = F.lag("volume_day").over(history())
    return with_session(ticks).withColumn("prev", prev).withColumn("delta", F.when(F.col("prev").isNull(), 0).otherwise(F.greatest(F.col("volume_day") - F.col("prev"), F.lit(0)))).drop("prev")


def features(ticks: DataFrame) -> DataFrame:
    """VWAP and deviation, price window statistics, relative volume, block multiple and sweep of every tick."""
    t = volume_delta(ticks)
    run = history().rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("pv", F.sum(F.col("ltp") * F.col("delta")).over(run)).withColumn("v", F.sum("delta").over(run))
    t = t.withColumn("vwap", F.when(F.col("v") > 0, F.try_divide("pv", "v")).otherwise(F.col("ltp"))).withColumn("dev_pct", F.try_divide((F.col("ltp") - F.col("vwap")) * 100, "vwap"))
    # The window's sums are differences of running sums, of prices from the session's first, so a tick costs the same at any width.
    x, n = F.col("ltp") - F.first("ltp").over(run), F.least(F.row_number().over(history()), F.lit(PRICES))
    t = t.withColumn("base", F.col("ltp") - x).withColumn("x", x).withColumn("n", n).withColumn("s1", F.sum("x").over(run)).withColumn("s2", F.sum(F.col("x") * F.col("x")).over(run))
    inside = lambda c: (F.col(c) - F.coalesce(F.lag(c, PRICES).over(history()), F.lit(0.0))) / F.col("n")
    t = t.withColumn("m1", inside("s1")).withColumn("m2", inside("s2")).withColumn("mean", F.col("base") + F.col("m1"))
    t = t.withColumn("sd", F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))))
    t = t.withColumn("z", F.when(F.col("sd") > 0, (F.col("ltp") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).otherwise(0.0))
    sizes = history().rowsBetween(-(SIZES - 1), -1)
    block = F.when(F.count(F.lit(1)).over(sizes) >= 5, F.try_divide(F.col("ltq").cast("double"), F.avg("ltq").over(sizes))).otherwise(0.0)
    t = t.withColumn("block", F.coalesce(block, F.lit(0.0)))
    up = down = F.lit(True)
    for k in range(6):
        a, b = F.lag("ltp", k).over(history()) if k else F.col("ltp"), F.lag("ltp", k + 1).over(history())
        up, down = up & (a > b), down & (a < b)
    sweep = F.when((F.col("block") > 1) & F.coalesce(up, F.lit(False)), 1).when((F.col("block") > 1) & F.coalesce(down, F.lit(False)), -1).otherwise(0)
    return t.withColumn("sweep", sweep).drop("pv", "v", "base", "x", "n", "s1", "s2", "m1", "m2")


def relative_volume(ticks: DataFrame) -> DataFrame:
    """Ticks with a volume delta: the delta over the mean of the last 256 such deltas, itself included."""
    t = volume_delta(ticks).where("delta > 0")
    return t.withColumn("rvol", F.col("delta") / F.avg("delta").over(history().rowsBetween(-(DELTAS - 1), 0)))


def book(depth: str = "depth") -> tuple[Column, Column]:
    """Imbalance of quantities and spread percent of a depth struct; null without a positive level."""
    total = lambda side: F.aggregate(F.col(f"{depth}.{side}"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["price"] > 0, x["qty"]).otherwise(0))
    bids, asks = total("bids"), total("asks")
    best_bid = F.array_max(F.transform(F.filter(F.col(f"{depth}.bids"), lambda x: x["price"] > 0), lambda x: x["price"]))
    best_ask = F.array_min(F.transform(F.filter(F.col(f"{depth}.asks"), lambda x: x["price"] > 0), lambda x: x["price"]))
    return F.try_divide((bids - asks).cast("double"), (bids + asks).cast("double")), F.try_divide((best_ask - best_bid) * 100, (best_ask + best_bid) / 2)


def spread_widening(rows: DataFrame, spread: str = "spread_pct", times: float = 2.5, least: int = 8) -> DataFrame:
    """Adds ``widening``: a spread of at least ``times`` the upper median of up to 63 positive ones before it."""
    positive = F.when(F.col(spread) > 0, F.col(spread))
    before = F.array_sort(F.collect_list(positive).over(history().rowsBetween(-(SIZES - 1), -1)))
    out = rows.withColumn("__b", before).withColumn("__m", F.get("__b", F.floor(F.size("__b") / 2).cast("int")))
    return out.withColumn("widening", F.coalesce((F.size("__b") >= least) & (F.col(spread) >= times * F.col("__m")), F.lit(False))).drop("__b", "__m")


def live_score(imbalance: Column, dev_pct: Column, long: Column) -> Column:
    sign = F.when(long, 1.0).otherwise(-1.0)
    pull = F.least(F.greatest(dev_pct / 2, F.lit(-0.5)), F.lit(0.5))
    return F.least(F.greatest(1 + sign * F.coalesce(imbalance, F.lit(0.0)) / 2 + sign * pull, F.lit(0.0)), F.lit(2.0))


def rank_snapshot(rows: DataFrame, k: int = 10) -> DataFrame:
    """Best row per (symbol, side), without those of zero shares, top ``k`` per side."""
    best = rows.where("shares > 0").withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "direction").orderBy(F.desc("score"), "strategy"))).where("__n = 1").drop("__n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("score"), "symbol"))).where(F.col("rank") <= k)


def caveat() -> Column:
    """What speaks for caution in a ranked row: few trades, a wide spread, a thin book, a loss out of sample, folds that disagree."""
    out = F.when(F.col("oos_expectancy") <= 0, F.format_string("OOS %+.2fR (fails out-of-sample)", "oos_expectancy"))
    folds = F.when((F.col("oos_n") > 0) & (F.col("wf_consistency") < 0.5), F.format_string("WF %.0f%% (inconsistent)", F.col("wf_consistency") * 100))
    return F.concat_ws(", ", F.when(F.col("n") < 50, "low n"), F.when(F.col("spread_pct") > 0.2, "wide spread"), F.when(F.abs("obi") < 0.05, "thin OBI"), out, folds)
