"""Scores and verdicts as column expressions. Labels and point values are fixed values of the method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (label, condition, points) in the order of the checks; within a check the first that holds counts.
CHECKS: list[list[tuple[str, str, int]]] = [
    [("negative_expectancy", "total_r <= 0", 20), ("high_drawdown", "max_dd / greatest(total_r, 0.01D) > 2", 12), ("moderate_drawdown", "max_dd / greatest(total_r, 0.01D) > 1", 6)],
    [("recent_underperformance", "win_pct > 0 AND recent_win_pct < 0.70D * win_pct", 12), ("slight_recent_underperformance", "win_pct > 0 AND recent_win_pct < 0.85D * win_pct", 6)],
    [("oos_degradation", "oos_expectancy IS NOT NULL AND oos_win_pct < win_pct * 0.75D", 12), ("mild_oos_degradation", "oos_expectancy IS NOT NULL AND oos_win_pct < win_pct * 0.90D", 5)],
    [("negative_oos_expectancy", "oos_win_pct IS NOT NULL AND oos_expectancy < 0", 15)],
    [("low_profit_factor", "profit_factor < 1.1D", 10), ("marginal_profit_factor", "profit_factor < 1.3D", 4)],
    [("long_losing_streak", "loss_streak >= 8", 8), ("moderate_losing_streak", "loss_streak >= 5", 3)],
    [("inconsistent_walkforward", "wf_consistency < 0.6D", 10), ("mild_walkforward_inconsistency", "wf_consistency < 0.8D", 5)],
    [("fragile_parameters", "robustness < 0.4D", 8), ("marginal_parameter_robustness", "robustness < 0.6D", 4)],
    [("regime_dependent_edge", "regime_consistent = false", 10)],
]
#: Upper ends of the bands of a score that is not provisional.
BANDS = [(50, "Weak - NO TRADE"), (60, "Low confidence"), (70, "Moderate confidence"), (80, "Good confidence"), (90, "Strong confidence")]
PROVISIONAL = "Provisional (small sample, 20-49 trades)"


def penalties() -> Column:
    """array<struct<label, points>> of the checks that a row fails."""
    found = []
    for check in CHECKS:
        one = F.lit(None).cast("struct<label:string,points:int>")
        for label, condition, points in reversed(check):
            one = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.struct(F.lit(label).alias("label"), F.lit(points).alias("points"))).otherwise(one)
        found.append(one)
    return F.array_compact(F.array(*found))


def confidence(df):
    """Adds penalties, confidence (0 to 95, null without an edge) and band; needs the columns that CHECKS names, n, t_stat, dsr."""
    lost = F.aggregate("penalties", F.lit(0), lambda a, x: a + x["points"])
    base = 50 + F.least(F.greatest(12 * F.col("t_stat"), F.lit(0.0)), F.lit(45.0))
    raw = F.least(F.greatest(base - lost, F.lit(0.0)), F.lit(95.0))
    proven = (F.col("n") >= 300) & F.coalesce(F.col("oos_win_pct") >= F.col("win_pct") * 0.90, F.lit(False)) & (F.col("profit_factor") >= 2)
    capped = F.when((raw > 90) & ~proven, 89.0).otherwise(raw)
    capped = F.when(F.col("n") < 50, F.least(capped, F.lit(55.0))).otherwise(capped)
    score = F.floor(capped).cast("int")
    score = F.when(F.col("dsr") < 0.5, F.least(score, F.lit(59))).otherwise(score)
    df = df.withColumn("penalties", penalties()).withColumn("confidence", F.when((F.col("n") >= 20) & (F.col("expectancy") > 0), score))
    band = F.lit("Very strong confidence")
    for top, name in reversed(BANDS):
        band = F.when(F.col("confidence") < top, name).otherwise(band)
    return df.withColumn("band", F.when(F.col("confidence").isNotNull(), F.when(F.col("n") < 50, PROVISIONAL).otherwise(band)))


def conviction(mtf: Column, mc_prob: Column, wf: Column, dsr: Column, oos_e: Column, oos_n: Column, skew: Column, kurt: Column) -> Column:
    points = F.least(mtf, F.lit(5.0)) * 3 + F.when(mc_prob >= 95, 15).when(mc_prob >= 90, 10).when(mc_prob >= 80, 5).otherwise(0) + F.round(wf * 12)
    points = points + F.when(dsr >= 0.20, 12).when(dsr >= 0.10, 6).otherwise(0) + F.when(oos_e > 0, F.when(oos_n >= 12, 8).when(oos_n >= 6, 4).otherwise(0)).otherwise(0)
    points = points + F.when((skew >= 0) & (kurt < 6), 8).when((skew >= -0.3) & (kurt < 8), 4).otherwise(0)
    return F.least(F.greatest(F.round(points), F.lit(0)), F.lit(100)).cast("int")


def conviction_label(score: Column) -> Column:
    word = F.when(score >= 70, "Strong conviction").when(score >= 50, "Moderate conviction").when(score >= 30, "Weak conviction").otherwise("Stand down")
    return F.concat(word, F.lit(" (structural only)"))


def shortlist(confidence_: Column, wilson: Column, dsr: Column) -> Column:
    return F.coalesce((confidence_ >= 70) & (wilson >= 60) & (dsr >= 0.5), F.lit(False))


def verdict(confidence_: Column) -> Column:
    return F.when(confidence_.isNull(), "no_edge").when(confidence_ >= 80, "shortlist").when(confidence_ >= 60, "watch").otherwise("skip")


def artifact_note(dsr: Column) -> Column:
    return F.when(dsr < 0.05, F.format_string("Deflated Sharpe %.2f: likely a selection artifact", dsr))


def break_even(cost: Column, win_pct: Column, avg_win: Column) -> Column:
    """R that a trade must earn to pay its costs, against what it earns on average."""
    return F.try_divide(cost * 100, F.nullif(win_pct * avg_win, F.lit(0.0)))


def lean(df: DataFrame) -> DataFrame:
    """Adds net, the sum of signed factors (imbalance, move, pivot side, support, resistance, news), and its verdict.

    Needs imbalance (null: no depth), move_pct, price, p, s1, s2, r1, r2, news, blocked.
    """
    c = F.col
    steps = lambda x, a, b, hi, lo: F.when(x > b, hi).when(x > a, lo).when(x < -b, -hi).when(x < -a, -lo).otherwise(0)
    near = lambda x: F.coalesce(F.abs(c("price") - c(x)) / c("price") < 0.004, F.lit(False)) & (c(x) > 0)
    net = F.coalesce(steps(c("imbalance"), 0.15, 0.4, 3, 2), F.lit(0)) + steps(c("move_pct"), 0.2, 1.0, 2, 1) + F.coalesce(F.signum(c("price") - c("p")), F.lit(0.0)).cast("int")
    net = net + F.when(near("s1") | near("s2"), 1).otherwise(0) - F.when(near("r1") | near("r2"), 1).otherwise(0)
    net = net + F.when(c("news") == "positive", 1).when(c("news") == "negative", -1).otherwise(0)
    df = df.withColumn("net", net)
    return df.withColumn("lean", F.when(c("blocked"), "DO NOT TRADE").when(c("net") >= 2, "LEAN BUY").when(c("net") <= -2, "LEAN SELL").otherwise("STAND ASIDE"))


def book_agrees(side: Column, imbalance: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """The live book leans to the side of the plan."""
    buy = F.coalesce(bid_qty, F.lit(0)) >= F.coalesce(ask_qty, F.lit(0))
    return ((side == "BUY") & ((imbalance > 0) | buy)) | ((side == "SELL") & ((imbalance < 0) | ~buy))
