"""Aggregates over trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import series

KEY = ["symbol", "strategy", "direction", "config_id"]


def keys_of(df: DataFrame) -> list[str]:
    """The key of one configuration: KEY, and the timeframe where there is one."""
    return [*series(df), *KEY[1:]]


def profit_factor(wins: Column, losses: Column, cap: float | None = 99.0) -> Column:
    """Gross wins over gross losses (a positive number); 99 without losses, 0 without either."""
    ratio = F.try_divide(wins, losses)
    return F.when(losses > 0, F.least(ratio, F.lit(cap)) if cap else ratio).when(wins > 0, 99.0).otherwise(0.0)


def summary(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or keys_of(trades)
    r = F.col("r")
    win, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r <= 0, -r).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg((r > 0).cast("double")) * 100).alias("win_pct"), F.avg("r").alias("expectancy"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"),
        profit_factor(win, loss).alias("profit_factor"), F.sum("r").alias("total_r"),
    )


def with_curve(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds trade number, cumulative R, its peak (from 0) and the run of losses each trade belongs to."""
    keys = keys or keys_of(trades)
    w = Window.partitionBy(*keys).orderBy("entry_idx")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("nth", F.row_number().over(w)).withColumn("equity", F.sum("r").over(run))
    t = t.withColumn("peak", F.greatest(F.max("equity").over(run), F.lit(0.0)))
    return t.withColumn("wins_before", F.sum((F.col("r") > 0).cast("int")).over(run))


def curve_stats(trades: DataFrame, keys: list[str] = KEY, recent: int = 20) -> DataFrame:
    """Max drawdown, Calmar, longest loss streak and recent win rate."""
    keys = keys or keys_of(trades)
    c = with_curve(trades, keys)
    streaks = c.where("r <= 0").groupBy(*keys, "wins_before").count().groupBy(*keys).agg(F.max("count").alias("loss_streak"))
    c = c.withColumn("from_end", F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.col("nth") + 1)
    per = c.groupBy(*keys).agg(
        F.max(F.col("peak") - F.col("equity")).alias("max_dd"), F.sum("r").alias("total_r"),
        (F.avg(F.when(F.col("from_end") <= recent, (F.col("r") > 0).cast("double"))) * 100).alias("recent_win_pct"),
    )
    return per.join(streaks, keys, "left").select(*keys, "max_dd", F.when(F.col("max_dd") > 0, F.col("total_r") / F.nullif("max_dd", F.lit(0.0))).otherwise(0.0).alias("calmar"), F.coalesce("loss_streak", F.lit(0)).cast("long").alias("loss_streak"), "recent_win_pct")


def sharpe_stats(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sample deviation, per-trade Sharpe, t statistic, skewness and (non-excess) kurtosis."""
    keys = keys or keys_of(trades)
    sd = F.coalesce(F.stddev_samp("r"), F.lit(0.0))
    per = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), sd.alias("sd"), F.coalesce(F.skewness("r"), F.lit(0.0)).alias("skew"), (F.coalesce(F.kurtosis("r"), F.lit(0.0)) + 3).alias("kurt"))
    sharpe = F.when(F.col("sd") > 0, F.col("mean") / F.nullif("sd", F.lit(0.0))).otherwise(0.0)
    flat = lambda c: F.when(F.isnan(c), F.lit(0.0 if c == "skew" else 3.0)).otherwise(F.col(c)).alias(c)
    return per.select(*keys, "n", "sd", sharpe.alias("sharpe"), (sharpe * F.sqrt(F.col("n").cast("double"))).alias("t_stat"), flat("skew"), flat("kurt"))


def eligible(n: Column, pf: Column, expectancy: Column) -> Column:
    return (n >= 30) & (pf >= 1.2) & (expectancy > 0)


def full(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or keys_of(trades)
    s = summary(trades, keys).join(curve_stats(trades, keys), keys).join(sharpe_stats(trades, keys).drop("n"), keys)
    return s.withColumn("eligible", eligible(F.col("n"), F.col("profit_factor"), F.col("expectancy")))
