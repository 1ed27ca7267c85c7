"""Out-of-sample splits, walk-forward folds, robustness, regimes, deflated Sharpe, overfitting."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mathx
from .bars import series
from .tradestats import keys_of


def purged_split(trades: DataFrame, lengths: DataFrame, oos: float = 0.30, embargo: float = 0.02) -> DataFrame:
    """Adds ``part``: is, oos, or null inside the embargo; ``lengths`` gives bars per series as ``total``."""
    start = F.floor(F.col("total") * (1 - oos))
    gap = F.floor(F.col("total") * embargo)
    part = F.when(F.col("entry_idx") >= start, "oos").when(F.col("entry_idx") < start - gap, "is")
    return trades.join(lengths, series(trades)).withColumn("part", part).drop("total")


def split_stats(split: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or keys_of(split)
    o = F.col("part") == "oos"
    return split.groupBy(*keys).agg(
        F.sum((F.col("part") == "is").cast("long")).alias("is_n"), F.avg(F.when(F.col("part") == "is", F.col("r"))).alias("is_expectancy"),
        F.sum(o.cast("long")).alias("oos_n"), F.avg(F.when(o, F.col("r"))).alias("oos_expectancy"), (F.avg(F.when(o, (F.col("r") > 0).cast("double"))) * 100).alias("oos_win_pct"),
    ).withColumns({"is_n": F.coalesce("is_n", F.lit(0)), "oos_n": F.coalesce("oos_n", F.lit(0))})


def walk_forward(trades: DataFrame, lengths: DataFrame, folds: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Share of non-empty folds (equal widths of bars) whose mean is positive; 1 with fewer than two folds."""
    keys = keys or keys_of(trades)
    width = F.greatest(F.ceil(F.col("total") / folds), F.lit(1))
    f = trades.join(lengths, series(trades)).withColumn("fold", F.least(F.floor(F.col("entry_idx") / width), F.lit(folds - 1)))
    per = f.groupBy(*keys, "fold").agg(F.avg("r").alias("m")).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.avg((F.col("m") > 0).cast("double")).alias("s"))
    return per.select(*keys, F.when(F.col("c") < 2, 1.0).otherwise(F.col("s")).alias("wf_consistency"))


def trade_walk_forward(trades: DataFrame, folds: int = 5, keys: list[str] | None = None) -> DataFrame:
    """The same over windows of equal numbers of trades; the last takes the rest."""
    keys = keys or keys_of(trades)
    w = Window.partitionBy(*keys)
    t = trades.withColumn("nth", F.row_number().over(w.orderBy("entry_idx")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    t = t.where(F.col("n") >= folds).withColumn("fold", F.least(F.floor(F.col("nth") / F.floor(F.col("n") / folds)), F.lit(folds - 1)))
    return t.groupBy(*keys, "fold").agg(F.avg("r").alias("m")).groupBy(*keys).agg(F.avg((F.col("m") > 0).cast("double")).alias("wf_trades"))


def robustness(stats: DataFrame, least: int = 20) -> DataFrame:
    """Share of the configurations of a (series, strategy, direction) with enough trades that make money; 1 if none has enough."""
    w = Window.partitionBy(*series(stats), "strategy", "direction")
    ok = F.when(F.col("n") >= least, (F.col("expectancy") > 0).cast("double"))
    return stats.withColumn("robustness", F.coalesce(F.avg(ok).over(w), F.lit(1.0)))


def benchmark_regime(index: DataFrame, n: int = 20) -> DataFrame:
    """index_name, date, up: at or above its 20-day mean; before that, not below the day before; the first day is up."""
    w = Window.partitionBy("index_name").orderBy("date")
    tail = w.rowsBetween(-(n - 1), 0)
    sma = F.when(F.count(F.lit(1)).over(tail) == n, F.avg("close").over(tail))
    prev = F.lag("close").over(w)
    return index.select("index_name", "date", "close", F.coalesce(F.when(sma.isNotNull(), F.col("close") >= sma), F.col("close") >= prev, F.lit(True)).alias("up"))


def regime_consistency(trades: DataFrame, regime: DataFrame, keys: list[str] | None = None, least: int = 10) -> DataFrame:
    """true: makes money in up and in down days, with enough trades in each; false: loses in one with enough; null: unknown."""
    keys = keys or keys_of(trades)
    j = trades.join(regime, trades.session_date == regime.date)
    up, down = F.col("up"), ~F.col("up")
    per = j.groupBy(*keys).agg(
        F.sum(up.cast("long")).alias("n_up"), F.avg(F.when(up, F.col("r"))).alias("e_up"), F.sum(down.cast("long")).alias("n_down"), F.avg(F.when(down, F.col("r"))).alias("e_down")
    )
    bad = ((F.col("n_up") >= least) & (F.col("e_up") <= 0)) | ((F.col("n_down") >= least) & (F.col("e_down") <= 0))
    return per.withColumn("regime_consistent", F.when(bad, False).when((F.col("n_up") >= least) & (F.col("n_down") >= least), True))


def deflated_sharpe(stats: DataFrame, by: list[str]) -> DataFrame:
    """Adds dsr: the chance that a Sharpe ratio is real given all trials of its ``by`` group."""
    w = Window.partitionBy(*by)
    s = stats.withColumn("trials", F.count(F.lit(1)).over(w))
    s = s.withColumn("spread", F.coalesce(F.stddev_samp("sharpe").over(w), F.lit(0.0))).withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1e-9))
    clean = lambda c, d: F.when(c.isNull() | F.isnan(c), d).otherwise(c)
    s = s.withColumn("t_skew", clean(F.skewness("sharpe").over(w), 0.0)).withColumn("t_kurt", clean(F.kurtosis("sharpe").over(w) + 3, 3.0))
    gamma, e = 0.5772156649, 2.718281828459045
    n = F.col("trials").cast("double")
    s = mathx.with_phi_inv(mathx.with_phi_inv(s, 1 - 1 / n, "__a"), 1 - 1 / (n * e), "__b")
    x, root = F.col("sharpe"), F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)).cast("double"))
    scale = F.sqrt(F.greatest(1 - F.col("t_skew") * x + (F.col("t_kurt") - 1) / 4 * x * x, F.lit(1e-9)))
    best = F.col("spread") * ((1 - gamma) * F.col("__a") + gamma * F.col("__b"))
    s = s.withColumn("__z", F.when(F.col("trials") == 1, x * root).otherwise((x - best) * root / scale))
    return s.withColumn("dsr", F.least(F.greatest(mathx.phi(F.col("__z")), F.lit(0.0)), F.lit(1.0))).drop("spread", "t_skew", "t_kurt", "__a", "__b", "__z")


def shrunk(n: Column, e: Column, prior: float = 0.0, strength: float = 40.0) -> Column:
    return (n * e + strength * prior) / (n + strength)


# ---------------------------------------------------------------- overfitting


def block_means(trades: DataFrame, lengths: DataFrame, blocks: int = 8, keys: list[str] | None = None) -> DataFrame:
    """keys, block, mean R of the trades of each of equal blocks of bars; empty blocks are 0."""
    keys = keys or keys_of(trades)
    width = F.greatest(F.ceil(F.col("total") / blocks), F.lit(1))
    t = trades.join(lengths, series(trades)).withColumn("block", F.least(F.floor(F.col("entry_idx") / width), F.lit(blocks - 1)).cast("int"))
    per = t.groupBy(*keys, "block").agg(F.avg("r").alias("m"))
    grid = trades.select(*keys).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return grid.join(per, [*keys, "block"], "left").select(*keys, "block", F.coalesce("m", F.lit(0.0)).alias("m"))


def overfit_probability(means: DataFrame, by: list[str], config: list[str], blocks: int = 8, least: int = 8) -> DataFrame:
    """Chance that the best configuration in half of the blocks falls below the middle in the other half.

    The split table is static (all halves of ``blocks``); each configuration is one row of block means.
    """
    halves = list(combinations(range(blocks), blocks // 2))
    cfg = means.groupBy(*by, *config).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "m"))), lambda x: x["m"]).alias("v"))
    cfg = cfg.withColumn("c", F.row_number().over(Window.partitionBy(*by).orderBy(*config)))
    rows = cfg.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, h)).alias("half")) for i, h in enumerate(halves)])))
    ins = F.expr("aggregate(s.half, 0D, (a, i) -> a + v[i])") / (blocks // 2)
    all_ = F.expr("aggregate(v, 0D, (a, x) -> a + x)")
    rows = rows.select(*by, "c", F.col("s.split").alias("split"), F.round(ins, 12).alias("ins"), F.round((all_ - ins * (blocks // 2)) / (blocks // 2), 12).alias("outs"))
    best = rows.groupBy(*by, "split").agg(F.max_by("outs", F.struct("ins", -F.col("c"))).alias("best"), F.count(F.lit(1)).alias("k"))
    j = rows.join(best, [*by, "split"]).where(F.col("k") >= least)
    ranks = j.groupBy(*by, "split").agg((F.sum((F.col("outs") < F.col("best")).cast("int")) + 0.5 * F.sum((F.col("outs") == F.col("best")).cast("int"))).alias("rank"), F.max("k").alias("k"))
    omega = F.least(F.greatest(F.col("rank") / F.col("k"), F.lit(1e-6)), F.lit(1 - 1e-6))
    ranks = ranks.withColumn("logit", F.log(omega / (1 - omega)))
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
        F.element_at(F.array_sort(F.collect_list("logit")), F.floor(F.count(F.lit(1)) / 2).cast("int") + 1).alias("logit_median"),
    )
