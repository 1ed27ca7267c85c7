"""Trade outcomes: bracket exits within the session, one position at a time, excursions, costs in R."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import series


def group(df: DataFrame) -> list[str]:
    """What one position at a time is held in."""
    return [*series(df), "session_date", "strategy", "direction", "config_id"]


def configs(spark, pairs: list[tuple[float, float]]) -> DataFrame:
    """The static table of (stop in ATR, reward to risk) configurations."""
    return spark.createDataFrame([(f"k{k:g}_rr{rr:g}", k, rr) for k, rr in pairs], "config_id string, k double, rr double")


#: Where the first bar at or after place ``{p}`` lies whose low is at most (high at least) the level; n or more: nowhere. Falling
#: powers of two are skipped while the extreme of the skipped bars stays off the level.
_FIRST = {
    "low": "aggregate(steps, {p}, (p, j) -> IF(p < n AND lows[j][p] > {level}, p + shiftleft(1, j), p))",
    "high": "aggregate(steps, {p}, (p, j) -> IF(p < n AND highs[j][p] < {level}, p + shiftleft(1, j), p))",
}


def session_tables(bars: DataFrame) -> DataFrame:
    """One row for each series and session: n, the bars' idx and close, and sparse tables of running extremes.

    ``lows[j][p]`` is the lowest low of the 2 ** j bars from place p on (as far as the session goes), ``highs`` the
    highest high; ``steps`` counts j down. A session's bars are bounded, so a row is.
    """
    key = [*series(bars), "session_date"]
    b = bars.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bar_idx", "high", "low", "close"))).alias("b"))
    b = b.select(*key, F.size("b").alias("n"), F.col("b.bar_idx").alias("idx"), F.col("b.close").alias("close"), F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    b = b.withColumn("top", F.greatest(F.ceil(F.log2("n")), F.lit(1)).cast("int"))
    table = lambda pick, c: F.expr(
        f"aggregate(sequence(1, top), CAST(array({c}) AS ARRAY<ARRAY<DOUBLE>>), (t, j) -> concat(t, array(transform(sequence(0, n - 1), p -> {pick}(t[j - 1][p], get(t[j - 1], p + shiftleft(1, j - 1)))))))"
    )
    return b.select(*key, "n", "idx", "close", F.expr("sequence(top, 0, -1)").alias("steps"), table("least", "low").alias("lows"), table("greatest", "high").alias("highs"))


def first_touch(entries: DataFrame, bars: DataFrame, cost: float = 0.0, pairs: list[tuple[float, float]] | None = None) -> DataFrame:
    """Outcome of each entry (series, session_date, strategy, direction, config_id, k, rr, entry_idx, entry, atr), in each
    configuration of ``pairs`` where entries have none (config_id, k, rr).

    The entries of a session are gathered and meet one row, the session's index of running extremes, in which every
    level is found by doubling steps; neither bars nor index are multiplied by entries or configurations.
    """
    own = [*series(entries), "session_date"]
    signal = ["strategy", "direction", "entry_idx", "entry", "atr"]
    given = [] if pairs is not None else ["config_id", "k", "rr"]
    held = entries.where("atr > 0").groupBy(*own).agg(F.collect_list(F.struct(*signal, *given)).alias("e"))
    met = held.join(session_tables(bars), own)
    fields = lambda row, names: ", ".join(f"'{c}', {row}.{c}" for c in names)
    if pairs is not None:
        met = met.withColumn("c", F.array(*[F.struct(F.lit(f"k{k:g}_rr{rr:g}").alias("config_id"), F.lit(float(k)).alias("k"), F.lit(float(rr)).alias("rr")) for k, rr in pairs]))
        met = met.withColumn("e", F.expr(f"flatten(transform(e, x -> transform(c, y -> named_struct({fields('x', signal)}, {fields('y', ['config_id', 'k', 'rr'])}))))")).drop("c")
    each = [*signal[:4], "config_id", "k", "rr"]
    low, high = _FIRST["low"].format(p="x.p", level="IF(x.sign > 0, x.stop, x.target)"), _FIRST["high"].format(p="x.p", level="IF(x.sign > 0, x.target, x.stop)")
    # the place of the next bar is the entry bar's, counted from one
    met = met.withColumn("e", F.expr(f"transform(e, x -> named_struct({fields('x', each)}, 'sign', IF(x.direction = 'BUY', 1D, -1D), 'risk', x.k * x.atr, 'p', CAST(array_position(idx, x.entry_idx) AS INT)))"))
    met = met.withColumn("e", F.expr(f"transform(filter(e, x -> x.p > 0 AND x.p < n), x -> named_struct({fields('x', [*each, 'sign', 'risk', 'p'])}, 'stop', x.entry - x.sign * x.risk, 'target', x.entry + x.sign * x.rr * x.risk))"))
    met = met.withColumn("e", F.expr(f"transform(e, x -> named_struct({fields('x', [*each, 'sign', 'risk', 'p', 'stop', 'target'])}, 'low_at', {low}, 'high_at', {high}))"))
    met = met.withColumn("e", F.expr(f"transform(e, x -> named_struct({fields('x', [*each, 'sign', 'risk', 'p', 'stop', 'target', 'low_at', 'high_at'])}, 'out', least(x.low_at, x.high_at, n - 1)))"))
    # two blocks of a power of two cover the bars held
    j = "CAST(floor(log2(x.out - x.p + 1)) AS INT)"
    second = f"x.out + 1 - shiftleft(1, {j})"
    met = met.withColumn("e", F.expr(
        f"transform(e, x -> named_struct({fields('x', [*each, 'sign', 'risk', 'stop', 'target', 'low_at', 'high_at', 'out'])}, 'exit_idx', idx[x.out], 'last_close', close[x.out], "
        f"'adverse', IF(x.sign > 0, x.entry - least(lows[{j}][x.p], lows[{j}][{second}]), greatest(highs[{j}][x.p], highs[{j}][{second}]) - x.entry)))"
    ))
    t = met.select(*own, F.inline("e"))
    at_stop = F.when(F.col("sign") > 0, F.col("low_at")).otherwise(F.col("high_at")) == F.col("out")
    at_target = F.when(F.col("sign") > 0, F.col("high_at")).otherwise(F.col("low_at")) == F.col("out")
    t = t.withColumn("exit_price", F.when(at_stop, F.col("stop")).when(at_target, F.col("target")).otherwise(F.col("last_close"))).withColumn("ambiguous", at_stop & at_target)
    return t.select(
        *own, "strategy", "direction", "config_id", "entry_idx", "entry", "risk", "exit_idx", "k", "rr", "exit_price", "ambiguous",
        _r(cost).alias("r"), (F.greatest("adverse", F.lit(0.0)) / F.col("risk")).alias("mae_r"),
    )


def _r(cost: float) -> Column:
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    return sign * (F.col("exit_price") - F.col("entry")) / F.col("risk") - cost * F.col("entry") / F.col("risk")


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """Drops an entry at or before the exit of the position that is still open.

    Positions end with their session, so the chain is cut by session and a group is a handful of rows.
    """
    keys = group(trades)
    others = [c for c in trades.columns if c not in keys and c not in ("entry_idx", "exit_idx")]
    held = trades.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("entry_idx", "exit_idx", *others))).alias("t"))
    kept = F.expr(
        """aggregate(t, named_struct('free', -1L, 'keep', CAST(array() AS ARRAY<LONG>)),
        (a, x) -> IF(x.entry_idx > a.free, named_struct('free', CAST(x.exit_idx AS LONG), 'keep', concat(a.keep, array(CAST(x.entry_idx AS LONG)))), a)).keep"""
    )
    return held.withColumn("keep", kept).select(*keys, F.inline(F.expr("filter(t, x -> array_contains(keep, CAST(x.entry_idx AS LONG)))")))


def resolve_intrabar(trades: DataFrame, finer: DataFrame) -> DataFrame:
    """For ambiguous trades: which level a finer bar of that day touched first. A bar that straddles both counts as the
    stop; a day whose finer bars touch neither proves nothing, which counts as the stop too (``proven`` is false)."""
    key = group(trades)
    t = trades.where("ambiguous").withColumn("sign", F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0))
    t = t.select(*key, "entry_idx", "sign", (F.col("entry") - F.col("sign") * F.col("risk")).alias("stop"), (F.col("entry") + F.col("sign") * F.col("rr") * F.col("risk")).alias("target"))
    # finer bars are of one timeframe, whatever that of the trades
    f = finer.select("symbol", "session_date", F.col("ts").alias("fine_ts"), F.col("high").alias("fh"), F.col("low").alias("fl"))
    long = F.col("sign") > 0
    stop = F.when(long, F.col("fl") <= F.col("stop")).otherwise(F.col("fh") >= F.col("stop"))
    target = F.when(long, F.col("fh") >= F.col("target")).otherwise(F.col("fl") <= F.col("target"))
    first = F.min(F.when(stop | target, F.struct("fine_ts", F.when(stop, "stop").otherwise("target").alias("level"))))
    found = t.join(f, ["symbol", "session_date"], "left").groupBy(*key, "entry_idx").agg(first.alias("first"))
    return found.select(*key, "entry_idx", F.coalesce("first.level", F.lit("stop")).alias("first_level"), F.col("first").isNotNull().alias("proven"))


def with_intrabar(trades: DataFrame, finer: DataFrame, cost: float = 0.0) -> DataFrame:
    """Trades whose ambiguous exits take the price of the level that finer bars touched first; adds intrabar_resolved.

    Only ambiguous trades meet the finer bars. Exits keep their bar, so this may follow the choice of one at a time.
    """
    key = [*group(trades), "entry_idx"]
    clear = trades.where("NOT ambiguous").withColumn("intrabar_resolved", F.lit(False))
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    target = F.col("entry") + sign * F.col("rr") * F.col("risk")
    mended = trades.where("ambiguous").join(resolve_intrabar(trades, finer), key).withColumn("exit_price", F.when(F.col("first_level") == "target", target).otherwise(F.col("exit_price")))
    mended = mended.withColumn("r", _r(cost)).withColumn("intrabar_resolved", F.col("proven")).drop("first_level", "proven")
    return clear.unionByName(mended)


def winner_heat(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 90th percentile (nearest rank, rounded) of the adverse excursion of winners."""
    won = trades.withColumn("won", F.col("r") > 0)
    by = Window.partitionBy(*keys, "won")
    won = won.withColumn("nth", F.row_number().over(by.orderBy("mae_r")) - 1).withColumn("of", F.count(F.lit(1)).over(by))
    at = lambda q: F.max(F.when(F.col("won") & (F.col("nth") == F.round((F.col("of") - 1) * q)), F.col("mae_r")))
    return won.groupBy(*keys).agg(F.sum(F.col("won").cast("int")).alias("winners"), at(0.5).alias("heat_median"), at(0.9).alias("heat_p90"))


def stressed_expectancy(trades: DataFrame, keys: list[str], fractions: dict[str, float], base: float) -> DataFrame:
    """Mean R at other cost fractions: exits do not change, so each trade shifts linearly."""
    unit = F.col("entry") / F.col("risk")
    return trades.groupBy(*keys).agg(*[F.avg(F.col("r") - (f - base) * unit).alias(n) for n, f in fractions.items()])
