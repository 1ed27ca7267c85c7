"""Bar shaping: sessions, positions, resampling, adjustment and prior-session levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Minutes after midnight at which sessions open; bar edges are anchored here.
OPEN_MINUTE = 555


def series(df: DataFrame) -> list[str]:
    """The columns that tell one series of bars (and what is made of it) from another."""
    return ["symbol", "tf"] if "tf" in df.columns else ["symbol"]


def session_date(ts: Column, tz: str = "UTC") -> Column:
    """Exchange-local date of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def bars_from_ticks(ticks: DataFrame, width: str) -> DataFrame:
    w = F.window("ts", width)
    return (
        ticks.groupBy("symbol", w.alias("w"))
        .agg(F.min_by("ltp", "ts").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "ts").alias("close"), F.sum("ltq").cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), F.to_date("w.start").alias("session_date"), "open", "high", "low", "close", "volume")
    )


def with_positions(bars: DataFrame) -> DataFrame:
    """Adds day_id (0-based session counter) and bar_idx (0-based position) per symbol and timeframe."""
    key = series(bars)
    return bars.withColumn("day_id", F.dense_rank().over(Window.partitionBy(key).orderBy("session_date")) - 1).withColumn("bar_idx", F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1)


def dedup_by_time(rows: DataFrame, tie: list[str]) -> DataFrame:
    """One row per (symbol, ts): the first by ``tie``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*tie))).where("__n = 1").drop("__n")


def _slot(ts: Column, minutes: Column | int, tz: str) -> Column:
    """Number of the bar that holds an instant: local minutes since the open, in steps of ``minutes`` (a divisor of a day)."""
    local = F.floor(F.unix_timestamp(F.from_utc_timestamp(ts, tz)) / 60)
    return F.floor((local - OPEN_MINUTE) / minutes)


def _slot_start(slot: Column, minutes: Column | int, tz: str) -> Column:
    return F.to_utc_timestamp(F.timestamp_seconds((slot * minutes + OPEN_MINUTE) * 60), tz)


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("parts")
    )


def resample(bars: DataFrame, minutes: int, tz: str = "UTC") -> DataFrame:
    """Bars of ``minutes`` from finer ones: left-closed, anchored at the session open in the exchange's zone."""
    merged = _merged(bars.withColumn("slot", _slot(F.col("ts"), minutes, tz)), "symbol", "slot")
    return merged.select("symbol", _slot_start(F.col("slot"), minutes, tz).alias("ts"), "open", "high", "low", "close", "volume", "parts")


def timeframes(bars: DataFrame, minutes: list[int], tz: str = "UTC") -> DataFrame:
    """One table of bars of several widths (column ``tf``) from finer ones, in one pass, with positions."""
    each = bars.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes))))
    merged = _merged(each.withColumn("slot", _slot(F.col("ts"), F.col("minutes"), tz)), "symbol", "minutes", "slot").withColumn("ts", _slot_start(F.col("slot"), F.col("minutes"), tz))
    day = session_date(F.col("ts"), tz).alias("session_date")
    return with_positions(merged.select("symbol", F.concat("minutes", F.lit("min")).alias("tf"), "ts", day, "open", "high", "low", "close", "volume"))


def back_adjust(daily: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices before each split divided by its ratio, volumes multiplied; over all later splits together."""
    splits = actions.where("type = 'split' AND value > 0").select(F.col("symbol").alias("__s"), F.col("date").alias("__d"), F.col("value").alias("__v"))
    keep = [c for c in daily.columns if c not in ("symbol", "date")]
    joined = daily.join(splits, (F.col("symbol") == F.col("__s")) & (F.col("date") < F.col("__d")), "left")
    ratio = F.aggregate(F.array_sort(F.collect_list("__v")), F.lit(1.0), lambda a, x: a * x)
    per = joined.groupBy("symbol", "date").agg(*[F.first(c).alias(c) for c in keep], ratio.alias("ratio"))
    price = [c for c in keep if c in ("open", "high", "low", "close", "adj_close")]
    return per.select("symbol", "date", *[(F.col(c) / F.col("ratio")).alias(c) for c in price], F.round(F.col("volume") * F.col("ratio")).alias("volume"), "ratio")


def session_bars(bars: DataFrame) -> DataFrame:
    """OHLC of each session with the position of its first bar."""
    return bars.groupBy(*series(bars), "session_date").agg(
        F.min("day_id").alias("day_id"), F.min("bar_idx").alias("start_idx"), F.min_by("open", "bar_idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_idx").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars"),
    )


def with_prior_session(bars: DataFrame) -> DataFrame:
    """Adds the prior session's high, low and close, and this session's open."""
    key = series(bars)
    w = Window.partitionBy(*key).orderBy("session_date")
    s = session_bars(bars).select(*key, "session_date", F.col("open").alias("session_open"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("high", "low", "close")])
    return bars.join(s, [*key, "session_date"])


def last_sessions(bars: DataFrame, k: int) -> DataFrame:
    """Bars of the last ``k`` distinct sessions of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("session_date"))
    return bars.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= k).drop("__r")


def recent_window(bars: DataFrame, days: int = 40) -> DataFrame:
    """Bars within ``days`` of the symbol's last bar."""
    last = F.max("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("__last", last).where(F.col("ts") >= F.col("__last") - F.make_dt_interval(F.lit(days))).drop("__last")


def close_returns(daily: DataFrame, k: int = 60, least: int = 3) -> DataFrame:
    """Close-to-close returns of the last ``k + 1`` sessions; symbols with fewer than ``least`` drop out."""
    newest, w = Window.partitionBy("symbol").orderBy(F.desc("date")), Window.partitionBy("symbol").orderBy("date")
    tail = daily.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= k + 1)
    r = tail.withColumn("base", F.lag("close").over(w)).where("base > 0").withColumn("ret", F.col("close") / F.col("base") - 1)
    return r.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("__c") >= least).select("symbol", "date", "ret")


def cumulative_volume(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "session_date").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("cum_volume", F.sum(F.greatest("volume", F.lit(0.0))).over(w))


def usable(bars: DataFrame) -> DataFrame:
    """Rows whose open, high, low and close are present, numbers, and positive."""
    ok = None
    for c in ("open", "high", "low", "close"):
        one = F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
        ok = one if ok is None else ok & one
    return bars.where(ok)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_phase(ts: Column) -> Column:
    """pre_open, open (09:15 to 15:30), closed; by exchange-local time."""
    m = minute_of_day(ts)
    return F.when(m.between(540, 547) | ((m == 548) & (F.second(ts) == 0)), "pre_open").when(m.between(555, 929) | ((m == 930) & (F.second(ts) == 0)), "open").otherwise("closed")


def square_off_flag(ts: Column) -> Column:
    m = minute_of_day(ts)
    return F.when(m.between(900, 914), "warn").when(m.between(915, 919), "danger").otherwise("none")
