"""Structured Streaming: keyed tick state, ranked snapshots and bars with a watermark.

State is keyed by (symbol, session). Rows of a micro-batch arrive in any order: the processor sorts
them by event time, so equality with the batch twins holds whenever batches follow event time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

TICKS = "symbol string, ts timestamp, ltp double, ltq long, volume_day long, latency_us long, event_id long, user_id long, imbalance double"
OUT = "symbol string, session_date date, event_id long, user_id long, imbalance double, delta long, vwap double, dev_pct double, mean double, sd double, z double, rvol double, rsi double, block double, sweep int, atr_proxy double, latency_median long"
STATE = "prev long, pv double, v double, prices array<double>, deltas array<double>, sizes array<double>, latencies array<double>"
PRICES, DELTAS, SIZES = 1000, 256, 64
#: A session's state goes this long after its last instant.
LATE = pd.Timedelta("10min")


def read_ticks(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """Ticks from a folder of parquet files, as they arrive."""
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_each).parquet(folder)


def market_hours(ticks: DataFrame) -> DataFrame:
    from ..operators.bars import session_phase

    return ticks.where(session_phase(F.col("ts")) == "open")


def tick_rsi(prices: np.ndarray, p: int = 14) -> float:
    """RSI of the window from its first price; 50 until there are ``p + 1`` prices, or when flat.

    Wilder's means are weighted sums: the seed's first ``p`` moves share what is left of its weight.
    """
    n = len(prices) - 1
    if n < p:
        return 50.0
    d, keep = np.diff(prices), (p - 1) / p
    weight = np.r_[np.full(p, keep ** (n - p) / p), keep ** np.arange(n - p - 1, -1, -1) / p]
    gain, loss = weight @ np.maximum(d, 0), weight @ np.maximum(-d, 0)
    return 50.0 if gain + loss == 0 else float(100.0 * gain / (gain + loss))


def window_rsi(x: np.ndarray, first: np.ndarray, ends: np.ndarray, p: int = 14) -> np.ndarray:
    """``tick_rsi`` of every window ``x[first:ends]``: one decaying sum runs over all moves, and each window takes off what
    the moves up to its seed's end have left in it. A side without a move in the window is exactly 0."""
    d, keep = np.diff(x, prepend=x[0]), (p - 1) / p
    rest = ends - 1 - first - p  # moves after the seed
    whole = rest >= 0
    a, b, seeded = first[whole], ends[whole] - 1, first[whole] + p
    sides = []
    for side in (np.maximum(d, 0), np.maximum(-d, 0)):
        e, decayed = 0.0, []
        for v in (side / p).tolist():
            e = e * keep + v
            decayed.append(e)
        decayed, total, count = np.array(decayed), np.cumsum(side), np.cumsum(side > 0)
        mean = decayed[b] + keep ** rest[whole] * ((total[seeded] - total[a]) / p - decayed[seeded])
        sides.append(np.where(count[b] > count[a], mean, 0.0))
    gain, loss = sides
    out = np.full(len(ends), 50.0)
    out[whole] = np.where(gain + loss == 0, 50.0, 100.0 * gain / np.where(gain + loss == 0, 1.0, gain + loss))
    return out


def window_medians(t: np.ndarray, first: np.ndarray, ends: np.ndarray) -> list[int]:
    """Medians, cut to whole numbers, of windows that move on by one value: a sorted list takes one in and gives one up."""
    values, out, oldest = t.tolist(), [], int(first[0])
    kept = sorted(values[oldest : int(ends[0]) - 1])
    for a, b in zip(first.tolist(), ends.tolist()):
        insort(kept, values[b - 1])
        while oldest < a:
            kept.pop(bisect_left(kept, values[oldest]))
            oldest += 1
        out.append(int((kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / 2))
    return out


def _trailing(old: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All values, and for each new one the first of the ``most`` values up to it."""
    both = np.r_[old, new]
    ends = len(old) + np.arange(1, len(new) + 1)
    return both, np.maximum(ends - most, 0)


def _means(values: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(values)]
    return (sums[ends] - sums[first]) / np.maximum(ends - first, 1)


def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Features of the ticks of one (symbol, session), in event-time order, after what ``state`` keeps of those before."""
    prev, pv, v, prices, deltas, sizes, lat = state or (None, 0.0, 0.0, [], [], [], [])
    rows = rows.sort_values(["ts", "event_id"])
    n, ltp, volume, ltq = len(rows), rows["ltp"].to_numpy(float), rows["volume_day"].to_numpy(np.int64), rows["ltq"].to_numpy(float)
    delta = np.maximum(np.diff(volume, prepend=volume[0] if prev is None else prev), 0)
    pvs, vs = pv + np.cumsum(ltp * delta), v + np.cumsum(delta)
    vwap = np.where(vs > 0, pvs / np.where(vs > 0, vs, 1), ltp)

    x, first = _trailing(np.array(prices, float), ltp, PRICES)
    ends = len(prices) + np.arange(1, n + 1)
    shifted = x - x[0]
    mean = _means(shifted, first, ends)
    sd = np.sqrt(np.maximum(_means(shifted**2, first, ends) - mean**2, 0.0))
    mean += x[0]

    moved = delta > 0
    d, d_first = _trailing(np.array(deltas, float), delta[moved].astype(float), DELTAS)
    count = len(deltas) + np.cumsum(moved)  # deltas up to each tick
    from_ = np.maximum(count - DELTAS, 0)
    rvol = np.where(count > 0, d[np.maximum(count - 1, 0)] / _means(d, from_, np.maximum(count, 1)), np.nan) if len(d) else np.full(n, np.nan)

    q, _ = _trailing(np.array(sizes, float), ltq, SIZES)
    q_ends = len(sizes) + np.arange(n)
    q_first = np.maximum(q_ends - (SIZES - 1), 0)
    usual = _means(q, q_first, q_ends)
    block = np.where((q_ends - q_first >= 5) & (usual > 0), ltq / np.where(usual > 0, usual, 1), 0.0)

    steps = np.sign(np.diff(x, prepend=x[0]))
    run = np.r_[0.0, np.cumsum(steps)]
    enough = (ends >= 7) & (ends - first >= 7)
    whole = run[ends] - run[np.maximum(ends - 6, 0)]
    one_way = np.where(enough & (whole == 6), 1, np.where(enough & (whole == -6), -1, 0))

    t, t_first = _trailing(np.array(lat, float), rows["latency_us"].to_numpy(float), DELTAS)
    t_ends = len(lat) + np.arange(1, n + 1)
    out = pd.DataFrame({
        "event_id": rows["event_id"].to_numpy(), "user_id": rows["user_id"].to_numpy(), "imbalance": rows["imbalance"].to_numpy(float), "delta": delta, "vwap": vwap,
        "dev_pct": np.where(vwap != 0, (ltp - vwap) * 100 / np.where(vwap != 0, vwap, 1), np.nan), "mean": mean, "sd": sd, "z": np.where(sd > 0, (ltp - mean) / np.where(sd > 0, sd, 1), 0.0), "rvol": rvol,
        "rsi": window_rsi(x, first, ends), "block": block, "sweep": np.where(block > 1, one_way, 0).astype(np.int32), "atr_proxy": np.maximum(sd, 0.002 * ltp),
        "latency_median": window_medians(t, t_first, t_ends),
    })
    kept = (int(volume[-1]), float(pvs[-1]), float(vs[-1]), x[-PRICES:].tolist(), d[-DELTAS:].tolist(), q[-SIZES:].tolist(), t[-DELTAS:].tolist())
    return out, kept


def _keyed_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    out, kept = step(pd.concat(list(batches)), state.get if state.exists else None)
    state.update(kept)
    # The watermark has passed the end of the session when this time is reached: no tick of it can come.
    state.setTimeoutTimestamp(int((pd.Timestamp(key[1]) + pd.Timedelta("1D") + LATE).timestamp() * 1000))
    yield out.assign(symbol=key[0], session_date=key[1])[[c.strip().split(" ")[0] for c in OUT.split(",")]]


def tick_features(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Features of every tick; the state of a session is dropped when the watermark has passed its end."""
    keyed = ticks.withWatermark("ts", late).withColumn("session_date", F.to_date("ts"))
    return keyed.groupBy("symbol", "session_date").applyInPandasWithState(_keyed_step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def bars_with_watermark(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars by event time; ticks later than the watermark are dropped."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("ltp", "ts").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "ts").alias("close"), F.sum("ltq").alias("volume")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def not_frozen(rows: DataFrame, breaker: DataFrame | None) -> DataFrame:
    """Rows without those of accounts (user_id) that the breaker (account_id, frozen) holds."""
    return rows if breaker is None else rows.join(breaker.where("frozen").select(F.col("account_id").alias("user_id")), "user_id", "left_anti")


LATEST = ["vwap", "dev_pct", "z", "imbalance"]


def carry_latest(batch: DataFrame, epoch: int, folder: str) -> DataFrame:
    """The newest features of every symbol seen so far: those of the epoch before and of the batch, by event_id, written as the
    epoch's table in ``folder``. An epoch that runs again writes the same; the table before the last is kept for that."""
    spark, columns = batch.sparkSession, ["symbol", "event_id", *LATEST]
    rows = batch.select(*columns)
    if epoch > 0:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/epoch={epoch - 1}"))
    rows.groupBy("symbol").agg(F.max("event_id").alias("event_id"), *[F.max_by(c, "event_id").alias(c) for c in LATEST]).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch={epoch - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(rows.schema).parquet(f"{folder}/epoch={epoch}")


def rank_each_batch(edges: DataFrame, breaker: DataFrame | None, sink: Callable[[DataFrame, int], None], carried: str, k: int = 10) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: the latest features of every symbol, whether or not it has ticks in the batch (carried from epoch
    to epoch in the folder ``carried``), of accounts that are not frozen, joined to edges, scored with the book's imbalance
    and the distance from VWAP, ranked."""
    from ..operators.ticks import live_score, rank_snapshot

    def ranked(batch: DataFrame, epoch: int) -> None:
        last = carry_latest(not_frozen(batch, breaker), epoch, carried)
        rows = last.join(edges, "symbol").withColumn("score", F.col("shrunk") * live_score(F.col("imbalance"), F.col("dev_pct"), F.col("direction") == "BUY"))
        sink(rank_snapshot(rows, k), epoch)

    return ranked


def keep_unfrozen(breaker: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that passes on the rows of accounts that are not frozen."""
    return lambda batch, epoch: sink(not_frozen(batch, breaker), epoch)


# ---------------------------------------------------------------- tokens


def validity(mapping: DataFrame) -> DataFrame:
    """token, symbol, valid_from and valid_to (null: open) of a mapping of rows (token, symbol, valid_from): a later row of a
    token ends the earlier; one without a symbol retires the token; equal times go to the symbol that sorts last."""
    one = mapping.groupBy("token", "valid_from").agg(F.max("symbol").alias("symbol"))
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("token").orderBy("valid_from")))


def with_symbols(ticks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ticks of a token with the symbol that the token had at their time; null when it had none."""
    span = validity(mapping).withColumnRenamed("token", "__token")
    at = (F.col("token") == F.col("__token")) & (F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    return ticks.join(span, at, "left").drop("__token", "valid_from", "valid_to")


def resolve_each_batch(mapping: Callable[[], DataFrame], known: Callable[[DataFrame, int], None], unknown: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that gives token ticks their symbols. ``mapping`` is read anew for every batch, so that a table
    that has changed counts from the next batch on; ticks whose token has no symbol at their time go to ``unknown``."""

    def resolved(batch: DataFrame, epoch: int) -> None:
        rows = with_symbols(batch, mapping())
        known(rows.where("symbol IS NOT NULL"), epoch)
        unknown(rows.where("symbol IS NULL").drop("symbol"), epoch)

    return resolved


# ---------------------------------------------------------------- breaker


MONEY = "decimal(28,4)"


def live_breaker(sink: Callable[[DataFrame, int], None], carried: str, threshold: float) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step over rows of accounts and their closed trades in one stream: account_id, ts, id, pnl (null but for
    trades) and what else the rows carry. A row passes while the account's realised result, trades of its own instant
    included, is above ``threshold``; a later profit opens the account again.

    The result of each account is carried from epoch to epoch in the folder ``carried``; an epoch that runs again writes the
    same. Batches should follow event time: a trade counts for rows of its own batch by time, and for all later batches.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        gained = batch.where("pnl IS NOT NULL").groupBy("account_id").agg(F.sum(F.col("pnl").cast(MONEY)).cast(MONEY).alias("result"))
        shape, before = gained.schema, None
        if epoch > 0:
            before = spark.read.schema(shape).parquet(f"{carried}/epoch={epoch - 1}")
            gained = before.unionByName(gained).groupBy("account_id").agg(F.sum("result").cast(MONEY).alias("result"))
        gained.write.mode("overwrite").parquet(f"{carried}/epoch={epoch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{carried}/epoch={epoch - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        so_far = F.sum(F.col("pnl").cast(MONEY)).over(Window.partitionBy("account_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
        rows = batch.withColumn("result", F.coalesce(so_far, F.lit(0)).cast(MONEY)).where("pnl IS NULL")
        if before is not None:
            rows = rows.join(before.withColumnRenamed("result", "__before"), "account_id", "left").withColumn("result", (F.col("result") + F.coalesce("__before", F.lit(0))).cast(MONEY)).drop("__before")
        sink(rows.where(F.col("result") > threshold).drop("pnl"), epoch)

    return step
