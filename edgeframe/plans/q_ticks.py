"""Registered queries of tick features (batch twins) and of the streaming jobs."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from ..operators import ticks as M
from ..operators import validation as V
from ..sources.stage import durable, shared_folder
from ..streaming import features as S
from .registry import query

W = "(PARTITION BY symbol, session_date ORDER BY ts, event_id)"
DELTA = f"SELECT *, CASE WHEN pv0 IS NULL THEN 0 ELSE greatest(volume_day - pv0, 0) END AS delta FROM (SELECT *, lag(volume_day) OVER {W} AS pv0 FROM (SELECT *, CAST(ts AS DATE) AS session_date FROM ticks))"
FEAT = f"""SELECT *, CASE WHEN v > 0 THEN pv / v ELSE ltp END AS vwap FROM (SELECT *, sum(ltp * delta) OVER w AS pv, sum(delta) OVER w AS v, avg(ltp) OVER p AS mean, stddev_pop(ltp) OVER p AS sd,
  CASE WHEN count(*) OVER s >= 5 THEN ltq / nullif(avg(ltq) OVER s, 0) ELSE 0 END AS block, ltp - lag(ltp) OVER w AS step FROM delta
  WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, event_id), p AS (PARTITION BY symbol, session_date ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol, session_date ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))"""
SWEEP = f"SELECT event_id, CASE WHEN block > 1 AND count(step) OVER w = 6 AND min(step) OVER w > 0 THEN 1 WHEN block > 1 AND count(step) OVER w = 6 AND max(step) OVER w < 0 THEN -1 ELSE 0 END AS sweep FROM feat WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
X = {"delta": DELTA, "feat": FEAT}


@query("m03_volume_delta", "ticks", extra={"delta": DELTA}, sql="SELECT event_id, delta FROM delta")
def m03(t):
    return M.volume_delta(t.ticks).select("event_id", "delta")


@query("m04_session_vwap", "ticks", extra=X, sql="SELECT event_id, R6(vwap) AS vwap, R6((ltp - vwap) * 100 / nullif(vwap, 0)) AS dev_pct FROM feat")
def m04(t):
    return M.features(t.ticks).select("event_id", "vwap", "dev_pct")


@query("m05_price_window", "ticks", extra=X, sql="SELECT event_id, R6(mean) AS mean, R6(sd) AS sd FROM feat")
def m05(t):
    return M.features(t.ticks).select("event_id", "mean", "sd")


@query("m06_relative_volume", "ticks", extra={"delta": DELTA}, sql="SELECT event_id, R6(delta / avg(delta) OVER (PARTITION BY symbol, session_date ORDER BY ts, event_id ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)) AS rvol FROM delta WHERE delta > 0")
def m06(t):
    return M.relative_volume(t.ticks).select("event_id", "rvol")


BOOK_LEVELS = 5


def with_depth(t):
    """A five-level book around each tick, derived from its price and size."""
    level = lambda i, s: F.struct((F.col("ltp") * (1 + s * 0.0005 * i)).alias("price"), (F.col("ltq") * (BOOK_LEVELS + 1 - i) + (F.col("event_id") + i) % 7 * (1 if s < 0 else 2)).alias("qty"), F.lit(1).cast("long").alias("orders"))
    side = lambda s: F.array(*[level(i, s) for i in range(1, BOOK_LEVELS + 1)])
    return t.ticks.withColumn("depth", F.struct(side(-1).alias("bids"), side(1).alias("asks")))


_B = " + ".join(f"ltq * {6 - i} + (event_id + {i}) % 7" for i in range(1, 6))
_A = " + ".join(f"ltq * {6 - i} + (event_id + {i}) % 7 * 2" for i in range(1, 6))


@query("m07_order_book", "ticks", sql=f"SELECT event_id, R6(CASE WHEN ltp > 0 THEN (({_B}) - ({_A})) / CAST(({_B}) + ({_A}) AS DOUBLE) END) AS imbalance, R6(CASE WHEN ltp > 0 THEN 0.1 END) AS spread_pct FROM ticks")
def m07(t):
    imbalance, spread = M.book()
    return with_depth(t).select("event_id", imbalance.alias("imbalance"), spread.alias("spread_pct"))


@query("m09_block_multiple", "ticks", extra=X, sql="SELECT event_id, R6(coalesce(block, 0)) AS block FROM feat")
def m09(t):
    return M.features(t.ticks).select("event_id", "block")


@query("m10_tick_sweep", "ticks", extra=X | {"sw": SWEEP}, sql="SELECT event_id, sweep FROM sw")
def m10(t):
    return M.features(t.ticks).select("event_id", "sweep")


SPREADS = f"SELECT event_id, x, list_sort(list(x) OVER (PARTITION BY symbol, session_date ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) AS b FROM (SELECT *, CAST(ts AS DATE) AS session_date, CAST(ltq % 10 + 1 AS INTEGER) AS x FROM ticks)"


@query("m11_spread_widening", "ticks", extra={"sp": SPREADS}, sql="SELECT event_id, coalesce(len(b) >= 8 AND x >= 2.5 * b[len(b) // 2 + 1], false) AS widening FROM sp")
def m11(t):
    rows = M.with_session(t.ticks).withColumn("spread_pct", F.col("ltq") % 10 + 1)
    return M.spread_widening(rows).select("event_id", "widening")


@query("m12_latency", "ticks", sql="SELECT symbol, CAST(floor(median(latency_us)) AS BIGINT) AS latency_median, count(*) AS ticks FROM ticks GROUP BY symbol")
def m12(t):
    return t.ticks.groupBy("symbol").agg(F.floor(F.median("latency_us")).cast("long").alias("latency_median"), F.count(F.lit(1)).alias("ticks"))


EDGES = "SELECT symbol, d AS direction, 'vwap_cross' AS strategy, 0.1 + 0.05 * length(symbol) AS e, 30 + length(symbol) AS n FROM (SELECT DISTINCT symbol FROM ticks) CROSS JOIN (VALUES ('BUY'), ('SELL')) x(d)"
IMBALANCE = f"CASE WHEN ltp > 0 THEN (({_B}) - ({_A})) / CAST(({_B}) + ({_A}) AS DOUBLE) END"
SNAP = f"SELECT symbol, arg_max((ltp - vwap) * 100 / nullif(vwap, 0), event_id) AS dev, arg_max({IMBALANCE}, event_id) AS ob FROM feat GROUP BY symbol"
SIDE = "(CASE WHEN direction = 'BUY' THEN 1 ELSE -1 END)"
SCORE = f"least(greatest(1 + {SIDE} * coalesce(ob, 0) / 2 + {SIDE} * least(greatest(dev / 2, -0.5), 0.5), 0), 2)"


def edges(t):
    return t.ticks.select("symbol").distinct().select("symbol", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))).alias("direction"), F.lit("vwap_cross").alias("strategy"), (0.1 + 0.05 * F.length("symbol")).alias("e"), (30 + F.length("symbol")).alias("n")).withColumn("shrunk", V.shrunk(F.col("n"), F.col("e"))).withColumn("shares", F.lit(1))


def booked(t):
    """Ticks with the imbalance of their book."""
    return with_depth(t).withColumn("imbalance", M.book()[0]).drop("depth")


def scored(t):
    last = M.features(booked(t)).groupBy("symbol").agg(*[F.max_by(c, "event_id").alias(c) for c in ("dev_pct", "z", "imbalance")])
    return last.join(edges(t), "symbol").withColumn("score", F.col("shrunk") * M.live_score(F.col("imbalance"), F.col("dev_pct"), F.col("direction") == "BUY"))


@query("m13_candidates", "ticks", extra=X | {"e": EDGES, "s": SNAP}, sql=f"SELECT symbol, direction, R6(ob) AS imbalance, R6(n * e / (n + 40.0) * {SCORE}) AS score FROM e JOIN s USING (symbol)")
def m13(t):
    return scored(t).select("symbol", "direction", "imbalance", "score")


RANKED = f"SELECT * FROM (SELECT symbol, direction, row_number() OVER (PARTITION BY direction ORDER BY n * e / (n + 40.0) * {SCORE} DESC, symbol) AS rank FROM e JOIN s USING (symbol)) WHERE rank <= 10"


@query("m14_snapshot_rank", "ticks", extra=X | {"e": EDGES, "s": SNAP}, sql=RANKED)
def m14(t):
    return M.rank_snapshot(scored(t)).select("symbol", "direction", "rank")


@query("m15_caveat", "ticks", extra=X, sql=f"""SELECT event_id, concat_ws(', ', CASE WHEN n < 50 THEN 'low n' END, CASE WHEN spread > 0.2 THEN 'wide spread' END, CASE WHEN abs(obi) < 0.05 THEN 'thin OBI' END, CASE WHEN oos <= 0 THEN printf('OOS %+.2fR (fails out-of-sample)', oos) END,
  CASE WHEN oos_n > 0 AND wf < 0.5 THEN printf('WF %.0f%% (inconsistent)', wf * 100) END) AS note, abs(z) > 3 AS stretched FROM (SELECT event_id, CASE WHEN sd > 0 THEN (ltp - mean) / sd ELSE 0 END AS z, event_id % 90 + 20 AS n, event_id % 5 / 10.0 AS spread, {IMBALANCE} AS obi, CASE WHEN event_id % 6 > 0 THEN (event_id % 8 - 3) / 4.0 END AS oos, event_id % 3 AS oos_n, event_id % 5 / 4.0 AS wf FROM feat)""")
def m15(t):
    """The note of every tick with its book's imbalance, and whether its price is stretched in the session's window."""
    i = F.col("event_id")
    rows = M.features(booked(t)).select(
        "event_id", "z", (i % 90 + 20).alias("n"), (i % 5 / 10.0).alias("spread_pct"), F.col("imbalance").alias("obi"), F.when(i % 6 > 0, (i % 8 - 3) / 4.0).alias("oos_expectancy"), (i % 3).alias("oos_n"), (i % 5 / 4.0).alias("wf_consistency")
    )
    return rows.select("event_id", M.caveat().alias("note"), (F.abs("z") > 3).alias("stretched"))


@query("m17_enrichment", "ticks", sql="SELECT symbol, CAST(date AS VARCHAR) AS date, adv FROM (SELECT symbol, date, avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS adv0, R6(avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS adv FROM (SELECT symbol, CAST(ts AS DATE) AS date, sum(ltq) AS v FROM ticks GROUP BY 1, 2))")
def m17(t):
    from pyspark.sql.window import Window

    d = t.ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("ltq").alias("v"))
    return d.select("symbol", F.col("date").cast("string").alias("date"), F.avg("v").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-4, 0)).alias("adv"))


# ---------------------------------------------------------------- streaming runs over the same ticks


#: Rows of one file of the stream's source.
FILE_ROWS = 250_000


def stream_source(t, files: int = 4):
    """The ticks as files that arrive one after another in event-time order, to be read as a stream:
    ``files`` or as many more as hold FILE_ROWS each. They are computed once and written side by side by
    ranges of time; the times of the files, which the stream follows, are set in the order of the ranges."""
    return in_time(t, booked(t).select(*[c.split()[0] for c in S.TICKS.split(", ")]), "event_id", files)


def in_time(t, rows, then: str, files: int = 4):
    """The folder of ``rows`` as files in the order of ``ts`` and ``then``."""
    folder = f"{shared_folder(t.spark)}/edgeframe-ticks-{uuid.uuid4().hex}"
    ticks = durable(rows, "all-ticks")
    parts = max(files, -(-ticks.count() // FILE_ROWS))
    ticks.repartitionByRange(parts, "ts", then).sortWithinPartitions("ts", then).write.option("maxRecordsPerFile", 2 * FILE_ROWS).parquet(folder)
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
    # Parts are numbered in the order of their ranges, and the files of a part in the order of its rows.
    found = sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda f: (f.getName().split("-")[1], f.getName().rsplit("-", 1)[1]))
    now = int(time.time() * 1000)
    for i, f in enumerate(found):
        fs.setTimes(f, now - len(found) + i, -1)
    return folder


def tick_stream(t, batches: int = 4):
    """The ticks as a stream of about ``batches`` micro-batches of many files."""
    folder = stream_source(t, batches)
    n = len(t.spark.read.schema(S.TICKS).parquet(folder).inputFiles())
    return S.read_ticks(t.spark, folder, max(1, -(-n // batches)))


def drain(t, df, mode: str = "append"):
    """Runs a stream over all that its source holds and reads what it wrote."""
    folder = f"{shared_folder(t.spark)}/edgeframe-stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(folder)


def drain_batches(t, df, step):
    """Runs a stream through a ``foreachBatch`` step whose sink appends to one table; the table, with each row's epoch."""
    folder = f"{shared_folder(t.spark)}/edgeframe-batches-{uuid.uuid4().hex}"
    sink = lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")  # noqa: E731  an epoch that is run again replaces itself
    run_batches(df, step(sink), f"{folder}-state")
    return t.spark.read.parquet(folder)


def run_batches(df, step, state: str):
    df.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query("m01_stream_features", "ticks", extra=X, sql="SELECT event_id, delta, R6(vwap) AS vwap, R6(mean) AS mean, R6(coalesce(block, 0)) AS block FROM feat")
def m01(t):
    """The streaming processor over the whole tick table; it must agree with the batch twin's SQL."""
    out = drain(t, S.tick_features(tick_stream(t)))
    return out.select("event_id", "delta", "vwap", "mean", "block")


@query("m02_session_gate", "ticks", sql="SELECT symbol, count(*) AS n FROM ticks WHERE hour(ts) * 60 + minute(ts) BETWEEN 555 AND 929 OR (hour(ts) * 60 + minute(ts) = 930 AND floor(second(ts)) = 0) GROUP BY symbol")
def m02(t):
    out = drain(t, S.market_hours(tick_stream(t)))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("m08_stream_rsi")
def m08(t):
    out = drain(t, S.tick_features(tick_stream(t)))
    return out.select("event_id", "rsi", "atr_proxy", "latency_median")


@query("m14_stream_rank", "ticks", extra=X | {"e": EDGES, "s": SNAP}, sql=RANKED)
def m14_stream(t):
    """The snapshot after the last ticks of each symbol, ranked batch by batch from the stream's features."""
    e = durable(edges(t), "edges")
    out = drain_batches(t, S.tick_features(tick_stream(t)), lambda sink: S.rank_each_batch(e, None, sink, f"{shared_folder(t.spark)}/edgeframe-latest-{uuid.uuid4().hex}"))
    last = out.agg(F.max("epoch")).first()[0]
    return out.where(F.col("epoch") == last).select("symbol", "direction", "rank")


FROZEN = "SELECT account_id FROM journal WHERE state = 'Manually_Accepted' GROUP BY account_id HAVING sum(pnl) / 1e6 * 100 <= -50"


@query("m16_freeze", "ticks", "journal", extra={"frozen": FROZEN}, sql="SELECT symbol, count(*) AS shown, count(DISTINCT user_id) AS accounts FROM ticks WHERE user_id NOT IN (SELECT account_id FROM frozen) GROUP BY symbol")
def m16(t):
    """The breaker of every account over its accepted trades; a frozen account's rows of the stream are held back."""
    b = t.journal.where("state = 'Manually_Accepted'").groupBy("account_id").agg(F.coalesce(F.sum("pnl") / 1e6 * 100 <= -50, F.lit(False)).alias("frozen"))
    out = drain_batches(t, tick_stream(t), lambda sink: S.keep_unfrozen(durable(b, "breaker"), sink))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("shown"), F.count_distinct("user_id").alias("accounts"))


#: Trades have dates of other years than the ticks: they are laid over the ticks' time by their number.
TRADE_TIMES = "SELECT min(ts) AS a, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) + 1 AS span FROM ticks"
ACCOUNT_ROWS = """SELECT user_id AS account_id, ts, symbol, CAST(NULL AS DOUBLE) AS pnl FROM ticks
  UNION ALL SELECT account_id, a + to_seconds(id * 7919 % span), NULL, pnl FROM journal, trade_times WHERE state = 'Manually_Accepted' AND pnl IS NOT NULL"""
SO_FAR = "SELECT *, coalesce(sum(CAST(pnl AS DECIMAL(28,4))) OVER (PARTITION BY account_id ORDER BY ts), 0) AS result FROM account_rows"


@query(
    "m16_live_breaker", "ticks", "journal", extra={"trade_times": TRADE_TIMES, "account_rows": ACCOUNT_ROWS, "so_far": SO_FAR},
    sql="SELECT symbol, count(*) AS shown, count(DISTINCT account_id) AS accounts, CAST(min(result) AS DOUBLE) AS lowest FROM so_far WHERE pnl IS NULL AND result > -50000 GROUP BY symbol",
)
def m16_live(t):
    """Ticks and closed trades as one stream by time; an account's rows pass while its result is above the threshold."""
    span = t.ticks.agg(F.min("ts").alias("a"), (F.floor(F.max("ts").cast("double") - F.min("ts").cast("double")) + 1).alias("span"))
    trades = t.journal.where("state = 'Manually_Accepted' AND pnl IS NOT NULL").crossJoin(F.broadcast(span))
    trades = trades.select("account_id", F.expr("a + make_dt_interval(0, 0, 0, id * 7919 % span)").alias("ts"), "id", "pnl", F.lit(None).cast("string").alias("symbol"))
    rows = t.ticks.select(F.col("user_id").alias("account_id"), "ts", F.col("event_id").alias("id"), F.lit(None).cast("double").alias("pnl"), "symbol").unionByName(trades)
    folder = in_time(t, rows, "id")
    found = t.spark.read.parquet(folder)
    stream = t.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", max(1, -(-len(found.inputFiles()) // 4))).parquet(folder)
    out = drain_batches(t, stream, lambda sink: S.live_breaker(sink, f"{shared_folder(t.spark)}/edgeframe-results-{uuid.uuid4().hex}", -50000.0))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("shown"), F.count_distinct("account_id").alias("accounts"), F.min("result").cast("double").alias("lowest"))


#: Tokens move on by one symbol at a tick in the middle of the time; the last symbol's new token is never listed.
TOKENS = {
    "listed": "SELECT symbol, row_number() OVER (ORDER BY symbol) AS r FROM (SELECT DISTINCT symbol FROM ticks)",
    "turn": "SELECT min(ts) AS a, make_timestamp(CAST(floor((epoch(min(ts)) + epoch(max(ts))) / 2) AS BIGINT) * 1000000) AS mid, (SELECT max(r) FROM listed) AS last FROM ticks",
}


@query(
    "m01_token_stream", "ticks", extra=TOKENS,
    sql="SELECT CASE WHEN ts >= mid AND r = last THEN 'unknown' ELSE symbol END AS symbol, CASE WHEN ts >= mid THEN 101 + r ELSE 100 + r END AS token, count(*) AS n, CAST(sum(ltq) AS BIGINT) AS volume FROM ticks JOIN listed USING (symbol), turn GROUP BY 1, 2",
)
def m01_tokens(t):
    """Ticks that carry a token: the mapping's second version is published while the stream runs, and one token is never listed."""
    from pyspark.sql.window import Window

    listed = durable(t.ticks.select("symbol").distinct().withColumn("r", F.row_number().over(Window.orderBy("symbol")).cast("long")), "listed")
    turn = t.ticks.agg(F.min("ts").alias("a"), F.floor((F.min("ts").cast("double") + F.max("ts").cast("double")) / 2).cast("timestamp").alias("mid"))
    a, mid = turn.select(F.unix_micros("a"), F.unix_micros("mid")).first()
    at = lambda us: F.timestamp_micros(F.lit(us).cast("long"))
    ticks = t.ticks.join(listed, "symbol").select((F.col("r") + F.when(F.col("ts") >= at(mid), 101).otherwise(100)).alias("token"), "ts", "event_id", "ltp", "ltq")
    folder, mapping = in_time(t, ticks, "event_id"), f"{shared_folder(t.spark)}/edgeframe-tokens-{uuid.uuid4().hex}"
    listed.select((F.col("r") + 100).alias("token"), "symbol", at(a).alias("valid_from")).write.parquet(f"{mapping}/version=0")
    turned = listed.where(F.col("r") < listed.agg(F.max("r")).first()[0]).select((F.col("r") + 101).alias("token"), "symbol", at(mid).alias("valid_from"))
    second = turned.unionByName(listed.where("r = 1").select((F.col("r") + 100).alias("token"), F.lit(None).cast("string").alias("symbol"), at(mid).alias("valid_from")))
    put = lambda name: lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{folder}-{name}/epoch={epoch}")
    resolve = S.resolve_each_batch(lambda: t.spark.read.parquet(mapping), put("known"), put("unknown"))

    def step(batch, epoch):
        if not batch.where(F.col("ts") >= at(mid)).isEmpty():  # the second version comes with the first batch of its time
            second.write.mode("overwrite").parquet(f"{mapping}/version=1")
        resolve(batch, epoch)

    found = t.spark.read.parquet(folder)
    stream = t.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", max(1, -(-len(found.inputFiles()) // 4))).parquet(folder)
    run_batches(stream, step, f"{folder}-state")
    known, unknown = t.spark.read.parquet(f"{folder}-known"), t.spark.read.parquet(f"{folder}-unknown").withColumn("symbol", F.lit("unknown"))
    return known.unionByName(unknown).groupBy("symbol", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("ltq").alias("volume"))


WINDOWS = "SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS w, arg_min(ltp, ts) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, ts) AS close, CAST(sum(ltq) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2"


@query("m18_stream_bars", "ticks", extra={"windows": WINDOWS}, sql="SELECT symbol, open, high, low, close, volume FROM windows WHERE w + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)")
def m18(t):
    """Five-minute bars by event time with a watermark; windows that it has not passed stay open."""
    return drain(t, S.bars_with_watermark(tick_stream(t))).drop("ts")
