"""Logical tables (bars, daily, ticks, journal, holdings, ...) as DataFrames over a directory of parquet.

Each adapter is a projection or one aggregation of its source tables; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import durable

#: Order of lineitem rows within a day: the table has no unique key.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
#: Prices of events and line items jump without memory; these many are averaged where an operator looks for trends.
TREND_TICKS, STEADY_DAYS = 256, 50
#: Line items (or orders) of one partition where those of a symbol or an account meet.
LINE_ROWS = 250_000
#: Strategy names that the journal adapter deals out.
STRATEGIES = ["vwap_cross", "ema_cross_9_21", "rsi_reversion", "macd_cross", "bollinger_reversion", "supertrend", "orb_15m", "donchian_breakout", "zscore_reversion", "vwap_band_reversion", "cpr_pivot", "gap_and_go", "rvol_breakout"]


def unit_price():
    """Price of one unit to four places."""
    return F.round(F.col("l_extendedprice") / F.col("l_quantity") * 10000.0) / 10000.0


def exact_mean(price: str, w, n: int):
    """Mean of the last ``n`` prices (of at most four places) in the order of ``w``: a difference of exact running sums,
    so that it costs the same for any ``n`` and does not depend on the order of additions."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col(price).cast("decimal(18,4)"))
    before = F.coalesce(F.sum(F.col(price).cast("decimal(18,4)")).over(w.rowsBetween(Window.unboundedPreceding, -n)), F.lit(0))
    return (total.over(run) - before).cast("double") / F.least(F.row_number().over(w), F.lit(n))


class Tables:
    """The logical tables of one directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._timeframes: dict[tuple[int, ...], DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Partitions for the rows of a table: as many as they need, so that a task's share does not grow with the table."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw(name).count() // LINE_ROWS))

    def line_parts(self) -> int:
        return self.parts("lineitem")

    @cached_property
    def trades_only(self) -> DataFrame:
        """The ticks without what runs over a day: symbol, ts, ltp, ltq, event_id, user_id."""
        return self.raw("events").select(
            F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ltp"),
            F.get_json_object("props", "$.k").cast("long").alias("ltq"), "event_id", "user_id",
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """symbol, ts, ltp, ltq, volume_day (running over the day), latency_us, event_id, user_id."""
        e = self.trades_only
        day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "event_id")
        return e.withColumn("volume_day", F.sum("ltq").over(day)).withColumn("latency_us", F.col("event_id") % 997 + F.col("ltq"))

    @cached_property
    def bars(self) -> DataFrame:
        """Hourly OHLCV per symbol with session_date, day_id and bar_idx."""
        from ..operators import bars

        return bars.with_positions(bars.bars_from_ticks(self.ticks, "1 hour").withColumn("tf", F.lit("60min")))

    @cached_property
    def trending(self) -> DataFrame:
        """symbol, ts, ltp, ltq of the ticks with prices that keep a direction for a while: means of the last TREND_TICKS prices."""
        from ..operators import ranges

        return ranges.trailing(self.trades_only.drop("user_id"), ["symbol"], ["ts", "event_id"], TREND_TICKS, lambda rows, w: rows.withColumn("ltp", exact_mean("ltp", w, TREND_TICKS)))

    @cached_property
    def kept_bars(self) -> DataFrame:
        """``bars``, written once for plans that read them several times."""
        return durable(self.bars, "bars")

    @cached_property
    def minutes(self) -> DataFrame:
        """Minute bars of the trending ticks with their session date."""
        from ..operators import bars

        return bars.bars_from_ticks(self.trending, "1 minute").withColumn("session_date", F.to_date("ts"))

    def timeframes(self, *minutes: int) -> DataFrame:
        """Bars of several widths of the trending ticks per symbol, told apart by tf, anchored at the session open; written once."""
        from ..operators import bars

        if minutes not in self._timeframes:
            self._timeframes[minutes] = durable(bars.timeframes(bars.bars_from_ticks(self.trending, "1 minute"), list(minutes)), "timeframes")
        return self._timeframes[minutes]

    @cached_property
    def steady(self) -> DataFrame:
        """The daily table with adj_close as the mean of the last STEADY_DAYS closes."""
        return self.daily.withColumn("adj_close", exact_mean("close", Window.partitionBy("symbol").orderBy("date"), STEADY_DAYS))

    @cached_property
    def daily(self) -> DataFrame:
        """symbol, date, open, high, low, close, adj_close, volume of one supplier's line items."""
        # The rows move once, as they are: days, and all windows of a symbol after them, are found where they then lie.
        raw = self.raw("lineitem").where("l_quantity > 0").select(F.col("l_suppkey").alias("symbol"), "l_shipdate", *LINE_ORDER).repartition(self.line_parts(), "symbol")
        l = raw.select("symbol", F.to_date("l_shipdate").alias("date"), unit_price().alias("price"), F.col("l_quantity").alias("qty"), F.struct(*LINE_ORDER).alias("o"))
        return l.groupBy("symbol", "date").agg(
            F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"),
            F.max_by("price", "o").alias("adj_close"), F.sum("qty").alias("volume"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        """symbol, name, sector, region, market_cap_inr (negative balances have none)."""
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 1e8).alias("market_cap_inr"),
        )

    @cached_property
    def index_daily(self) -> DataFrame:
        """index_name (the region), date, close."""
        # Prices keep four places, so that sums do not depend on the order of rows.
        close = F.sum(F.col("close").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))
        return self.daily.join(self.symbols, "symbol").groupBy(F.col("region").alias("index_name"), "date").agg(close.alias("close"))

    @cached_property
    def journal(self) -> DataFrame:
        """One trade per order: id, symbol, strategy, direction, state, entry_date, exit_date, qty, entry, exit, pnl, sector."""
        o = self.raw("orders")
        names = F.array(*map(F.lit, STRATEGIES))
        closed = F.col("o_orderstatus") != "O"
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"), F.col("o_custkey").alias("account_id"),
            F.element_at(names, (F.col("o_orderkey") % 13 + 1).cast("int")).alias("strategy"),
            F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("direction"),
            F.when(F.col("o_orderkey") % 10 == 9, "Manually_Rejected").otherwise("Manually_Accepted").alias("state"),
            F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int")).alias("entry_date"), F.when(closed, F.to_date("o_orderdate")).alias("exit_date"), (F.col("o_orderkey") % 50 + 1).alias("qty"),
            (F.col("o_totalprice") / 1000).alias("entry"), F.when(closed, F.col("o_totalprice") - 250000).alias("pnl"),
            F.concat(F.lit("SEG"), F.col("o_custkey") % 7).alias("sector"),
        )

    @cached_property
    def holdings(self) -> DataFrame:
        """Statement rows: account_id, symbol, qty, avg_cost, broker, row order key."""
        l, o = self.raw("lineitem").where("l_quantity > 0"), self.raw("orders")
        j = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("account_id"), F.col("l_suppkey").alias("symbol"), F.col("o_orderpriority").alias("broker"), *LINE_ORDER)
        # An account's rows lie together, so that they are merged without moving again.
        return j.repartition(self.line_parts(), "account_id").select("account_id", "symbol", F.col("l_quantity").alias("qty"), unit_price().alias("avg_cost"), "broker", F.struct(*LINE_ORDER).alias("pos"))

    @cached_property
    def headlines(self) -> DataFrame:
        """symbol (the source), doc_id, headline (first line of the text)."""
        return self.raw("documents").select(F.col("source").alias("symbol"), "doc_id", F.substring_index("text", "\n", 1).alias("headline"))

    @cached_property
    def corp_actions(self) -> DataFrame:
        """symbol, date, type, value: every 97th line item is a split of 2 to 5, every 101st a dividend."""
        l = self.raw("lineitem").where("l_quantity > 0")
        kind = F.when(F.col("l_orderkey") % 97 == 0, "split").when(F.col("l_orderkey") % 101 == 0, "dividend")
        rows = l.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), kind.alias("type"), (F.col("l_partkey") % 4 + 2).cast("double").alias("value"))
        return rows.where("type IS NOT NULL").groupBy("symbol", "date", "type").agg(F.max("value").alias("value"))

    @cached_property
    def returns(self) -> DataFrame:
        """symbol (a vector), session, value: one return series per embedding, drawn to the first of each three; fifty names an account."""
        e = self.raw("embeddings").select(F.col("vec_id").alias("symbol"), F.posexplode("embedding").alias("session", "value")).withColumn("value", F.col("value").cast("double"))
        lead = e.where("symbol % 3 = 0").select(F.col("symbol").alias("__lead"), "session", F.col("value").alias("__v"))
        drawn = e.withColumn("__lead", F.col("symbol") - F.col("symbol") % 3).join(lead, ["__lead", "session"])
        return drawn.select("symbol", F.floor(F.col("symbol") / 50).alias("account_id"), "session", (F.col("value") + 1.5 * F.col("__v")).alias("value"))


def timeframe_sql(*minutes: int, open_minute: int = 555) -> str:
    """The bars of ``Tables.timeframes`` as SQL, where symbol and timeframe are one name (``click@15min``)."""
    widths = ", ".join(f"({m})" for m in minutes)
    return f"""SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS day_id, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM (
      SELECT symbol || '@' || m || 'min' AS symbol, make_timestamp((slot * m + {open_minute}) * 60000000) AS ts, CAST(make_timestamp((slot * m + {open_minute}) * 60000000) AS DATE) AS session_date,
        arg_min(ltp, t) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, t) AS close, CAST(sum(ltq) AS DOUBLE) AS volume
      FROM (SELECT symbol, ts AS t, ltp, ltq, m, CAST(floor((floor(epoch(ts) / 60) - {open_minute}) / m) AS BIGINT) AS slot FROM trending CROSS JOIN (VALUES {widths}) v(m)) GROUP BY symbol, m, slot)"""


#: The same tables as SQL common table expressions for an ANSI engine.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ticks": (
        """SELECT event_type AS symbol, ts, value AS ltp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ltq, event_id, user_id,
        CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS volume_day,
        event_id % 997 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS latency_us FROM events""",
        (),
    ),
    "trending": (f"SELECT * REPLACE (CAST(sum(CAST(ltp AS DECIMAL(18,4))) OVER w AS DOUBLE) / count(*) OVER w AS ltp) FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN {TREND_TICKS - 1} PRECEDING AND CURRENT ROW)", ("ticks",)),
    "steady": (f"SELECT * REPLACE (CAST(sum(CAST(close AS DECIMAL(18,4))) OVER w AS DOUBLE) / count(*) OVER w AS adj_close) FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {STEADY_DAYS - 1} PRECEDING AND CURRENT ROW)", ("daily",)),
    "bars": (
        """SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS day_id, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx
        FROM (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(date_trunc('hour', ts) AS DATE) AS session_date, arg_min(ltp, ts) AS open, max(ltp) AS high, min(ltp) AS low,
        arg_max(ltp, ts) AS close, CAST(sum(ltq) AS DOUBLE) AS volume, '60min' AS tf FROM ticks GROUP BY symbol, date_trunc('hour', ts))""",
        ("ticks",),
    ),
    "daily": (
        """SELECT symbol, date, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN a = n THEN price END) AS close,
        max(CASE WHEN a = n THEN price END) AS adj_close, sum(qty) AS volume
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS a, count(*) OVER (PARTITION BY symbol, date) AS n
        FROM (SELECT *, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, round(l_extendedprice / l_quantity * 10000.0) / 10000.0 AS price, l_quantity AS qty FROM lineitem WHERE l_quantity > 0)) GROUP BY symbol, date""",
        (),
    ),
    "symbols": (
        """SELECT s_suppkey AS symbol, s_name AS name, n_name AS sector, r_name AS region, CASE WHEN s_acctbal > 0 THEN s_acctbal * 1e8 END AS market_cap_inr
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        (),
    ),
    "index_daily": ("SELECT region AS index_name, date, CAST(sum(CAST(close AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS close FROM daily JOIN symbols USING (symbol) GROUP BY region, date", ("daily", "symbols")),
    "journal": (
        f"""SELECT o_orderkey AS id, o_orderpriority AS symbol, o_custkey AS account_id, list_extract({STRATEGIES!r}, CAST(o_orderkey % 13 + 1 AS INT)) AS strategy,
        CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction, CASE WHEN o_orderkey % 10 = 9 THEN 'Manually_Rejected' ELSE 'Manually_Accepted' END AS state,
        CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) AS DATE) AS entry_date, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS exit_date, o_orderkey % 50 + 1 AS qty, o_totalprice / 1000 AS entry,
        CASE WHEN o_orderstatus <> 'O' THEN o_totalprice - 250000 END AS pnl, 'SEG' || CAST(o_custkey % 7 AS VARCHAR) AS sector FROM orders""",
        (),
    ),
    "holdings": (
        """SELECT o_custkey AS account_id, l_suppkey AS symbol, l_quantity AS qty, round(l_extendedprice / l_quantity * 10000.0) / 10000.0 AS avg_cost, o_orderpriority AS broker,
        row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0""",
        (),
    ),
    "headlines": ("SELECT source AS symbol, doc_id, split_part(text, chr(10), 1) AS headline FROM documents", ()),
    "corp_actions": (
        """SELECT symbol, date, type, max(value) AS value FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
        CASE WHEN l_orderkey % 97 = 0 THEN 'split' WHEN l_orderkey % 101 = 0 THEN 'dividend' END AS type, CAST(l_partkey % 4 + 2 AS DOUBLE) AS value FROM lineitem WHERE l_quantity > 0)
        WHERE type IS NOT NULL GROUP BY symbol, date, type""",
        (),
    ),
    "vectors": ("SELECT vec_id AS symbol, generate_subscripts(embedding, 1) - 1 AS session, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings", ()),
    "vec_returns": ("SELECT e.symbol, e.symbol // 50 AS account_id, e.session, e.value + 1.5 * l.value AS value FROM vectors e JOIN vectors l ON l.symbol = e.symbol - e.symbol % 3 AND l.session = e.session", ("vectors",)),
}
