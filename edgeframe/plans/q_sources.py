"""Registered queries of scans, ingest and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import journal as L
from ..sources import ingest as A
from ..sources.stage import shared_folder
from .registry import query


def fresh_folder(t, label):
    return f"{shared_folder(t.spark)}/edgeframe-{label}-{uuid.uuid4().hex}"


@query("a01_bar_scan", "bars", sql="SELECT symbol, bar_idx, CAST(session_date AS VARCHAR) AS session_date, day_id FROM bars")
def a01(t):
    """Every symbol and timeframe; a caller's filters on them reach the scan."""
    return t.bars.select("symbol", "bar_idx", F.col("session_date").cast("string").alias("session_date"), "day_id")


@query("a02_universe", "daily", sql="SELECT DISTINCT symbol FROM daily")
def a02(t):
    return A.universe(t.daily)


@query("a03_daily_fallback", "daily", sql="SELECT symbol, CASE WHEN symbol % 3 = 0 THEN 'daily' ELSE '1day' END AS source, count(*) AS n FROM daily GROUP BY ALL")
def a03(t):
    return A.daily_with_fallback(t.daily.where("symbol % 3 = 0"), t.daily).groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("n"))


@query("a04_daily_universe", "daily", sql="SELECT symbol, date_diff('day', DATE '2000-01-01', date) AS day, R6(CASE WHEN isfinite(close * volume) THEN close * volume ELSE 0 END) AS turnover, max(date_diff('day', DATE '2000-01-01', date)) OVER () AS last_day FROM daily WHERE adj_close > 0")
def a04(t):
    return A.daily_universe(t.daily).select("symbol", "day", "turnover", "last_day")


@query("a05_index_tail", "index_daily", sql="SELECT index_name, age, R6(close) AS close FROM (SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY date DESC) - 1 AS age FROM index_daily) WHERE age < 30")
def a05(t):
    return X.index_tail(t.index_daily, 30).select("index_name", "age", "close")


@query("a06_last_actions", "corp_actions", sql="SELECT symbol, CAST(date AS VARCHAR) AS date, type, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, type) AS n FROM corp_actions) WHERE n <= 3")
def a06(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("symbol").orderBy(F.desc("date"), "type")
    return t.corp_actions.withColumn("n", F.row_number().over(w)).where("n <= 3").select("symbol", F.col("date").cast("string").alias("date"), "type", "value")


@query("a07_metadata", "symbols", sql="SELECT symbol, coalesce(sector, 'Unknown') AS sector, R6(coalesce(market_cap_inr / 1e7, 0)) AS cap_crore FROM symbols")
def a07(t):
    return t.symbols.select("symbol", F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.coalesce(F.col("market_cap_inr") / 1e7, F.lit(0.0)).alias("cap_crore"))


@query("a08_fundamentals", sql="SELECT p_brand AS symbol, count(*) AS n, count(CASE WHEN p_size % 5 <> 0 THEN 1 END) AS covered, R6(avg(CASE WHEN p_size % 5 <> 0 THEN p_retailprice END)) AS pe FROM part GROUP BY p_brand")
def a08(t):
    pe = F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    clean = F.when(~F.isnan(pe), pe)
    return t.raw("part").select(F.col("p_brand").alias("symbol"), clean.alias("pe")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("pe").alias("covered"), F.avg("pe").alias("pe"))


@query("a09_surveillance", sql="SELECT CAST(s_nationkey AS VARCHAR) AS file, 'SYM' || s_suppkey AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 'surveillance' ELSE 'GSM ' || s_suppkey % 4 END AS measure FROM supplier")
def a09(t):
    """List lines of one file per nation: files of even nations have a header (columns swapped), the others are positional."""
    s = t.raw("supplier")
    even = F.col("s_nationkey") % 2 == 0
    measure = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("GSM "), F.col("s_suppkey") % 4))
    sym = F.concat(F.lit("sym"), "s_suppkey")
    rows = s.select(F.col("s_nationkey").cast("string").alias("file"), (F.col("s_suppkey") + 1).alias("nth"), F.when(even, F.concat_ws(",", measure, sym)).otherwise(F.concat_ws(",", sym, measure)).alias("line"))
    heads = s.where("s_nationkey % 2 = 0").select(F.col("s_nationkey").cast("string").alias("file"), F.lit(0).cast("long").alias("nth"), F.lit("Stage,Symbol").alias("line")).distinct()
    return A.surveillance(rows.union(heads))


@query("a10_instruments", sql="SELECT p_name AS tradingsymbol, min(p_partkey) AS instrument_token FROM part WHERE p_partkey % 3 <> 0 AND p_size > 5 AND p_brand <> '' AND p_name IN (SELECT p_name FROM part WHERE p_size > 40) GROUP BY p_name")
def a10(t):
    p = t.raw("part")
    rows = p.select(F.col("p_partkey").alias("instrument_token"), F.col("p_partkey").alias("nth"), F.col("p_name").alias("tradingsymbol"), F.when(F.col("p_partkey") % 3 == 0, "BSE").otherwise("NSE").alias("exchange"), F.when(F.col("p_size") > 5, "EQ").otherwise("FUT").alias("instrument_type"))
    return A.instruments(rows, p.where("p_size > 40").select(F.col("p_name").alias("symbol"))).select("tradingsymbol", "instrument_token")


def statement_files(t, kind):
    """One CSV statement per account, in one of three layouts, from the journal."""
    j = t.journal.where("pnl IS NOT NULL")
    if kind == "trades":
        line = F.format_string("%s,%s,%d,%.2f,%.2f,%s", F.concat(F.lit("S"), F.col("id") % 40), "direction", "qty", "entry", F.col("entry") + 1, F.col("exit_date").cast("string"))
        head = "Symbol,Side,Qty,Entry Price,Exit Price,Trade Date"
    else:
        # Rounded as the SQL rounds: the text of a double that ends in half a cent may fall to the other side.
        line = F.format_string("%s;%d;%.2f", F.concat(F.lit("S"), F.col("id") % 40), "qty", F.round(F.col("entry") * F.col("qty") * 100.0) / 100.0)
        head = "Stock;Quantity;Buy Value"
    # Parsing costs far more than its bytes tell: tasks are cut by rows, and Spark does not merge them by size.
    lines = j.select("account_id", line.alias("line")).repartition(t.parts("orders"), "account_id")
    body = lines.groupBy("account_id").agg(F.concat_ws("\n", F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text"))
    return body.select(F.concat(F.lit("acc"), "account_id").alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("a11_holdings_statements", "journal", sql="SELECT 'acc' || account_id AS path, count(*) AS n, R6(sum(qty)) AS qty, R6(sum(round(entry * qty, 2))) AS value FROM journal WHERE pnl IS NOT NULL GROUP BY account_id")
def a11(t):
    rows = A.statements(statement_files(t, "holdings"), "holdings").where("warning IS NULL")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum(F.round(F.col("qty") * F.col("avg_cost"), 2)).alias("value"))


@query("a12_trade_statements", "journal", sql="SELECT 'acc' || account_id AS path, count(*) AS n, R6(sum(qty)) AS qty, min(CAST(exit_date AS VARCHAR)) AS first_day, count(*) FILTER (WHERE direction = 'SELL') AS sells FROM journal WHERE pnl IS NOT NULL GROUP BY account_id")
def a12(t):
    rows = A.statements(statement_files(t, "trades"), "trades").where("warning IS NULL")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.min("day").alias("first_day"), F.sum((F.col("side") == "SELL").cast("long")).alias("sells"))


def imported(t):
    return t.journal.where("pnl IS NOT NULL").select("id", "symbol", F.col("direction").alias("side"), F.col("qty").cast("double").alias("qty"), F.col("entry"), (F.col("entry") + 1).alias("exit"), F.when(F.col("id") % 2 == 0, F.col("pnl")).alias("pnl"), F.when(F.col("id") % 3 == 0, F.col("entry") * 0.99).alias("order_price"), F.col("exit_date").cast("string").alias("day"))


@query("a13_closed_rows", "journal", sql="SELECT id, R6(CASE WHEN id % 2 = 0 THEN pnl ELSE qty * ((entry + 1) - entry) * CASE WHEN direction = 'BUY' THEN 1 ELSE -1 END END) AS pnl, R6(CASE WHEN id % 3 = 0 THEN (entry - entry * 0.99) * CASE WHEN direction = 'BUY' THEN 1 ELSE -1 END END) AS slippage FROM journal WHERE pnl IS NOT NULL")
def a13(t):
    return A.closed_rows(imported(t)).select("id", "pnl", "slippage")


@query("a14_import_dedup", "journal", sql="SELECT count(*) AS n FROM (SELECT DISTINCT symbol, direction, qty, CAST(round(pnl * 100) AS BIGINT) AS paise, exit_date FROM journal WHERE pnl IS NOT NULL EXCEPT SELECT symbol, direction, qty, CAST(round(pnl * 100) AS BIGINT), exit_date FROM journal WHERE pnl IS NOT NULL AND id % 10 = 0)")
def a14(t):
    rows = imported(t).drop("pnl").join(t.journal.select("id", "pnl"), "id")
    return A.new_imports(rows.union(rows), rows.where("id % 10 = 0")).agg(F.count(F.lit(1)).alias("n"))


@query("a15_fundamentals_flatten", sql="SELECT p_partkey AS symbol, R6(CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN p_retailprice + 1 END) AS pe FROM part WHERE p_size % 3 <> 2")
def a15(t):
    m = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("P/E"), F.col("p_retailprice"))).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("pe ratio"), F.col("p_retailprice") + 1)).otherwise(F.create_map(F.lit("other"), F.col("p_retailprice")))
    return A.flatten_metrics(t.raw("part").select(F.col("p_partkey").alias("symbol"), m.alias("metrics")), {"pe": ["pe", "peratio"]})


@query("a16_upsert", "symbols", sql="SELECT symbol, CASE WHEN symbol % 5 = 0 THEN 'new' ELSE sector END AS sector FROM symbols WHERE symbol % 7 <> 3 OR symbol % 5 = 0")
def a16(t):
    old = t.symbols.where("symbol % 7 <> 3").select("symbol", "sector")
    return L.upsert(old, t.symbols.where("symbol % 5 = 0").select("symbol", F.lit("new").alias("sector")), ["symbol"])


@query("a16_upsert_counts", "symbols", sql="SELECT count(*) FILTER (WHERE symbol % 7 = 3 AND symbol % 5 = 0) AS added, count(*) FILTER (WHERE symbol % 7 <> 3 AND symbol % 5 = 0) AS replaced, count(*) FILTER (WHERE symbol % 7 <> 3 OR symbol % 5 = 0) AS total FROM symbols")
def a16b(t):
    return L.upsert_counts(t.symbols.where("symbol % 7 <> 3"), t.symbols.where("symbol % 5 = 0"), ["symbol"])


@query(
    "a17_merge_metadata", "symbols",
    extra={"j": "SELECT symbol, CASE WHEN symbol % 2 = 0 THEN name || '!' WHEN symbol % 3 = 0 THEN name || '?' WHEN symbol % 5 = 0 THEN name END AS nm, CASE WHEN symbol % 4 = 0 THEN 'fresh' WHEN symbol % 3 = 0 THEN 'prior' WHEN symbol % 5 = 0 THEN sector END AS sc, CASE WHEN symbol % 3 = 0 THEN CAST(symbol // 3 + 1 AS INT) END AS rank FROM symbols WHERE symbol % 2 = 0 OR symbol % 3 = 0 OR symbol % 5 = 0"},
    sql="SELECT symbol, nm AS name, coalesce(sc, 'Unknown') AS sector, CAST(coalesce(rank, (SELECT max(rank) FROM j) + row_number() OVER (PARTITION BY rank IS NULL ORDER BY symbol)) AS INT) AS rank FROM j",
)
def a17(t):
    s = t.symbols
    fresh = s.where("symbol % 2 = 0").select("symbol", F.concat("name", F.lit("!")).alias("name"), F.when(F.col("symbol") % 4 == 0, "fresh").alias("sector"))
    prior = s.where("symbol % 3 = 0").select("symbol", F.concat("name", F.lit("?")).alias("name"), F.lit("prior").alias("sector"), F.expr("CAST(symbol div 3 + 1 AS INT)").alias("rank"))
    return A.merge_metadata(fresh, prior, s.where("symbol % 5 = 0").select("symbol", "name", "sector"))


@query("a18_headline_feed", "headlines", sql="SELECT doc_id AS symbol, headline AS headlines, R6(doc_id % 9) AS pct_change FROM headlines")
def a18(t):
    h = t.headlines.withColumn("json", F.to_json(F.struct(F.array(F.concat(F.lit("<b>"), "headline", F.lit("</b>"))).alias("headlines"), F.concat(F.col("doc_id") % 9, F.lit("%")).alias("percentChange"))))
    return A.headlines(h.select(F.col("doc_id").alias("symbol"), "json")).select("symbol", F.trim(F.col("headlines")[0]).alias("headlines"), "pct_change")


def edge_rows(t):
    return t.journal.where("pnl IS NOT NULL").groupBy(F.concat("symbol", F.col("account_id") % 20).alias("symbol"), "strategy", F.when(F.col("id") % 2 == 0, "30min").otherwise("60min").alias("tf")).agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("expectancy")).withColumn("eligible", (F.col("n") >= 5) & (F.col("expectancy") > 0))


ER = "SELECT symbol || CAST(account_id % 20 AS VARCHAR) AS symbol, strategy, CASE WHEN id % 2 = 0 THEN '30min' ELSE '60min' END AS tf, count(*) AS n, avg(pnl) AS expectancy, count(*) >= 5 AND avg(pnl) > 0 AS eligible FROM journal WHERE pnl IS NOT NULL GROUP BY 1, 2, 3"


@query("a19_edge_map_sink", "journal", extra={"er": ER}, sql="SELECT symbol, strategy, tf, n, R6(expectancy) AS expectancy, eligible FROM er")
def a19(t):
    """Written by timeframe, one timeframe written again, read back."""
    path, e = fresh_folder(t, "edges"), edge_rows(t)
    A.write_edges(e, path)
    A.write_edges(e.where("tf = '30min'"), path)
    return t.spark.read.parquet(path).select("symbol", "strategy", F.col("tf").cast("string").alias("tf"), "n", "expectancy", "eligible")


@query("a20_edge_freshness", "journal", extra={"er": ER}, sql="SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT CASE WHEN eligible THEN symbol END) AS eligible_symbols, CAST(sum(CAST(eligible AS INT)) AS BIGINT) AS eligible_edges, count(*) AS edges FROM er")
def a20(t):
    return A.edge_freshness(edge_rows(t))


@query("a21_freshness_status", "daily", sql="SELECT symbol, symbol % 4 = 0 AS is_new, symbol % 4 <> 0 AND max(date) > DATE '2001-06-01' AS has_newer FROM daily GROUP BY symbol")
def a21(t):
    """Symbols without an edge map, and symbols whose bars are newer than its build."""
    built = t.daily.select("symbol").distinct().where("symbol % 4 <> 0").withColumn("built", F.lit("2001-06-01").cast("date"))
    j = t.daily.groupBy("symbol").agg(F.max("date").alias("last")).join(built, "symbol", "left")
    return j.select("symbol", F.col("built").isNull().alias("is_new"), F.coalesce(F.col("last") > F.col("built"), F.lit(False)).alias("has_newer"))


@query("a22_archive_freshness", "bars", sql="SELECT symbol, CAST(max(session_date) AS VARCHAR) AS last_session, CAST(date_diff('day', max(session_date), DATE '2024-02-02') AS INT) AS days_behind, max(session_date) >= DATE '2024-02-02' AS fresh FROM bars GROUP BY symbol")
def a22(t):
    """As of a Monday morning the expected session is the Friday before."""
    return A.freshness(t.bars, F.lit("2024-02-05 09:00:00").cast("timestamp"))


@query("a23_journal_events", "journal", sql="SELECT id, CASE WHEN id % 3 = 0 THEN 'done' ELSE 'open' END AS state FROM journal WHERE id % 11 <> 0")
def a23(t):
    """Inserts, updates of every third trade and deletes of every eleventh, folded to the latest state."""
    j = t.journal.select("id")
    events = j.select("id", (F.col("id") * 4).alias("seq"), F.lit("insert").alias("kind"), F.lit("open").alias("state"))
    events = events.union(j.where("id % 3 = 0").select("id", F.col("id") * 4 + 1, F.lit("update"), F.lit("done"))).union(j.where("id % 11 = 0").select("id", F.col("id") * 4 + 2, F.lit("delete"), F.lit(None).cast("string")))
    return L.latest_state(events).select("id", "state")


@query("a24_csv_export", "journal", sql="SELECT CAST(id AS VARCHAR) AS id, symbol, CASE WHEN exit_date IS NOT NULL THEN CAST(exit_date AS VARCHAR) END AS exit_date FROM journal")
def a24(t):
    path = fresh_folder(t, "csv")
    A.export_journal(t.journal.select("id", "symbol", "exit_date"), path)
    return t.spark.read.csv(path, header=True)


@query("a25_symbol_code", sql="SELECT valid, count(*) AS n FROM (SELECT regexp_full_match(p_name, '[A-Za-z0-9&-]{1,24}') AS valid FROM part UNION ALL SELECT regexp_full_match(p_type, '[A-Za-z0-9&-]{1,24}') FROM part) GROUP BY valid")
def a25(t):
    p = t.raw("part")
    return p.select(A.valid_symbol(F.col("p_name")).alias("valid")).union(p.select(A.valid_symbol(F.col("p_type")))).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))
