"""Registered queries of market context and daily scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as X
from ..sources import ingest as A
from . import pipelines as P
from .q_bars import MOVES, X_AREA, ema_sql, rma_sql
from .registry import query

BREADTH = "SELECT coalesce(sum(CAST(close > prev AS BIGINT)), 0) AS advances, coalesce(sum(CAST(close < prev AS BIGINT)), 0) AS declines, count(*) AS symbols FROM (SELECT symbol, close, row_number() OVER w AS n, lead(close) OVER w AS prev FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY date DESC)) WHERE n = 1 AND prev IS NOT NULL"
ADV = "CAST(advances AS BIGINT) AS advances, CAST(declines AS BIGINT) AS declines, symbols"


X_BASE = {"moves": MOVES, "rma14": rma_sql("tr")} | X_AREA | {
    "years": "SELECT symbol, max(high) AS high_52w, min(low) AS low_52w FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) AS n FROM bars) WHERE n <= 252 GROUP BY symbol",
    "atrs": "SELECT symbol, arg_max(e, bar_idx) AS atr FROM rma14 GROUP BY symbol",
}


@query(
    "i01_baseline", "bars", extra=X_BASE,
    sql="""SELECT b.symbol, last_close, bars, R6(atr) AS atr, high_52w, low_52w, R6(poc) AS poc, R6(vah) AS vah, R6(val) AS val, CASE WHEN atr IS NULL THEN 'too few bars for ATR' WHEN poc IS NULL THEN 'no volume profile' END AS failure
    FROM (SELECT symbol, arg_max(close, bar_idx) AS last_close, count(*) AS bars FROM bars GROUP BY symbol) b LEFT JOIN atrs a USING (symbol) LEFT JOIN years y USING (symbol) LEFT JOIN area v USING (symbol)""",
)
def i01(t):
    return P.baseline(t.bars)


X_SWING = {
    "days": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS bar_idx, CASE WHEN avg(volume) OVER u > 0 THEN volume / avg(volume) OVER u ELSE 0 END AS vol_ratio, max(high) OVER p AS prior_high FROM daily WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    "moves": MOVES.replace("FROM bars", "FROM days"), "rma14": rma_sql("tr"), "e200": ema_sql("days", "close", 200, 0),
    "years": "SELECT symbol, max(high) AS high_52w, min(low) AS low_52w FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM daily) WHERE n <= 252 GROUP BY symbol",
    "last": "SELECT symbol, count(*) AS bars, arg_max(close, date) AS close, arg_max(vol_ratio, date) AS vol_ratio, arg_max(prior_high, date) AS prior_high FROM days GROUP BY symbol",
    "setups": """SELECT *, abs(close - ema200) / ema200 AS dist, CASE WHEN vol_ratio >= 2.5 AND close > prior_high THEN 'volume_delivery_breakout' WHEN abs(close - ema200) / ema200 <= 0.03 AND close >= 0.97 * ema200 THEN 'mean_reversion_200ema' END AS setup
      FROM last JOIN (SELECT symbol, arg_max(e, bar_idx) AS ema200 FROM e200 GROUP BY symbol) USING (symbol) JOIN (SELECT symbol, arg_max(e, bar_idx) AS atr FROM rma14 GROUP BY symbol) USING (symbol) JOIN years USING (symbol) WHERE bars >= 220""",
}


@query("i12_swing_scan", "daily", extra=X_SWING, sql="SELECT symbol, setup, 'BUY' AS side, R6(close) AS close, R6(vol_ratio) AS vol_ratio, R6(ema200) AS ema200, R6(atr) AS atr, R6(low_52w) AS support, R6(high_52w) AS resistance, R6(CASE WHEN setup = 'volume_delivery_breakout' THEN vol_ratio ELSE 1 / (1 + dist) END) AS score FROM setups WHERE setup IS NOT NULL")
def i12(t):
    return P.swing_scan(t.daily)


@query("j01_breadth", "daily", sql=f"SELECT {ADV} FROM ({BREADTH.format(src='daily')})")
def j01(t):
    return X.breadth(t.daily)


TAIL = "SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY date DESC) - 1 AS age FROM index_daily"


@query(
    "j02_market_regime", "daily", "index_daily", extra={"b": BREADTH.format(src="daily"), "tail": TAIL, "per": "SELECT index_name, max(CASE WHEN age = 0 THEN close END) AS last, max(CASE WHEN age = 1 THEN close END) AS prev, avg(CASE WHEN age < 20 THEN close END) AS sma20, stddev_pop(close) / avg(close) * 100 AS vol FROM tail WHERE age < 21 GROUP BY index_name",
    "lab": "SELECT *, (last / prev - 1) * 100 AS move_pct, advances * 100.0 / (advances + declines) AS breadth_pct, CASE WHEN last >= sma20 AND last >= prev THEN 'up' WHEN last < sma20 AND last < prev THEN 'down' ELSE 'flat' END AS trend FROM per, b",
    "lab2": "SELECT *, CASE WHEN breadth_pct >= 60 THEN 'broad up' WHEN breadth_pct <= 40 THEN 'broad down' ELSE 'mixed' END AS breadth_band FROM lab"},
    sql="SELECT index_name, R6(move_pct) AS move_pct, trend, CASE WHEN vol < 13 THEN 'calm' WHEN vol < 18 THEN 'normal' WHEN vol < 25 THEN 'elevated' ELSE 'high' END AS vol_band, R6(breadth_pct) AS breadth_pct, breadth_band, CASE WHEN (trend = 'up' AND breadth_band = 'broad down') OR (trend = 'down' AND breadth_band = 'broad up') THEN 'divergent' WHEN trend = 'up' THEN 'long' WHEN trend = 'down' THEN 'short' ELSE 'neutral' END AS bias FROM lab2",
)
def j02(t):
    return X.market_regime(t.index_daily, t.daily)


@query(
    "j03_light_regime", "daily", "index_daily", extra={"firsts": "SELECT * FROM daily WHERE symbol IN (SELECT DISTINCT symbol FROM daily ORDER BY symbol LIMIT 207)", "b": BREADTH.format(src="firsts"), "tail": TAIL,
    "dev": "SELECT index_name, CASE WHEN count(close) = 20 AND avg(close) > 0 THEN max(CASE WHEN age = 0 THEN close END) / avg(close) - 1 END AS d FROM tail WHERE age < 20 GROUP BY index_name"},
    sql="SELECT index_name, CASE WHEN d > 0.001 THEN 'Up' WHEN d < -0.001 THEN 'Down' ELSE 'Flat' END AS direction, CAST(advances AS BIGINT) AS advances, CAST(declines AS BIGINT) AS declines, CASE WHEN advances + declines = 0 THEN 'neutral' WHEN greatest(advances, declines) * 1.0 / (advances + declines) > 0.6 THEN 'narrow' ELSE 'broad' END AS breadth_label FROM dev, b",
)
def j03(t):
    return X.light_regime(t.index_daily, t.daily)


def _ret(src, key, p):
    at = lambda k: f"max(CASE WHEN n = {k} THEN close END)"
    return f"SELECT {key}, " + ", ".join(f"CASE WHEN {at(k)} > 0 THEN ({at(0)} / {at(k)} - 1) * 100 END AS {p}{k}" for k in (1, 5, 20)) + f" FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) - 1 AS n FROM {src}) GROUP BY {key}"


#: A sector's index is its region's; those of one region have none and take the broad one.
BROAD, WITHOUT = "EUROPE", "AFRICA"


@query(
    "j04_sector_strength", "daily", "index_daily", "symbols", extra={"a": _ret("daily", "symbol", "r"), "b": _ret("index_daily", "index_name", "i"), "named": f"SELECT symbol, sector, region = '{WITHOUT}' AS broad_fallback, CASE WHEN region = '{WITHOUT}' THEN '{BROAD}' ELSE region END AS index_name FROM symbols"},
    sql="SELECT symbol, sector, index_name, broad_fallback, R6(r1 - i1) AS rs_1, R6(r5 - i5) AS rs_5, R6(r20 - i20) AS rs_20, CASE WHEN r5 - i5 IS NULL THEN 'unknown' WHEN r5 - i5 >= 1.5 THEN 'leader' WHEN r5 - i5 <= -1.5 THEN 'laggard' ELSE 'in-line' END AS label FROM a JOIN named USING (symbol) LEFT JOIN b USING (index_name)",
)
def j04(t):
    own = t.symbols.where(F.col("region") != WITHOUT).select("sector", F.col("region").alias("index_name")).distinct()
    return X.sector_strength(t.daily, t.symbols, t.index_daily, own, BROAD)


@query(
    "j05_data_quality", "daily", "corp_actions",
    extra={"d": "SELECT *, CASE WHEN prev > 0 AND close > 0 THEN greatest(close / prev, prev / close) END AS jump FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM daily)",
    "base": "SELECT symbol, count(*) AS bars, CAST(sum(CASE WHEN close <= 0 OR high < low OR close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid, min(close) AS min_close, max(jump) AS worst_jump FROM d GROUP BY symbol",
    "worst": "SELECT symbol, CAST(date AS VARCHAR) AS worst_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY jump DESC NULLS LAST, date) AS n FROM d) WHERE n = 1",
    "seen": "SELECT symbol, ex_date, ratio, close / prev AS obs FROM (SELECT d.symbol, c.date AS ex_date, c.value AS ratio, d.close, d.prev, row_number() OVER (PARTITION BY d.symbol, c.date, c.value ORDER BY d.date) AS n FROM corp_actions c JOIN d ON d.symbol = c.symbol AND d.date >= c.date WHERE c.type = 'split' AND c.value >= 1.5) WHERE n = 1",
    "raw": "SELECT symbol, count(*) AS uncorrected FROM seen WHERE obs < 0.85 AND abs(obs * ratio - 1) <= 0.25 GROUP BY symbol"},
    sql="""SELECT symbol, bars, invalid, R6(min_close) AS min_close, R6(greatest(coalesce(worst_jump, 1), 1)) AS worst_jump, CASE WHEN worst_jump > 1 THEN worst_date END AS worst_date, coalesce(uncorrected, 0) AS uncorrected,
    concat_ws('; ', CASE WHEN invalid > 0 THEN 'bad ticks' END, CASE WHEN worst_jump >= 3 THEN 'discontinuity' WHEN worst_jump >= 1.8 THEN 'jump' END, CASE WHEN uncorrected > 0 THEN 'uncorrected split' END, CASE WHEN min_close < 1 THEN 'price under one' END) AS flags,
    CASE WHEN coalesce(uncorrected, 0) > 0 OR invalid > 0 OR worst_jump >= 3 THEN 'unreliable' WHEN worst_jump >= 1.8 OR min_close < 1 THEN 'caution' ELSE 'ok' END AS verdict FROM base JOIN worst USING (symbol) LEFT JOIN raw USING (symbol)""",
)
def j05(t):
    return X.data_quality(t.daily, t.corp_actions)


MED = "SELECT symbol, median(close * volume) AS med, max(CASE WHEN n = 1 THEN close END) AS last_close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM daily) WHERE n <= 60 GROUP BY symbol"
WATCH = "SELECT symbol, CASE WHEN symbol % 14 = 0 THEN 'GSM' ELSE 'ASM' END AS measure FROM symbols WHERE symbol % 7 = 0"
DELIVERY = "SELECT symbol, CASE WHEN symbol % 11 = 0 THEN 'BE' WHEN symbol % 11 = 1 THEN 'BZ' ELSE 'EQ' END AS series FROM symbols WHERE symbol % 11 < 3"


def watch(t):
    return t.symbols.where("symbol % 7 = 0").select("symbol", F.when(F.col("symbol") % 14 == 0, "GSM").otherwise("ASM").alias("measure"))


def delivery(t):
    return t.symbols.where("symbol % 11 < 3").select("symbol", F.when(F.col("symbol") % 11 == 0, "BE").when(F.col("symbol") % 11 == 1, "BZ").otherwise("EQ").alias("series"))


X_TRADE = {"med": MED, "watch": WATCH, "delivery": DELIVERY, "x": """SELECT symbol, coalesce(series, 'EQ') AS series, measure, coalesce(measure <> '', false) AS w, coalesce(series IN ('BE', 'BZ', 'BL'), false) AS t2t,
  CASE WHEN coalesce(med, 0) <= 0 THEN 'unknown' WHEN med / 1e5 >= 50 THEN 'deep' WHEN med / 1e5 >= 5 THEN 'ok' WHEN med / 1e5 >= 1 THEN 'thin' ELSE 'very thin' END AS tier,
  coalesce(last_close > 0 AND last_close < 20, false) AS low_price, coalesce(market_cap_inr > 0 AND market_cap_inr / 1e7 < 500, false) AS micro_cap FROM symbols FULL JOIN med USING (symbol) LEFT JOIN watch USING (symbol) LEFT JOIN delivery USING (symbol)""",
  "y": "SELECT *, CASE WHEN tier = 'thin' THEN 'thin liquidity' END AS a, CASE WHEN low_price THEN 'low-priced' END AS b, CASE WHEN micro_cap THEN 'micro-cap' END AS c FROM x",
  "judged": """SELECT symbol, series, tier, low_price, micro_cap, measure, CASE WHEN w OR t2t THEN 'blocked' WHEN tier = 'very thin' THEN 'high_risk' WHEN tier = 'thin' OR low_price OR micro_cap THEN 'caution' ELSE 'ok' END AS verdict,
  CASE WHEN w THEN 'surveillance: ' || measure WHEN t2t THEN 'trade-to-trade series ' || series WHEN tier = 'very thin' THEN 'very thin liquidity' ELSE concat_ws(' / ', a, b, c) END AS reason,
  concat_ws(' · ', CASE WHEN w THEN 'under ' || measure END, CASE WHEN t2t THEN series || ' series' END, CASE WHEN tier IN ('thin', 'very thin') THEN tier || ' liquidity' END, b, c) AS caption, NOT (w OR t2t) AS intraday_ok FROM y"""}  # fmt: skip


@query("j06_tradability", "daily", "symbols", extra=X_TRADE, sql="SELECT * FROM judged")
def j06(t):
    return X.tradability(t.daily, t.symbols, watch(t), 1e5, delivery(t))


@query("j06_coverage", "daily", "symbols", sql="SELECT count(*) AS symbols, count(market_cap_inr) AS with_cap FROM (SELECT DISTINCT symbol FROM daily) LEFT JOIN symbols USING (symbol)")
def j06b(t):
    return t.daily.select("symbol").distinct().join(t.symbols, "symbol", "left").agg(F.count(F.lit(1)).alias("symbols"), F.count("market_cap_inr").alias("with_cap"))


@query("j07_series", sql="SELECT series, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 1 THEN 'BE' WHEN p_partkey % 5 = 2 THEN 'BZ' WHEN p_partkey % 5 = 3 THEN 'BL' ELSE 'EQ' END AS series FROM part) GROUP BY series")
def j07(t):
    suffix = F.element_at(F.array(*map(F.lit, ["", "-BE", "-BZ", "-BL", "-XX"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.raw("part").select(X.series_of(F.concat("p_brand", suffix)).alias("series")).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


#: The documents are invented prose, so two words of the lexicon, or none, stand before each headline.
LEXICON = [*X.POSITIVE, *X.NEGATIVE]
TOLD = f"SELECT doc_id, symbol, CASE WHEN doc_id % 3 = 0 THEN '' ELSE list_extract({LEXICON!r}, CAST(doc_id % {len(LEXICON)} + 1 AS INT)) || ', ' || list_extract({LEXICON!r}, CAST(doc_id // 7 % {len(LEXICON)} + 1 AS INT)) END || ': ' || headline AS headline FROM headlines"
SENT = f"SELECT doc_id, any_value(symbol) AS symbol, count(*) FILTER (WHERE w IN {tuple(X.POSITIVE)}) AS p, count(*) FILTER (WHERE w IN {tuple(X.NEGATIVE)}) AS n FROM (SELECT doc_id, symbol, unnest(regexp_split_to_array(lower(headline), '[^a-z]+')) AS w FROM told) GROUP BY doc_id"


@query("j08_headline_sentiment", "headlines", extra={"told": TOLD, "s": SENT, "z": "SELECT h.doc_id, h.symbol, CASE WHEN coalesce(p + n, 0) > 0 THEN (p - n) / CAST(p + n AS DOUBLE) ELSE 0 END AS score FROM headlines h LEFT JOIN s USING (doc_id)"}, sql="SELECT doc_id, symbol, R6(score) AS score, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM z")
def j08(t):
    words = F.array(*map(F.lit, LEXICON))
    word = lambda k: F.element_at(words, (F.floor(F.col("doc_id") / k) % len(LEXICON) + 1).cast("int"))
    before = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws(", ", word(1), word(7)))
    return X.headline_sentiment(t.headlines.withColumn("headline", F.concat(before, F.lit(": "), "headline")))


@query("j09_news_contradiction", "journal", sql="""SELECT id, CASE WHEN buy AND (l = 1 OR m <= -2) OR NOT buy AND (l = 2 OR m >= 2) THEN 'cautious' WHEN buy AND (l = 2 OR m >= 2) OR NOT buy AND (l = 1 OR m <= -2) THEN 'aligned' ELSE 'neutral' END AS verdict
  FROM (SELECT id, direction = 'BUY' AS buy, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS l, coalesce(pnl, 0) / 1e5 AS m FROM journal)""")
def j09(t):
    label = F.when(F.col("id") % 4 == 0, "negative").when(F.col("id") % 4 == 1, "positive").otherwise("neutral")
    return t.journal.select("id", X.contradiction(label, F.col("pnl") / 1e5, F.col("direction")).alias("verdict"))


@query(
    "j10_provider_sentiment",
    sql="""SELECT doc_id, provider, CASE WHEN doc_id % 5 > 0 THEN R6(greatest(least(CASE provider WHEN 'marketaux' THEN (x + y + 3) / 3 ELSE (x + y) / 2 END, 1), -1)) END AS sentiment,
      CASE WHEN doc_id % 5 > 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'text ' ELSE 'title ' END || doc_id END AS headline, CASE WHEN doc_id % 5 > 0 THEN coalesce(lang, provider) END AS source
      FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'marketaux' ELSE 'eodhd' END AS provider, (doc_id % 21 - 10) / 5.0 AS x, (length(coalesce(text, '')) % 7 - 3) / 4.0 AS y FROM documents)""",
)
def j10(t):
    """Answers of both providers made of each document's id, length and language, some without articles, then read back."""
    i = F.col("doc_id")
    d = t.raw("documents").select("doc_id", "lang", ((i % 21 - 10) / 5.0).alias("x"), ((F.length(F.coalesce("text", F.lit(""))) % 7 - 3) / 4.0).cast("string").alias("y"))
    title, text = F.when(i % 3 > 0, F.concat(F.lit(" title "), i)).alias("title"), F.concat(F.lit("text "), i, F.lit(" "))
    source = F.col("lang").alias("source")
    aux = F.struct(title, text.alias("description"), source, F.array(*[F.struct(c.cast("string").alias("sentiment_score")) for c in (F.col("x"), F.col("y"), F.lit("n/a"))]).alias("entities"))
    more = F.struct(F.lit("second").alias("title"), F.lit("").alias("description"), F.lit("s").alias("source"), F.array(F.struct(F.lit("3").alias("sentiment_score"))).alias("entities"))
    items = [F.struct(title, text.alias("content"), source, F.struct(c.alias("polarity")).alias("sentiment")) for c in (F.col("x").cast("string"), F.col("y"), F.lit(None).cast("string"))]
    body = F.when(i % 5 == 0, F.when(i % 2 == 0, '{"data": []}').otherwise("[]")).otherwise(F.when(i % 2 == 0, F.to_json(F.struct(F.array(aux, more).alias("data")))).otherwise(F.to_json(F.array(*items))))
    feed = d.select("doc_id", F.when(i % 2 == 0, "marketaux").otherwise("eodhd").alias("provider"), body.alias("body"))
    return A.provider_sentiment(feed).select("doc_id", "provider", "sentiment", "headline", "source")


X_EXIT = {
    "given": """SELECT id, direction AS side, entry, CASE WHEN direction = 'BUY' THEN entry * (1 - (id % 25) / 100.0) ELSE entry * (1 + (id % 25) / 100.0) END AS stop, qty * entry AS notional,
      CASE WHEN id % 4 > 0 THEN CASE WHEN direction = 'BUY' THEN entry * (0.95 - (id % 16) / 100.0) ELSE entry * (1.05 + (id % 16) / 100.0) END END AS band,
      CASE WHEN id % 13 = 0 THEN 'blocked' WHEN id % 11 = 0 THEN 'high_risk' WHEN id % 9 = 0 THEN 'caution' WHEN id % 5 > 0 THEN 'ok' END AS tradability, CASE WHEN id % 6 > 0 THEN (id % 1000 + 50) * 1000.0 END AS turnover FROM journal""",
    "found": "SELECT *, CASE WHEN band > 0 AND entry > 0 THEN abs(entry - band) / entry * 100 END AS room, CASE WHEN band > 0 AND entry > 0 THEN CASE WHEN side = 'BUY' THEN stop > band ELSE stop < band END END AS inside, CASE WHEN turnover > 0 AND notional > 0 THEN notional / turnover * 100 END AS part FROM given",
    "told": "SELECT *, CASE WHEN tradability = 'blocked' THEN 'blocked' WHEN NOT inside THEN 'unreachable_stop' WHEN part > 5 OR tradability IN ('high_risk', 'caution') THEN 'caution' WHEN inside IS NULL THEN 'unknown' ELSE 'ok' END AS v FROM found",
}


@query("j11_exit_reachability", "journal", extra=X_EXIT, sql="SELECT id, R6(room) AS circuit_room_pct, inside AS stop_inside_band, R6(part) AS participation_pct, v AS exit_verdict, CASE v WHEN 'blocked' THEN 'danger' WHEN 'unreachable_stop' THEN 'danger' WHEN 'ok' THEN 'info' ELSE 'warn' END AS severity FROM told")
def j11(t):
    e, i, buy = F.col("entry"), F.col("id"), F.col("direction") == "BUY"
    away = lambda pct: F.when(buy, e * (1 - pct)).otherwise(e * (1 + pct))
    band = F.when(i % 4 > 0, F.when(buy, e * (0.95 - (i % 16) / 100.0)).otherwise(e * (1.05 + (i % 16) / 100.0)))
    named = F.when(i % 13 == 0, "blocked").when(i % 11 == 0, "high_risk").when(i % 9 == 0, "caution").when(i % 5 > 0, "ok")
    rows = t.journal.select(
        "id", F.col("direction").alias("side"), "entry", away((i % 25) / 100.0).alias("stop"), (F.col("qty") * e).alias("notional"), F.when(buy, band).alias("band_low"), F.when(~buy, band).alias("band_high"),
        named.alias("tradability"), F.when(i % 6 > 0, (i % 1000 + 50) * 1000.0).alias("turnover"),
    )
    return X.exit_reachability(rows).select("id", "circuit_room_pct", "stop_inside_band", "participation_pct", "exit_verdict", "severity")


@query("j12_symbol_metadata", "bars", sql="SELECT symbol, string_agg(DISTINCT tf, ',') AS intervals, count(DISTINCT session_date) AS days, CAST(max(session_date) AS VARCHAR) AS last_date, CAST(date_diff('day', max(session_date), DATE '2024-03-01') AS INT) AS age_days FROM bars GROUP BY symbol")
def j12(t):
    return X.symbol_metadata(t.bars, F.lit("2024-03-01").cast("date"))
