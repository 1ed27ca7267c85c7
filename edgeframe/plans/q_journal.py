"""Registered queries of the trade journal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import context as X
from ..operators import journal as L
from .registry import query

ACC = ["account_id"]
CLOSED = "SELECT *, row_number() OVER w AS pos, CAST(sum(CAST(pnl AS DECIMAL(20,2))) OVER w AS DOUBLE) AS equity FROM journal WHERE pnl IS NOT NULL WINDOW w AS (PARTITION BY account_id ORDER BY exit_date NULLS LAST, id)"
DD = "SELECT *, greatest(max(equity) OVER (PARTITION BY account_id ORDER BY pos), 0) - equity AS dd FROM closed"
PF = "CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) WHEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) > 0 THEN 99 ELSE 0 END"


def adv(t, k):
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return t.daily.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("symbol").agg(F.avg("volume").alias("adv"))


@query("l01_metrics", "journal", extra={"closed": CLOSED, "d": DD}, sql=f"SELECT account_id, count(*) AS trades, R6(avg(CAST(pnl > 0 AS DOUBLE)) * 100) AS win_pct, R6({PF}) AS profit_factor, R6(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0)) AS sharpe, R6(max(dd)) AS max_drawdown, R6(CAST(sum(CAST(pnl AS DECIMAL(20,2))) AS DOUBLE)) AS total FROM d GROUP BY account_id")
def l01(t):
    return L.metrics(t.journal, ACC)


@query("l02_equity_curve", "journal", extra={"closed": CLOSED}, sql="SELECT account_id, id, pos, R6(equity) AS equity, coalesce(CAST(exit_date AS VARCHAR), CAST(pos AS VARCHAR)) AS label FROM closed")
def l02(t):
    return L.curve(t.journal, ACC).select("account_id", "id", "pos", "equity", "label")


@query("l03_slippage_pnl", "journal", sql="SELECT id, R6(CASE WHEN direction = 'BUY' THEN entry * 1.001 - entry ELSE entry - entry * 1.001 END) AS slippage, R6(CASE WHEN direction = 'BUY' THEN entry * 1.02 - entry * 1.001 ELSE entry * 1.001 - entry * 1.02 END * qty) AS pnl FROM journal")
def l03(t):
    e, actual = F.col("entry"), F.col("entry") * 1.001
    return t.journal.select("id", L.slippage(F.col("direction"), e, actual).alias("slippage"), L.pnl(F.col("direction"), actual, e * 1.02, F.col("qty")).alias("pnl"))


@query("l04_breaker", "journal", extra={"marks": "SELECT symbol, avg(entry) AS mark FROM journal GROUP BY symbol", "b": "SELECT account_id, sum(coalesce(pnl, (CASE WHEN direction = 'BUY' THEN mark - entry ELSE entry - mark END) * qty)) / 1e6 * 100 AS pct FROM journal JOIN marks USING (symbol) WHERE state = 'Manually_Accepted' GROUP BY account_id"}, sql="SELECT account_id, R6(pct) AS pct, pct <= -2 AS frozen FROM b")
def l04(t):
    marks = t.journal.groupBy("symbol").agg(F.avg("entry").alias("mark"))
    return L.breaker(t.journal, marks, 1e6).drop("result")


X_DAYS = {
    "d": "SELECT * FROM (SELECT *, unnest(list_distinct([entry_date, exit_date])) AS day FROM journal WHERE state = 'Manually_Accepted') WHERE day IS NOT NULL",
    "w": "SELECT *, coalesce(sum(CAST(pnl >= 0 AS INT)) OVER (PARTITION BY account_id, day ORDER BY exit_date DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING), 0) AS w FROM d",
    "g": "SELECT account_id, day, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, count(*) FILTER (WHERE pnl IS NOT NULL AND w = 0) AS loss_run, coalesce(sum(pnl), 0) AS result FROM w GROUP BY account_id, day",
}


@query("l05_governor", "journal", extra=X_DAYS, sql="""SELECT account_id, CAST(day AS VARCHAR) AS day, trades, wins, losses, loss_run, R6(result) AS result,
  concat_ws(', ', CASE WHEN result <= -200000 THEN 'daily loss' WHEN result <= -140000 THEN 'near daily loss' END, CASE WHEN trades >= 3 THEN 'trades' WHEN trades >= 2 THEN 'near trades' END, CASE WHEN loss_run >= 2 THEN 'loss run' WHEN loss_run >= 1 THEN 'near loss run' END) AS reasons,
  CASE WHEN result <= -200000 OR trades >= 3 OR loss_run >= 2 THEN 'closed' WHEN result <= -140000 OR trades >= 2 OR loss_run >= 1 THEN 'caution' ELSE 'open' END AS verdict FROM g""")
def l05(t):
    return L.governor(t.journal, ACC, trades=3, losses=2).withColumn("day", F.col("day").cast("string"))


EDG = "SELECT symbol, strategy, direction, avg(CAST(pnl > -50000 AS DOUBLE)) * 100 AS win_pct, avg(pnl) AS expectancy, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0) AS profit_factor FROM journal WHERE pnl IS NOT NULL GROUP BY ALL"


def _edges(t):
    return t.journal.where("pnl IS NOT NULL").groupBy("symbol", "strategy", "direction").agg((F.avg((F.col("pnl") > -50000).cast("double")) * 100).alias("win_pct"), F.avg("pnl").alias("expectancy"), F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))).alias("profit_factor"))


@query("l06_calibration", "journal", extra={"e": EDG, "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY expectancy DESC, strategy) AS n FROM e) WHERE n = 1", "p": "SELECT j.pnl, coalesce(e.win_pct, b.win_pct) AS p FROM journal j LEFT JOIN e USING (symbol, strategy, direction) LEFT JOIN best b ON b.symbol = j.symbol AND b.direction = j.direction WHERE j.pnl IS NOT NULL"},
       sql="SELECT CASE WHEN p < 55 THEN '<55' WHEN p < 65 THEN '55-65' WHEN p < 75 THEN '65-75' ELSE '>=75' END AS bucket, count(*) AS trades, R6(avg(p)) AS predicted, R6(avg(CAST(pnl > 0 AS DOUBLE)) * 100) AS realised, R6(avg(CAST(pnl > 0 AS DOUBLE)) * 100 - avg(p)) AS gap FROM p WHERE p IS NOT NULL GROUP BY 1")
def l06(t):
    return L.calibration(t.journal, _edges(t))


@query("l07_style", "journal", extra={"e": EDG, "small": "SELECT * FROM (SELECT symbol, CASE WHEN symbol < '2' THEN 0.0 WHEN symbol < '4' THEN 20000.0 ELSE 30000.0 END AS cap FROM (SELECT DISTINCT symbol FROM journal)) WHERE cap > 0 AND cap <= 20000", "m": f"SELECT e.* FROM e JOIN small USING (symbol) WHERE direction = 'BUY' AND strategy IN {tuple(L.MOMENTUM)}"},
       sql="""SELECT universe, edges, names, R6(median_expectancy) AS median_expectancy, R6(median_profit_factor) AS median_profit_factor, R6(median_win_pct) AS median_win_pct, R6(coverage) AS coverage, coalesce(top, '') AS top, CASE WHEN universe = 0 THEN 'unavailable' WHEN edges = 0 THEN 'no edge' WHEN coverage < 0.05 THEN 'thin, name-specific' ELSE 'name-specific' END AS verdict FROM (
    SELECT *, coalesce(names * 1.0 / nullif(universe, 0), 0) AS coverage FROM (SELECT (SELECT count(*) FROM small) AS universe, count(*) AS edges, count(DISTINCT symbol) AS names, coalesce(median(expectancy), 0) AS median_expectancy, coalesce(median(profit_factor), 0) AS median_profit_factor, coalesce(median(win_pct), 0) AS median_win_pct FROM m),
    (SELECT string_agg(symbol || ' ' || strategy, ', ' ORDER BY round(expectancy, 9) DESC, symbol, strategy) AS top FROM (SELECT * FROM m ORDER BY round(expectancy, 9) DESC, symbol, strategy LIMIT 8)))""")
def l07(t):
    caps = t.journal.select("symbol").distinct().withColumn("cap_crore", F.when(F.col("symbol") < "2", 0.0).when(F.col("symbol") < "4", 20000.0).otherwise(30000.0))
    return L.style_validation(_edges(t), caps)


def _group(name, by):
    @query(name, "journal", sql=f"SELECT {by}, count(*) AS trades, R6(avg(CAST(pnl > 0 AS DOUBLE)) * 100) AS win_pct, R6({PF}) AS profit_factor, R6(sum(pnl)) AS pnl FROM journal WHERE pnl IS NOT NULL GROUP BY {by}")
    def run(t):
        return L.group_results(t.journal, by)


for _by in ("strategy", "sector", "symbol"):
    _group(f"f08_by_{_by}", _by)


@query("f09_medians", "daily", sql="SELECT symbol, R6(median(close)) AS median_close, R6(median(volume)) AS median_volume FROM daily GROUP BY symbol")
def f09(t):
    return t.daily.groupBy("symbol").agg(F.median("close").alias("median_close"), F.median("volume").alias("median_volume"))


@query("f10_percentiles", "daily", sql="SELECT symbol, R6(quantile_cont(close, 0.05)) AS p05, R6(quantile_cont(close, 0.95)) AS p95 FROM daily GROUP BY symbol")
def f10(t):
    return t.daily.groupBy("symbol").agg(F.percentile("close", 0.05).alias("p05"), F.percentile("close", 0.95).alias("p95"))


@query("f11_adv", "daily", sql="SELECT symbol, R6(avg(volume)) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM daily) WHERE n <= 20 GROUP BY symbol")
def f11(t):
    return adv(t, 20)


@query("f12_median_turnover", "daily", sql="SELECT symbol, R6(median(close * volume)) AS median_turnover FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM daily) WHERE n <= 60 GROUP BY symbol")
def f12(t):
    return X.turnover_median(t.daily).drop("last_close")


@query("f13_distinct_counts", "daily", "symbols", sql="SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT sector) AS sectors, count(DISTINCT date) AS days FROM daily JOIN symbols USING (symbol)")
def f13(t):
    return t.daily.join(t.symbols, "symbol").agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("sector").alias("sectors"), F.count_distinct("date").alias("days"))
