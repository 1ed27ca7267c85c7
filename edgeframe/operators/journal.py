"""Trade journal: events to latest state, metrics, curve, calibration, governor, breaker, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tradestats import profit_factor



def by_exit() -> list[Column]:
    return [F.asc_nulls_last("exit_date"), F.asc("id")]


def latest_state(events: DataFrame) -> DataFrame:
    """Events (id, seq, kind, ...) to current rows: the last event of each id, deletes and a later clear drop it."""
    cleared = events.where("kind = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__c"))
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    last = events.where("kind <> 'clear'").withColumn("__n", F.row_number().over(w)).where("__n = 1 AND kind <> 'delete'").drop("__n")
    return last.crossJoin(F.broadcast(cleared)).where("seq > __c").drop("__c")  # one row


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``'s keys replaced; others untouched."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: added, replaced, total."""
    j = new.select(*keys).distinct().join(old.select(*keys, F.lit(True).alias("__o")).distinct(), keys, "full").join(new.select(*keys, F.lit(True).alias("__n")).distinct(), keys, "left")
    return j.agg(F.sum((F.col("__o").isNull()).cast("long")).alias("added"), F.sum((F.col("__o") & F.col("__n")).cast("long")).alias("replaced"), F.count(F.lit(1)).alias("total"))


def slippage(direction: Column, intended: Column, actual: Column) -> Column:
    return F.when(direction == "BUY", actual - intended).otherwise(intended - actual)


def pnl(direction: Column, entry: Column, exit_: Column, qty: Column) -> Column:
    return F.when(direction == "BUY", exit_ - entry).otherwise(entry - exit_) * qty


def curve(journal: DataFrame, by: list[str]) -> DataFrame:
    """Closed trades in exit order (null last), position, cumulative result and label."""
    w = Window.partitionBy(*by).orderBy(*by_exit())
    c = journal.where("pnl IS NOT NULL").withColumn("pos", F.row_number().over(w))
    c = c.withColumn("equity", F.sum(F.col("pnl").cast("decimal(20,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    return c.withColumn("label", F.coalesce(F.col("exit_date").cast("string"), F.col("pos").cast("string")))


def metrics(journal: DataFrame, by: list[str]) -> DataFrame:
    """Closed-trade metrics; here a loss is a result below zero and the profit factor has no cap."""
    c = curve(journal, by)
    peak = F.greatest(F.max("equity").over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    c = c.withColumn("dd", peak - F.col("equity"))
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    sd = F.stddev_samp("pnl")
    return c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), (F.avg((F.col("pnl") > 0).cast("double")) * 100).alias("win_pct"), profit_factor(win, loss, None).alias("profit_factor"),
        F.coalesce(F.try_divide(F.avg("pnl"), sd), F.lit(0.0)).alias("sharpe"), F.max("dd").alias("max_drawdown"), F.sum(F.col("pnl").cast("decimal(20,2)")).cast("double").alias("total"),
    )


def group_results(journal: DataFrame, by: str) -> DataFrame:
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    return journal.where("pnl IS NOT NULL").groupBy(by).agg(F.count(F.lit(1)).alias("trades"), (F.avg((F.col("pnl") > 0).cast("double")) * 100).alias("win_pct"), profit_factor(win, loss, None).alias("profit_factor"), F.sum("pnl").alias("pnl"))


def breaker(journal: DataFrame, marks: DataFrame, pool: float, limit_pct: float = -2.0) -> DataFrame:
    """Per account: realised result of accepted trades plus open ones at their mark; frozen at the limit."""
    j = journal.where("state = 'Manually_Accepted'").join(marks, "symbol", "left")
    open_ = pnl(F.col("direction"), F.col("entry"), F.coalesce("mark", "entry"), F.col("qty"))
    per = j.groupBy("account_id").agg(F.sum(F.coalesce(F.col("pnl"), open_)).alias("result"))
    return per.withColumn("pct", F.col("result") / pool * 100).withColumn("frozen", F.col("pct") <= limit_pct)


def governor(journal: DataFrame, by: list[str], trades: int = 5, losses: int = 3, loss_pct: float = 2.0, pool: float = 1e7) -> DataFrame:
    """Per ``by`` and day: accepted trades opened or closed that day (open ones count), wins, losses, the run of losses that
    ends the day's closed trades in the order of exits, the day's result; closed, caution or open, with the reasons."""
    j = journal.where("state = 'Manually_Accepted'").withColumn("day", F.explode(F.array_distinct(F.array_compact(F.array("entry_date", "exit_date")))))
    key, closed = [*by, "day"], F.col("pnl").isNotNull()
    back = Window.partitionBy(*key).orderBy(F.desc_nulls_last("exit_date"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__w", F.sum((F.col("pnl") >= 0).cast("int")).over(back))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    per = j.groupBy(*key).agg(
        F.count(F.lit(1)).alias("trades"), count(F.col("pnl") > 0).alias("wins"), count(F.col("pnl") < 0).alias("losses"),
        count(closed & (F.coalesce("__w", F.lit(0)) == 0)).alias("loss_run"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("result"),
    )
    cap, n, run, result = -max(pool, 0.0) * max(loss_pct, 0.0) / 100, F.col("trades"), F.col("loss_run"), F.col("result")
    limits = [
        ("daily loss", F.lit(cap < 0) & (result <= cap), F.lit(cap < 0) & (result <= 0.7 * cap)),
        ("trades", F.lit(trades > 0) & (n >= trades), F.lit(trades > 0) & (n + 1 >= trades)),
        ("loss run", F.lit(losses > 0) & (run >= losses), F.lit(losses > 0) & (run + 1 >= losses) & (run > 0)),
    ]
    why = F.concat_ws(", ", *[F.when(hit, name).when(near, f"near {name}") for name, hit, near in limits])
    any_of = lambda i: limits[0][i] | limits[1][i] | limits[2][i]
    return per.withColumn("reasons", why).withColumn("verdict", F.when(any_of(1), "closed").when(any_of(2), "caution").otherwise("open"))


def calibration(journal: DataFrame, edges: DataFrame) -> DataFrame:
    """Predicted win rate (the trade's own strategy, else the best edge of its side) against what happened, by bucket."""
    c = journal.where("pnl IS NOT NULL").select("id", "symbol", "strategy", "direction", "pnl")
    exact = edges.select("symbol", "strategy", "direction", F.col("win_pct").alias("p1"))
    best = edges.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "direction").orderBy(F.desc("expectancy"), "strategy"))).where("n = 1").select("symbol", "direction", F.col("win_pct").alias("p2"))
    j = c.join(exact, ["symbol", "strategy", "direction"], "left").join(best, ["symbol", "direction"], "left").withColumn("predicted", F.coalesce("p1", "p2")).where("predicted IS NOT NULL")
    bucket = F.when(F.col("predicted") < 55, "<55").when(F.col("predicted") < 65, "55-65").when(F.col("predicted") < 75, "65-75").otherwise(">=75")
    per = j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("trades"), F.avg("predicted").alias("predicted"), (F.avg((F.col("pnl") > 0).cast("double")) * 100).alias("realised"))
    return per.withColumn("gap", F.col("realised") - F.col("predicted"))


# The family of breakouts with momentum.
MOMENTUM = ["gap_and_go", "rvol_breakout", "donchian_breakout", "orb_15m"]


def style_validation(edges: DataFrame, caps: DataFrame, cap_limit: float = 20_000.0, top: int = 8) -> DataFrame:
    """One row: does long momentum hold in small caps (symbols with a cap above 0 and up to ``cap_limit``)? The universe, names
    with an edge among the eligible ``edges``, their share, edges, medians (0 without edges), the best edges and a verdict."""
    small = caps.where((F.col("cap_crore") > 0) & (F.col("cap_crore") <= cap_limit))
    j = edges.where("direction = 'BUY'").where(F.col("strategy").isin(MOMENTUM)).join(small, "symbol")
    median = lambda c: F.coalesce(F.median(c), F.lit(0.0)).alias(f"median_{c}")
    per = j.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("symbol").alias("names"), median("expectancy"), median("profit_factor"), median("win_pct"))
    line = F.concat_ws(" ", F.col("symbol").cast("string"), "strategy")
    # a fixed number of rows reaches the list
    best = j.orderBy(F.round("expectancy", 9).desc(), "symbol", "strategy").limit(top).select(F.struct((-F.round("expectancy", 9)).alias("o"), "symbol", "strategy").alias("k"), line.alias("line"))
    named = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), ", ").alias("top"))
    out = small.agg(F.count(F.lit(1)).alias("universe")).crossJoin(per).crossJoin(named)  # one row each
    share = F.coalesce(F.try_divide(F.col("names").cast("double"), F.col("universe")), F.lit(0.0))
    out = out.withColumn("coverage", share)
    return out.withColumn("verdict", F.when(F.col("universe") == 0, "unavailable").when(F.col("edges") == 0, "no edge").when(F.col("coverage") < 0.05, "thin, name-specific").otherwise("name-specific"))
