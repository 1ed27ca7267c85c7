"""Holdings and portfolio: normalisation, concentration, correlation, clusters, rotation, screens, baskets.

The key is account_id, so every account of a statement table is handled in one plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import durable


def account():
    """The window over one account's rows."""
    return Window.partitionBy("account_id")


def merge_holdings(rows: DataFrame, order: str = "pos", brokers: bool = True) -> DataFrame:
    """One row per (account, symbol): summed quantity, quantity-weighted cost, distinct brokers in first-seen order (or none,
    which leaves out their grouping)."""
    if not brokers:
        return rows.groupBy("account_id", "symbol").agg(F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("avg_cost")) / F.sum("qty")).alias("avg_cost"))
    first = rows.groupBy("account_id", "symbol", "broker").agg(F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("avg_cost")).alias("cost"), F.min(order).alias("o"))
    return first.groupBy("account_id", "symbol").agg(
        F.sum("qty").alias("qty"), (F.sum("cost") / F.sum("qty")).alias("avg_cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "broker"))), lambda x: x["broker"]), "/").alias("broker"),
    )


def mark(holdings: DataFrame, last: DataFrame, stated: str | None = None) -> DataFrame:
    """Adds price: the statement's, else the archive's last close, else cost (flagged)."""
    j = holdings.join(last.select("symbol", F.col("close").alias("__c")), "symbol", "left")
    given = F.col(stated) if stated else F.lit(None).cast("double")
    return j.withColumn("price", F.coalesce(given, "__c", "avg_cost")).withColumn("at_cost", given.isNull() & F.col("__c").isNull()).drop("__c")


def valued(marked: DataFrame) -> DataFrame:
    """Adds value, cost, unrealised, its percentage, weight in percent and rank by value."""
    v = marked.withColumn("value", F.col("qty") * F.col("price")).withColumn("cost", F.col("qty") * F.col("avg_cost"))
    v = v.withColumn("unrealised", F.col("value") - F.col("cost")).withColumn("unrealised_pct", F.try_divide(F.col("unrealised") * 100, "cost"))
    v = v.withColumn("weight", F.coalesce(F.try_divide(F.col("value") * 100, F.sum("value").over(account())), F.lit(0.0)))
    return v.withColumn("rank", F.row_number().over(account().orderBy(F.desc("value"), "symbol")))


def totals(v: DataFrame) -> DataFrame:
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("weight")).otherwise(0.0)).alias(f"top{k}")
    return v.groupBy("account_id").agg(F.count(F.lit(1)).alias("names"), F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.sum("unrealised").alias("unrealised"), top(1), top(3), top(5))


def concentration(v: DataFrame) -> DataFrame:
    h = F.sum(F.col("weight") * F.col("weight"))
    out = v.groupBy("account_id").agg(h.alias("hhi")).withColumn("effective_names", F.try_divide(F.lit(10000.0), F.col("hhi")))
    return out.withColumn("label", F.when(F.col("hhi") >= 2500, "concentrated").when(F.col("hhi") >= 1500, "moderate").otherwise("diversified"))


def exposure(v: DataFrame, by: str) -> DataFrame:
    """Per account and group (no name: Unknown): value, weight, names, unrealised result, heat (high from 40 percent, elevated
    from 20) and the group's place by value."""
    name = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("Unknown")).alias(by)
    e = v.select("account_id", name, "symbol", "value", "weight", "unrealised").groupBy("account_id", by).agg(
        F.sum("value").alias("value"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("names"), F.sum("unrealised").alias("unrealised"), F.sort_array(F.collect_list("symbol")).alias("members")
    )
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.round("value", 6).desc(), by))
    return e.withColumn("heat", F.when(F.col("weight") >= 40, "high").when(F.col("weight") >= 20, "elevated").otherwise("normal")).withColumn("place", place)


def flags(v: DataFrame, edges: DataFrame) -> DataFrame:
    """deep_loss, then concentration, then sector_overweight, then no_edge. ``edges``: symbols with an eligible edge."""
    sector = F.sum("weight").over(Window.partitionBy("account_id", "sector"))
    j = v.join(edges.select("symbol", F.lit(True).alias("__e")), "symbol", "left").withColumn("sector_weight", sector)
    flag = F.when(F.col("unrealised_pct") <= -25, "deep_loss").when(F.col("weight") >= 25, "concentration").when(F.col("sector_weight") >= 40, "sector_overweight").when(F.col("__e").isNull(), "no_edge")
    return j.withColumn("flag", flag).drop("__e")


def kelly_band(win_pct: Column, profit_factor: Column) -> tuple[Column, Column]:
    """A quarter and a half of the Kelly share w * (1 - 1 / pf) in percent, each within 0..5."""
    full = F.when(profit_factor > 0, F.least(F.greatest(win_pct / 100, F.lit(0.0)), F.lit(1.0)) * (1 - 1 / profit_factor) * 100)
    return tuple(F.coalesce(F.least(F.greatest(part * full, F.lit(0.0)), F.lit(5.0)), F.lit(0.0)) for part in (0.25, 0.5))


def sector_clusters(v: DataFrame) -> DataFrame:
    """Known sectors of two names or more that weigh 25 percent together, with their members."""
    e = exposure(v, "sector").where("names >= 2 AND weight >= 25 AND sector <> 'Unknown'")
    return e.select("account_id", "sector", "names", "weight", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


# ---------------------------------------------------------------- correlation


def align(series: DataFrame, least: int = 61, last: int = 504) -> DataFrame:
    """Sessions that all kept names of an account share; names with fewer than ``least`` points drop out."""
    key = Window.partitionBy("account_id", "symbol")
    s = series.withColumn("__n", F.count(F.lit(1)).over(key)).where(F.col("__n") >= least).drop("__n")
    names = s.groupBy("account_id").agg(F.count_distinct("symbol").alias("__all"))
    common = s.groupBy("account_id", "session").agg(F.count_distinct("symbol").alias("__has")).join(names, "account_id").where(F.col("__has") == F.col("__all"))
    common = common.withColumn("__r", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("session")))).where(F.col("__r") <= last)
    return s.join(common.select("account_id", "session"), ["account_id", "session"])


def correlations(series: DataFrame) -> DataFrame:
    """Pairs a <= b of an account's names with their population correlation; no variance gives 0, the diagonal 1.

    An account's names meet on (account, session); pairs are of the names of one account only.
    """
    a = series.select("account_id", "session", F.col("symbol").alias("a"), F.col("value").alias("x"))
    b = series.select("account_id", "session", F.col("symbol").alias("b"), F.col("value").alias("y"))
    p = a.join(b, ["account_id", "session"]).where("a <= b").groupBy("account_id", "a", "b").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    rho = F.coalesce(F.try_divide("c", F.col("sx") * F.col("sy")), F.lit(0.0))
    return p.select("account_id", "a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0))).alias("rho"))


def effective_bets(rho: DataFrame) -> DataFrame:
    """N squared over the sum of squared correlations, and the average off the diagonal."""
    off = F.col("a") != F.col("b")
    per = rho.groupBy("account_id").agg(F.sum((~off).cast("int")).alias("n"), F.sum(F.when(off, 2 * F.col("rho") ** 2).otherwise(1.0)).alias("s"), F.avg(F.when(off, F.col("rho"))).alias("avg_pair"))
    return per.select("account_id", "n", (F.col("n") * F.col("n") / F.col("s")).alias("effective_bets"), "avg_pair")


def linked_clusters(rho: DataFrame, least: float = 0.60, rounds: int = 50) -> DataFrame:
    """account, symbol, cluster: names chained by correlations of at least ``least``, labelled by their smallest name.

    Minimum labels spread over the links and jump to their label's label, so rounds grow with the
    logarithm of a chain. Each round is written to the shared folder.
    """
    link = rho.where((F.col("rho") >= least) & (F.col("a") != F.col("b")))
    link = link.select("account_id", "a", "b").union(link.select("account_id", F.col("b").alias("a"), F.col("a").alias("b")))
    label = rho.where("a = b").select("account_id", F.col("a").alias("symbol"), F.col("a").alias("label"))
    link, label, before = durable(link, "links"), durable(label, "labels"), None
    for _ in range(rounds):
        near = link.join(label.select("account_id", F.col("symbol").alias("b"), F.col("label").alias("other")), ["account_id", "b"]).groupBy("account_id", F.col("a").alias("symbol")).agg(F.min("other").alias("other"))
        now = label.join(near, ["account_id", "symbol"], "left").select("account_id", "symbol", F.least("label", F.coalesce("other", "label")).alias("label"))
        jump = now.select("account_id", F.col("symbol").alias("label"), F.col("label").alias("up"))
        label = durable(now.join(jump, ["account_id", "label"], "left").select("account_id", "symbol", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        sign = label.agg(F.sum(F.xxhash64("account_id", "symbol", "label").cast("decimal(38,0)"))).first()[0]
        if sign == before:
            return label.withColumnRenamed("label", "cluster")
        before = sign
    raise RuntimeError("clusters did not settle")


def cluster_table(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """Clusters of two names or more, members by weight."""
    j = clusters.join(weights.select("account_id", "symbol", "weight"), ["account_id", "symbol"])
    one = F.struct((-F.col("weight")).alias("w"), "symbol")
    per = j.groupBy("account_id", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["symbol"].cast("string")), ",").alias("members"), F.count(F.lit(1)).alias("names"), F.sum("weight").alias("weight"))
    return per.where("names >= 2")


# ---------------------------------------------------------------- rotation


def rotation_signals(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Distance from the 50- and 200-day means, strength against the index, off-high, momentum, trend label."""
    down = Window.partitionBy("symbol").orderBy(F.desc("date"))
    d = daily.select("symbol", "date", F.col("adj_close").alias("x"), F.row_number().over(down).alias("rn"))
    at = lambda n: F.max(F.when(F.col("rn") == n, F.col("x")))
    s = d.where("rn <= 253").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), at(1).alias("last"), F.avg(F.when(F.col("rn") <= 50, F.col("x"))).alias("m50"), F.avg(F.when(F.col("rn") <= 200, F.col("x"))).alias("m200"),
        ((at(1) / at(64) - 1) * 100).alias("ret_63"), ((at(1) / at(127) - 1) * 100).alias("ret_126"), ((at(1) / at(253) - 1) * 100).alias("ret_252"), F.max(F.when(F.col("rn") <= 252, F.col("x"))).alias("top"),
    )
    iw = Window.orderBy(F.desc("date"))
    i = index.groupBy("date").agg((F.sum(F.col("close").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))).alias("close"))
    newest = i.orderBy(F.desc("date")).limit(253).withColumn("rn", F.row_number().over(iw))  # 253 rows
    iat = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    bench = newest.agg(((iat(1) / iat(127) - 1) * 100).alias("i_126"), ((iat(1) / iat(253) - 1) * 100).alias("i_252"))
    s = s.where("bars >= 60").crossJoin(F.broadcast(bench))  # one row
    s = s.withColumn("vs50", (F.col("last") / F.col("m50") - 1) * 100).withColumn("vs200", (F.col("last") / F.col("m200") - 1) * 100)
    s = s.withColumn("rs_6m", F.col("ret_126") - F.col("i_126")).withColumn("rs_12m", F.col("ret_252") - F.col("i_252")).withColumn("off_high", (F.col("last") / F.col("top") - 1) * 100)
    trend = F.when((F.col("vs200") > 0) & (F.col("ret_63") > 0), "uptrend").when((F.col("vs200") < 0) & (F.col("ret_252") < 0) & (F.col("ret_63") < 0), "downtrend").otherwise("sideways")
    return s.select("symbol", "last", "vs50", "vs200", "ret_63", "rs_6m", "rs_12m", "off_high", trend.alias("trend"))


def rotation_bucket(trend: Column, rs12: Column, weight: Column, vs200: Column, excluded: Column) -> Column:
    return (
        F.when(excluded, "Hold*").when((trend == "downtrend") & (rs12 < -15), "Rotate out").when((trend == "uptrend") & F.coalesce(rs12 > 0, F.lit(True)), "Leader")
        .when((weight >= 12) & (vs200 < 0) & (rs12 < 0), "Trim").otherwise("Hold")
    )


def buy_screen(signals: DataFrame, edges: DataFrame, held: DataFrame, k: int = 12, off_high: float = -18.0) -> DataFrame:
    """Per account: symbols it does not hold, above both means, stronger than the index over 6 and 12 months, near their
    high, with a long edge; the strongest over both spans first.

    The candidates are ranked once. An account that holds h of them finds its ``k`` among the first k + h, so it needs the
    places of those that it holds and nothing else of its names.
    """
    ok = signals.where("vs50 > 0 AND vs200 > 0 AND rs_6m > 0 AND rs_12m > 0").where(F.col("off_high") >= off_high).join(edges, "symbol").withColumn("strength", F.round(F.col("rs_12m") + F.col("rs_6m"), 9))
    names = durable(held.select("account_id", "symbol").distinct(), "held")
    most = k + (names.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    first = ok.orderBy(F.desc("strength"), "symbol").limit(most)
    first = durable(first.withColumn("__place", F.row_number().over(Window.orderBy(F.desc("strength"), "symbol"))), "first")  # at most k and one account's names
    places = names.join(F.broadcast(first.select("symbol", "__place")), "symbol", "left").groupBy("account_id").agg(F.collect_set("__place").alias("__held"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.size("__held") + k), F.col("__held")), 1, k)
    met = places.select("account_id", F.posexplode(free).alias("rank", "__place")).join(F.broadcast(first), "__place")
    return met.withColumn("rank", F.col("rank") + 1).drop("__place")


def _sold() -> Column:
    return F.when(F.col("bucket") == "Rotate out", 1.0).when(F.col("bucket") == "Trim", 0.6).otherwise(0.0)


def rebalance_sells(v: DataFrame) -> DataFrame:
    """What an account sells: ``Rotate out`` whole, 60 percent of ``Trim``; shares, cash and gain in whole units."""
    f = _sold()
    return v.where(f > 0).select("account_id", "symbol", "bucket", f.alias("part"), F.round(F.col("qty") * f).cast("long").alias("shares"), F.round(F.col("value") * f).alias("cash"), F.round(F.col("unrealised") * f).alias("gain"))


def rebalance(v: DataFrame, candidates: DataFrame, tax_free: float = 125_000.0, tax_rate: float = 0.125, names: int = 5) -> DataFrame:
    """Per account with something to sell: cash raised, gain, tax, what is left to spend (not below 0), the number of its
    ``candidates`` (account_id, symbol, rank) that share it, at most ``names``, and the share of each."""
    per = rebalance_sells(v).groupBy("account_id").agg(F.sum("cash").alias("cash"), F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("sold"))
    found = candidates.where(F.col("rank") <= names).groupBy("account_id").agg(F.count(F.lit(1)).alias("names"))
    out = per.join(found, "account_id", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    out = out.withColumn("tax", F.greatest(F.col("gain") - tax_free, F.lit(0.0)) * tax_rate)
    out = out.withColumn("to_spend", F.greatest(F.col("cash") - F.col("tax"), F.lit(0.0)))
    return out.withColumn("per_name", F.when(F.col("to_spend") > 0, F.try_divide("to_spend", "names")))


def rebalance_buys(plan: DataFrame, candidates: DataFrame, names: int = 5) -> DataFrame:
    """The candidates (with ``last``) that share what ``rebalance`` has to spend, in whole shares."""
    j = candidates.where(F.col("rank") <= names).join(plan.where("per_name IS NOT NULL").select("account_id", "per_name"), "account_id")
    return j.select("account_id", "symbol", "rank", F.round("per_name").alias("amount"), F.when(F.col("last") > 0, F.floor(F.col("per_name") / F.col("last"))).otherwise(0).cast("long").alias("shares"))


def rebalance_profiles(v: DataFrame, buys: DataFrame) -> DataFrame:
    """Per account before and after: share in uptrends, sectors, the two largest names, concentration, in whole numbers."""
    before = v.select("account_id", F.lit("before").alias("stage"), "value", (F.col("vs200") > 0).alias("up"), "sector")
    after = v.select("account_id", F.lit("after").alias("stage"), (F.col("value") * (1 - _sold())).alias("value"), (F.col("vs200") > 0).alias("up"), "sector").where("value > 0")
    new = buys.select("account_id", F.lit("after").alias("stage"), F.col("amount").alias("value"), F.lit(True).alias("up"), F.lit("New").alias("sector"))
    rows = before.unionByName(after).unionByName(new)
    by = Window.partitionBy("account_id", "stage")
    rows = rows.withColumn("w", F.col("value") / F.greatest(F.sum("value").over(by), F.lit(1.0)) * 100).withColumn("n", F.row_number().over(by.orderBy(F.desc("value"))))
    known = F.when(F.col("sector") != "", F.col("sector"))
    return rows.groupBy("account_id", "stage").agg(
        F.round(F.sum(F.when(F.col("up"), F.col("w")).otherwise(0.0))).alias("uptrend_pct"), F.count_distinct(known).alias("sectors"),
        F.round(F.sum(F.when(F.col("n") <= 2, F.col("w")).otherwise(0.0))).alias("top2_pct"), F.round(F.sum(F.col("w") * F.col("w"))).alias("hhi"),
    )


# ---------------------------------------------------------------- horizon screen and allocation

FACTORS = ["cagr", "rs", "trend", "drawdown", "consistency", "quality"]
# Factor weights and gates of each horizon in years.
HORIZONS = {
    "1y": (0.20, 0.35, 0.25, 0.05, 0.05, 0.10), "2y": (0.25, 0.30, 0.20, 0.05, 0.10, 0.10), "3y": (0.30, 0.20, 0.15, 0.10, 0.15, 0.10),
    "5y": (0.30, 0.10, 0.05, 0.20, 0.20, 0.15), "10y": (0.28, 0.05, 0.02, 0.25, 0.20, 0.20),
}


# Least market capitalisation and daily turnover in crore, and least share of positive one-year holds.
FLOORS = {"1y": (3000.0, 5.0, 0.45), "2y": (3000.0, 5.0, 0.45), "3y": (5000.0, 5.0, 0.50), "5y": (10000.0, 3.0, 0.55), "10y": (20000.0, 3.0, 0.60)}


def span_stats(daily: DataFrame, spans: list[int], year: int = 252, price: str = "adj_close") -> DataFrame:
    """Per symbol and span of so many years that its history is longer than: return in percent and a year's share of it (cagr),
    largest fall (negative percent) over the span's bars, yearly volatility of its returns (0 below two)."""
    down, up = Window.partitionBy("symbol").orderBy(F.desc("date")), Window.partitionBy("symbol").orderBy("date")
    x = daily.select("symbol", "date", F.col(price).alias("x"), F.row_number().over(down).alias("rn"), F.lag(price).over(up).alias("prev"))
    wide = x.where(F.col("rn") <= max(spans) * year + 1).withColumn("years", F.explode(F.array(*map(F.lit, spans)))).where(F.col("rn") <= F.col("years") * year + 1)
    inside = F.col("rn") <= F.col("years") * year
    peak = F.max(F.when(inside, F.col("x"))).over(Window.partitionBy("symbol", "years").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    wide = wide.withColumn("fall", F.when(inside & (peak > 0), F.col("x") / peak - 1)).withColumn("r", F.when(inside & (F.col("prev") > 0), F.col("x") / F.col("prev") - 1))
    base, last = F.max(F.when(~inside, F.col("x"))), F.max(F.when(F.col("rn") == 1, F.col("x")))
    ratio = F.when(base > 0, last / base)
    return wide.groupBy("symbol", "years").agg(
        ((ratio - 1) * 100).alias("ret"), ((F.pow(ratio, 1 / F.col("years")) - 1) * 100).alias("cagr"), (F.least(F.min("fall"), F.lit(0.0)) * 100).alias("max_dd"),
        F.when(F.count("r") >= 2, F.stddev_pop("r") * F.sqrt(F.lit(float(year))) * 100).otherwise(0.0).alias("vol"), F.max((~inside).cast("int")).alias("__whole"),
    ).where("__whole = 1").drop("__whole")


def horizon_features(daily: DataFrame, symbols: DataFrame, index: DataFrame, edges: DataFrame, year: int = 252, unit: float = 1e7, stale_days: int = 30, price: str = "adj_close") -> DataFrame:
    """horizon, symbol, sector, last, vol and the six factors of every symbol that passes a horizon's gates.

    Gates: a last bar within ``stale_days`` of the newest, max(years, 2) * ``year`` + 5 bars, a positive CAGR, a close above
    the mean of 200, and the horizon's floors. ``edges``: symbols with a long edge. ``unit`` is a crore of turnover.
    """
    up, down = Window.partitionBy("symbol").orderBy("date"), Window.partitionBy("symbol").orderBy(F.desc("date"))
    d = daily.select("symbol", "date", F.col(price).alias("x"), (F.col("close") * F.col("volume")).alias("turn"), (F.row_number().over(up) - 1).alias("i"), F.row_number().over(down).alias("rn"), F.lag(price, year).over(up).alias("ago"))
    held = (F.col("i") >= year) & ((F.col("i") - year) % 21 == 0) & (F.col("ago") > 0)
    per = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.max("date").alias("newest"), F.max(F.when(F.col("rn") == 1, F.col("x"))).alias("last"), F.avg(F.when(F.col("rn") <= 200, F.col("x"))).alias("sma"),
        F.coalesce(F.avg(F.when(held, (F.col("x") > F.col("ago")).cast("double"))), F.lit(0.0)).alias("holds"), (F.median(F.when(F.col("rn") <= 60, F.col("turn"))) / unit).alias("liquid"),
    )
    years = [int(h[:-1]) for h in HORIZONS]
    market = index.groupBy("date").agg((F.sum(F.col("close").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))).alias("adj_close"))
    bench = span_stats(market.withColumn("symbol", F.lit("")), years, year).select("years", F.col("ret").alias("bench"))  # a row for each span
    rows = F.array(*[F.struct(F.lit(int(h[:-1])).alias("years"), F.lit(h).alias("horizon"), *[F.lit(v).alias(n) for v, n in zip(FLOORS[h], ("least_cap", "least_liquid", "least_holds"))]) for h in HORIZONS])
    f = span_stats(daily, years, year, price).join(per, "symbol").join(symbols.select("symbol", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")).alias("sector"), F.coalesce(F.col("market_cap_inr") / 1e7, F.lit(0.0)).alias("cap")), "symbol", "left")
    f = f.withColumn("h", F.explode(rows)).where("h.years = years").select("*", "h.horizon", "h.least_cap", "h.least_liquid", "h.least_holds").join(F.broadcast(bench), "years", "left")
    f = f.crossJoin(F.broadcast(per.agg(F.max("newest").alias("__newest"))))  # one row
    vs200 = (F.col("last") / F.col("sma") - 1) * 100
    gates = (F.datediff("__newest", "newest") <= stale_days) & (F.col("bars") >= F.greatest("years", F.lit(2)) * year + 5) & (F.col("last") > 0) & (F.col("cagr") > 0) & (vs200 > 0)
    gates = gates & (F.coalesce("cap", F.lit(0.0)) >= F.col("least_cap")) & (F.col("liquid") >= F.col("least_liquid")) & (F.col("holds") >= F.col("least_holds"))
    backed = edges.select("symbol", F.lit(True).alias("__e")).distinct()
    return f.where(gates).join(backed, "symbol", "left").select(
        "horizon", "symbol", "sector", "last", "vol", F.least("cagr", F.lit(60.0)).alias("cagr"), F.coalesce(F.col("ret") - F.col("bench"), F.lit(0.0)).alias("rs"), vs200.alias("trend"),
        F.col("max_dd").alias("drawdown"), (F.col("holds") * 100).alias("consistency"), F.log(F.greatest("cap", F.lit(0.0)) + 1).alias("quality"), F.col("__e").isNotNull().alias("edge_backed"),
    )


def horizon_screen(f: DataFrame, per_sector: int = 2, k: int = 8) -> DataFrame:
    """f: horizon, symbol, sector, the six factors, edge_backed. Each horizon's best: z-scored factors, weights, at most two a sector.

    The z-scores come from one aggregate row of each horizon joined back, never from an unpartitioned window.
    """
    stats = f.groupBy("horizon").agg(*[F.avg(c).alias(f"m_{c}") for c in FACTORS], *[F.stddev_pop(c).alias(f"s_{c}") for c in FACTORS])
    weights = f.sparkSession.createDataFrame([(h, *ws) for h, ws in HORIZONS.items()], "horizon string, " + ", ".join(f"w_{c} double" for c in FACTORS))
    z = f.join(F.broadcast(stats.join(weights, "horizon")), "horizon")  # a row for each horizon
    score = sum((F.col(f"w_{c}") * F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in FACTORS), F.lit(0.0))
    z = z.select("horizon", "symbol", "sector", (score + F.when(F.col("edge_backed"), 0.25).otherwise(0.0)).alias("score"))
    z = z.withColumn("in_sector", F.row_number().over(Window.partitionBy("horizon", "sector").orderBy(F.desc("score"), "symbol"))).where(F.col("in_sector") <= per_sector)
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("score"), "symbol"))).where(F.col("rank") <= k)


def capped_weights(vol: np.ndarray, cap: float = 0.25) -> np.ndarray:
    """Inverse-volatility weights no larger than ``cap``; the excess goes to the others in proportion."""
    w = 1 / np.maximum(vol, 5.0)
    w /= w.sum()
    cap = max(cap, 1 / len(w))
    fixed = np.zeros(len(w), bool)
    while (over := (w > cap + 1e-12) & ~fixed).any():
        fixed |= over
        w[fixed] = cap
        free = ~fixed
        if free.any():
            w[free] *= (1 - cap * fixed.sum()) / w[free].sum()
    return w


def whole_shares(weight: np.ndarray, capital: float, price: np.ndarray) -> tuple[np.ndarray, float]:
    """Whole shares of each slice, then one by one to the name furthest below its slice (ties: the first) that the cash can
    buy, until it buys none; what is left. Cash and deficits only fall, so a queue of deficits serves all steps."""
    shares = np.where(price > 0, np.floor(weight * capital / np.where(price > 0, price, 1)), 0)
    cash = capital - float(shares @ price)
    queue = [(-(capital * weight[i] - shares[i] * price[i]), i) for i in range(len(price)) if price[i] > 0]
    heapq.heapify(queue)
    while queue:
        _, i = heapq.heappop(queue)
        if price[i] <= cash:
            shares[i] += 1
            cash -= price[i]
            heapq.heappush(queue, (-(capital * weight[i] - shares[i] * price[i]), i))
    return shares.astype(int), cash


def allocate(plans: DataFrame, cap: float = 0.25) -> DataFrame:
    """plan_id, capital, symbol, price, vol -> weight, shares, cash_left: inverse-volatility slices in whole shares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol").reset_index(drop=True)
        w = capped_weights(pdf["vol"].to_numpy(float), cap)
        shares, cash = whole_shares(w, float(pdf["capital"].iloc[0]), pdf["price"].to_numpy(float))
        return pdf[["plan_id", "symbol"]].assign(weight=w, shares=shares, cash_left=cash)

    types = {x.name: x.dataType.simpleString() for x in plans.schema.fields}
    return plans.groupBy("plan_id").applyInPandas(run, f"plan_id {types['plan_id']}, symbol {types['symbol']}, weight double, shares long, cash_left double")


def basket(rows: DataFrame, most: int = 5, per_sector: int = 2, risk_pct: float = 6.0, leverage: float = 5.0, trade_risk_pct: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Greedy choice by score of each account's candidates: names, sector (an unknown one has no cap), leverage, and a risk cap
    of at least one trade's risk; skipped rows say why. ``keep``: further columns to pass on.

    A task walks its accounts' sorted rows batch by batch and carries what the open account has spent, so neither the number of
    accounts nor an account's size costs more than its rows. Once an account has all its names, the walk goes on at the next.
    """
    share = max(risk_pct, trade_risk_pct) / 100
    reasons = ["", "names", "sector", "leverage", "risk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capital, spent, risk, sectors, taken = 0.0, 0.0, 0.0, {}, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("sector", "notional", "risk", "capital", "__nth")]
            coded = columns[0].dictionary_encode()
            names, place = coded.dictionary.to_pylist(), pc.fill_null(coded.indices, -1).to_numpy().tolist()
            notionals, risks, all_ = (c.to_numpy(zero_copy_only=False).astype(float).tolist() for c in columns[1:4])  # null: NaN
            starts = np.flatnonzero(columns[4].to_numpy() == 1).tolist()
            why = np.ones(batch.num_rows, np.int8)
            for first, end in zip([0, *starts], [*starts, batch.num_rows]):
                if first < end and (first or starts[:1] == [0]):
                    capital, spent, risk, sectors, taken = all_[first], 0.0, 0.0, {}, 0
                for i in range(first, end):
                    if taken >= most:
                        break
                    sector, r, notional = names[place[i]] if place[i] >= 0 else None, risks[i], notionals[i]
                    if sector and sectors.get(sector, 0) >= per_sector:
                        why[i] = 2
                    elif spent + notional > capital * leverage:
                        why[i] = 3
                    elif risk + r > capital * share:
                        why[i] = 4
                    else:
                        why[i], taken, spent, risk = 0, taken + 1, spent + notional, risk + r
                        sectors[sector] = sectors.get(sector, 0) + 1
            skipped = pa.DictionaryArray.from_arrays(pa.array(why), pa.array(reasons)).cast(pa.string())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(why == 0), skipped], [*passed, "taken", "skipped"])

    passed = ["account_id", "symbol", "score", "notional", "risk", *keep]
    numbers = rows.select(*[F.col(c).cast("double").alias(c) if c in ("score", "notional", "risk", "capital") else F.col(c) for c in [*passed, "sector", "capital"]])
    order = [F.when(~F.isnan("score"), F.col("score")).desc_nulls_last(), F.col("symbol").asc_nulls_last()]
    # The window leaves a task's rows account by account, in the order of their numbers.
    numbered = numbers.withColumn("__nth", F.row_number().over(account().orderBy(*order)))
    types = {x.name: x.dataType.simpleString() for x in numbered.schema.fields}
    return numbered.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in passed) + ", taken boolean, skipped string")


def basket_totals(b: DataFrame) -> DataFrame:
    """Per account of ``basket``: ideas considered and taken, money and risk in use, and how many each cap left out."""
    left = lambda why: F.sum((F.col("skipped") == why).cast("long")).alias(f"skipped_{why}")
    used = lambda c: F.sum(F.when(F.col("taken"), F.col(c)).otherwise(0.0))
    return b.groupBy("account_id").agg(F.count(F.lit(1)).alias("considered"), F.sum(F.col("taken").cast("long")).alias("positions"), used("notional").alias("deployed"), used("risk").alias("total_risk"), *map(left, ("names", "sector", "leverage", "risk")))


def basket_bets(n: Column, rho: Column) -> Column:
    """Independent bets of ``n`` names at an average correlation (0.5 if unknown)."""
    r = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return n / (1 + (n - 1) * r)


def basket_losses(rows: DataFrame, draws: int = 4000, seed: int = 42) -> DataFrame:
    """Per account: seeded draws of the day's result of its basket (rows: risk, win_pct, rr), each name winning rr times its
    risk or losing it: mean, nearest-rank 5th and 95th percentile, share of losing days and of days that lose half the risk.

    Baskets of as many names meet the same numbers, so a task draws them once for each size.
    """
    from .bootstrap import draws as numbers

    names = ["account_id", "names", "expected", "p05", "p95", "losing_pct", "big_loss_pct"]
    at = lambda q: int(np.floor(q * (draws - 1) + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, u = -1, None
        for batch in batches:
            out, places = [], batch.column(1)
            ends, flat = places.offsets.to_numpy(), places.values
            risks, wins, rrs = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("risk", "win_pct", "rr"))
            # Accounts by size: one set of numbers is held at a time.
            for i in np.argsort(np.diff(ends), kind="stable"):
                a, b = ends[i], ends[i + 1]
                n, risk = int(b - a), risks[a:b]
                if n != last:
                    last, u = n, (numbers(seed, 0, draws * n) >> np.uint64(11)).astype(float).reshape(draws, n) / 2.0**53
                day = np.sort(np.where(u < np.clip(wins[a:b] / 100, 0, 1), rrs[a:b] * risk, -risk).sum(1))
                out.append((i, n, float(day.mean()), float(day[at(0.05)]), float(day[at(0.95)]), float((day < 0).mean() * 100), float((day <= -0.5 * risk.sum()).mean() * 100)))
            which = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), *[pa.array([x[k] for x in out], pa.int64() if k == 1 else pa.float64()) for k in range(1, 7)]], names)

    one = F.struct(F.col("symbol").isNull().alias("z"), "symbol", *[F.col(c).cast("double").alias(c) for c in ("risk", "win_pct", "rr")])
    baskets = rows.groupBy("account_id").agg(F.sort_array(F.collect_list(one)).alias("names"))
    kind = rows.schema["account_id"].dataType.simpleString()
    return baskets.mapInArrow(run, f"account_id {kind}, names long, expected double, p05 double, p95 double, losing_pct double, big_loss_pct double")


def exposure_gauge(used_pct: Column) -> Column:
    return F.when(used_pct >= 90, "red").when(used_pct >= 60, "amber").otherwise("green")


# ---------------------------------------------------------------- names to symbols

# Words of statements and what they stand for; words that do not tell names apart.
LONG_FORMS = {
    "LTD": "LIMITED", "L": "LIMITED", "CORP": "CORPORATION", "CORPN": "CORPORATION", "FIN": "FINANCE", "DEV": "DEVELOPMENT", "HSG": "HOUSING", "CO": "COMPANY",
    "PASS": "PASSENGER", "VEH": "VEHICLES", "PVT": "PRIVATE", "INDS": "INDUSTRIES", "INDUS": "INDUSTRIES", "TECH": "TECHNOLOGIES",
}
COMMON = ["LIMITED", "THE", "AND"]


def name_words(name: Column) -> Column:
    """Upper-case words of a name, ``&`` as AND, with abbreviations written out."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(name), "&", " AND "), "[^A-Z0-9]+", " ")
    full = F.create_map(*[F.lit(x) for kv in LONG_FORMS.items() for x in kv])
    return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.coalesce(full[w], w))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(name_words(name), lambda w: ~w.isin(COMMON)))


def resolve_names(names: DataFrame, symbols: DataFrame, least: float = 0.60, margin: float = 0.10) -> DataFrame:
    """name -> symbol (text), how (symbol, name, fuzzy, unmatched), score.

    A name that is a symbol stands for itself; else the whole normalised name decides; else the symbol of the
    best token score (half of shared words in all words, half of shared words in the name's) if that is at
    least ``least`` and clear of the runner-up's by ``margin``. Only names that are still open meet the inverted
    index of tokens, by those of their tokens that any acceptable partner or runner-up must share (the rarest).
    """
    left = names.select("name").distinct().withColumn("as_symbol", F.upper(F.trim("name")))
    known = symbols.select(F.upper(F.col("symbol").cast("string")).alias("symbol"), "name")
    by_symbol = left.join(known.select(F.col("symbol").alias("as_symbol")).distinct(), "as_symbol").select("name", F.col("as_symbol").alias("symbol"), F.lit("symbol").alias("how"), F.lit(1.0).alias("score"))
    left = left.join(by_symbol, "name", "left_anti").withColumn("norm", F.array_join(name_words(F.col("name")), " "))
    exact = known.select("symbol", F.array_join(name_words(F.col("name")), " ").alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min("symbol").alias("symbol"))
    by_name = left.join(exact, "norm").select("name", "symbol", F.lit("name").alias("how"), F.lit(1.0).alias("score"))
    open_ = left.join(by_name, "name", "left_anti").select("name", name_tokens(F.col("name")).alias("t"))
    right = known.select("symbol", name_tokens(F.col("name")).alias("s")).where(F.size("s") > 0).distinct()
    postings = right.select("symbol", "s", F.explode("s").alias("w"))
    rare = postings.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    words = open_.select("name", "t", F.explode("t").alias("w")).join(rare, "w")
    # A score is at most the share of the name's words that are shared; runners-up count from least - margin on.
    need = F.ceil(F.size("t") * (least - margin) - 1e-9)
    words = words.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("f", "w"))).withColumn("missing", F.size("t") - F.count(F.lit(1)).over(Window.partitionBy("name")))
    pairs = words.where(F.col("nth") + F.col("missing") <= F.size("t") - need + 1).join(postings, "w").select("name", "t", "symbol", "s").distinct()
    c, a, b = F.size(F.array_intersect("t", "s")), F.size("t"), F.size("s")
    hits = pairs.groupBy("name", "symbol").agg(F.max(0.5 * c / (a + b - c) + 0.5 * c / a).alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "symbol")
    best = hits.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("n = 1")
    ok = (F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= margin))
    fuzzy = open_.select("name").join(best, "name", "left").select("name", F.when(ok, F.col("symbol")).alias("symbol"), F.when(ok, "fuzzy").otherwise("unmatched").alias("how"), F.col("score"))
    return by_symbol.unionByName(by_name).unionByName(fuzzy)
