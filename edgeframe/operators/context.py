"""Market context: breadth, regime, sectors, data quality, tradability, headlines, exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def index_tail(index: DataFrame, k: int) -> DataFrame:
    """Last ``k`` closes of each index; ``age`` 0 is the newest."""
    w = Window.partitionBy("index_name").orderBy(F.desc("date"))
    return index.withColumn("age", F.row_number().over(w) - 1).where(F.col("age") < k)


def breadth(daily: DataFrame) -> DataFrame:
    """One row: symbols up and down on their last day against the one before."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    two = daily.select("symbol", "date", "close", F.row_number().over(w).alias("n"), F.lead("close").over(w).alias("prev")).where("n = 1 AND prev IS NOT NULL")
    up, down = F.sum((F.col("close") > F.col("prev")).cast("long")), F.sum((F.col("close") < F.col("prev")).cast("long"))
    return two.agg(F.coalesce(up, F.lit(0)).alias("advances"), F.coalesce(down, F.lit(0)).alias("declines"), F.count(F.lit(1)).alias("symbols"))


def market_regime(index: DataFrame, daily: DataFrame, vol_of: Column | None = None) -> DataFrame:
    """Per index: % move, trend against the 20-day mean, volatility band, breadth band and bias."""
    t = index_tail(index, 21)
    per = t.groupBy("index_name").agg(
        F.max(F.when(F.col("age") == 0, F.col("close"))).alias("last"), F.max(F.when(F.col("age") == 1, F.col("close"))).alias("prev"),
        F.avg(F.when(F.col("age") < 20, F.col("close"))).alias("sma20"), F.stddev_pop("close").alias("sd"), F.avg("close").alias("mean"),
    )
    per = per.crossJoin(F.broadcast(breadth(daily)))  # one row
    per = per.withColumn("move_pct", (F.col("last") / F.col("prev") - 1) * 100).withColumn("vol", vol_of if vol_of is not None else F.col("sd") / F.col("mean") * 100)
    per = per.withColumn("breadth_pct", F.try_divide(F.col("advances") * 100.0, F.col("advances") + F.col("declines")))
    trend = F.when((F.col("last") >= F.col("sma20")) & (F.col("move_pct") >= 0), "up").when((F.col("last") < F.col("sma20")) & (F.col("move_pct") < 0), "down").otherwise("flat")
    per = per.withColumn("trend", trend).withColumn("vol_band", F.when(F.col("vol") < 13, "calm").when(F.col("vol") < 18, "normal").when(F.col("vol") < 25, "elevated").otherwise("high"))
    per = per.withColumn("breadth_band", F.when(F.col("breadth_pct") >= 60, "broad up").when(F.col("breadth_pct") <= 40, "broad down").otherwise("mixed"))
    bias = F.when((F.col("trend") == "up") & (F.col("breadth_band") == "broad down") | (F.col("trend") == "down") & (F.col("breadth_band") == "broad up"), "divergent")
    return per.withColumn("bias", bias.when(F.col("trend") == "up", "long").when(F.col("trend") == "down", "short").otherwise("neutral")).select("index_name", "move_pct", "trend", "vol_band", "breadth_pct", "breadth_band", "bias")


def light_regime(index: DataFrame, daily: DataFrame, dead: float = 0.001, first: int = 207) -> DataFrame:
    """Per index: the last close against its mean of 20 (Up, Down, or Flat within ``dead`` of it and below 20 closes);
    breadth over the first symbols, narrow if over 60 percent of those that moved went one way."""
    some = daily.select("symbol").distinct().orderBy("symbol").limit(first)  # the definition's own bound
    b = breadth(daily.join(some, "symbol", "left_semi"))
    per = index_tail(index, 20).groupBy("index_name").agg(F.max(F.when(F.col("age") == 0, F.col("close"))).alias("last"), F.avg("close").alias("sma"), F.count("close").alias("n")).crossJoin(F.broadcast(b))
    dev = F.when((F.col("n") == 20) & (F.col("sma") > 0), (F.col("last") - F.col("sma")) / F.col("sma"))
    moved = F.col("advances") + F.col("declines")
    label = F.when(moved == 0, "neutral").when(F.greatest("advances", "declines") / moved > 0.6, "narrow").otherwise("broad")
    return per.select("index_name", F.when(F.abs(dev) <= dead, "Flat").when(dev > 0, "Up").when(dev < 0, "Down").otherwise("Flat").alias("direction"), "advances", "declines", label.alias("breadth_label"))


def sector_strength(daily: DataFrame, symbols: DataFrame, index: DataFrame, sector_index: DataFrame, broad: str, sessions: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Per symbol: n-session returns relative to the index of its sector (``sector_index``: sector, index_name), or to the
    ``broad`` one where the sector has none; leader or laggard by five sessions."""
    def returns(df, key, names):
        w = Window.partitionBy(key).orderBy(F.desc("date"))
        rows = df.withColumn("n", F.row_number().over(w) - 1)
        at = lambda k: F.max(F.when(F.col("n") == k, F.col("close")))
        return rows.where(F.col("n") <= max(sessions)).groupBy(key).agg(*[F.when(at(k) > 0, (at(0) / at(k) - 1) * 100).alias(f"{names}{k}") for k in sessions])

    named = symbols.select("symbol", "sector").join(sector_index.withColumnRenamed("index_name", "__own"), "sector", "left")
    named = named.withColumn("broad_fallback", F.col("__own").isNull()).withColumn("index_name", F.coalesce("__own", F.lit(broad)))
    j = returns(daily, "symbol", "r").join(named, "symbol").join(returns(index, "index_name", "i"), "index_name", "left")
    out = j.select("symbol", "sector", "index_name", "broad_fallback", *[(F.col(f"r{k}") - F.col(f"i{k}")).alias(f"rs_{k}") for k in sessions])
    return out.withColumn("label", F.when(F.col("rs_5").isNull(), "unknown").when(F.col("rs_5") >= 1.5, "leader").when(F.col("rs_5") <= -1.5, "laggard").otherwise("in-line"))


def data_quality(daily: DataFrame, actions: DataFrame) -> DataFrame:
    """Per symbol: invalid bars, lowest close, worst symmetric jump (1 without one) and its date, splits that prices do not
    reflect; unreliable from a jump of 3, caution from 1.8 or below a price of one."""
    w = Window.partitionBy("symbol").orderBy("date")
    d = daily.withColumn("prev", F.lag("close").over(w))
    bad = (F.col("close") <= 0) | (F.col("high") < F.col("low")) | F.col("close").isNull()
    jump = F.greatest(F.try_divide("close", "prev"), F.try_divide("prev", "close"))
    d = d.withColumn("jump", F.when((F.col("prev") > 0) & (F.col("close") > 0), jump))
    base = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("invalid"), F.min("close").alias("min_close"), F.max("jump").alias("worst_jump"), F.max_by(F.col("date").cast("string"), F.struct("jump", -F.unix_date("date"))).alias("worst_date"))
    splits = actions.where("type = 'split' AND value >= 1.5").select("symbol", F.col("date").alias("ex_date"), F.col("value").alias("ratio"))
    seen = splits.join(d.select("symbol", "date", "close", "prev"), "symbol").where("date >= ex_date").groupBy("symbol", "ex_date", "ratio").agg(F.min_by(F.struct("close", "prev"), "date").alias("x"))
    observed = F.try_divide(F.col("x.close"), F.col("x.prev"))
    raw = seen.where((observed < 0.85) & (F.abs(observed * F.col("ratio") - 1) <= 0.25)).groupBy("symbol").agg(F.count(F.lit(1)).alias("uncorrected"))
    out = base.join(raw, "symbol", "left").withColumn("uncorrected", F.coalesce("uncorrected", F.lit(0)))
    out = out.withColumn("worst_date", F.when(F.col("worst_jump") > 1, F.col("worst_date"))).withColumn("worst_jump", F.greatest(F.coalesce("worst_jump", F.lit(1.0)), F.lit(1.0)))
    jumped = F.when(F.col("worst_jump") >= 3.0, "discontinuity").when(F.col("worst_jump") >= 1.8, "jump")
    flags = [F.when(F.col("invalid") > 0, "bad ticks"), jumped, F.when(F.col("uncorrected") > 0, "uncorrected split"), F.when(F.col("min_close") < 1.0, "price under one")]
    bad = (F.col("uncorrected") > 0) | (F.col("invalid") > 0) | (F.col("worst_jump") >= 3.0)
    verdict = F.when(bad, "unreliable").when((F.col("worst_jump") >= 1.8) | F.coalesce(F.col("min_close") < 1.0, F.lit(False)), "caution").otherwise("ok")
    return out.withColumn("flags", F.concat_ws("; ", *flags)).withColumn("verdict", verdict)


def turnover_median(daily: DataFrame, k: int = 60) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    t = daily.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return t.groupBy("symbol").agg(F.median(F.col("close") * F.col("volume")).alias("median_turnover"), F.max(F.when(F.col("n") == 1, F.col("close"))).alias("last_close"))


def liquidity_tier(crore: Column) -> Column:
    return F.when(crore.isNull() | (crore <= 0), "unknown").when(crore >= 50, "deep").when(crore >= 5, "ok").when(crore >= 1, "thin").otherwise("very thin")


def participation(qty: Column, adv: Column) -> Column:
    return F.try_divide(qty * 100.0, adv)


def participation_verdict(pct: Column) -> Column:
    return F.when(pct.isNull(), "unknown").when(pct < 1, "ok").when(pct < 5, "caution").when(pct < 20, "heavy").otherwise("illiquid")


def series_of(trading_symbol: Column) -> Column:
    """Series from a trading symbol's suffix; EQ without one."""
    s = F.regexp_extract(trading_symbol, "-(BE|BZ|BL)$", 1)
    return F.when(s == "", "EQ").otherwise(s)


def tradability(daily: DataFrame, symbols: DataFrame, watch: DataFrame, unit: float = 1e7, series: DataFrame | None = None) -> DataFrame:
    """Tier, flags, caption and verdict of each symbol: blocked (under a surveillance measure, or a series of trade-to-trade),
    high_risk (very thin), caution (thin, low-priced, micro-cap), ok. ``series`` (symbol, series) is EQ where it says nothing;
    a symbol without days has the tier unknown. ``unit`` is one crore of the turnover's currency."""
    t = symbols.select("symbol", "name", (F.col("market_cap_inr") / 1e7).alias("cap_crore")).join(turnover_median(daily), "symbol", "full").join(watch, "symbol", "left")
    t = t.join(series, "symbol", "left") if series is not None else t.withColumn("series", F.lit(None).cast("string"))
    t = t.withColumn("series", F.coalesce("series", F.lit("EQ"))).withColumn("tier", liquidity_tier(F.col("median_turnover") / unit))
    price, cap = F.col("last_close"), F.col("cap_crore")
    t = t.withColumn("low_price", F.coalesce((price > 0) & (price < 20), F.lit(False))).withColumn("micro_cap", F.coalesce((cap > 0) & (cap < 500), F.lit(False)))
    watched, delivery = F.coalesce(F.col("measure") != "", F.lit(False)), F.col("series").isin("BE", "BZ", "BL")
    soft = [F.when(F.col("tier") == "thin", "thin liquidity"), F.when(F.col("low_price"), "low-priced"), F.when(F.col("micro_cap"), "micro-cap")]
    softly = F.concat_ws(" / ", *soft)
    verdict = F.when(watched | delivery, "blocked").when(F.col("tier") == "very thin", "high_risk").when(softly != "", "caution").otherwise("ok")
    reason = F.when(watched, F.concat(F.lit("surveillance: "), "measure")).when(delivery, F.concat(F.lit("trade-to-trade series "), "series")).when(F.col("tier") == "very thin", "very thin liquidity").otherwise(softly)
    flags = [F.when(watched, F.concat(F.lit("under "), "measure")), F.when(delivery, F.concat("series", F.lit(" series"))), F.when(F.col("tier").isin("thin", "very thin"), F.concat("tier", F.lit(" liquidity"))), *soft[1:]]
    return t.withColumn("caption", F.concat_ws(" · ", *flags)).withColumn("reason", reason).withColumn("verdict", verdict).withColumn("intraday_ok", F.col("verdict") != "blocked").select(
        "symbol", "series", "tier", "low_price", "micro_cap", "measure", "verdict", "reason", "caption", "intraday_ok"
    )


# Sentiment words of headlines.
POSITIVE = (
    "surge surges surged jump jumps jumped gain gains gained rally rallies rallied soar soars soared rise rises rose record high profit profits beat beats upgrade upgrades upgraded bonus dividend "
    "order orders win wins won approval approved expansion expands acquire acquires acquisition strong growth outperform bullish boost boosts hike hikes raises raised multibagger buyback"
).split()
NEGATIVE = (
    "fall falls fell drop drops dropped plunge plunges plunged slump slumps slumped decline declines declined low loss losses miss misses missed downgrade downgrades downgraded cut cuts probe fraud "
    "scam default defaults resign resigns resigned weak slowdown lawsuit penalty fine fined ban bans recall bearish warning warns concern concerns debt crash crashes tumble tumbles tumbled selloff raid"
).split()


def headline_sentiment(rows: DataFrame, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """doc_id, score (p - n) / (p + n) over whole tokens, label with a band of 0.15."""
    spark = rows.sparkSession
    words = F.broadcast(spark.createDataFrame([(w, 1) for w in positive] + [(w, -1) for w in negative], "word string, sign int"))
    tokens = rows.select("doc_id", F.explode(F.split(F.lower("headline"), "[^a-z]+")).alias("word")).where("word <> ''")
    per = tokens.join(words, "word").groupBy("doc_id").agg(F.sum((F.col("sign") > 0).cast("long")).alias("p"), F.sum((F.col("sign") < 0).cast("long")).alias("n"))
    out = rows.select("doc_id", "symbol").join(per, "doc_id", "left").withColumn("score", F.coalesce(F.try_divide((F.col("p") - F.col("n")).cast("double"), (F.col("p") + F.col("n")).cast("double")), F.lit(0.0)))
    return out.select("doc_id", "symbol", "score", F.when(F.col("score") > 0.15, "positive").when(F.col("score") < -0.15, "negative").otherwise("neutral").alias("label"))


def contradiction(label: Column, move_pct: Column, side: Column, move: float = 2.0) -> Column:
    """Headlines and the day's move (``move`` percent) against the side of a trade: cautious if either speaks against it,
    aligned if either speaks for it, neutral."""
    up, down = F.coalesce(move_pct >= move, F.lit(False)), F.coalesce(move_pct <= -move, F.lit(False))
    bullish, bearish, buy = (label == "positive") | up, (label == "negative") | down, F.upper(side) == "BUY"
    return F.when((buy & bearish) | (~buy & bullish), "cautious").when((buy & bullish) | (~buy & bearish), "aligned").otherwise("neutral")


def exit_reachability(rows: DataFrame, cap_pct: float = 5.0) -> DataFrame:
    """Rows with side, entry, stop, notional, band_low, band_high, tradability, turnover: can the stop be filled?

    The band that counts is the one the stop protects against. Highest consequence first: blocked, unreachable_stop,
    caution (a larger share of the day's turnover than ``cap_pct``, or an elevated-risk name), unknown (no band), ok.
    """
    long = F.upper("side") != "SELL"
    band = F.when(long, F.col("band_low")).otherwise(F.col("band_high"))
    known = (band > 0) & (F.col("entry") > 0)
    inside = F.when(known, F.when(long, F.col("stop") > band).otherwise(F.col("stop") < band))
    part = F.when((F.col("turnover") > 0) & (F.col("notional") > 0), F.col("notional") / F.col("turnover") * 100)
    out = rows.withColumn("circuit_room_pct", F.when(known, F.abs(F.col("entry") - band) / F.col("entry") * 100)).withColumn("stop_inside_band", inside).withColumn("participation_pct", part)
    v = F.when(F.col("tradability") == "blocked", "blocked").when(~F.col("stop_inside_band"), "unreachable_stop").when(F.col("participation_pct") > cap_pct, "caution")
    v = v.when(F.col("tradability").isin("high_risk", "caution"), "caution").when(F.col("stop_inside_band").isNull(), "unknown").otherwise("ok")
    return out.withColumn("exit_verdict", v).withColumn("severity", F.when(F.col("exit_verdict").isin("blocked", "unreachable_stop"), "danger").when(F.col("exit_verdict") == "ok", "info").otherwise("warn"))


def symbol_metadata(bars: DataFrame, as_of: Column) -> DataFrame:
    return bars.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set("tf")), ",").alias("intervals"), F.count_distinct("session_date").alias("days"), F.max("session_date").alias("last")).select("symbol", "intervals", "days", F.col("last").cast("string").alias("last_date"), F.datediff(as_of, "last").alias("age_days"))
