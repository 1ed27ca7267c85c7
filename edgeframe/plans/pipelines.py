"""Pipelines that compose the operators: edge maps, deep dives, scanners, sizing, picks, staging.

The heavy part (signals, outcomes, statistics) is one plan over all symbols; ranking and sizing are
windows and projections on its small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import costs, mathx, scores

from ..operators import bootstrap as BS
from ..operators import indicators as C
from ..operators import outcomes as E
from ..operators import signals as D
from ..operators import tradestats as TS
from ..operators import validation as V
from ..operators.bars import series
from ..sources.stage import durable

COST = costs.reference_fraction()
LEVERAGE = 5.0
#: (stop in ATR, reward to risk) of the setup card's search.
CARD_CONFIGS = [(1.0, 1.5), (1.0, 2.0), (1.0, 3.0), (0.75, 2.0), (1.25, 2.0)]


def with_mean_atr(ind: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``atr`` as the mean of the last ``n`` true ranges."""
    w = Window.partitionBy(*series(ind)).orderBy("bar_idx").rowsBetween(-(n - 1), 0)
    out = ind.withColumn("tr", C.true_range(ind))
    return out.withColumn("atr", F.when(F.count("tr").over(w) == n, F.avg("tr").over(w)))


def last_prices(bars: DataFrame) -> DataFrame:
    """symbol (and timeframe), ltp, atr at the last bar of each series."""
    return with_mean_atr(bars).groupBy(*series(bars)).agg(F.max_by("close", "bar_idx").alias("ltp"), F.max_by("atr", "bar_idx").alias("atr"))


def backtest(ind: DataFrame, bars: DataFrame, strategies: dict, pairs: list[tuple[float, float]], cost: float = COST, finer: DataFrame | None = None) -> DataFrame:
    """Trades of all strategies and configurations; ``ind`` has the indicator columns and ``atr``. With ``finer`` bars, exits
    that touch both levels are resolved by them; without, they take the stop."""
    rows = ind.withColumn("entry_idx", F.col("bar_idx")).withColumn("entry", F.col("close"))
    sig = D.signals(rows, strategies, [*series(ind), "session_date", "entry_idx", "entry", "atr"])
    trades = E.one_at_a_time(E.first_touch(sig, bars, cost, pairs))
    return trades if finer is None else E.with_intrabar(durable(trades, "trades"), finer, cost)


def lengths(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*series(bars)).agg(F.count(F.lit(1)).alias("total"))


def edge_map(bars: DataFrame, k: float = 1.5, rr: float = 2.0, least_bars: int = 100, finer: DataFrame | None = None) -> DataFrame:
    """One row per (series, strategy, direction): metrics, eligibility, validation and robustness; each series is a
    map of its own, with its own trials."""
    own = series(bars)
    n = lengths(bars).where(F.col("total") >= least_bars)
    long = bars.join(n.select(*own), own, "left_semi")
    ind = C.all_indicators(long).withColumn("atr", F.col("atr14"))
    rules = {s: {**D.WINDOWED, **D.RECURSIVE}[s] for s in D.EDGE_SET}
    t = durable(backtest(ind, long, rules, [(k, rr)], finer=finer), "trades")
    keys = TS.keys_of(t)
    s = TS.full(t).join(V.split_stats(V.purged_split(t, n)), keys).join(V.walk_forward(t, n), keys)
    s = V.deflated_sharpe(s, own)
    return s.select(*own, "strategy", "direction", "n", "win_pct", "expectancy", "profit_factor", "avg_win", "avg_loss", "max_dd", "eligible", "oos_expectancy", "oos_n", "wf_consistency", "dsr")


def edge_index(edges: DataFrame) -> DataFrame:
    """Each series and its eligible edges, best first."""
    one = F.struct((-F.round("expectancy", 9)).alias("worst"), "strategy", "direction", "n", "expectancy", "profit_factor")
    return edges.where("eligible").groupBy(*series(edges)).agg(F.array_sort(F.collect_list(one)).alias("edges"))


def scored(trades: DataFrame, n: DataFrame, index: DataFrame) -> DataFrame:
    """All statistics, validation and the confidence score of each configuration; the trials of a symbol are all its
    configurations, of every timeframe."""
    s, keys = TS.full(trades), TS.keys_of(trades)
    s = s.join(V.split_stats(V.purged_split(trades, n)), keys).join(V.walk_forward(trades, n), keys).join(V.trade_walk_forward(trades), keys, "left")
    s = s.join(V.regime_consistency(trades, V.benchmark_regime(index)).select(*keys, "regime_consistent"), keys, "left")
    s = V.deflated_sharpe(V.robustness(s), ["symbol"])
    s = s.withColumn("wilson_low", mathx.wilson_low(F.col("win_pct"), F.col("n"))).withColumn("p_value", mathx.p_one_sided(F.col("t_stat")))
    return scores.confidence(s)


def with_agreement(s: DataFrame, least: int = 20) -> DataFrame:
    """Adds agree: the timeframes in which the (symbol, strategy) has a configuration of enough trades that makes money."""
    tf = F.col("tf") if "tf" in s.columns else F.lit("")
    pays = F.when((F.col("n") >= least) & (F.col("expectancy") > 0), tf)
    return s.withColumn("agree", F.size(F.collect_set(pays).over(Window.partitionBy("symbol", "strategy"))).cast("double"))


def with_conviction(s: DataFrame, trades: DataFrame, paths: int = 5000) -> DataFrame:
    keys = TS.keys_of(trades)
    boot = BS.bootstrap(trades, keys, paths).select(*keys, "prob_profit_pct", "dd_p95", "final_p05")
    s = with_agreement(s).join(boot, keys)
    score = scores.conviction(F.col("agree"), F.col("prob_profit_pct"), F.coalesce("wf_trades", F.lit(1.0)), F.col("dsr"), F.col("oos_expectancy"), F.col("oos_n"), F.col("skew"), F.col("kurt"))
    return s.withColumn("conviction", score).withColumn("conviction_label", scores.conviction_label(F.col("conviction")))


def best_per(s: DataFrame, by: list[str], *first: Column) -> DataFrame:
    """The best row of each group; ties go to the smallest strategy, timeframe, configuration and direction."""
    w = Window.partitionBy(*by).orderBy(*first, "strategy", *series(s)[1:], "config_id", "direction")
    return s.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per(s: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order, "symbol", "strategy", "config_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_first() -> list[Column]:
    """By confidence, then by expectancy to nine places: configurations that traded alike are ties."""
    return [F.desc_nulls_last("confidence"), F.round("expectancy", 9).desc_nulls_last()]


def scanner(s: DataFrame, floor: int = 50, k: int = 10) -> DataFrame:
    """Per side, the ``k`` best symbols by their best configuration with enough confidence."""
    ok = best_per(s.where(F.col("confidence") >= floor), ["symbol", "direction"], *_best_first())
    return top_per(ok, ["direction"], k, *_best_first()).select("direction", "rank", *series(s), "strategy", "config_id", "confidence", "band", "n", "win_pct", "wilson_low", "expectancy", "profit_factor", "dsr")


def sizing(price: Column, stop_distance: Column, budget: Column | float, risk_pct: Column | float) -> Column:
    """Shares that risk no more than ``risk_pct`` of the budget and stay within the leverage."""
    budget = F.lit(budget) if not isinstance(budget, Column) else budget
    budget = F.least(F.greatest(budget, F.lit(50_000.0)), F.lit(7_500_000.0))
    risk = F.lit(risk_pct) if not isinstance(risk_pct, Column) else risk_pct
    risk = F.least(F.greatest(risk, F.lit(1.0)), F.lit(7.0))
    return F.least(F.floor(F.try_divide(budget * risk / 100, stop_distance)), F.floor(F.try_divide(budget * LEVERAGE, price)))


def _config(part: str) -> Column:
    """k or rr out of a configuration's name."""
    return F.regexp_extract("config_id", {"k": r"^k([0-9.]+)_", "rr": r"_rr([0-9.]+)$"}[part], 1).cast("double")


def size_rows(rows: DataFrame, budget: float, risk_pct: float) -> DataFrame:
    """Adds shares, stop, target and projected profit and loss to rows with ltp and atr."""
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    out = rows.withColumn("stop_distance", _config("k") * F.col("atr")).withColumn("shares", sizing(F.col("ltp"), F.col("stop_distance"), budget, risk_pct))
    out = out.withColumn("stop", F.col("ltp") - sign * F.col("stop_distance")).withColumn("target", F.col("ltp") + sign * _config("rr") * F.col("stop_distance"))
    return out.withColumn("gain_at_target", F.col("shares") * F.col("stop_distance") * _config("rr")).withColumn("loss_at_stop", -F.col("shares") * F.col("stop_distance")).where("shares >= 1")


def finder(s: DataFrame, prices: DataFrame, capital: float, risk_pct: float, max_atr: float | None = None, floor: int = 50) -> DataFrame:
    """Best setup with a confidence of ``floor`` or more of each symbol of which the capital can hold a share, sized to it; the
    fit score is the confidence times the part of the shares by risk that the money reaches."""
    best = best_per(s.where(F.col("confidence") >= floor), ["symbol"], *_best_first()).join(prices, series(prices))
    if max_atr is not None:
        best = best.where(F.col("atr") <= max_atr)
    sized = size_rows(best.where("ltp > 0 AND atr > 0"), capital, risk_pct)
    by_risk, by_money = F.floor(capital * risk_pct / 100 / F.col("stop_distance")), F.floor(capital * LEVERAGE / F.col("ltp"))
    sized = sized.withColumn("shares_by_risk", by_risk.cast("double")).withColumn("shares_by_money", by_money.cast("double"))
    net = lambda level: costs.net_pnl(F.col("direction"), F.col("ltp"), F.col(level), F.col("shares"))
    sized = sized.withColumn("net_profit", net("target")).withColumn("net_loss", net("stop")).withColumn("deployed_pct", F.col("shares") * F.col("ltp") / (capital * LEVERAGE) * 100)
    sized = sized.withColumn("fit", F.when(F.col("shares_by_risk") <= F.col("shares_by_money"), "ideal").otherwise("leverage_bound"))
    return sized.withColumn("fit_score", F.col("confidence") * F.least(F.col("shares") / F.col("shares_by_risk"), F.lit(1.0))).select(
        *series(s), "strategy", "direction", "config_id", "confidence", "expectancy", "win_pct", "wilson_low", "profit_factor", "n", "ltp", "atr", "shares", "shares_by_risk", "shares_by_money", "stop", "target",
        "net_profit", "net_loss", "deployed_pct", "fit", "fit_score",
    )


def picks(rows: DataFrame, tradability: DataFrame, k: int = 5, cost: float = COST) -> DataFrame:
    """Top ``k`` per side of the finder's rows by fit, without blocked symbols and without edges below what a round trip costs
    in R; the chance as X of 10 from the Wilson bound. A symbol that ``tradability`` (symbol, verdict, reason) does not have is unverified."""
    known = tradability.select("symbol", F.col("verdict").alias("__v"), F.col("reason").alias("__r"))
    j = rows.join(known, "symbol", "left").withColumn("tradability", F.coalesce("__v", F.lit("unverified")))
    floor = cost * F.col("ltp") / F.abs(F.col("ltp") - F.col("stop"))
    ok = j.where("tradability <> 'blocked' AND expectancy > 0 AND shares > 0").where(~(F.col("expectancy") < floor))
    note = F.when(F.col("tradability").isin("high_risk", "caution"), F.col("__r")).when(F.col("tradability") == "unverified", "not verified")
    one = Window.partitionBy("direction", "symbol").orderBy(F.round("fit_score", 9).desc(), *series(rows)[1:], "strategy", "config_id")
    ok = ok.withColumn("note", note).withColumn("__n", F.row_number().over(one)).where("__n = 1")
    out = top_per(ok, ["direction"], k, F.round("fit_score", 9).desc())
    return out.withColumn("x_of_10", F.least(F.greatest(F.round(F.col("wilson_low") / 10), F.lit(0)), F.lit(10)).cast("int")).drop("__v", "__r", "__n")


def target_feasibility(picked: DataFrame, risk_pct: float, start: float, goal: float) -> DataFrame:
    """One row: the trades of the picks' median expectancy that compound ``start`` to ``goal`` (0 without a gain, a million at
    most), and how realistic that is: reasonable to 1.5 times, aggressive to 3."""
    multiple = goal / start
    growth = risk_pct / 100 * F.coalesce(F.median("expectancy"), F.lit(0.0))
    per = picked.agg(growth.alias("g"), F.count(F.lit(1)).alias("picks"))
    need = F.least(F.greatest(F.ceil(F.log(F.lit(multiple)) / F.log(1 + F.col("g"))), F.lit(0)), F.lit(1_000_000))
    label = "reasonable" if multiple <= 1.5 else "aggressive" if multiple <= 3.0 else "unrealistic"
    pays = F.col("g") > 0
    return per.select("picks", F.lit(multiple).alias("multiple"), (F.col("g") * 100).alias("growth_pct"), F.when(pays, need).otherwise(0).cast("long").alias("trades_needed"), F.when(pays, label).otherwise("unrealistic").alias("label"))


def staged(rows: DataFrame, k: int = 5, tiers: tuple[float, ...] = (0.5, 1.0, 2.0), capital: float = 500_000.0) -> DataFrame:
    """Bracket order rows: limit a tenth of an ATR better than the last price, stop and target from the row's own multiples."""
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    rows = rows.where(F.col("rank") <= k).withColumn("risk_pct", F.explode(F.array(*map(F.lit, tiers))))
    rows = rows.withColumn("limit", F.col("ltp") - sign * 0.1 * F.col("atr")).withColumn("d", _config("k") * F.col("atr"))
    rows = rows.withColumn("stop", F.col("limit") - sign * F.col("d")).withColumn("target", F.col("limit") + sign * _config("rr") * F.col("d"))
    rows = rows.withColumn("shares", F.least(F.floor(F.try_divide(capital * F.col("risk_pct") / 100, F.col("d"))), F.floor(F.try_divide(F.lit(capital * LEVERAGE), F.col("limit")))))
    text = F.format_string("%s %s x%d LIMIT %.2f SL %.2f TP %.2f", "direction", F.col("symbol").cast("string"), "shares", "limit", "stop", "target")
    return rows.where("shares >= 1").select("direction", "rank", *series(rows), "strategy", "risk_pct", "limit", "stop", "target", "shares", text.alias("text"))


def card_trades(bars: DataFrame, pairs: list[tuple[float, float]] = CARD_CONFIGS) -> DataFrame:
    """Trades of the four card strategies on both sides, in every timeframe and configuration."""
    return backtest(with_mean_atr(C.windowed(bars)), bars, {k: D.WINDOWED[k] for k in D.CARD_SET.values()}, pairs)


def deep_dive(bars: DataFrame, index: DataFrame, least: int = 20) -> DataFrame:
    """Card strategies, both sides, five configurations, every timeframe: the best of each (symbol, strategy), deflated
    over all configurations, with the timeframes that agree, the overfitting probability of its timeframe, and whether
    it is the best of the symbol."""
    t = durable(card_trades(bars), "trades")
    n = lengths(bars)
    s = with_agreement(scored(t, n, index), least)
    by = series(bars)
    pbo = V.overfit_probability(V.block_means(t, n), by, ["strategy", "direction", "config_id"])
    best = best_per(s.where(F.col("n") >= least), ["symbol", "strategy"], *_best_first()).join(pbo, by, "left")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(*_best_first(), "strategy"))
    return best.withColumn("best_overall", place == 1).select(
        *by, "strategy", "direction", "config_id", "n", "win_pct", "expectancy", "profit_factor", "confidence", "band", "dsr", "trials", "robustness", "agree", "pbo",
        scores.verdict(F.col("confidence")).alias("verdict"), "best_overall",
    )


def setup_cards(s: DataFrame, trades: DataFrame, prices: DataFrame, budget: float = 500_000.0, risk_pct: float = 2.0) -> DataFrame:
    """The best configuration of each symbol with levels, quantity, itemised net profit and statistics."""
    keys = TS.keys_of(trades)
    best = best_per(with_conviction(s, trades), ["symbol"], *_best_first())
    rows = size_rows(best.join(E.winner_heat(trades, keys), keys, "left").join(prices, series(prices)), budget, risk_pct)
    net = costs.net_pnl(F.col("direction"), F.col("ltp"), F.col("target"), F.col("shares"))
    return rows.withColumn("net_at_target", net).select(
        *keys, "ltp", "stop", "target", "shares", "gain_at_target", "loss_at_stop", "net_at_target", "n", "win_pct", "expectancy", "profit_factor", "max_dd", "confidence", "band",
        "conviction", "conviction_label", "prob_profit_pct", "heat_median", "heat_p90", "dsr",
    )


def baseline(bars: DataFrame, order: str = "bar_idx") -> DataFrame:
    """Pre-market baseline: last close, ATR, year range, profile levels, bars; a failed symbol says why."""
    per = bars.groupBy("symbol").agg(F.max_by("close", order).alias("last_close"), F.count(F.lit(1)).alias("bars"))
    full = C.final_wilder(bars, order).select("symbol", "atr").join(C.year_range(bars, order), "symbol", "left").join(C.value_area(C.volume_histogram(bars)), "symbol", "left")
    return per.join(full, "symbol", "left").withColumn("failure", F.when(F.col("atr").isNull(), "too few bars for ATR").when(F.col("poc").isNull(), "no volume profile"))


def swing_scan(daily: DataFrame, least: int = 220) -> DataFrame:
    """Each symbol's last day: a breakout above the 20 highs before it on 2.5 times the mean volume of the 50 days before it,
    else a retest of the 200-day EMA; with Wilder's ATR and the year's range."""
    up = Window.partitionBy("symbol").orderBy("date")
    usual, high = F.avg("volume").over(up.rowsBetween(-50, -1)), F.max("high").over(up.rowsBetween(-20, -1))
    d = daily.withColumn("vol_ratio", F.when(usual > 0, F.col("volume") / usual).otherwise(0.0)).withColumn("prior_high", high)
    last = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), *[F.max_by(c, "date").alias(c) for c in ("close", "vol_ratio", "prior_high")])
    smooth = C.final_wilder(daily, "date").select("symbol", F.col("ema").alias("ema200"), "atr")
    base = last.where(F.col("bars") >= least).join(smooth, "symbol").join(C.year_range(daily), "symbol").where("ema200 IS NOT NULL AND atr IS NOT NULL")
    dist = F.abs(F.col("close") - F.col("ema200")) / F.col("ema200")
    breakout = (F.col("vol_ratio") >= 2.5) & (F.col("close") > F.col("prior_high"))
    retest = (F.col("ema200") > 0) & (dist <= 0.03) & (F.col("close") >= 0.97 * F.col("ema200"))
    out = base.withColumn("setup", F.when(breakout, "volume_delivery_breakout").when(retest, "mean_reversion_200ema")).where("setup IS NOT NULL")
    score = F.when(F.col("setup") == "volume_delivery_breakout", F.col("vol_ratio")).otherwise(1 / (1 + dist))
    return out.withColumn("score", score).select("symbol", "setup", F.lit("BUY").alias("side"), "close", "vol_ratio", "ema200", "atr", F.col("low_52w").alias("support"), F.col("high_52w").alias("resistance"), "score")
