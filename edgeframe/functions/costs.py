"""Itemised round-trip costs of an intraday equity trade, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates of the fee schedule.
BROKERAGE_RATE, BROKERAGE_MAX = 0.0003, 20.0
STT_SELL, EXCHANGE, REGULATOR, GST, STAMP_BUY, SLIPPAGE = 0.00025, 0.0000297, 0.000001, 0.18, 0.00003, 0.00025


def items(buy: Column, sell: Column, slippage: float = SLIPPAGE) -> dict[str, Column]:
    """Each cost of buying for ``buy`` and selling for ``sell`` (turnover of each leg)."""
    leg = lambda v: F.least(v * BROKERAGE_RATE, F.lit(BROKERAGE_MAX))
    both = buy + sell
    brokerage, exchange, regulator = leg(buy) + leg(sell), both * EXCHANGE, both * REGULATOR
    return {
        "brokerage": brokerage, "stt": sell * STT_SELL, "exchange": exchange, "regulator": regulator, "gst": (brokerage + exchange + regulator) * GST,
        "stamp": buy * STAMP_BUY, "slippage": both * slippage,
    }


def total(buy: Column, sell: Column, slippage: float = SLIPPAGE) -> Column:
    out = None
    for c in items(buy, sell, slippage).values():
        out = c if out is None else out + c
    return out


def reference_fraction(slippage_times: float = 1.0, leg: float = 100_000.0) -> float:
    """Round-trip cost at ``leg`` on each side as a share of one leg."""
    brokerage = 2 * min(leg * BROKERAGE_RATE, BROKERAGE_MAX)
    levies = 2 * leg * (EXCHANGE + REGULATOR)
    return (brokerage + levies + (brokerage + levies) * GST + leg * (STT_SELL + STAMP_BUY) + 2 * leg * SLIPPAGE * slippage_times) / leg


def net_pnl(direction: Column, entry: Column, exit_: Column, qty: Column) -> Column:
    """Profit after costs; a short sells first."""
    a, b = entry * qty, exit_ * qty
    long = direction == "BUY"
    return F.when(long, b - a).otherwise(a - b) - total(F.when(long, a).otherwise(b), F.when(long, b).otherwise(a))
