"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import registry
from .plans import q_bars, q_context, q_edges, q_journal, q_market, q_portfolio, q_sources, q_ticks, q_trades  # noqa: F401  they register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["i02_edge_map"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
