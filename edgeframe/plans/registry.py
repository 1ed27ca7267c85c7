"""Registry of queries: a name, a function of the logical tables, and the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places (and no negative zero), so that results compare across engines. The nudge of a
    thousandth of the last place keeps values that end in exactly half of it on one side."""
    return df.select(*[(F.round(F.col(f"`{f.name}`") * 10.0**places + 0.001) / 10.0**places + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _expand(text: str) -> str:
    """``R6(x)`` in SQL is x to six places."""
    while (at := text.find("R6(")) >= 0:
        depth, end = 0, at + 2
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if not depth:
                break
            end += 1
        text = f"{text[:at]}(round(CAST({text[at + 3 : end]} AS DOUBLE) * 1000000.0 + 0.001) / 1000000.0 + 0.0){text[end + 1 :]}"
    return text


def with_tables(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after the common table expressions of ``names`` and then ``extra``."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][1]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    recursive = "RECURSIVE " if "UNION" in "".join(parts) else ""
    return _expand((f"WITH {recursive}{', '.join(parts)} " if parts else "") + body)


def query(name: str, *tables: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers ``f(tables) -> DataFrame`` under ``name``, with SQL over the named logical tables."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, path: rounded(f(Tables(spark, path)))
        if sql:
            SQL[name] = with_tables(sql, *tables, extra=extra)
        return f

    return add
