"""Trailing frames over long keys: ranges of (key, order) with the rows before them copied in front.

A window partitioned by a key alone puts all rows of that key into one task. Here the rows are cut into
ranges of (key, order) of about equal size, whatever the keys; each range of a key gets copies of the last
``n`` rows of the key that stand before it (its halo), from as many ranges as those lie in. A frame of at most
n rows back then sees what it would see in the whole key, and the window is partitioned by range and key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.stage import durable

ROWS_EACH = 100_000


def ranges_of(df: DataFrame, rows_each: int = ROWS_EACH) -> int:
    return max(1, -(-df.count() // rows_each))


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """``df`` in ``parts`` ranges of (keys, order), numbered by ``__range``, written once: cuts are sampled, so they must
    not be drawn again."""
    return durable(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def with_halo(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``rows`` of ``ranged`` and, marked by ``__halo``, copies of the ``n`` rows of the key before each range."""
    mine = ["__range", *keys]
    counts = rows.groupBy(*mine).agg(F.count(F.lit(1)).alias("__c"))
    # one row for each range of a key; every range listed has a row, so the next n ranges are enough
    by_key = Window.partitionBy(*keys).orderBy("__range")
    begins = F.sum("__c").over(by_key) - F.col("__c")
    after = F.collect_list(F.struct("__range", "__begins")).over(by_key.rowsBetween(1, n))
    reach = counts.withColumn("__begins", begins).withColumn("__after", after).withColumn("__ends", F.col("__begins") + F.col("__c")).select(*mine, "__ends", "__after")
    last = Window.partitionBy(*mine).orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("__back", F.row_number().over(last)).where(F.col("__back") <= n)
    copies = tails.join(reach, mine).withColumn("__to", F.explode(F.expr(f"filter(__after, a -> a.__begins - __ends + __back <= {n})")))
    copies = copies.withColumn("__range", F.col("__to.__range")).select(*rows.columns, F.lit(True).alias("__halo"))
    return rows.withColumn("__halo", F.lit(False)).unionByName(copies)


def trailing(df: DataFrame, keys: list[str], order: list[str], n: int, with_columns: Callable[[DataFrame, WindowSpec], DataFrame], rows_each: int = ROWS_EACH) -> DataFrame:
    """``with_columns(rows, window)`` where the window's frames look at most ``n`` rows back; a task holds about
    ``rows_each`` rows and their halo, whatever the keys. All rows of a table of one range are that range already.

    A range of fewer rows than n makes its rows halo of several ranges, so ranges should be much longer.
    """
    parts = ranges_of(df, rows_each)
    if parts == 1:
        return with_columns(df, Window.partitionBy(*keys).orderBy(*order))
    rows = with_halo(ranged(df, keys, order, parts), keys, order, n)
    return with_columns(rows, Window.partitionBy("__range", *keys).orderBy(*order)).where("NOT __halo").drop("__range", "__halo")
