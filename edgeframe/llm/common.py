"""Shared helpers of the training-data operators: row keys, free names, salted prefix sums, joins to hot keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import durable

__all__ = ["durable", "free", "join_hot", "prefix_sums", "row_key", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column (names differ by more than case) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def row_key(*columns: str) -> list[Column]:
    """Two columns k1, k2 (128 bits, never null): rows share them if and only if they agree in ``columns``.

    A null and an empty text differ: what is null is hashed too.
    """
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("k2"), *reversed(parts)).alias("k2")]


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column], weight: str, out: str) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``keys``, in (bucket, order) order.

    ``bucket`` splits each key into pieces that sort before one another, so no task ever holds a
    whole key: each piece is summed alone and shifted by the total of the pieces before it. ``keys``
    and ``bucket`` must not be null. ``df`` is read twice: pass a durable one.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("__total"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(shifts, [*keys, bucket]).withColumn(out, F.col("__local") + F.col("__shift")).drop("__local", "__shift")


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], rows: str, spread: list[str], most_hot: int = 1000, parts: int = 64) -> DataFrame:
    """Inner join of ``many`` to ``one``, which has one row for each key; ``rows`` counts the key's rows in ``many``.

    A key with over 1 / ``most_hot`` of all rows is hot; there are fewer than ``most_hot`` of those, so
    they are broadcast. Rows of a hot key are dealt into ``parts`` by a hash of ``spread``, and its
    row of ``one`` is repeated for each part. ``one`` is read three times: pass a durable one.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0
    hot = one.where(F.col(rows) * most_hot > total).select(*keys, F.lit(True).alias("__hot"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")).otherwise(0)).drop("__hot")
    last = F.when(F.col(rows) * most_hot > total, parts - 1).otherwise(0)
    return dealt.join(one.withColumn("__part", F.explode(F.sequence(F.lit(0), last))), [*keys, "__part"]).drop("__part")
