"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.llm import langid, line_dedup, mixing, packing, simhash
from edgeframe.llm.common import durable, free, row_key, table
from edgeframe.llm.queries import LONG_LINE_WORDS


def _recounted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with n_chars, where there is one, of the text as it now is."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns that rows share if and only if they agree in all columns, and their names."""
    names = [free(docs.columns, c) for c in ("row_k1", "row_k2")]
    return docs.select("*", *[c.alias(n) for c, n in zip(row_key(*docs.columns), names)]), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, no letter); all others stay."""
    model = langid.learn(docs.where(f"NOT ({langid.HELD_OUT})"))
    found = free(docs.columns, "found")
    return docs.withColumn(found, langid.language_column(model)).where(f"{found}.lang_pred <> 'und'").drop(found)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated windows; n_chars follows the text."""
    return _recounted(line_dedup.cut_repeats(docs, long_line_words=LONG_LINE_WORDS), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id (then of the smallest row key; null last)."""
    keyed, (k1, k2) = _keyed(docs)
    rows = simhash.grouped(keyed, keep=(k1, k2))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", k1, k2)).alias("first")
    kept = rows.groupBy("root").agg(first).select(f"first.{k1}", f"first.{k2}")
    return keyed.join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as many times as the mix takes it whole; the one at a source's cut stands with its first words."""
    keyed, (k1, k2) = _keyed(docs)
    taken, size, nth = (free(keyed.columns, c) for c in ("taken", "size", "nth"))
    # Rows that agree in all columns are one row that is taken for all of them.
    amounts = mixing.mix(keyed, keep=(k1, k2)).groupBy(k1, k2).agg(F.sum("taken").alias(taken), F.max("size").alias(size)).where(F.col(taken) > 0)
    each = keyed.join(amounts, [k1, k2]).dropDuplicates([k1, k2])
    copies = each.withColumn(nth, F.explode(F.expr(f"sequence(1L, CAST(ceil({taken} / {size}) AS LONG))")))
    part = F.expr(f"CAST(least({size}, {taken} - ({nth} - 1) * {size}) AS INT)")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), 0), 1, part), " ")
    return _recounted(copies.withColumn("text", F.when(part == F.col(size), F.col("text")).otherwise(cut)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of best-fit packing; a document that the mix repeats is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Fingerprints, learned language models and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
