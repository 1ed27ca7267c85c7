"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

A document's size is its number of words (runs of non-space characters). Sources, ordered by code
point with null last, weigh 1, 2, 3, repeating, and share the total of all sizes by weight; a target
stops at ``max_epochs`` times its source's size, and the excess is reshared by weight until no target
is above. Within a source, documents stand in the order of a random key (an MD5 of doc_id), prefix
sums of their sizes say where each begins, and the source is cut at its budget: whole epochs first,
then the words before the cut; the document at the cut gives the part before it. Keys depend on
doc_id alone (documents that share one stand by size and text), so reruns agree.

Defined cases: null text has size 0; null is a source of its own; a null doc_id is an id like any
other; documents of size 0 take 0; repeated rows are separate documents side by side; an empty table
gives no rows; other columns are ignored. A source is never held by one task: its keys are split into
about as many ranges as each then has documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, prefix_sums

WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(src, source_size, target) of each source of ``sizes`` (src, size)."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    per = durable(per.withColumn("one", F.lit(1)).withColumn("head", F.substring("src", 1, 3)), "mix-sources")
    place = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    per = durable(prefix_sums(per, [], "head", [F.col("src")], "one", "nth").withColumn("weight", place), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    stop, level = F.col("source_size") * max_epochs, None
    share = F.lit(False)
    # Only sums over all sources reach the driver; each round stops at least one more source.
    while True:
        capped, weight = per.agg(
            F.coalesce(F.sum(F.when(share, stop)), F.lit(0)), F.coalesce(F.sum(F.when(~share, F.col("weight"))), F.lit(0))
        ).first()
        if (capped, weight) == level or not weight:
            break
        level = (capped, weight)
        # target above the stop: weight * (total - capped) / weights left > stop, in whole numbers
        share = F.col("weight").cast("decimal(38,0)") * F.lit(total - capped).cast("decimal(20,0)") > stop.cast("decimal(20,0)") * F.lit(weight).cast("decimal(18,0)")
    capped, weight = level or (0, 1)
    free = F.col("weight") * F.lit(float(total - capped)) / F.lit(float(weight or 1))
    return per.select("src", "source_size", F.least(stop.cast("double"), free).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, key_digits: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), start (words before it in its
    source), and the columns ``keep`` of ``docs``. ``key_digits`` makes 16 to that power ranges, by default from the counts."""
    sized = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        F.xxhash64("text").alias("same"),
        F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
    )
    sized = durable(sized, "mix-sizes")
    most = sized.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    digits = key_digits or next(d for d in range(1, 16) if 16 ** (2 * d) >= most)
    placed = prefix_sums(sized.withColumn("range", F.substring("key", 1, digits)), ["src"], "range", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("same")], "size", "start")
    budget = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.least("size", F.greatest(F.lit(0).cast("long"), rest - F.col("start")))
    out = placed.join(source_targets(sized, weights, max_epochs), "src").withColumn("budget", budget).withColumn("epochs", epochs.cast("long"))
    return out.select(
        "doc_id", F.when(F.col("src") != "1", F.expr("substring(src, 2)")).alias("source"), "size", "source_size", "target",
        taken.cast("long").alias("taken"), F.col("start").cast("long").alias("start"), *[F.col(f"kept.{c}").alias(c) for c in keep],
    )


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents
),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM per),
sums AS (
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0)::DOUBLE AS stopped, total_w - coalesce(sum(weight) OVER w, 0)::DOUBLE AS left_w
  FROM (SELECT *, sum(weight) OVER ()::DOUBLE AS total_w FROM ranked)
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT arg_min((total - stopped) / left_w, 3.0 * source_size / weight) FILTER (WHERE weight * (total - stopped) / left_w <= 3 * source_size) AS x FROM sums),
targets AS (SELECT source, source_size, least(3.0 * source_size, coalesce(weight * x, 3.0 * source_size))::DOUBLE AS target FROM ranked, level),
placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
epoch AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
  (epochs * size + least(size, greatest(0, budget - epochs * source_size - start)))::BIGINT AS taken, start
FROM epoch
"""
