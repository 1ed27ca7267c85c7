"""Quality classifier by hierarchical empirical Bayes.

Boosted trees on form features of a text (repetition, case, symbols, word lengths, lines) give each
document's own probability of good quality. Sites share what their documents show: with the global
rate as the prior, each host gets a Beta posterior from the other documents of the host, and each path
one from the other documents of the path with the host's posterior as its prior. The prior strengths
are fitted by moments over all hosts and all paths, so sparse sites shrink towards the level above.
The quality of a document is its own log-odds plus the log-odds that its path stands above or below
the global rate, and a document is kept if that is at least ``threshold``.

The trees are fitted on at most ``most_labels`` labelled documents (those of smallest MD5 of doc_id);
all rates, counts and posteriors cover all documents.

Defined cases: null text counts as empty; a null host or path is a site of its own; without labels
every document's own probability is one half; repeated labels of a document count once, by the
smallest value; documents that share a labelled doc_id teach once, by the smallest features, and count
each time otherwise; a null doc_id has no label; an empty table gives no rows; other columns are ignored.
A site that holds many of the documents is dealt over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import durable, join_hot

SYMBOLS = re.compile(r"[^\w\s.,;:'\"!?()\-]")
RAISED = re.compile(r"[!?|*#%&$<>{}\[\]\\^~=_+/@]")
FEATURES = 14


def features(text: str | None) -> list[float]:
    t = text or ""
    words = t.split()
    n, c = max(1, len(words)), max(1, len(t))
    distinct = set(words)
    lines = [x for x in t.split("\n") if x]
    letters = sum(map(str.isalpha, t))
    return [
        float(np.log1p(len(words))), len(distinct) / n, len(set(zip(words, words[1:]))) / n, (c - len(words) + 1) / n,
        letters / c, sum(1 for w in words if w.isupper() and len(w) > 1) / n, len(SYMBOLS.findall(t)) / c, len(RAISED.findall(t)) / n,
        t.count(".") / n, t.count(",") / n, len(set(lines)) / max(1, len(lines)), sum(map(str.isdigit, t)) / c,
        words.count("|") / n, max((len(w) for w in distinct), default=0) / 10.0,
    ]


def fit_documents(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> gbdt.Trees | None:
    """Trees for the label ``quality``; only the features of a bounded sample reach the driver."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = marked.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most_labels)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, f array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "f": [features(t) for t in pdf["text"]]})

    # `some` has at most most_labels rows of two numbers, so texts stay where they are.
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInPandas(run, schema)
    rows = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("f").alias("f")).toPandas()
    if rows["quality"].nunique() < 2:
        return None
    x = np.stack(rows["f"].to_numpy()).astype(np.float32)
    order = np.lexsort(x.T)  # rows arrive in any order; sums must not depend on it
    return gbdt.fit(x[order], rows["quality"].to_numpy(float)[order], trees=40, depth=3)


def own_quality(model: gbdt.Trees | None, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(column), 0.5))
        logit = model.logit(np.array([features(t) for t in column], np.float32).reshape(len(column), FEATURES))
        return pd.Series(np.round(1 / (1 + np.exp(-logit)), 9))

    return score(text)


def _strength(groups: DataFrame, prior: Column, most: float = 1e4) -> float:
    """Prior documents of a Beta prior by moments: spread of group rates against what sampling explains."""
    rate = F.col("s") / F.col("n")
    row = groups.where("n >= 2").agg(
        F.count(F.lit(1)), F.sum("n").cast("double"), F.sum(F.col("n") * (rate - prior) ** 2), F.sum(prior * (1 - prior)), F.sum(F.col("n") * prior * (1 - prior))
    ).first()
    k, n, spread, sampled, pooled = (float(v or 0) for v in row)
    between = (spread - sampled) / n if n else 0.0
    return float(np.clip(pooled / n / between - 1, 1.0, most)) if between > 0 else most


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most_labels: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, own (document evidence), host_rate, path_rate (posteriors), quality, keep."""
    model = fit_documents(docs, labels, most_labels)
    scored = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("\0null")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0null")).alias("path"))
    scored = durable(scored.withColumn("own", own_quality(model)).drop("text"), "quality-own")
    # decimal sums: the same whatever the order of rows
    total = lambda c: F.sum(F.col(c).cast("decimal(12,9)")).cast("double")
    paths = durable(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("decimal(12,9)")).alias("d"), total("own").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("d").cast("double").alias("s"))
    all_n, all_s = hosts.agg(F.sum("n"), F.sum("s")).first()
    base = min(max((all_s or 0.0) / (all_n or 1), 1e-6), 1 - 1e-6)
    k_host = _strength(hosts, F.lit(base))
    host_post = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.lit(k_host * base) + F.col("s")) / (k_host + F.col("n"))).alias("hp"))
    joined = durable(paths.drop("d").join(host_post, "host"), "quality-sites")
    k_path = _strength(joined, F.col("hp"))
    sites = join_hot(scored, joined, ["host", "path"], "n", ["doc_id", "own"])
    # a document's own evidence is left out of what its site says about it
    host_rate = (F.lit(k_host * base) + F.col("hs") - F.col("own")) / (F.lit(k_host - 1.0) + F.col("hn"))
    path_rate = (F.lit(k_path) * F.col("host_rate") + F.col("s") - F.col("own")) / (F.lit(k_path - 1.0) + F.col("n"))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    odds = logit("own") + logit("path_rate") - F.lit(float(np.log(base / (1 - base))))
    shown = lambda c: F.when(F.col(c) != "\0null", F.col(c)).alias(c)
    return (
        sites.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .select("doc_id", shown("host"), shown("path"), "own", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("keep"))
    )
