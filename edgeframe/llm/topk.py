"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Components become floor(256 * x). Candidates are dealt over shelves by a hash of their vectors, every
shelf meets every query, and a task goes through a shelf in blocks: each block is sorted once for each
dimension, and each query reads the lists from the end that its component favours, level by level,
scoring what it has not met before. The sum of the products at the reached levels bounds all rows not
yet met; the query is done with a block when that bound is below its kth best score (not when it is equal: a
smaller vec_id may win a tie). The kth best score is carried from block to block, so a block that cannot
beat it is left after a first look at its largest components. The best of the shelves are ranked together.

Of equal vectors only the k + 1 smallest ids can be among any query's k best besides itself, so the others
of a group of copies are left out by a ranked window, which Spark applies before the shuffle as well.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; only
vectors of equal length are compared; rows that share a vec_id are separate candidates, and a query leaves
out one row of its own id and vector; a null vec_id is no query and comes last among ties; components are
held where scores fit a long; fewer than k candidates are all returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

SCALE = 256
#: Stands for a null vec_id: after all others.
_LAST = (1 << 63) - 1
#: Candidates of a block, and the first step down its lists.
BLOCK, _LEVEL = 4096, 8


class Best:
    """The k best (score descending, vec_id ascending) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.null: list[np.ndarray] = [np.zeros(0, bool)] * queries

    def floor(self, q: int) -> int | None:
        """The kth best score, if there are k."""
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else None

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        low = self.floor(q)
        if low is not None:
            some = score >= low
            score, ids, null = score[some], ids[some], null[some]
        if len(score) > self.k:  # ties at the cut stay in
            some = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, null = score[some], ids[some], null[some]
        score, ids, null = np.r_[self.score[q], score], np.r_[self.ids[q], ids], np.r_[self.null[q], null]
        top = np.lexsort((null, ids, -score))[: self.k]
        self.score[q], self.ids[q], self.null[q] = score[top], ids[top], null[top]


class Block:
    """Candidates with one list for each dimension, ascending."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, null: np.ndarray):
        self.v, self.ids, self.null = v, ids, null
        self.lists = np.argsort(v, axis=0, kind="stable").T  # (dimension, place): row
        self.values = np.take_along_axis(v, self.lists.T, 0).T

    def search(self, q: np.ndarray, best: Best, at: int, own: int | None) -> int:
        """Adds what belongs to the best of query ``at``; the candidates that were scored."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        up = q[dims] > 0
        met = np.zeros(n, bool)
        if own is not None:
            met[own] = True
        level, scored = 0, 0
        while True:
            # the next value of each list, from the end that the query favours
            bound = int(q[dims] @ np.where(up, self.values[dims, n - 1 - level], self.values[dims, level]))
            low = best.floor(at)
            if low is not None and bound < low:
                return scored
            # without a component every row scores zero, so all are met at once
            to = min(n, level * 2 + _LEVEL) if len(dims) else n
            new = np.zeros(n, bool) if len(dims) else ~met
            new[self.lists[dims[up], n - to : n - level].ravel()] = True
            new[self.lists[dims[~up], level:to].ravel()] = True
            rows = np.flatnonzero(new & ~met)
            met[rows] = True
            scored += len(rows)
            best.add(at, (self.v[rows] @ q).astype(np.int64), self.ids[rows], self.null[rows])
            if to == n or met.all():
                return scored
            level = to


class Search:
    """The k best of each query over blocks that come one after another; one row of a query's own id and vector is left out."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids = queries, query_ids
        self.best, self.own_met = Best(len(queries), k), np.zeros(len(queries), bool)
        self.largest = int(np.abs(queries).max(initial=0))
        self.of_id: dict[int, list[int]] = {}
        for i, x in enumerate(query_ids.tolist()):
            self.of_id.setdefault(x, []).append(i)

    def block(self, v: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
        """The candidates that were scored, summed over queries."""
        largest = max(self.largest, int(np.abs(v).max(initial=0)))
        kind = np.float64 if v.shape[1] * largest**2 < 2**53 else np.int64  # both exact
        block = Block(v.astype(kind), ids, null)
        own: dict[int, int] = {}
        for row in np.flatnonzero(np.isin(ids, self.query_ids) & ~null).tolist():
            for i in self.of_id[int(ids[row])]:
                if not self.own_met[i] and np.array_equal(v[row], self.queries[i]):
                    own[i], self.own_met[i] = row, True
        return sum(block.search(q, self.best, i, own.get(i)) for i, q in enumerate(self.queries.astype(kind)))


def _searched(k: int, block_rows: int):
    """Rows ordered by (task, d, kind): the queries (kind 0) of a task come before its candidates."""

    def result(search: Search | None, rows: list[int]) -> Iterator[pd.DataFrame]:
        if search is not None and len(rows):
            best = search.best
            n = [len(s) for s in best.score]
            ids = pd.Series(np.concatenate(best.ids), dtype="Int64").mask(np.concatenate(best.null))
            yield pd.DataFrame({"row": np.repeat(rows, n), "query_id": np.repeat(search.query_ids, n), "vec_id": ids, "score": np.concatenate(best.score)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, search, rows = None, None, []
        asking: list[pd.DataFrame] = []
        waiting: list[pd.DataFrame] = []

        def meet() -> None:
            part = pd.concat(waiting) if len(waiting) > 1 else waiting[0]
            waiting.clear()
            null = part["vec_id"].isna().to_numpy()
            search.block(np.stack(part["v"].to_numpy()), part["vec_id"].fillna(_LAST).to_numpy(np.int64), null)

        for pdf in batches:
            for key, group in pdf.groupby(["task", "d"], sort=True):
                if key != at:
                    if waiting and search is not None:
                        meet()
                    yield from result(search, rows)
                    at, search, rows = key, None, []
                    asking.clear()
                    waiting.clear()
                mine = group[group["kind"] == 0]
                if len(mine):
                    asking.append(mine)
                others = group[group["kind"] == 1]
                if not len(others) or not asking:
                    continue  # no query of this length
                if search is None:
                    q = pd.concat(asking)
                    rows = q["row"].tolist()
                    search = Search(np.stack(q["v"].to_numpy()), q["vec_id"].to_numpy(np.int64), k)
                for first in range(0, len(others), block_rows):
                    waiting.append(others.iloc[first : first + block_rows])
                    if sum(map(len, waiting)) >= block_rows:
                        meet()
        if waiting and search is not None:
            meet()
        yield from result(search, rows)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, rows_each: int = BLOCK, most_shelves: int = 4096, queries_each: int = 1 << 15) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose vec_id is divisible by ``every``.

    A shelf holds about ``rows_each`` candidates, more where that would make over ``most_shelves``; a task
    holds at most ``queries_each`` queries and one block.
    """
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(e) > 0)
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size(e)))
    v = F.transform(e, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE).cast("double"), -most), most).cast("long"))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("row", F.monotonically_increasing_id())
    rows = durable(rows, "topk-vectors")
    ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy("h", "v").orderBy(F.asc_nulls_last("vec_id"))))
    candidates = ranked.where(F.col("copy") <= k + 1)
    queries = rows.where(F.col("vec_id") % every == 0)
    n, asked = rows.count(), queries.count()
    shelves, chunks = max(1, min(most_shelves, -(-n // rows_each))), max(1, -(-asked // queries_each))
    # vectors of one length share a task's blocks
    shelf = F.pmod(F.xxhash64("h", F.lit("shelf")), F.lit(shelves)).cast("int")
    chunk = F.pmod(F.xxhash64("row", F.lit("chunk")), F.lit(chunks)).cast("int")
    each = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    asking = queries.select(F.lit(0).alias("kind"), "row", "vec_id", "v", each(shelves).alias("shelf"), chunk.alias("chunk"))
    asked_of = candidates.select(F.lit(1).alias("kind"), "row", "vec_id", "v", shelf.alias("shelf"), each(chunks).alias("chunk"))
    dealt = asking.union(asked_of).withColumn("task", F.col("chunk") * shelves + F.col("shelf")).withColumn("d", F.size("v"))
    dealt = dealt.repartitionById(shelves * chunks, F.col("task")).sortWithinPartitions("task", "d", "kind")
    found = dealt.select("task", "d", "kind", "row", "vec_id", "v").mapInPandas(_searched(k, rows_each), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS rid FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""
