"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Components become floor(1024 * x); a vector is cut into 4 equal consecutive parts, and each part
position has a codebook of 256 entries, refined by rounds of assignment and floored means. The nearest
entry of a part is looked for among the entries in the order of their component sums: by Cauchy and
Schwarz, entries whose sum differs by g are at a squared distance of g * g / d at least (d components),
so the search starts at the part's own sum, goes outward on both sides, and ends on a side when
g * g > d * best. What is left out is strictly farther, so ties go to the lower index among all.

Every round reads the table again and sends only sums for each entry through the shuffle, at most
4 * 256 * (d + 1) numbers a task; those, and 256 rows for the start, are all that reaches the driver.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped, and so are
vectors whose length is not a positive multiple of 4 or not that of the kept row of the smallest vec_id
(null ids come last); rows of one vec_id are separate rows, ordered by their vectors; with fewer than 256
rows a codebook is smaller; null is a label of its own; components are held within 2**30 / d after
scaling, where all distances fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows searched together, and entries by which their window grows on one side.
_ROWS, _STEP = 512, 16


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of double) of the rows whose vectors can be coded."""
    v = F.col("embedding")
    # a null array or component makes the condition null, which drops the row
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0) & (F.size(v) % PARTS == 0)
    return vectors.where(good).select("vec_id", "label", v.cast("array<double>").alias("v"))


def whole(v: pd.Series) -> np.ndarray:
    """(rows, PARTS, d) integer components."""
    x = np.stack(v.to_numpy())
    d = x.shape[1] // PARTS
    most = 2**30 // d
    return np.clip(np.floor(x * SCALE), -most, most).astype(np.int64).reshape(len(x), PARTS, d)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of ``x``, ties to the lower index."""
    n, d = x.shape
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    kind = np.float64 if 8 * d * largest**2 < 2**53 else np.int64  # both exact
    order = np.argsort(entries.sum(1), kind="stable")
    sums, e = entries.sum(1)[order], entries[order].astype(kind)
    square = (e * e).sum(1)
    index, best = np.full(n, len(e)), np.full(n, np.iinfo(np.int64).max)
    own = x.sum(1)
    by_sum = np.argsort(own, kind="stable")
    for at in range(0, n, _ROWS):
        rows = by_sum[at : at + _ROWS]
        y = x[rows].astype(kind)
        mine, length = own[rows], (y * y).sum(1)
        near, which = best[rows], index[rows]

        def visit(of: np.ndarray, a: int, b: int) -> None:
            """Rows ``of`` meet the entries a to b of the order of sums."""
            far = (length[of, None] + square[a:b] - 2 * (y[of] @ e[a:b].T)).astype(np.int64)
            low = far.min(1)
            first = np.where(far == low[:, None], order[a:b], len(e)).min(1)
            nearer = (low < near[of]) | ((low == near[of]) & (first < which[of]))
            near[of[nearer]], which[of[nearer]] = low[nearer], first[nearer]

        left = max(0, int(np.searchsorted(sums, mine[0])) - 1)
        right = min(len(e), int(np.searchsorted(sums, mine[-1], "right")) + 1)
        visit(np.arange(len(rows)), left, right)
        while left > 0 or right < len(e):
            grown = False
            for below in (True, False):
                if left == 0 if below else right == len(e):
                    continue
                gap = mine - sums[left - 1] if below else sums[right] - mine
                of = np.flatnonzero(gap * gap <= d * near)
                if len(of):
                    a, b = (max(0, left - _STEP), left) if below else (right, min(len(e), right + _STEP))
                    visit(of, a, b)
                    left, right, grown = min(left, a), max(right, b), True
            if not grown:
                break
        best[rows], index[rows] = near, which
    return index, best


def _refined(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the floored mean of its parts."""
    k, d = books.shape[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((PARTS, k, d + 1), np.int64), False
        for pdf in batches:
            if not len(pdf):
                continue
            x, seen = whole(pdf["v"]), True
            for p in range(PARTS):
                index, _ = nearest(x[:, p], books[p])
                for j in range(d):
                    np.add.at(total[p, :, j], index, x[:, p, j])
                total[p, :, d] += np.bincount(index, minlength=k)
        if seen:
            p, entry, place = (a.ravel() for a in np.indices(total.shape))
            used = np.repeat(total[:, :, d].ravel() > 0, d + 1)
            yield pd.DataFrame({"part": p[used], "entry": entry[used], "place": place[used], "s": total.ravel()[used]})

    sums = parts.select("v").mapInPandas(run, "part int, entry int, place int, s long").groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # at most PARTS * ENTRIES * (d + 1) rows
    found = {(r.part, r.entry, r.place): int(r.s) for r in sums.collect()}
    new = books.copy()
    for (p, entry, place), s in found.items():
        if place < d:
            new[p, entry, place] = s // found[p, entry, d]
    return new


def train(parts: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """(PARTS, entries, d) codebooks of rows as ``kept`` returns them, all of one length; None without rows."""
    start = parts.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toPandas()["v"]
    if not len(start):
        return None
    books = np.ascontiguousarray(whole(start).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _refined(parts, books)
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error, label_error, codebooks_sha256."""
    good = kept(vectors)
    first = good.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).first()
    parts = good.where(F.size("v") == (first[0] if first else 0))
    books = train(parts, rounds, entries)
    sha = hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
    label = F.when(F.col("label").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("label").cast("string")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = whole(pdf["v"])
                found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
                codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
                yield pdf.drop(columns="v").assign(code=[c.tobytes().hex() for c in codes], error=sum(e for _, e in found))

    ids = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, l string"
    coded = durable(parts.withColumn("l", label).select("vec_id", "label", "l", "v").mapInPandas(run, f"{ids}, code string, error long"), "pq-codes")
    of_label = durable(coded.groupBy("l").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "pq-labels")
    return join_hot(coded, of_label, ["l"], "n", ["vec_id", "code"]).select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written one after another; vectors whose length is a multiple of 4 and that of the first."""
    steps = [f"""
WITH good AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
parts AS MATERIALIZED (
  SELECT rid, i // d AS part, i % d AS place, least(greatest(floor({SCALE} * embedding[i + 1]::DOUBLE), -({2**30} // d)), {2**30} // d)::BIGINT AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS i, len(embedding) // {PARTS} AS d, len(embedding) AS n FROM good)
  WHERE n = (SELECT len(embedding) FROM good WHERE rid = 1)
),
kept AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS nth FROM (SELECT DISTINCT rid FROM parts)),
book0 AS MATERIALIZED (SELECT part, nth AS entry, place, x AS c FROM parts JOIN kept USING (rid) WHERE nth < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT rid, part, min(far) AS far, arg_min(entry, (far, entry)) AS entry FROM (
    SELECT p.rid, p.part, b.entry, sum((p.x - b.c) * (p.x - b.c))::BIGINT AS far FROM parts p JOIN book{r} b USING (part, place) GROUP BY ALL) GROUP BY ALL
)""")
        if r < ROUNDS:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM near{r} JOIN parts USING (rid, part) GROUP BY ALL) m USING (part, entry, place)
)""")
    return ",".join(steps) + f""",
coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN good USING (rid)
"""


ORACLE = _oracle()
