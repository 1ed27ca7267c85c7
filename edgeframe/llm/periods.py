"""Periodic runs of words by scale-tiled distribution.

A run of smallest period q and at least 4 * q words shows as a stretch of at least 3 * q words that equal
the word q further on. Periods are sought by octaves [P, 2 * P). A document is exploded into tiles for each
octave, 32 * P words long with 8 * P in common with the next (one set of tiles serves all octaves that fit,
and a document of at most ``tile_words`` is one tile); tiles are solved independently, wherever they are; the
stretches they find are shuffled by (document, period) and stitched where they meet or overlap. A stretch
that a tile's edge cuts below the length that shows lies whole in what the neighbour sees.

Within a tile every multiple of P is a boundary, and a boundary b has two Z-functions over the octave's shifts: how
far the words from b on, and those before b backwards, agree with the words q further on. Stretches of
3 * P - 1 words hold a boundary whose forward Z-value is at least 2 * P at their period, which hashes
of 2 * P words show for all shifts at once. By Fine and Wilf a boundary with two such shifts lies in a run of
a smaller period, which its own octave finds; so one shift is left, and its two Z-values follow from comparing
words, as neighbouring boundaries of one shift share them. Runs whose period has a smaller root are dropped
by comparing words. Hashes (64 bits) only choose what is compared.

Defined cases: null text is empty; an empty text has no run and the digest of an empty text; a null doc_id has
no planted period; repeated rows and ids are separate documents; an empty table gives no rows; other columns
are ignored. The rows of a document are told apart by a number that is written with them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

LEAST, TIMES = 6, 4
TILE_WORDS = 1 << 14
#: Length and overlap of a tile in units of P; at least 8 and 5.
_LONG, _SHARED = 32, 8
#: Words solved together, and bytes of texts that leave Python at once.
_TOGETHER, _AT_ONCE = 1 << 18, 1 << 23
_HEADER, _FRAGMENT, _TILE = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shifts(h: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary number, shift) of the boundaries whose hash stands at exactly one shift of the octave."""
    rows = -(-len(h) // p)
    if rows < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.zeros(rows * p, np.uint64)
    whole[: len(h)] = h
    same = whole.reshape(rows, p)[1:] == whole[::p][:-1, None]
    same[-1, len(h) - (rows - 1) * p :] = False
    at = np.flatnonzero(same)
    b, q = at // p, at % p + p
    alone = np.ones(len(b), bool)
    alone[1:] &= b[1:] != b[:-1]
    alone[:-1] &= b[1:] != b[:-1]
    return b[alone], q[alone]


def _has_root(x: np.ndarray) -> bool:
    """Whether ``x`` repeats a shorter word a whole number of times."""
    left, r = len(x), 2
    while left > 1:
        r = r if r * r <= left else left
        if left % r == 0:
            p = len(x) // r
            if np.array_equal(x[:-p], x[p:]):
                return True
            while left % r == 0:
                left //= r
        r += 1
    return False


def stretches(x: np.ndarray, sizes: np.ndarray, first: int = 1, last: int | None = None, cut: tuple[bool, bool] = (False, False)) -> list[tuple[int, int, int]]:
    """(period, from, to): words of ``x`` in that range equal those a period further on.

    ``x`` holds texts one after another, longest first (``sizes``), with no word in common. Octaves from
    ``first`` to ``last`` (powers of two). ``cut``: whether the text goes on before and behind; only then
    are short stretches at that edge returned.
    """
    ends = np.cumsum(sizes)
    h, p, out = _mix(x.astype(np.uint64) + np.uint64(1)), 1, []
    while last is None or p <= last:
        texts = int(np.searchsorted(-sizes, -max(TIMES * p, LEAST), "right")) if cut == (False, False) else len(sizes)
        m = int(ends[texts - 1]) if texts else 0
        if m < 3 * p:
            break
        h = h[:m]
        h = _mix(h[:-p] * np.uint64(0x9E3779B97F4A7C15) + h[p:])  # hashes of 2 * p words
        if p >= first:
            b, q = _shifts(h, p)
            new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1] + 1) | (q[1:] != q[:-1])]) if len(b) else []
            for i, j in zip(new, [*new[1:], len(b)]):
                shift, anchor = int(q[i]), int(b[i]) * p
                low, high = max(0, anchor - p), min(m - shift, int(b[j - 1] + 3) * p)
                other = np.flatnonzero(x[low:high] != x[low + shift : high + shift]) + low
                side = int(np.searchsorted(other, anchor))
                start = int(other[side - 1]) + 1 if side else low
                end = int(other[side]) if side < len(other) else high
                long = end - start >= max(LEAST - shift, (TIMES - 1) * shift)
                if (long or (cut[0] and start == 0) or (cut[1] and end + shift == m)) and not _has_root(x[start : start + shift]):
                    out.append((shift, start, end))
        p *= 2
    return out


def tiles(n: int, tile_words: int) -> Iterator[tuple[int, int, int | None, int]]:
    """(begin, end, first octave, last octave or 0 for all) of the tiles of a text of ``n`` words."""
    p, first = 1 << (max(1, tile_words // _LONG).bit_length() - 1), 1
    while _LONG * p < n:
        for at in range(0, n, (_LONG - _SHARED) * p):
            yield at, min(n, at + _LONG * p), first, p
            if at + _LONG * p >= n:
                break
        p = first = 2 * p
    yield 0, n, first, 0


def planted(n: int, h: int | None) -> np.ndarray | None:
    """The numbers of the original words that stand in their place, or None for all as they are."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


_SHAPE = "kind int, row long, id string, n long, body binary, collapsed string, period long, lo long, hi long, tile binary, first long, last long"
_COLUMNS = [c.split()[0] for c in _SHAPE.split(", ")]


def _scanned(tile_words: int):
    """Headers of all documents (with their words where runs may be), stretches of those of one tile, tiles of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = count(TaskContext.get().partitionId() << 33)
        waiting: list[tuple[int, str, list[bytes], np.ndarray]] = []

        def solved() -> Iterator[pd.DataFrame]:
            waiting.sort(key=lambda d: -len(d[3]))
            rows, size = [], 0
            sizes = np.array([len(d[3]) for d in waiting])
            ends = np.cumsum(sizes)
            short = int(np.searchsorted(-sizes, -tile_words, "left"))  # the first that is one tile
            begin = int(ends[short - 1]) if short else 0
            found = stretches(np.concatenate([d[3] for d in waiting[short:]]), sizes[short:]) if short < len(waiting) else []
            owners = np.searchsorted(ends, [begin + lo for _, lo, _ in found], "right")
            for (period, lo, hi), i in zip(found, owners.tolist()):
                base = int(ends[i] - sizes[i]) - begin
                rows.append((_FRAGMENT, waiting[i][0], None, None, None, None, period, lo - base, hi - base, None, None, None))
            some = set(owners.tolist()) | set(range(short))
            for i, (number, doc, words, x) in enumerate(waiting):
                body = b" ".join(words)
                if i not in some:
                    rows.append((_HEADER, number, doc, len(x), None, hashlib.sha256(body).hexdigest(), *[None] * 6))
                    continue
                rows.append((_HEADER, number, doc, len(x), body, *[None] * 7))
                size += len(body)
                if i < short:
                    x = (x - x.min()).astype("<i4")
                    for at, end, first, last in tiles(len(x), tile_words):
                        rows.append((_TILE, number, None, len(x), None, None, None, at, end, x[at:end].tobytes(), first, last))
                        size += 4 * (end - at)
                        if size > _AT_ONCE:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, size = [], 0
                if size > _AT_ONCE:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=_COLUMNS)

        ids, total = count(), 0
        for pdf in batches:
            for doc, text, h in zip(pdf["id"], pdf["text"], pdf["h"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                names: defaultdict[bytes, int] = defaultdict(ids.__next__)
                x = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
                order = planted(len(words), None if h < 0 else int(h))
                if order is not None:
                    words, x = [words[i] for i in order.tolist()], x[order]
                waiting.append((next(numbers), doc, words, x))
                total += len(words)
                if total >= _TOGETHER or len(waiting) >= 10_000:
                    yield from solved()
                    waiting.clear()
                    ids, total = count(), 0
        if waiting:
            yield from solved()

    return run


def _solve_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for row, n, at, end, first, last, data in zip(pdf["row"], pdf["n"], pdf["lo"], pdf["hi"], pdf["first"], pdf["last"], pdf["tile"]):
            x = np.frombuffer(data, "<i4").astype(np.int64)
            found = stretches(x, np.array([len(x)]), int(first), int(last) or None, (at > 0, end < n))
            rows += [(row, period, lo + at, hi + at) for period, lo, hi in found]
        yield pd.DataFrame(rows, columns=["row", "period", "lo", "hi"])


def _collapsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of the words that no run drops."""
    for pdf in batches:
        out = []
        for body, known, starts, periods, lengths in zip(pdf["body"], pdf["collapsed"], pdf["starts"], pdf["periods"], pdf["lengths"]):
            if body is not None and starts is not None and len(starts):
                words = bytes(body).split(b" ")
                # a word is dropped where more runs have begun (behind their first period) than ended
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.asarray(starts) + periods, 1)
                np.add.at(edge, np.asarray(starts) + lengths, -1)
                body = b" ".join([words[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0).tolist()])
            out.append(known if body is None else hashlib.sha256(body).hexdigest())
        yield pdf.drop(columns=["body", "starts", "periods", "lengths"]).assign(collapsed=out)


def stitch(fragments: DataFrame) -> DataFrame:
    """row, start, length, period of the runs, from stretches (row, period, lo, hi) that meet or overlap."""
    in_order = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1))
    joined = marked.withColumn("island", F.sum("new").over(in_order)).groupBy("row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    runs = joined.select("row", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def periodic_runs(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    text_id = F.col("doc_id").cast("string")
    given = docs.select(text_id.alias("id"), "text", F.coalesce(F.crc32(text_id), F.lit(-1)).alias("h"))
    # written once: numbers of rows stay, and texts without stretches (nearly all) go no further
    found = durable(given.mapInPandas(_scanned(tile_words), _SHAPE), "periods-found")
    shape = "row long, period long, lo long, hi long"
    cut = found.where(F.col("kind") == _TILE).select("row", "n", "lo", "hi", "first", "last", "tile").repartition("row", "first", "lo").mapInPandas(_solve_tiles, shape)
    runs = stitch(found.where(F.col("kind") == _FRAGMENT).select("row", "period", "lo", "hi").union(cut))
    best = F.max(F.struct("length", (-F.col("start")).alias("before"), (-F.col("period")).alias("lower"), "start", "period"))
    of_row = runs.groupBy("row").agg(F.count(F.lit(1)).alias("n_runs"), best.alias("best"), F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    headers = found.where(F.col("kind") == _HEADER).select("row", "id", F.col("n").alias("n_words"), "body", "collapsed")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    listed = F.coalesce(F.array_join(F.transform("runs", line), ""), F.lit(""))
    all_rows = headers.join(of_row, "row", "left").select(
        "id", "n_words", F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.sha2(listed, 256).alias("runs_sha256"), "body", "collapsed", F.col("runs.start").alias("starts"), F.col("runs.period").alias("periods"), F.col("runs.length").alias("lengths"),
    )
    shape = "id string, n_words long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed string"
    return all_rows.mapInPandas(_collapsed, shape).select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "n_runs", "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"), "runs_sha256", F.col("collapsed").alias("collapsed_sha256"),
    )
