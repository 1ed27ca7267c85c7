"""Document fingerprints from closed syncmers, matched by position.

Every ``S``-byte word of the UTF-8 text is hashed; a ``K``-byte window is a closed syncmer if the
smallest of its inner words stands at one of its edges. Whether a window is chosen depends on its own
bytes alone, so equal passages give equal anchors wherever they stand. The fingerprint holds all
anchors of the text with their positions and grows with it. Anchors of two texts are matched one to
one by hash, repeated hashes in the order of their positions; the likeness is the share of matched
anchors in all anchors of both, and a shared passage is a run of matched anchors that keep their
distance.

Defined cases: null text is empty; an empty text has the empty fingerprint, like only to another
empty one; a text shorter than one window is an anchor by itself; documents of equal doc_id stand in
the order of their texts; a null doc_id comes after all others; a table of one document is its own next; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

S, K = 8, 16
_STEP = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
#: Stands for a null doc_id: the least long.
NO_ID = -(1 << 63)
#: Characters of fingerprints that leave Python at once.
_AT_ONCE = 1 << 23


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions, 64-bit hashes) of the closed syncmers of ``data``."""
    if len(data) < K:
        return (np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")], np.uint64)) if data else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    places, hashes = [], []
    for at in range(0, len(data) - K + 1, _STEP):
        part = np.frombuffer(data, np.uint8, min(_STEP + K - 1, len(data) - at), at)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, S)).view("<u8").ravel()
        h = _mix(words)
        n, w = len(part) - K + 1, K - S + 1
        low, span = h, 1
        while 2 * span <= w:  # minimum of every w words, by doubling
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[w - span : w - span + n])
        chosen = np.flatnonzero((h[:n] == low) | (h[w - 1 : w - 1 + n] == low))
        places.append(chosen + at)
        # the two outer words cover the window's bytes
        hashes.append(_mix(h[chosen] + h[chosen + w - 1] * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(places), np.concatenate(hashes)


def sketch(text: str) -> np.ndarray:
    """All anchors, ascending: the 32-bit hash above the 32-bit byte position."""
    at, h = anchors(text.encode("utf-8", "surrogatepass"))
    return np.sort((h & ~_LOW) | at.astype(np.uint64))


def as_text(s: np.ndarray) -> str:
    """Base64 of the anchors in order of position: a byte of the distance from the one before (at most K - S), four of the hash."""
    by_place = np.sort((s << _HALF) | (s >> _HALF))
    out = np.empty(len(s), [("gap", "u1"), ("hash", ">u4")])
    out["gap"] = np.diff(by_place >> _HALF, prepend=np.uint64(0))
    out["hash"] = by_place & _LOW
    return base64.b64encode(out.tobytes()).decode("ascii")


def _numbered(s: np.ndarray) -> np.ndarray:
    """Ascending: the hash above the number of its occurrence."""
    i = np.arange(len(s))
    h = s >> _HALF
    first = np.maximum.accumulate(np.where(np.diff(h, prepend=~h[:1]) != 0, i, 0))
    return (s & ~_LOW) | (i - first).astype(np.uint64)


def _find(needles: np.ndarray, sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``sorted_values``, whether the value there is the needle)."""
    place = np.minimum(np.searchsorted(sorted_values, needles), len(sorted_values) - 1)
    return place, sorted_values[place] == needles


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions in both texts of the anchors matched one to one."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, hit = _find(_numbered(a), _numbered(b))
    return (a[hit] & _LOW).astype(np.int64), (b[place[hit]] & _LOW).astype(np.int64)


def _near(a: np.ndarray, b: np.ndarray, matched: int) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return matched / (len(a) + len(b) - matched)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return _near(a, b, len(matches(a, b)[0]))


def _once(s: np.ndarray) -> np.ndarray:
    """The hashes that occur once."""
    h = s >> _HALF
    new = np.r_[True, h[1:] != h[:-1], True]
    return h[new[:-1] & new[1:]]


def compare(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """(likeness, matched anchors, bytes of the longest shared passage)."""
    x, y = matches(a, b)
    if not len(x):
        return _near(a, b, 0), 0, 0
    order = np.argsort(a & _LOW)
    h, at = a[order] >> _HALF, (a[order] & _LOW).astype(np.int64)
    shift = np.zeros(len(a), np.int64)
    place = np.searchsorted(at, x)
    shift[place] = y - x
    ok = np.zeros(len(a), bool)
    ok[place] = True
    # Of a hash that repeats, the occurrence on the line of the last or the next anchor of a single hash is the passage's.
    sure = place[np.isin(h[place], _once(a)) & np.isin(h[place], _once(b))]
    if len(sure) and len(sure) < len(x):
        sure.sort()
        repeats = np.setdiff1d(np.flatnonzero(np.isin(h, b >> _HALF)), sure)
        for step in (0, -1):  # the last one is looked at second and prevails
            line = shift[sure[np.clip(np.searchsorted(sure, repeats) + step, 0, len(sure) - 1)]]
            there = at[repeats] + line
            on = there >= 0
            on[on] = _find((h[repeats[on]] << _HALF) | there[on].astype(np.uint64), b)[1]
            shift[repeats[on]] = line[on]
            ok[repeats[on]] = True
    starts = np.flatnonzero(np.r_[True, (shift[1:] != shift[:-1]) | (ok[1:] != ok[:-1])])
    ends = np.r_[starts[1:], len(at)] - 1
    return _near(a, b, len(x)), len(x), int((at[ends] - at[starts])[ok[starts]].max()) + K


def _descending_runs(docs: DataFrame, rows_each: int, most_runs: int) -> DataFrame:
    """place (doc_id, the least number for null), text, run, ahead: documents dealt into runs that follow one another
    in descending doc_id. The first document of the next run stands at the end of each (``ahead`` = 1)."""
    ids = docs.select("place")
    n = ids.count()
    runs = max(1, min(most_runs, -(-n // rows_each)))
    cuts = ids.agg(F.percentile_approx("place", [i / runs for i in range(1, runs)], 100_000)).first()[0] if n and runs > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def run_of(place: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, place.to_numpy(np.int64)))

    own = docs.select("place", F.coalesce("text", F.lit("")).alias("text"), run_of("place").alias("run"))
    # At most `most_runs` rows: the largest doc_id of each run.
    heads = sorted((r["run"], r["top"]) for r in ids.select("place", run_of("place").alias("run")).groupBy("run").agg(F.max("place").alias("top")).collect())
    ahead = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    look = F.broadcast(docs.sparkSession.createDataFrame(ahead, "head long, before int"))
    places = F.expr("CASE WHEN before IS NULL THEN array(struct(run, 0 AS ahead)) ELSE array(struct(run, 0 AS ahead), struct(before AS run, 1 AS ahead)) END")
    dealt = own.join(look, F.col("place") == F.col("head"), "left").select("place", "text", F.explode(places).alias("p")).select("place", "text", "p.*")
    return dealt.repartitionById(len(bounds) + 1, F.col("run"))


def edited_pairs(docs: DataFrame, rows_each: int = 4096, most_runs: int = 10_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    matched anchors and bytes of the longest shared passage (at least one window where an anchor is
    shared) of each document against its edited text and the next document in descending doc_id. A task
    takes ``rows_each`` documents, more where that would make over ``most_runs`` tasks."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    dealt = _descending_runs(docs.select(place.alias("place"), "text"), rows_each, most_runs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "matched_edited", "passage_edited", "near_next", "matched_next", "passage_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the document that waits for its next: (doc_id, text, sketch)
        for pdf in batches:
            rows, chars = [], 0
            for doc_id, text, ahead in zip(pdf["place"], pdf["text"], pdf["ahead"]):
                if ahead and held is None:
                    continue
                mine = sketch(text)
                if held is not None:
                    before, old, fp = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    other = sketch(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((before, len(old), sha, as_text(fp), as_text(other), *compare(fp, other), *compare(fp, mine)))
                    chars += len(rows[-1][3]) + len(rows[-1][4])
                    if chars > _AT_ONCE:
                        yield pd.DataFrame(rows, columns=names)
                        rows, chars = [], 0
                held = None if ahead else (doc_id, text, mine)
            yield pd.DataFrame(rows, columns=names)

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, matched_edited long, passage_edited long, near_next double, matched_next long, passage_next long"
    ordered = dealt.sortWithinPartitions("ahead", F.desc("place"), "text")
    paired = ordered.select("place", "text", "ahead").mapInPandas(run, shape)
    return paired.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
