"""SimHash near-dedup by segment-popcount embedding.

A text's A-Z are lower-cased, its words are runs of non-space characters, its shingles are ``shingle``
consecutive words joined by one space (a shorter text is one shingle, a text without words has the
fingerprint zero). A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64
hashes. Texts link at ``distance`` or fewer differing bits; a component is what links reach.

Links come from a range join under the Manhattan distance of an embedding. A fingerprint is embedded
as the bit counts of its ``64 / width`` segments; the Manhattan distance of two embeddings never
exceeds the number of differing bits. The grid has ``groups`` axes of several segments each and one of
the total bit count. Two points within ``distance`` agree on at least ``groups - distance`` axes, so
they meet in a cell of one such choice of axes, and there their bit counts differ by at most
``distance``: points stand in strips of that width along the last axis, and only points of the same or
of neighbouring strips are compared. Pairs within the Manhattan distance are verified by their exact
number of differing bits, and only a spanning forest of a cell's links leaves it. Cells of over
``block`` points are dealt out as pairs of neighbouring strips (and of blocks of a strip), so no task
holds an unbounded cell. Copies share a fingerprint and are one point.

The number of axes follows the number of points (``axes_for``): more axes make finer cells and more
rows a point; every number over ``distance`` gives the same components.

Defined cases: null and empty texts have the fingerprint zero and link like others; repeated rows and
ties share a component; a null doc_id links too, and a component of such rows alone has a null
component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_hot

_WORDS = 1 << 18  # shingles hashed, or grid points compared, at a time
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[len(words) - n :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _WORDS):
        s, e = starts[at : min(n, at + _WORDS)].tolist(), ends[at : min(n, at + _WORDS)].tolist()
        hashes = np.fromiter((digest(flat[a:b], 42) for a, b in zip(s, e)), np.uint64, len(s))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and the columns ``keep``."""
    columns = ["doc_id", *keep]
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(fps.view(np.int64))], names=[*columns, "fp"])

    return docs.select(*columns, "text").mapInArrow(run, shape)


def embed(fp: np.ndarray, width: int) -> np.ndarray:
    """The bit counts of the segments of ``width`` bits (1, 2, 4 or 8), each written as that many low ones of its
    segment: the Manhattan distance of two embeddings is the number of bits in which they differ."""
    count = lambda byte, k: ((byte >> k) & ((1 << width) - 1)).bit_count()
    of_byte = np.array([sum(((1 << count(byte, k)) - 1) << k for k in range(0, 8, width)) for byte in range(256)], np.uint8)
    return of_byte[np.ascontiguousarray(fp).view(np.uint8)].view(np.uint64)


def axes_for(points: int, distance: int) -> int:
    """Grid axes that keep the work in cells near the number of rows: two more than ``distance``, and one more from ten million points, another from a billion."""
    return distance + 2 + (points > 10**7) + (points > 10**9)


def _cells(points: DataFrame, distance: int, width: int, groups: int) -> DataFrame:
    """(cell, strip, fp) once for each choice of ``groups - distance`` grid axes."""
    segments = np.array_split(np.arange(BITS // width), groups)
    masks = [sum(((1 << width) - 1) << (width * int(k)) for k in axis) for axis in segments]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            place, strip = embed(fp, width), np.bitwise_count(fp) // np.uint8(distance + 1)
            for c, chosen in enumerate(itertools.combinations(masks, groups - distance)):
                with np.errstate(over="ignore"):  # places may share a number: links are verified, so this only adds work
                    cell = (place & np.uint64(sum(chosen))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)
                    cell = (cell ^ (cell >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pd.DataFrame({"cell": (cell ^ (cell >> np.uint64(32))).view(np.int64), "strip": strip.astype(np.int32), "fp": pdf["fp"]})

    return points.mapInPandas(run, "cell long, strip int, fp long")


def _forest(fp: np.ndarray, place: np.ndarray, ones: np.ndarray, distance: int) -> tuple[list, list]:
    """Edges of a spanning forest of the links among the points of one cell, by breadth-first search; ``ones``
    (bit counts) ascend, so a point's partners stand within a range."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            lo, hi = np.searchsorted(ones[left], (ones[at] - distance, ones[at] + distance + 1))
            some = left[lo:hi]
            near = np.bitwise_count(place[some] ^ place[at]) <= distance
            near[near] = np.bitwise_count(fp[some[near]] ^ fp[at]) <= distance
            if near.any():
                found = some[near]
                a += [fp[at]] * len(found)
                b += fp[found].tolist()
                queue += found.tolist()
                left = np.concatenate([left[:lo], some[~near], left[hi:]])
    return a, b


def _cell_edges(cell: np.ndarray, fp: np.ndarray, distance: int, width: int, small: int = 48) -> tuple[list, list]:
    """Links within runs of equal ``cell``: small cells by shifted comparison, larger ones by search."""
    place, ones = embed(fp, width), np.bitwise_count(fp).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cell)])
    a: list = []
    b: list = []
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        by = s + np.argsort(ones[s : s + n], kind="stable")
        x, y = _forest(fp[by], place[by], ones[by], distance)
        a += x
        b += y
    keep = np.repeat(sizes <= small, sizes)
    cell, fp, place = cell[keep], fp[keep], place[keep]
    for d in range(1, int(sizes[sizes <= small].max(initial=1))):
        at = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(at):
            break
        at = at[np.bitwise_count(place[at] ^ place[at + d]) <= distance]
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        a += fp[at].tolist()
        b += fp[at + d].tolist()
    return a, b


def links(points: DataFrame, distance: int = 4, width: int = 2, groups: int | None = None, block: int = 4096) -> DataFrame:
    """Edges (a, b) between fingerprints that connect what fingerprints within ``distance`` connect.

    ``points``: distinct ``fp``; ``groups``: grid axes, by default from their number.
    """
    groups = groups or axes_for(points.count(), distance)
    if groups <= distance:
        raise ValueError("groups must exceed distance")
    cells = durable(_cells(points, distance, width, groups), "simhash-cells")
    large = cells.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    # A large cell's points stand in units (a, b) of two blocks, both of one strip or of strips side by side.
    own = F.expr("strip * parts + CAST(pmod(xxhash64(fp, 1), parts) AS INT)")
    last = BITS // (distance + 1)
    near = F.expr(f"sequence(greatest(0, strip - 1) * parts, (least({last}, strip + 1) + 1) * parts - 1)")
    units = F.transform(near, lambda o: F.least(o, F.col("own")).cast("long") * 1_000_000_000 + F.greatest(o, F.col("own")))
    dealt = (
        cells.join(large, "cell", "left")
        .withColumn("own", own)
        .withColumn("unit", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(units)))
        .select(F.when(F.col("unit") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "unit")).alias("cell"), "fp")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in itertools.chain(batches, [None]):
            held += [] if pdf is None else [pdf]
            if not held or (pdf is not None and sum(map(len, held)) < _WORDS):
                continue
            rows = pd.concat(held, ignore_index=True)
            goes_on = rows["cell"] == rows["cell"].iloc[-1] if pdf is not None else np.zeros(len(rows), bool)
            held, ready = [rows[goes_on]], rows[~goes_on]
            a, b = _cell_edges(ready["cell"].to_numpy(np.int64), ready["fp"].to_numpy(np.int64).view(np.uint64), distance, width)
            yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as grouped minima and joins;
    each round is written to the shared folder. Ends when a round changes nothing.
    """
    def star(a: str, b: str):
        return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")

    now = durable(edges.where("a <> b").select(*star("a", "b")).distinct(), "star")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(root, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = durable(small, "star")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, shingle: int = 4, distance: int = 4, width: int = 2, groups: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint), component_id (its smallest doc_id) and the columns ``keep``."""
    fps = durable(fingerprints(docs, shingle, keep), "simhash-fps")
    points = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-points")
    roots = components(links(points.select("fp"), distance, width, groups))
    whole = durable(points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    # Most components are one fingerprint; the others' smallest ids are found among their fingerprints.
    many = durable(whole.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")), "simhash-components")
    named = durable(join_hot(whole, many, ["root"], "members", ["fp"]).select("fp", "n", "root", "component_id"), "simhash-named")
    return join_hot(fps, named, ["fp"], "n", ["doc_id", *keep]).select("doc_id", "fp", "root", "component_id", *keep)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, width: int = 2, groups: int | None = None) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    return grouped(docs, shingle, distance, width, groups).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
