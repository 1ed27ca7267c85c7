"""Best-fit packing by length patterns and non-negative least squares.

Documents become token ids (each ends with ``end_id``), those over ``capacity`` are cut into pieces,
and only the histogram of piece lengths, at most ``capacity`` counts, reaches the driver. There, few-document
patterns that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded within what is there, and the residual is packed best-fit
decreasing, all on counts. The result is a table of slots (length, ranks) -> (sequence, offset), whose
size depends on ``capacity`` alone; pieces get their rank within their length from distributed
prefix sums and look up their slot.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed separately;
an empty table gives no rows; very long texts give many pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, prefix_sums

# ---------------------------------------------------------------- tokens

#: Chunks of these characters only split into words by WORD exactly as the tokenizer splits them.
PLAIN = "^[\\x21-\\x7e\\x{a1}-\\x{17f}\\x{400}-\\x{45f}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{20a0}-\\x{20bf}]*$"
#: The pre-tokenizer's pattern (a fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of ``ids`` one after another, where each begins and the last one ends)."""
    place = np.r_[0, np.cumsum(size)]
    return ids[np.repeat(start - place[:-1], size) + np.arange(place[-1])], place


def _strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, which makes a scalar object of each value, but quicker."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of texts as little-endian 32-bit bytes. No token spans ASCII white space, so what stands between it
    (a chunk) is coded once for each run of texts: plain chunks by their words, the others each by itself.
    The ids of words are kept for the runs that follow."""

    #: Characters of text taken at once; a longer text is taken alone.
    AT_ONCE = 1 << 23
    #: Once more words than these are kept, the next run of texts starts anew.
    KEPT = 1 << 19

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer, normalizers

        # Spark's tasks use the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.plain = Tokenizer.from_file(tokenizer_file), Tokenizer.from_file(tokenizer_file)
        # a marker string inside a text is ordinary text
        self.whole.encode_special_tokens = self.plain.encode_special_tokens = True
        # plain chunks are lower-cased and split beforehand, which is all that normalizing changes in them
        self.plain.normalizer = normalizers.Sequence([])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.split = regex.compile(f"\n|{WORD}").findall
        self._forget()

    def _forget(self) -> None:
        # The line feed, which stands between chunks, is the first word and has no ids.
        self.words = {"\n": 0}
        self.kept, self.start, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str], at_once: int = 2000) -> None:
        lines = [" ".join(words[i : i + at_once]) for i in range(0, len(words), at_once)]
        ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(e.ids, "<u4") for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]])
        # The ids at which words end tell the words' ids apart.
        ends = np.r_[0, np.flatnonzero(self.last[ids]) + 1]
        if len(words) != len(ends) - 1:
            raise ValueError("the tokenizer splits words in another way")
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.start, self.size = np.r_[self.start, len(self.kept) + ends[:-1]], np.r_[self.size, np.diff(ends)]
        self.kept = np.r_[self.kept, ids]

    def _plain_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in turn, number of each chunk's ids)."""
        words = self.split("\n".join(chunks))
        if len(self.words) > self.KEPT:
            self._forget()
        self._learn(list(set(words).difference(self.words)))
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ids, place = _gather(self.kept, self.start[at], self.size[at])
        ends = place[np.r_[np.flatnonzero(at == 0), len(at)]]
        return ids, np.diff(np.r_[0, ends])[: len(chunks)]

    def ids(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.values.dictionary_encode()
        chunks = coded.dictionary
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        lower = pc.split_pattern(pa.array(["\n".join(_strings(chunks.filter(pa.array(plain)))).lower()], pa.string()), "\n").values[: plain.sum()].dictionary_encode()
        fast, fast_sizes = self._plain_ids(_strings(lower.dictionary))
        odd = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(_strings(chunks.filter(pa.array(~plain))), add_special_tokens=False)]
        ids = np.concatenate([fast, *odd])
        # Of each chunk, where its ids stand and how many they are: the plain ones by their lower case, then the others.
        odd_sizes = np.array([len(o) for o in odd], np.int64)
        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        of = lower.indices.to_numpy()
        start[plain], size[plain] = (np.cumsum(fast_sizes) - fast_sizes)[of], fast_sizes[of]
        start[~plain], size[~plain] = len(fast) + np.cumsum(odd_sizes) - odd_sizes, odd_sizes
        at = coded.indices.to_numpy()
        stream, place = _gather(ids, start[at], size[at])
        raw = stream.tobytes()
        bounds = (4 * place[lists.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def parts(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(first, end) of runs of texts to take at once."""
        first, held = 0, 0
        for i, text in enumerate(texts):
            if held and held + len(text) > self.AT_ONCE:
                yield first, i
                first, held = i, 0
            held += len(text)
        if first < len(texts):
            yield first, len(texts)


@functools.lru_cache(maxsize=1)
def word_ids(tokenizer_file: str) -> WordIds:
    """One for each Python worker, which Spark uses again for later tasks."""
    return WordIds(tokenizer_file)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    end = np.array([end_id], "<u4").tobytes()
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for first, last in words.parts(texts):
                rows: list[tuple] = []
                for row, ids in enumerate(words.ids(texts[first:last]), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                row, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row)), *map(pa.array, columns, kinds.values())], names=["doc_id", *kinds]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- patterns


def enumerate_patterns(counts: np.ndarray, capacity: int, per_length: int = 4) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill ``capacity``; ``counts`` is indexed by length."""
    here = np.flatnonzero(counts[:capacity])
    here = here[here > 0]
    if not len(here):
        return np.zeros((0, 4), np.int64)
    mass = np.cumsum(counts[here])
    # companions at even steps of the histogram's mass, another offset for every length
    offset = (here * 2654435761 % 4096) / 4096
    found = [np.stack([here, capacity - here, 0 * here, 0 * here], 1)]
    for j in range(per_length):
        b = here[np.searchsorted(mass, ((offset + j / per_length) % 1) * mass[-1], side="right").clip(0, len(here) - 1)]
        c = here[np.searchsorted(mass, ((offset * 7 + j / per_length) % 1) * mass[-1], side="right").clip(0, len(here) - 1)]
        found.append(np.stack([here, b, capacity - here - b, 0 * here], 1))
        found.append(np.stack([here, b, c, capacity - here - b - c], 1))
    rows = np.concatenate(found)
    rows = rows[(rows >= 0).all(1)]
    rows = np.sort(rows, axis=1)[:, ::-1]
    ok = (rows[:, 0] > 0) & ((rows == 0) | (counts[rows] > 0)).all(1)
    return np.unique(rows[ok], axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose documents come nearest the histogram, by accelerated projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    weight = np.where(counts > 0, 1 / np.maximum(counts, 1), 0.0)
    weight[0] = 0
    uses = np.bincount(patterns.ravel(), minlength=len(counts)).astype(float)
    size = weight[patterns].sum(1)
    # the row sums of A'WA bound its largest eigenvalue
    bound = np.max((weight * uses)[patterns].sum(1) + size) or 1.0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), np.repeat(y, 4), minlength=len(counts))
        slope = (weight * (made - counts))[patterns].sum(1)
        new = np.maximum(0, y - slope / bound)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (length, copies) runs, repeats)] that uses up ``counts`` (indexed by length)."""
    left = counts.astype(np.int64).copy()
    packed: list[tuple[list[tuple[int, int]], int]] = []
    if left[capacity]:
        packed.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    patterns = enumerate_patterns(left, capacity)
    repeats = fit_repeats(patterns, left)
    for i in np.lexsort((np.arange(len(patterns)), -repeats)):
        lengths, copies = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = min(int(np.floor(repeats[i] + 0.5)), int((left[lengths] // copies).min()))
        if n > 0:
            left[lengths] -= n * copies
            packed.append((list(zip(lengths.tolist(), copies.tolist()))[::-1], n))
    # Best fit, longest first, on counts: bins with equal contents are one group.
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        space = length
        while n and space <= capacity:
            if not room[space]:
                space += 1
                continue
            runs, bins = room[space].pop()
            each = min(space // length, n)
            use = min(bins, n // each)
            if use < bins:
                room[space].append([runs, bins - use])
            room[space - each * length].append([[*runs, (length, each)], use])
            n -= use * each
        each = capacity // length
        for copies, bins in ((each, n // each), (n % each, 1)):
            if copies and bins:
                room[capacity - copies * length].append([[(length, copies)], bins])
    return packed + [(runs, bins) for groups in room for runs, bins in groups]


def slot_table(packed: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """length, first and last (ranks, last excluded), copies, base (first sequence), at (offset)."""
    rows, used, base = [], {}, 0
    for runs, repeats in packed:
        at = 0
        for length, copies in runs:
            first = used.get(length, 0)
            used[length] = last = first + copies * repeats
            rows.append((length, first, last, copies, base, at))
            at += length * copies
        base += repeats
    return pd.DataFrame(rows, columns=["length", "first", "last", "copies", "base", "at"]).astype("int64")


def pack(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces of one length are ranked in about
    as many buckets as each then has pieces."""
    pieces = token_pieces(docs, tokenizer_file or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id)
    pieces = durable(pieces, "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row per length
        counts[row["length"]] = row["count"]
    buckets = max(1, int(np.sqrt(counts.max())))
    mark = F.xxhash64("doc_id", "piece", "ids_crc32")
    slots = slot_table(pack_histogram(counts, capacity))
    spark = docs.sparkSession
    shape = "length long, first long, last long, copies long, base long, at long"
    # At most about twice `capacity` groups of bins, each with under sqrt(2 * capacity) runs: a few MB.
    slots_df = spark.createDataFrame(slots, shape) if len(slots) else spark.createDataFrame([], shape)
    ranked = prefix_sums(pieces.withColumn("bucket", F.pmod(mark, F.lit(buckets))).withColumn("one", F.lit(1)), ["length"], "bucket", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "one", "rank")
    s = F.broadcast(slots_df.withColumnRenamed("length", "slot_length"))
    nth = F.col("rank") - F.col("first")
    return ranked.join(s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
