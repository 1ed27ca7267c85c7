"""Vector codes, periodic runs and exact top-k search against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeframe.llm import periods, pq, queries, topk

EMBEDDINGS = "vec_id long, embedding array<float>, label string, v int, d int, kind int, row int, l int, n int, h int, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, 2, 3, 4, 5, 6, 7, 8) for i, e, label in rows], EMBEDDINGS)


def random_rows(n, d, seed, label=lambda i: None if i % 3 == 0 else str(i % 2)):
    r = random.Random(seed)
    return [(i, [r.randrange(-40, 40) / 64 for _ in range(d)], label(i)) for i in range(n)]


# vector codes


def brute_codes(rows, entries=pq.ENTRIES, rounds=pq.ROUNDS):
    """Rows of (vec_id, vector, label) that can be coded: (vec_id, code, error), label errors, digest, by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[[math.floor(1024 * x) for x in e[p * len(e) // 4 : (p + 1) * len(e) // 4]] for p in range(4)] for _, e, _ in rows]
    books = [[x[p] for x in parts[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for x in parts:
                groups.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(g) for c in zip(*g)]
    final = [[near(x[p], books[p]) for p in range(4)] for x in parts]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(f for f, _ in x) for x in final]
    by_label = Counter()
    for (_, _, label), e in zip(rows, error):
        by_label[label] += e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in x), e, by_label[r[2]], sha) for r, x, e in zip(rows, final, error)), key=repr)


def codes(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_codes_against_loops(spark):
    rows = random_rows(330, 12, 4)
    rows += [(7, rows[7][1], "1"), (7, rows[9][1], "1"), (None, rows[3][1], None), (400, rows[3][1], "x")]
    bad = [(-1, None, "1"), (-2, [], "1"), (-3, [1.0] * 11, "1"), (1000, [1.0] * 8, "1"), (-4, [None] + [0.0] * 11, "1"), (-5, [float("nan")] * 12, "1"), (-6, [float("-inf")] * 12, "1")]
    assert codes(pq.compress(vectors(spark, rows + bad))) == brute_codes(rows)


def test_codes_of_few_and_none(spark):
    rows = random_rows(5, 4, 1) + [(9, [1e30, -1e30, 0.0, 5.0], "z")]
    got = codes(pq.compress(vectors(spark, rows)))
    assert len(got) == 6 and all(r[2] == 0 for r in got)
    assert pq.compress(vectors(spark, [])).count() == 0 and pq.compress(vectors(spark, [(1, None, "a")])).count() == 0


def test_one_label_and_one_vector_hold_most_rows(spark):
    rows = random_rows(60, 8, 2, lambda i: "hot") + [(100 + i, [0.25] * 8, "hot") for i in range(300)]
    assert codes(pq.compress(vectors(spark, rows))) == brute_codes(rows)


@pytest.mark.parametrize("size", [3, 300, 10**7])
def test_equal_average_search_is_exact(size):
    r = np.random.default_rng(size)
    x, e = r.integers(-size, size, (400, 6)), r.integers(-size, size, (70, 6))
    e[40:] = e[:30]  # ties
    far = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(2)
    index, best = pq.nearest(x, e)
    assert [int(b) for b in best] == [min(f) for f in far.tolist()] and index.tolist() == [f.index(min(f)) for f in far.tolist()]


def test_search_leaves_entries_out(monkeypatch):
    """Entries far off by their sum are not visited."""
    seen = []
    where = np.where
    monkeypatch.setattr(pq.np, "where", lambda c, a, b: (seen.append(np.shape(c)), where(c, a, b))[1])
    x = np.arange(2000).reshape(-1, 1) * np.ones((1, 4), np.int64)
    index, _ = pq.nearest(x, x[::20])
    assert index.tolist() == [min(range(100), key=lambda j: (abs(i - 20 * j), j)) for i in range(2000)]
    assert sum(a * b for a, b in seen) < 0.7 * 2000 * 100


# exact top-k


def brute_top(rows, k=5):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e, _ in rows]
    out = []
    for at, (q, a) in enumerate(v):
        if q is not None and q % 50 == 0:
            found = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for j, (i, b) in enumerate(v) if j != at and len(a) == len(b)]
            out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def top(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows_each", [7, 64, 4096])
def test_top_k_against_loops(spark, rows_each):
    rows = random_rows(260, 6, 8)
    rows += [(300 + i, rows[50][1], "copy") for i in range(40)] + [(None, rows[50][1], "null"), (50, rows[50][1], "again"), (50, rows[51][1], "same id")]
    rows += [(400, [0.0] * 6, "zero"), (450, [0.5] * 3, "short"), (451, [0.25] * 3, "short"), (500, [1.0], "alone")]
    bad = [(550, None, ""), (600, [], ""), (650, [None] * 6, ""), (700, [float("inf")] + [0.0] * 5, ""), (702, [float("nan")] * 6, "")]
    got = top(topk.top_k(vectors(spark, rows + bad), rows_each=rows_each, queries_each=4))
    assert got == brute_top(rows)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0], ""), (1, [3.0, -1.0], ""), (2, [2e6, 0.0], "")]
    assert top(topk.top_k(vectors(spark, rows))) == brute_top(rows)
    held = math.isqrt((1 << 62) // 2)
    assert top(topk.top_k(vectors(spark, [(0, [1e30, 0.0], ""), (1, [1e30, -1e30], "")]))) == [(0, 1, 1, held * held)]
    assert topk.top_k(vectors(spark, [])).count() == 0 and topk.top_k(vectors(spark, rows[1:])).count() == 0


def test_threshold_stops_before_all_rows():
    """Rows that cannot beat the kth best are not scored, and a block without such rows is left at once."""
    r = np.random.default_rng(1)
    v = r.integers(-5, 6, (4000, 4))
    v[:10] += np.array([200, 200, -200, 0])
    search = topk.Search(np.array([[3, 2, -1, 0]]), np.array([0]), 5)
    assert search.block(v, np.arange(1, 4001), np.zeros(4000, bool)) < 200
    assert search.block(r.integers(-5, 6, (4000, 4)), np.arange(5000, 9000), np.zeros(4000, bool)) == 0
    want = sorted((-int(s), i + 1) for i, s in enumerate(v @ [3, 2, -1, 0]))[:5]
    assert [(-int(s), int(i)) for s, i in zip(search.best.score[0], search.best.ids[0])] == want


# periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        t = 0
        while t + q < n:
            s = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            run = words[s : t + q]
            if len(run) >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((s, len(run), q))
            t += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periods(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if not rest:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, dropped = brute_runs(words), set()
    for s, length, q in runs:
        dropped |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def odd_texts(seed, n):
    r = random.Random(seed)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x " * 900, "  a  b", "a\x1cb a\x1cb " * 3]
    for _ in range(n):
        words = [r.choice("abcdefgh"[: r.choice([1, 2, 4, 8])]) + r.choice(["", "", "é"]) for _ in range(r.randrange(200))]
        for _ in range(r.randrange(3)):
            a, p = r.randrange(len(words) + 1), r.randrange(1, 40)
            for i in range(a + p, min(len(words), a + r.randrange(1, 9) * p)):
                words[i] = words[i - p]
        out.append(r.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("tile_words", [32, 100, periods.TILE_WORDS])
def test_runs_against_loops(spark, tile_words):
    rows = [(i, t) for i, t in enumerate(odd_texts(3, 120))]
    rows += [(7, rows[20][1]), (7, rows[21][1]), (7, rows[21][1]), (None, rows[22][1]), (None, "b c " * 5), ((1 << 60) + 7, rows[23][1])]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, row int, kind int, n int, period int, h int")
    got = periods.periodic_runs(docs, tile_words)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted((brute_periods(*r) for r in rows), key=repr)


def test_runs_of_empty_table_and_text_ids(spark):
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = periods.periodic_runs(spark.createDataFrame([("one", "a b " * 9)], "doc_id string, text string")).first()
    assert (got.doc_id, got.n_runs, got.start, got.length, got.period, got.exponent_milli) == ("one", 1, 0, 18, 2, 9000)


def test_tiles_see_every_run():
    """Long texts in small tiles give what one tile gives, with periods of every octave."""
    r = random.Random(9)
    for _ in range(40):
        x = np.array([r.randrange(1000) for _ in range(3000)])
        for _ in range(4):
            a, p = r.randrange(2500), int(2 ** r.uniform(0, 9))
            for i in range(a + p, min(len(x), a + r.randrange(3, 7) * p)):
                x[i] = x[i - p]
        want = [(q, lo, hi) for q, lo, hi in periods.stretches(x, np.array([len(x)])) if hi - lo + q >= max(6, 4 * q)]
        pieces = sorted(
            (q, lo + at, hi + at) for at, end, first, last in periods.tiles(len(x), 64)
            for q, lo, hi in periods.stretches(x[at:end], np.array([end - at]), first, last or None, (at > 0, end < len(x)))
        )
        found = []
        for q, lo, hi in pieces:
            if found and found[-1][0] == q and lo <= found[-1][2]:
                found[-1][2] = max(hi, found[-1][2])
            else:
                found.append([q, lo, hi])
        assert sorted(want) == [tuple(f) for f in found if f[2] - f[1] + f[0] >= max(6, 4 * f[0])]


def test_tiles_of_a_document_with_one_word(spark):
    docs = spark.createDataFrame([(3, "w " * 5000)], "doc_id long, text string")
    got = periods.periodic_runs(docs, 64).first()
    assert (got.n_runs, got.start, got.length, got.period, got.collapsed_sha256) == (1, 0, 5000, 1, hashlib.sha256(b"w").hexdigest())


def test_runs_of_whole_table(spark):
    from tests.conftest import SF

    got = queries.queries()["op12_periodic_runs"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where(F.length("text") < 9000).collect()
    have = {r.doc_id: tuple(r) for r in got.drop("n_words").collect()}
    assert len(have) >= 200 and all(have[d.doc_id] == brute_periods(d.doc_id, d.text) for d in docs)
