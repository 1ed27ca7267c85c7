"""No operator loses or mixes rows: null and repeated ids, added columns of clashing names, hot keys."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from edgeframe.llm import common, langid, line_dedup, media, mixing, packing, quality, simhash, syncmers
from tests.llm.test_llm_ops import brute_components, brute_fingerprint, brute_lines

BIG = (1 << 60) + 7
TEXTS = ["a\nb\nc", "a\nb\nc", "x\ny\nz", "the same words here and there", "the same words here and there", None, "", "¿ ½ ² Ⅷ", "q\nr\ns", "a\nb\nc"]
IDS = [1, 5, 5, None, None, None, 7, 8, BIG, BIG + 1]


def odd_docs(spark):
    """Null ids, one id with different texts, ids beyond doubles, and columns that the code might use for itself."""
    rows = [(i, t, "en", "s" if n % 3 else None, None if t is None else len(t), n, n, n, n, n, n, n, n) for n, (i, t) in enumerate(zip(IDS, TEXTS))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 int, h1 int, taken int, size int, line_dedup int, row_k1 int, fp int, found int")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize(
    "op", [line_dedup.dedup_lines, line_dedup.cut_repeats, simhash.near_duplicates, langid.language_id, media.digest, syncmers.edited_pairs, mixing.mix, lambda d: quality.classify(d, d.selectExpr("doc_id", "k1 % 2 AS quality"), F.col("source"), F.col("lang"))]
)
def test_one_row_per_row(spark, op):
    assert ids(op(odd_docs(spark))) == Counter(IDS)


def test_packing_keeps_every_row(spark):
    got = packing.pack(odd_docs(spark)).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(IDS) and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_lines_by_row(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()]
    want = brute_lines(rows, long_words=None)
    assert sorted(got, key=repr) == sorted(((d, want[d, t]) for d, t in rows), key=repr)
    assert (5, "x\ny\nz") in got and (5, "") in got
    assert line_dedup.cut_repeats(docs).columns == [c for c in docs.columns if c != "line_dedup"] + ["line_dedup"]


def test_mixing_takes_from_null_ids(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert sum(r.taken for r in got if r.doc_id is None) > 0
    for source in (None, "s"):
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.5 and rows[0].source_size == sum(r.size for r in rows)
    few = mixing.mix(odd_docs(spark), key_digits=3).collect()  # finer ranges give the same
    assert sorted(map(repr, few)) == sorted(map(repr, got))


def test_und(spark):
    docs = odd_docs(spark)
    got = {(r.doc_id, r.lang_pred) for r in langid.language_id(docs).collect()}
    assert (8, "und") in got and (7, "und") in got and not any(r.held_out is None for r in langid.language_id(docs).collect())
    with pytest.raises(ValueError):
        langid.learn(docs, most_languages=0)


def test_trigrams_have_no_seams():
    text = "Über alles, señor " * 40
    whole = [b for part in langid.trigrams(text, 10**9) for b in part]
    assert [b for part in langid.trigrams(text, 7) for b in part] == whole and len(whole) == len(f" {text.lower()} ".encode()) - 2
    assert [list(p) for p in langid.trigrams("")] == []


def test_mixture_against_plain_em():
    """Shares and penalised choice against expectation-maximisation written out for one text."""
    import numpy as np

    r = np.random.default_rng(3)
    log_p = np.log(r.dirichlet(np.ones(1 << langid.BITS) * 0.05 + 1e-3, 3).T + 1e-9).astype(np.float32)
    model, text = langid.Model(["a", "b", "c"], log_p), "words of some kind " * 60
    bins = np.concatenate(list(langid.trigrams(text)))
    parts = [log_p[bins[i : i + 48]].sum(0, dtype=np.float64) for i in range(0, len(bins), 48)]

    def em(langs):
        share = [1 / len(langs)] * len(langs)
        for _ in range(12):
            post = []
            for p in parts:
                w = [s * np.exp(p[j] - max(p)) for s, j in zip(share, langs)]
                post.append([x / sum(w) for x in w])
            share = [sum(q[i] for q in post) / len(parts) for i in range(len(langs))]
        return share, sum(np.log(sum(s * np.exp(p[j] - max(p)) for s, j in zip(share, langs))) + max(p) for p in parts)

    every, _ = em([0, 1, 2])
    order = sorted(range(3), key=lambda j: -every[j])
    single = max(range(3), key=lambda j: sum(p[j] for p in parts))
    options = [(sum(p[single] for p in parts), {single: 1.0})]
    for size in (2, 3):
        share, fit = em(order[:size])
        options.append((fit - 2.0 * (size - 1) * np.log(len(parts) + 1), dict(zip(order[:size], share))))
    best = max(options, key=lambda o: o[0])[1]
    chosen, got = langid.infer([text], model)
    assert got[0] == pytest.approx(every, abs=1e-3) and chosen[0] == pytest.approx([best.get(j, 0.0) for j in range(3)], abs=1e-3)


@pytest.mark.parametrize("k", [2, 5, 24])
def test_sets_that_cannot_win_are_left_out(k):
    """The chosen sets of texts side by side against every size of set fitted for each text; the early end loses none."""
    import numpy as np

    r = np.random.default_rng(k)
    words = [[bytes(r.integers(97, 123, 4).astype(np.uint8)).decode() for _ in range(40)] for _ in range(k)]
    counts = np.zeros((1 << langid.BITS, k))
    for j in range(k):
        for bins in langid.trigrams(" ".join(r.choice(words[j], 4000))):
            counts[:, j] += np.bincount(bins, minlength=1 << langid.BITS)
    model = langid.Model([f"l{j:02}" for j in range(k)], np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << langid.BITS))).astype(np.float32))
    texts = [" ".join(" ".join(r.choice(words[j], 120)) for j in r.choice(k, int(r.integers(1, min(k, 6) + 1)), replace=False)) for _ in range(12)] + ["ab", "no word of any"]
    chosen, every = langid.infer(texts, model)
    sizes = set()
    for text, got, shares in zip(texts, chosen, every):
        bins = np.concatenate(list(langid.trigrams(text)))
        parts = np.array([model.log_p[bins[i : i + 48]].sum(0, dtype=np.float64) for i in range(0, len(bins), 48)])
        best, score = np.eye(k)[parts.sum(0).argmax()], parts.sum(0).max()
        order, top = np.argsort(-shares, kind="stable"), parts.max(1, keepdims=True)
        for size in range(2, k + 1):
            share = np.zeros(k)
            share[order[:size]] = 1 / size
            for _ in range(12):
                post = np.exp(parts - top) * share
                share = (post / post.sum(1, keepdims=True)).mean(0)
            fit = (np.log((np.exp(parts - top) * share).sum(1)) + top[:, 0]).sum() - 2.0 * (size - 1) * np.log(len(parts) + 1)
            if fit > score:
                best, score = share, fit
        np.testing.assert_allclose(got, best, atol=1e-3)
        sizes.add(int((best > 0.05).sum()))
    assert len(sizes) > 1


def test_runs_of_texts_stay_within_their_cells():
    texts = ["x" * n for n in (0, 10, 5000, 10, 10, 100_000, 3)]
    runs = list(langid._runs(texts, 20, cells=3000))
    assert [i for run in runs for i in run] == list(range(7)) and [5] in runs and list(langid._runs([], 4)) == []
    assert all(len(run) == 1 or sum(len(texts[i]) // 48 + 1 for i in run) * 20 <= 3000 for run in runs)


def test_quality_against_plain_bayes(spark):
    """The posteriors and the final probability by loops over documents, from the operator's own document scores."""
    import math

    rows = [(i, "fine words, well put. " * (i % 5 + 1) if i % 3 else "BAD!! " * 9, "en" if i % 2 else "de", f"h{i % 7 // 2}" if i % 11 else None, 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)], "doc_id long, quality int")
    got = quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    own = {r.doc_id: r.own for r in got}
    base = sum(own.values()) / len(own)

    def groups(key):
        out = {}
        for r in got:
            out.setdefault(key(r), []).append(own[r.doc_id])
        return out

    def strength(sites, prior):
        some = {k: v for k, v in sites.items() if len(v) >= 2}
        n = sum(map(len, some.values()))
        spread = sum(len(v) * (sum(v) / len(v) - prior(k)) ** 2 for k, v in some.items())
        between = (spread - sum(prior(k) * (1 - prior(k)) for k in some)) / n
        return min(max(sum(len(v) * prior(k) * (1 - prior(k)) for k, v in some.items()) / n / between - 1, 1.0), 1e4) if between > 0 else 1e4

    hosts, paths = groups(lambda r: r.host), groups(lambda r: (r.host, r.path))
    kh = strength(hosts, lambda k: base)
    post = {k: (kh * base + sum(v)) / (kh + len(v)) for k, v in hosts.items()}
    kp = strength(paths, lambda k: post[k[0]])
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        h, p = hosts[r.host], paths[r.host, r.path]
        host_rate = (kh * base + sum(h) - r.own) / (kh - 1 + len(h))
        path_rate = (kp * host_rate + sum(p) - r.own) / (kp - 1 + len(p))
        want = 1 / (1 + math.exp(-(logit(r.own) + logit(path_rate) - logit(base))))
        assert (r.host_rate, r.path_rate, r.quality) == pytest.approx((host_rate, path_rate, want), abs=1e-6) and r.keep == (r.quality >= 0.5)


def test_media_features_and_stored_forms(spark):
    """The feature string by its definition, and stored forms that other readers understand."""
    import io
    import math
    import wave

    docs = odd_docs(spark)
    for r in media.digest(docs).collect():
        if r.doc_id == BIG:
            raw = b"q\nr\ns" + b"\xff" * (576 - 5)
            mean = sum(raw) / len(raw)
            share = [raw.count(b) / len(raw) for b in set(raw)]
            want = f"mean={mean:.4f};sd={math.sqrt(sum((b - mean) ** 2 for b in raw) / len(raw)):.4f};entropy={-sum(p * math.log2(p) for p in share):.4f};rising={sum(a < b for a, b in zip(raw, raw[1:])) / (len(raw) - 1):.4f}"
            assert r.feature == f"{r.media_type};{want}"
    pay = bytes(range(256)) * 9
    with wave.open(io.BytesIO(media.encode(pay, "audio/wav"))) as w:
        assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == pay
    pgm = media.encode(pay, "image/x-portable-graymap")
    assert pgm.startswith(b"P5") and pgm.endswith(pay)
    assert all(media.decode(media.encode(pay, k), k) == pay for k in media.STORED)


def test_join_hot(spark):
    many = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    one = many.groupBy("k").count()
    got = common.join_hot(many, one, ["k"], "count", ["id"], most_hot=10, parts=4).collect()
    assert len(got) == 1000 and all(r["count"] == (334 if r.k == 0 else 1) for r in got)
    assert common.free(["a", "B_", "b"], "b") == "b__"


def test_pipeline_by_rows(spark):
    """Null and repeated ids and clashing columns through every stage, against brute force over rows."""
    docs, steps = odd_docs(spark), dict(cp.STAGES)
    columns = docs.columns
    key = lambda df: Counter((r.doc_id, r.text, r.k1) for r in df.collect())
    a = steps["language_id"](spark, docs, "")
    assert a.columns == columns and key(a) == Counter({(r.doc_id, r.text, r.k1): 1 for r in docs.collect() if r.text and any(map(str.isalpha, r.text))})
    b = steps["line_dedup"](spark, a, "").cache()
    want = brute_lines([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == columns and key(b) == Counter((r.doc_id, want[r.doc_id, r.text], r.k1) for r in a.collect())
    c = steps["simhash_near_dedup"](spark, b, "").cache()
    groups = {}
    roots = brute_components([(i, r.text) for i, r in enumerate(b.collect())])
    for i, r in enumerate(b.collect()):
        groups.setdefault(roots[i][1], []).append(r)
    assert c.columns == columns and c.count() == len(groups)
    for rows in groups.values():
        some = [r.doc_id for r in rows if r.doc_id is not None]
        assert sum(r in rows for r in c.collect()) == 1 and next(r for r in c.collect() if r in rows).doc_id == (min(some) if some else None)
    d = steps["mixing"](spark, c, "").cache()
    assert d.columns == columns
    words = sum(len((r.text or "").split()) for r in d.collect())
    assert words == sum(r.taken for r in mixing.mix(c).collect()) > 0
    e = steps["best_fit_packing"](spark, d, "").collect()
    assert sum(r.piece == 0 for r in e) == d.count()
    assert brute_fingerprint(None) == 0
