"""The training-data operators against brute force, SQL and defined edge cases."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from edgeframe.llm import chat, langid, line_dedup, media, mixing, packing, quality, simhash, syncmers
from edgeframe.llm import queries as Q

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, covered string, bucket int"


def edge_docs(spark, rows=None):
    texts = [None, "", " \n\t", "one line", "one line", "a\nb\nc\nd", "x\na\nb\nc\ny", LONG, LONG, "Ünïcode ŞĞ ¿ 你好 \x00 end", "!!! ### 123"]
    data = rows if rows is not None else [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), 7, 7, "c", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SHAPE)


def same(a, b, key, places=9):
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (a, b))
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=10**-places, equal_nan=True)
        else:
            assert a[c].astype(object).where(a[c].notna(), None).tolist() == b[c].astype(object).where(b[c].notna(), None).tolist(), c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    keys = [["conv_id"], ["query_id", "rank"], ["vec_id"], ["doc_id"]]
    same(got, want, next(k for k in keys if set(k) <= set(got.columns)))


# ---------------------------------------------------------------- 1


def brute_lines(rows, window=3, long_words=50):
    """(doc_id, text) -> text after the cut, by listing all places of all windows."""
    where, solid_of = {}, {}
    for row in set(rows):
        solid = solid_of[row] = [(i, s.rstrip(" \t\n\r\v\f")) for i, s in enumerate((row[1] or "").split("\n")) if s.strip(" \t\n\r\v\f")]
        if 0 < len(solid) < window:
            where.setdefault(("all", *[s for _, s in solid]), []).append((row, 0, len(solid)))
        for k in range(len(solid)):
            for m in range(1, window + 1):
                part = [s for _, s in solid[k : k + m]]
                if len(part) == m and (m == window or long_words is not None and sum(len(s.split()) for s in part) > long_words):
                    where.setdefault((m, *part), []).append((row, k, m))
    cut = {}
    for places in where.values():
        ids = sorted({(row[0] is not None, row[0]) for row, _, _ in places})
        first = min(p for p in places if (p[0][0] is not None, p[0][0]) == ids[0])
        for row, k, m in places:
            if (row, k) != first[:2]:
                cut.setdefault(row, set()).update(i for i, _ in solid_of[row][k : k + m])
    return {row: None if row[1] is None else "\n".join(s for i, s in enumerate(row[1].split("\n")) if i not in cut.get(row, ())) for row in set(rows)}


def lines_of(docs, **kw):
    """{doc_id: text} of the cut documents, and of brute force."""
    want = {row[0]: text for row, text in brute_lines([(r.doc_id, r.text) for r in docs.collect()], long_words=kw.get("long_line_words")).items()}
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, **kw).collect()}, want


@pytest.mark.parametrize("long", [None, 50])
def test_line_dedup_edges(spark, long):
    docs = edge_docs(spark)
    got, want = lines_of(docs, long_line_words=long)
    assert got == want
    assert got[0] is None and got[4] == "" and got[3] == "one line" and got[6] == "x\ny" and got[8] == ""
    assert line_dedup.cut_repeats(docs).columns == [*docs.columns, "line_dedup"]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(docs.union(docs)).collect()
    assert len(twice) == 2 * len(got) and {(r.doc_id, r.text) for r in twice} == set(got.items())


def test_line_dedup_two_line_passages(spark):
    a, b = " ".join(f"a{i}" for i in range(43)), " ".join(f"b{i}" for i in range(49))
    small, whole = "c " * 25, "d " * 25 + "d"
    texts = [f"one\n{a}\n\n{b} \ntwo\nthree", f"four\nfive\n{a}\n{b}\nsix", f"{a}\n{b}", f"x\n{small}\n{small}e\ny", f"z\n{small}\n{small}e\nw", f"v\n{small}\n{whole}\nu", f"q\nr\n{small}\n{small}"]
    docs = edge_docs(spark, [(i, t, "en", "s", len(t), 7, 7, "c", 1) for i, t in enumerate(texts)])
    got, want = lines_of(docs, long_line_words=50)
    assert got[0] == texts[0] and got[1] == "four\nfive\nsix" and got[2] == ""
    assert got[4] == "z\nw" and got[5] == texts[5] and got[6] == texts[6]  # 50 words are not over 50
    assert got == want
    plain, want = lines_of(docs)
    assert plain == want and plain[1] == texts[1] and plain[4] == texts[4]


def test_line_dedup_against_brute_force(spark):
    got, want = lines_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), long_line_words=50)
    assert got == want


# ---------------------------------------------------------------- 3


def pack_brute(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out = []
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(r.doc_id, i, i * 4096, min(4096, len(ids) - i * 4096), zlib.crc32(ids[i * 4096 : (i + 1) * 4096].tobytes())) for i in range(-(-len(ids) // 4096))]
    return out


@pytest.mark.parametrize("kind", ["edges", "documents"])
def test_packing(spark, kind):
    docs = edge_docs(spark) if kind == "edges" else spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs).toPandas()
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(pack_brute(spark, docs))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / 4096) + 2


def test_packing_none(spark):
    assert packing.pack(edge_docs(spark, [])).count() == 0
    docs = edge_docs(spark)
    twice = packing.pack(docs.union(docs)).toPandas()
    assert twice.groupby("sequence_id").length.sum().max() <= 4096 and not twice.duplicated(["sequence_id", "offset"]).any()


@pytest.mark.parametrize("kept", [0, 30, 1 << 19])
@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_word_ids(at_once, kept):
    """Ids by distinct chunks are those of the tokenizer, whatever the runs of texts and however many words stay known."""
    import public_tokenizers

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.AT_ONCE, words.KEPT = at_once, kept
    r = np.random.default_rng(at_once)
    bits = ["don't", "'S", "we'll", "O''s", "a_b", "9", "42x", "ß", "Ĳ", "İ", "ŉ", "×", "…", "--", "<|endoftext|>", "</w>", " ", "\t", "\n", "\r\n", "Ünï", "s" * 300, ".,", "'"]
    bits += ["¿", "¡", "«hola»", "€5", "£", "Σίσυφος", "ΑΣ", "Σ"]
    rare = ["\u3000", "你好", "\x1c", "e\u0301", "²", "\x00", "\u00a0", "😀"]
    texts = ["".join(r.choice(bits + rare * int(i % 4 == 0), r.integers(0, 30))) for i in range(300)]
    got = [ids for a, b in words.parts(texts) for ids in words.ids(texts[a:b])]
    assert got == [np.array(words.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(words.parts([])) == [] and words.ids([]) == []


@pytest.mark.parametrize("seed", range(6))
def test_pack_histogram(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(256, r.lognormal(3, 1.3, 3000).astype(int) + 1), minlength=257)
    used, bins = np.zeros(257, int), 0
    for runs, n in packing.pack_histogram(counts, 256):
        assert sum(a * b for a, b in runs) <= 256 and n > 0
        bins += n
        for length, copies in runs:
            used[length] += copies * n
    assert (used == counts).all()
    low = max(np.ceil((counts * np.arange(257)).sum() / 256), counts[129:].sum())
    assert bins <= 1.01 * low + 1


# ---------------------------------------------------------------- 4


def test_quality(spark):
    got = Q.op4_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().drop_duplicates("doc_id")
    m = got.merge(labels, on="doc_id", suffixes=("", "_label"))
    assert len(got) == 200 and (m.keep == (m.quality_label == 1)).mean() > 0.9 and got.quality.between(0, 1).all()


def test_quality_shrinks(spark):
    from pyspark.sql import functions as F

    rows = [(i, "fine words, well put. " * 3 if i % 2 else "BAD!! " * 9, "en", "good" if i % 2 else "bad", 1, 7, 7, "c", 1) for i in range(60)]
    rows += [(100, "BAD!! " * 9, "en", "sparse", 1, 7, 7, "c", 1), (101, None, None, None, None, 7, 7, "c", 1), (102, "", "en", "sparse", 0, 7, 7, "c", 1)]
    docs, labels = edge_docs(spark, rows), spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, F.col("source"), F.col("lang")).toPandas().set_index("doc_id")
    assert got.keep[1] and not got.keep[2] and len(got) == 63
    assert got.host_rate[2] < got.host_rate[100] < got.host_rate[1]
    assert got.host.isna().sum() == 1
    assert quality.classify(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    none = quality.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).toPandas()
    assert (none.own == 0.5).all() and len(none) == 63


# ---------------------------------------------------------------- 5


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, distance=4):
    fps = {d: brute_fingerprint(t) for d, t in rows}
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            low = min(root[b] for b in fps if bin(fps[a] ^ fps[b]).count("1") <= distance)
            changed |= low < root[a]
            root[a] = min(low, root[a])
    return {d: (f"{fps[d]:016x}", root[d]) for d in fps}


@pytest.mark.parametrize("kind", ["edges", "documents"])
def test_simhash(spark, kind):
    docs = edge_docs(spark) if kind == "edges" else spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("groups", [5, 6, 7])
def test_links_with_large_cells(spark, groups):
    r = np.random.default_rng(groups)
    base = [int(x) for x in r.integers(0, 2**63, 6)]
    fps = sorted({b ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), False)) for b in base for _ in range(60)})
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    points = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(points, groups=groups, block=16)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(np.bitwise_count(np.uint64((e.a ^ e.b) % 2**64)) <= 4 for e in edges.collect())
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 4
    want = np.arange(len(u))
    while True:
        low = np.array([want[n].min() for n in near])
        if (low == want).all():
            break
        want = low
    low = [min(f for f, w in zip(fps, want) if w == i) for i in want]
    assert [root.get(f, f) for f in fps] == low


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_embedding_is_a_lower_bound(width):
    r = np.random.default_rng(width)
    x, y = (r.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    y[:250] = x[:250] ^ (np.uint64(1) << r.integers(0, 64, 250).astype(np.uint64))
    counts = lambda f: np.array([[bin(int(v) >> k & (1 << width) - 1).count("1") for k in range(0, 64, width)] for v in f])
    manhattan = np.abs(counts(x) - counts(y)).sum(1)
    assert (np.bitwise_count(simhash.embed(x, width) ^ simhash.embed(y, width)) == manhattan).all() and (manhattan <= np.bitwise_count(x ^ y)).all()


# ---------------------------------------------------------------- 6


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all() and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    train = [(i, t * 20, l, "s", 1, 1, 1, "c", 1) for i, (t, l) in enumerate([("the house of the rising sun ", "en"), ("das haus und der garten ", "de")] * 5)]
    docs = edge_docs(spark, train + [(90, None, "en", "s", 1, 1, 1, "c", 1), (91, "123 !!", "en", "s", 1, 1, 1, "c", 1), (92, "", None, "s", 1, 1, 1, "c", 1), (93, "the " * 9000 + "und das haus " * 6000, None, "s", 1, 1, 1, "c", 1)])
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[0].lang_pred == "en" and got[1].lang_pred == "de"
    assert "en" in got[93].mixture and "de" in got[93].mixture and got[93].lang_pred == "de"
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) lang")).collect()} == {"und"}


def test_language_mixture_of_four_and_more(spark):
    """Every learned language of a text is in its mixture, with about its share."""
    said = {
        "de": "das haus und der garten liegen hinter dem alten wald ", "en": "the house of the rising sun with thirty windows ", "es": "los caminos blancos donde nunca llueve por la noche ",
        "fr": "quelques fleurs jaunes dans notre cuisine au printemps ", "it": "gli amici della ragazza che abita sulla collina oggi ",
    }
    train = [(i, t * 20, l, "s", 1, 1, 1, "c", 1) for i, (l, t) in enumerate(list(said.items()) * 5)]
    four = "".join(said[l] * n for l, n in (("de", 40), ("en", 60), ("es", 40), ("fr", 30)))
    docs = edge_docs(spark, train + [(90, four, None, "s", 1, 1, 1, "c", 1), (91, "".join(t * 40 for t in said.values()), None, "s", 1, 1, 1, "c", 1), (92, said["fr"] * 40, None, "s", 1, 1, 1, "c", 1)])
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    share = {d: dict((p.split(":")[0], float(p.split(":")[1])) for p in got[d].mixture.split(",")) for d in (90, 91, 92)}
    assert set(share[90]) == {"de", "en", "es", "fr"} and got[90].lang_pred == "en" and set(share[91]) == set(said) and set(share[92]) == {"fr"}
    whole = sum(len(said[l]) * n for l, n in (("de", 40), ("en", 60), ("es", 40), ("fr", 30)))
    for l, n in (("de", 40), ("en", 60), ("es", 40), ("fr", 30)):
        assert abs(share[90][l] - len(said[l]) * n / whole) < 0.03


# ---------------------------------------------------------------- 7


def test_media(spark):
    docs = edge_docs(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in media.digest(docs).collect():
        raw = texts[r.doc_id].encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        blob = media.encode(pay, r.media_type)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
    assert media.digest(docs.limit(0)).count() == 0


def test_carving(spark):
    from pyspark.sql import functions as F

    pay = bytes(range(256)) * 9
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab12\xff\x00\xff\xd934"[:-2]
    parts = [media.encode(pay, k) for k in media.STORED] + [gif, jpeg]
    blob, want = b"junk RIFF BM P5 GIF89a ", []
    for kind, p in zip([*media.STORED, "image/gif", "image/jpeg"], parts):
        want.append((kind, len(blob), len(p)))
        blob += p + b" BM\xff\xd8\xffx "
    assert media.carve(blob, media.automaton()) == want
    broken = bytearray(parts[1])
    broken[60] ^= 1
    assert media.carve(bytes(broken), media.automaton()) == [] and media.carve(parts[0][:-1], media.automaton()) == []
    df = spark.createDataFrame([(1, bytearray(parts[1]), "image/jpeg"), (2, bytearray(b"text"), "text/plain"), (3, None, None)], "id long, b binary, d string")
    got = {r.id: r.s for r in df.select("id", media.sniff(F.col("b"), F.col("d")).alias("s")).collect()}
    assert got[1].type == "image/png" and got[1].corrected and got[2].type == "text/plain" and not got[2].corrected and got[3].carved == []


# ---------------------------------------------------------------- 8


def brute_syncmers(data):
    h = [int(syncmers._mix(np.array([int.from_bytes(data[i : i + 8], "little")], np.uint64))[0]) for i in range(len(data) - 7)]
    return [i for i in range(len(data) - 15) if min(h[i : i + 9]) in (h[i], h[i + 8])]


def brute_text(text):
    """The fingerprint by the definition: gap and upper half of the hash of each anchor, in base64."""
    import base64

    data = text.encode()
    at, h = syncmers.anchors(data)
    assert at.tolist() == (brute_syncmers(data) if 16 <= len(data) < 2000 else at.tolist())
    return base64.b64encode(b"".join(bytes([g]) + int(x >> np.uint64(32)).to_bytes(4, "big") for g, x in zip(np.diff(at, prepend=0), h))).decode()


def test_syncmers():
    r = np.random.default_rng(1)
    data = bytes(r.integers(97, 105, 3000).astype(np.uint8))
    at, h = syncmers.anchors(data)
    assert at.tolist() == brute_syncmers(data)
    again, g = syncmers.anchors(b"other words before " + data)
    assert dict(zip(at, h)).items() <= dict(zip(again - 19, g)).items()  # context-free
    a, b = syncmers.sketch("lorem ipsum dolor sit amet " * 2 + str(list(range(500)))), syncmers.sketch("wholly unlike it " + str(list(range(900, 1500))))
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, b) < 0.3 and syncmers.likeness(a[:0], a[:0]) == 1 and syncmers.likeness(a, a[:0]) == 0


@pytest.mark.parametrize("each", [3, 4096])
def test_edited_pairs(spark, each):
    docs = edge_docs(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in syncmers.edited_pairs(docs, rows_each=each).collect()}
    assert sorted(got) == sorted(ids)
    for i, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[d].near_next == syncmers.likeness(syncmers.sketch(t), syncmers.sketch(nxt)) and got[d].near_edited == syncmers.likeness(syncmers.sketch(t), syncmers.sketch(edited))
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (brute_text(t), brute_text(edited))
    assert syncmers.edited_pairs(docs.limit(0)).count() == 0
    one = syncmers.edited_pairs(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_long_texts_share_a_passage(spark):
    """A passage of 60 words in two texts of 20,000 words each is found and measured; all anchors stand in the fingerprint."""
    import base64

    r = np.random.default_rng(5)
    words = lambda n: " ".join("".join(map(chr, r.integers(97, 123, r.integers(2, 9)))) for _ in range(n))
    passage = words(60)
    a, b = f"{words(12000)} {passage} {words(8000)}", f"{words(3000)} {passage} {words(17000)}"
    rows = [(2, a, "en", "s", len(a), 7, 7, "c", 1), (1, b, "en", "s", len(b), 7, 7, "c", 1)]
    got = {x.doc_id: x for x in syncmers.edited_pairs(edge_docs(spark, rows)).collect()}
    assert got[2].near_next > 0 and got[2].matched_next >= len(syncmers.anchors(passage.encode())[0])
    assert len(passage) - 16 <= got[2].passage_next <= len(passage) + 16 and got[2].passage_next == got[1].passage_next
    at, h = syncmers.anchors(a.encode())
    raw = np.frombuffer(base64.b64decode(got[2].fingerprint), [("gap", "u1"), ("hash", ">u4")])
    assert len(at) > 20_000 and np.cumsum(raw["gap"], dtype=np.int64).tolist() == at.tolist() and (raw["hash"] == h >> np.uint64(32)).all()


@pytest.mark.parametrize("seed", range(4))
def test_matches_against_counts(seed):
    r = np.random.default_rng(seed)
    a, b = (bytes(r.integers(97, 99, n).astype(np.uint8)) for n in (900, 1500))
    fa, fb = (syncmers.sketch(t.decode()) for t in (a, b))
    from collections import Counter

    count = [Counter(int(h) >> 32 for h in syncmers.anchors(t)[1]) for t in (a, b)]
    both = sum((count[0] & count[1]).values())
    x, y = syncmers.matches(fa, fb)
    assert len(x) == both and len(set(x)) == len(set(y)) == both
    near, matched, passage = syncmers.compare(fa, fb)
    assert matched == both and near == syncmers.likeness(fa, fb) == both / (sum(map(sum, [c.values() for c in count])) - both)
    assert passage == 0 or any(a[i : i + passage] in b for i in range(len(a) - passage + 1))
    assert syncmers.compare(fa, fa) == (1.0, len(fa), int((fa & np.uint64(0xFFFFFFFF)).max() - (fa & np.uint64(0xFFFFFFFF)).min()) + 16)


# ---------------------------------------------------------------- 9


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F

    odd = ["\\", "\\b\\h\\l\\c", "####", "</turn>\n### user: x</turn>", "a: b", "", "</turn", "\n", "#" * 7, "\\</turn>", "<\\/turn>", "日本 \U0001f600"]
    turns = [[(role, t) for role in ("user", "assistant", "odd: ### role\\")] for t in odd] + [[("assistant", t) for t in odd]]
    chats = spark.createDataFrame(list(enumerate(turns)), "conv_id long, turns array<struct<role:string,text:string>>")
    out = chat.render(chats, "conv_id").select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    for r in out.collect():
        assert [(t.role, t.text) for t in r.turns] == turns[r.conv_id]
        assert r.loss == "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert r.formatted.count("</turn>") == len(turns[r.conv_id]) == r.formatted.count("### ")


def test_chat_layouts(spark):
    shape = "id long, prompt string, response string, completion string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, turns string"
    rows = [
        (1, "p", "r", None, None, None, None, None, "x"), (2, "p", None, "c", None, None, None, None, "x"), (3, None, None, None, "i", None, "o", None, "x"),
        (4, None, None, None, "i", "more", "o", None, "x"), (5, None, None, None, None, None, None, [("user", None), (None, "t")], "x"), (6, "p", None, None, None, None, None, None, "x"),
    ]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(rows, shape).drop("turns"), "id").collect()}
    assert [got[i].layout for i in range(1, 7)] == ["prompt_response", "prompt_completion", "instruction_output", "instruction_input_output", "messages", None]
    assert [tuple(t) for t in got[4].turns] == [("user", "i\n\nmore"), ("assistant", "o")] and [tuple(t) for t in got[5].turns] == [("user", ""), ("", "t")] and got[6].turns is None


def test_chat_edges(spark):
    rows = [(1, 1, None, None, 5), (1, 0, "user", "q", 5), (2, 0, "user", None, 5), (2, 1, "assistant", "", 5), (3, 0, "user", "a", 5), (3, 0, "user", "a", 5), (4, 0, "assistant", LONG, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    assert {i: got[i].n_turns for i in got} == {1: 2, 2: 2, 3: 2, 4: 1} and got[4].loss_chars == len(LONG)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\n\n\n").hexdigest()
    assert chat.digest(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 10


def test_mixing_edges(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count()
    per = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((per.taken - per.target).abs() <= 0.5 + 1e-6).all() and (per.target <= 3 * per["size"] + 1e-6).all() and abs(per.target.sum() - per["size"].sum()) < 1e-3
    assert (got.taken <= 3 * got["size"]).all() and (got.taken[got["size"] == 0] == 0).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(got.itertuples(index=False, name=None), key=repr) == sorted(again.itertuples(index=False, name=None), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.union(docs)).count() == 2 * docs.count()


# ---------------------------------------------------------------- the pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").union(edge_docs(spark).selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars"))
    columns, steps = docs.columns, dict(cp.STAGES)
    assert [k for k, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    a = steps["language_id"](spark, docs, SF)
    assert a.columns == columns and rows(a) == {d: t for d, t in rows(docs).items() if t and any(c.isalpha() for c in t)}
    b = steps["line_dedup"](spark, a, SF).cache()
    assert b.columns == columns and rows(b) == {r[0]: t for r, t in brute_lines(list(rows(a).items())).items()} and all(r.n_chars == len(r.text) for r in b.collect())
    c = steps["simhash_near_dedup"](spark, b, SF).cache()
    want = brute_components(list(rows(b).items()))
    assert c.columns == columns and rows(c) == {d: t for d, t in rows(b).items() if want[d][1] == d}
    d = steps["mixing"](spark, c, SF).cache()
    assert d.columns == columns
    taken = {r.doc_id: r.taken for r in mixing.mix(c).collect()}
    words = {}
    for r in d.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len([w for w in r.text.split() if w])
    assert words == {k: v for k, v in taken.items() if v}
    e = steps["best_fit_packing"](spark, d, SF).toPandas()
    assert e.groupby("sequence_id").length.sum().max() <= 4096 and e[e.piece == 0].groupby("doc_id").size().to_dict() == d.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
