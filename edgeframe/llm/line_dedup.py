"""Line dedup by overlapping three-line windows.

Lines of a text are split at ``\\n``; blank lines take no part and stay where they are. Every run of
``window`` consecutive lines is hashed (128 bits, so that collisions stay out of reach at trillions
of windows); a text of fewer lines is one window of all it has. With ``long_line_words`` every shorter
run of lines (one line, two lines) of over that many words is a window too, because a passage pasted
into unrelated text often sits on one or two lines; then no passage of over that many words that fills
whole lines stays. The first occurrence of a window is the one with the smallest (doc_id, text,
position); all later ones cover their lines, overlapping cover merges, and covered lines are cut.

Windows are made and written once; a window that repeats all over is dealt over many tasks when its
occurrences meet their first one.

Defined cases: null text stays null with no lines; a text that is wholly covered becomes empty; a null
doc_id comes first; documents are told apart by doc_id and text, so different texts under one doc_id
are documents of their own, and exact repeats of a row act as one document; white space at the end of
a line does not count; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free, join_hot, row_key

#: ASCII white space, as in the other operators of this package.
SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"


def _windows(docs: DataFrame, window: int, long_line_words: int | None) -> DataFrame:
    """One row per window: h1, h2, doc_id, k1, k2 (the row's key), at (rank of its first line) and its lines' positions."""
    solid = f"filter(transform(split(text, '\\n'), (x, i) -> struct(regexp_replace(x, '{SPACE}$', '') AS s, i)), x -> x.s <> '')"
    lines = docs.select("doc_id", *row_key("doc_id", "text"), F.expr(solid).alias("l")).where("size(l) > 0")
    run = ", ".join(f"l[k + {j}].s" for j in range(window))
    places = ", ".join(f"l[k + {j}].i" for j in range(window))
    whole = "array_join(transform(l, x -> x.s), '\\n')"
    spans = f"""
        CASE WHEN size(l) < {window} THEN
            array(struct(xxhash64('all', {whole}) AS h1, xxhash64({whole}, 'all') AS h2, 0 AS at, transform(l, x -> x.i) AS covers))
        ELSE
            transform(sequence(0, size(l) - {window}), k ->
                struct(xxhash64('run', {run}) AS h1, xxhash64({run}, 'run') AS h2, k AS at, array({places}) AS covers))
        END"""
    short = []  # one line, and runs of fewer lines than a window
    if long_line_words is not None:
        lines = lines.withColumn("l", F.expr("transform(l, x -> struct(x.s, x.i, regexp_count(x.s, '[^\\\\x20\\\\x09-\\\\x0D]+') AS n))"))
        for m in range(1, max(2, window)):
            words = " + ".join(f"get(l, k + {j}).n" for j in range(m))
            part, kind = ", ".join(f"l[k + {j}].s" for j in range(m)), "one" if m == 1 else f"short{m}"
            at = ", ".join(f"l[k + {j}].i" for j in range(m))
            short.append(f"""
        transform(filter(sequence(0, size(l) - 1), k -> k + {m} <= size(l) AND {words} > {long_line_words}),
            k -> struct(xxhash64('{kind}', {part}) AS h1, xxhash64({part}, '{kind}') AS h2, k AS at, array({at}) AS covers))""")
    return lines.select("doc_id", "k1", "k2", F.inline(F.expr(f"concat({', '.join([spans, *short])})" if short else spans)))


def covered_lines(docs: DataFrame, window: int = 3, long_line_words: int | None = None) -> DataFrame:
    """(k1, k2: key of the row, covered: positions of lines) of the documents that repeat a window seen before."""
    spans = durable(_windows(docs, window, long_line_words), "line-windows")
    place = F.struct("doc_id", "k1", "k2", "at")
    seen = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").drop("last")
    seen = durable(seen, "line-repeats")
    later = join_hot(spans, seen, ["h1", "h2"], "n", ["k1", "at"]).where(place != F.col("first"))
    # Gathers at most the windows of one document.
    return later.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_set("covers"))).alias("covered"))


def cut_repeats(docs: DataFrame, window: int = 3, long_line_words: int | None = None) -> DataFrame:
    """``docs`` with all its columns, repeated windows cut from ``text``, and a struct column
    ``line_dedup`` (in place of one of that name) of n_lines (all lines) and n_removed (lines cut)."""
    covered = covered_lines(docs.select("doc_id", "text"), window, long_line_words)
    k1, k2, cut = (free(docs.columns, c) for c in ("line_k1", "line_k2", "line_cut"))
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key("doc_id", "text"), (k1, k2))])
    marked = keyed.join(covered.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("covered").alias(cut)), [k1, k2], "left")
    lines, places = "split(text, '\n')", "sequence(0, size(split(text, '\n')) - 1)"
    out = f"CASE WHEN {cut} IS NULL THEN text ELSE array_join(transform(array_except({places}, {cut}), i -> {lines}[i]), '\n') END"
    n_lines = f"CASE WHEN text IS NULL THEN 0L ELSE CAST(size({lines}) AS LONG) END AS n_lines"
    n_removed = f"CASE WHEN text IS NULL OR {cut} IS NULL THEN 0L ELSE CAST(size(array_intersect({places}, {cut})) AS LONG) END AS n_removed"
    counts = F.expr(f"struct({n_lines}, {n_removed})").alias("line_dedup")
    return marked.select(*[F.expr(out).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != "line_dedup"], counts)


def dedup_lines(docs: DataFrame, window: int = 3, long_line_words: int | None = None) -> DataFrame:
    """doc_id, text without repeated windows, n_lines, n_removed."""
    return cut_repeats(docs.select("doc_id", "text"), window, long_line_words).select("doc_id", "text", "line_dedup.*")


ORACLE = """
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
flat AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, regexp_replace(unnest(ls), '[\\x20\\x09-\\x0D]+$', '') AS s FROM raw
),
solid AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n,
  lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2
  FROM flat WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
wins AS (
  SELECT doc_id, k, 'run' || chr(0) || s || chr(10) || s1 || chr(10) || s2 AS w, [i, i1, i2] AS covers FROM solid WHERE n >= 3 AND k <= n - 3
  UNION ALL
  SELECT doc_id, 0, 'all' || chr(0) || string_agg(s, chr(10) ORDER BY i), list(i ORDER BY i) FROM solid WHERE n < 3 GROUP BY doc_id
  UNION ALL
  SELECT doc_id, k, 'one' || chr(0) || s, [i] FROM solid WHERE len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) > 50
  UNION ALL
  SELECT doc_id, k, 'two' || chr(0) || s || chr(10) || s1, [i, i1] FROM solid WHERE s1 IS NOT NULL AND len(regexp_extract_all(s || ' ' || s1, '[^\\x20\\x09-\\x0D]+')) > 50
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS rn FROM wins),
cut AS (SELECT DISTINCT doc_id, unnest(covers) AS i FROM ranked WHERE rn > 1),
line AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS s FROM raw),
kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN c.i IS NULL THEN l.s END, chr(10) ORDER BY l.i) AS text, count(*) AS n_lines, count(c.i) AS n_removed
  FROM line l LEFT JOIN cut c USING (doc_id, i) GROUP BY l.doc_id
)
SELECT r.doc_id, CASE WHEN r.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM raw r LEFT JOIN kept k USING (doc_id)
"""
