"""Language ID as inference of a mixture of languages.

Learning counts hashed byte trigrams per language over all labelled texts. For a text, every segment
of ``segment`` trigrams has a likelihood under each language; expectation-maximisation estimates the
proportions in which languages make up the segments. The set of languages is then chosen by penalised
likelihood: the single best, the best two and so on up to all learned languages (by their
proportions), each fitted again, where one more language must raise the log-likelihood by
``penalty * log(segments + 1)``; of all sizes the one of largest penalised likelihood is taken. A text
is done with larger sets as soon as even segments that were each explained by their best language could
not pay for one, so what it costs grows with its own languages. The prediction is the language with the
largest share.

Defined cases: null texts and texts without a letter (``str.isalpha``: no digits, fractions or numerals)
are ``und`` with score 0, as all are when nothing was learned; rows with null text or language teach
nothing; a null doc_id counts as the empty string, which is held out; repeated rows count each time;
ties go to the language that sorts first; an empty table gives no rows; other columns are ignored. The
model holds every language value; more than ``most_languages`` of them are an error, not a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
HELD_OUT = "pmod(crc32(coalesce(CAST(doc_id AS STRING), '')), 5) = 0"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(text: str, at_once: int = 48 << 14) -> Iterator[np.ndarray]:
    """Hash bins of the byte trigrams of the lower-cased text between two spaces, ``at_once`` of them at a time."""
    data = f" {text.lower()} ".encode("utf-8", "surrogatepass")
    for at in range(0, len(data) - 2, at_once):
        b = np.frombuffer(data, np.uint8, min(at_once + 2, len(data) - at), at).astype(np.uint32)
        yield (((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # (2 ** BITS, languages)


def learn(docs: DataFrame, smoothing: float = 0.5, most_languages: int = 1000) -> Model:
    """Trigram counts of each language over all rows; what reaches the driver is one row of at most 2 ** BITS counts a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if lang not in seen:
                    seen[lang] = np.zeros(1 << BITS, np.int64)
                for bins in trigrams(text):
                    seen[lang] += np.bincount(bins, minlength=1 << BITS)
        for lang, n in seen.items():
            bins = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bin": bins, "n": n[bins]})

    taught = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    if docs.where("lang IS NOT NULL").select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"over {most_languages} values of lang: not a language column")
    rows = taught.mapInPandas(count, "lang string, bin int, n long")
    each = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("counts"))
    table = each.select("lang", "counts.bin", "counts.n").toPandas().sort_values("lang", ignore_index=True)
    langs = table["lang"].tolist()
    counts = np.zeros((1 << BITS, len(langs)))
    for i, (bins, n) in enumerate(zip(table["bin"], table["n"])):
        counts[np.asarray(bins, int), i] = n
    return Model(langs, np.log((counts + smoothing) / (counts.sum(0) + smoothing * (1 << BITS))).astype(np.float32))


def _segments(text: str, log_p: np.ndarray, segment: int) -> np.ndarray:
    out = [np.add.reduceat(log_p[part], np.arange(0, len(part), segment), axis=0) for part in trigrams(text, segment << 10)]
    return np.concatenate(out).astype(np.float64)


def _mixture(like: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of each text after ``rounds`` of expectation-maximisation; like: exp of scaled log-likelihoods."""
    sizes = np.diff(np.r_[starts, len(like)])
    for _ in range(rounds):
        post = like * np.repeat(share, sizes, axis=0)
        post /= post.sum(1, keepdims=True)
        share = np.add.reduceat(post, starts, axis=0) / sizes[:, None]
    return share


def infer(texts: list[str], model: Model, segment: int = 48, penalty: float = 2.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(proportions within the chosen language set, proportions over all languages) of texts with trigrams."""
    parts = [_segments(t, model.log_p, segment) for t in texts]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    log_like = np.concatenate(parts)
    sizes = np.diff(np.r_[starts, len(log_like)])
    top = log_like.max(1, keepdims=True)
    like = np.exp(np.maximum(log_like - top, -300.0)) + 1e-300
    n, k = len(texts), len(model.langs)
    every = _mixture(like, starts, np.full((n, k), 1 / k), rounds)
    single = np.add.reduceat(log_like, starts, axis=0)
    best = single.argmax(1)
    score = single[np.arange(n), best]
    chosen = np.eye(k)[best]
    order = np.argsort(-every, axis=1, kind="stable")
    # No set explains a segment better than the segment's own best language does.
    bound, price = np.add.reduceat(top[:, 0], starts), penalty * np.log(sizes + 1)
    open_ = np.arange(n)
    for size in range(2, k + 1):
        open_ = open_[bound[open_] - price[open_] * (size - 1) > score[open_] - 1e-9]
        if not len(open_):
            break
        these, heads = sizes[open_], np.cumsum(np.r_[0, sizes[open_][:-1]])
        rows = np.arange(these.sum()) + np.repeat(starts[open_] - heads, these)
        langs = np.sort(order[open_, :size], axis=1)
        some = like[rows[:, None], np.repeat(langs, these, axis=0)]
        share = _mixture(some, heads, np.full((len(open_), size), 1 / size), rounds)
        fit = np.add.reduceat(np.log((some * np.repeat(share, these, axis=0)).sum(1) + 1e-300) + top[rows, 0], heads) - price[open_] * (size - 1)
        better = np.flatnonzero(fit > score[open_])
        score[open_[better]] = fit[better]
        chosen[open_[better]] = 0.0
        chosen[open_[better][:, None], langs[better]] = share[better]
    return chosen, every


def _runs(texts: list[str], languages: int, segment: int = 48, cells: int = 1 << 21) -> Iterator[list[int]]:
    """Places of texts in runs whose segments times languages stay within ``cells``, or of one text."""
    run, size = [], 0
    for i, t in enumerate(texts):
        more = (len(t) // segment + 1) * languages
        if run and size + more > cells:
            yield run
            run, size = [], 0
        run.append(i)
        size += more
    if run:
        yield run


def language_column(model: Model, text: str = "text") -> Column:
    """A struct column: lang_pred, score (its share over all languages), mixture (chosen languages and shares)."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, mixture string")
    def predict(column: pd.Series) -> pd.DataFrame:
        model, texts = shared.value, column.tolist()
        lang, score, mixture = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
        ok = [i for i, t in enumerate(texts) if model.langs and isinstance(t, str) and has_letter(t)]
        for run in _runs([texts[i] for i in ok], len(model.langs)):
            some = [ok[j] for j in run]
            for i, c, e in zip(some, *infer([texts[i] for i in some], model)):
                best = int(c.argmax())
                lang[i], score[i] = model.langs[best], float(min(1.0, e[best]))
                mixture[i] = ",".join(f"{model.langs[j]}:{c[j]:.3f}" for j in np.flatnonzero(c > 0.0005))
        return pd.DataFrame({"lang_pred": lang, "score": score, "mixture": mixture})

    return predict(text)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture; learned from the documents that are not held out."""
    model = learn(docs.where(f"NOT ({HELD_OUT})"))
    return docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), language_column(model).alias("found")).select("doc_id", "held_out", "found.*")
