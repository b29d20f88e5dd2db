"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the text lower-cased, runs of other characters than letters one space, all n-grams of
one to three characters hashed to ``FEATURES`` buckets; sublinear term frequency times inverse
document frequency, at length one. Document frequencies are counted over all rows to learn from.
The weights are fitted by follow-the-regularised-leader (per-coordinate steps, elastic net, so
most stay exactly 0) on at most ``SAMPLE`` labelled rows, an equal share for each language; a
tenth of those is kept back to choose the temperature that divides the scores before the
softmax. The fitted table (buckets times languages) goes to the tasks that score all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import map_slices, text_columns, utf8

FEATURES = 1 << 15
NGRAMS = 3
#: Labelled rows that the weights are fitted on, at most.
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
#: Characters looked at in one step, so that very long texts take bounded memory.
BLOCK = 1 << 20

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: bytes, block: int = BLOCK) -> np.ndarray | None:
    """How often each bucket's n-grams occur in a text (UTF-8), the same for any ``block``; None if it has no letters."""
    lowered = text.decode("utf-8", "replace").lower()
    total, any_letter = np.zeros(FEATURES, np.int64), False
    seen = np.full(1, 32, np.uint64)  # the last characters of the text so far, which begins with a space
    for at in range(0, len(lowered), block):
        points = np.frombuffer(lowered[at : at + block].encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[points]
        any_letter |= bool(letter.any())
        points = np.where(letter, points, 32).astype(np.uint64)
        before = np.concatenate((seen[-1:], points[:-1]))
        seen = _add_grams(seen, points[(points != 32) | (before != 32)], total)
    if seen[-1] != 32:
        _add_grams(seen, np.full(1, 32, np.uint64), total)
    return total if any_letter else None


def _add_grams(seen: np.ndarray, new: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Count the n-grams that end in ``new``, which follows ``seen``; returns the characters that the next ones need."""
    line, old = np.concatenate((seen, new)), len(seen)
    for n in range(NGRAMS):
        first = max(old, n)  # of the last characters of the n-grams
        if first >= len(line):
            continue
        key = line[first - n : len(line) - n]
        for k in range(n - 1, -1, -1):
            key = (key << np.uint64(21)) | line[first - k : len(line) - k]
        hashed = (key * np.uint64(_MIX[n])) >> np.uint64(64 - 15)
        total += np.bincount(hashed.astype(np.int64), minlength=FEATURES)
    return line[-(NGRAMS - 1) :]


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and TF-IDF values of length one."""
    at = np.flatnonzero(found)
    value = (1 + np.log(found[at])) * idf[at]
    return at, value / (np.sqrt((value * value).sum()) or 1.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights (buckets x classes; the last row is the intercept)."""
    z = np.zeros((FEATURES + 1, classes))
    n = np.zeros_like(z)

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        return np.where(np.abs(part) <= L1, 0.0, -(part - np.sign(part) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value, label = rows[k]
            at, value = np.append(at.astype(np.int64), FEATURES), np.append(value.astype(float), 1.0)
            w = weights(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(FEATURES + 1))


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, of a fine geometric grid, with the least log loss."""
    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]))

    return min(np.geomspace(0.05, 20, 241).tolist(), key=loss) if len(labels) else 1.0


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """In how many of the rows each bucket occurs, and how many rows with letters each language has; one pass over the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros(FEATURES, np.int64), Counter()
        for b in batches:
            for text, lang in zip(utf8(b.column("text")), b.column("lang").to_pylist(), strict=True):
                if (found := counts(text)) is not None:
                    seen += found > 0
                    sizes[lang] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), *[-1] * len(sizes)], pa.int32()), pa.array([*[None] * len(at), *sizes], pa.string()), pa.array([*seen[at].tolist(), *sizes.values()], pa.int64())], ["bucket", "lang", "n"])

    summed = map_slices(rows.select("text", "lang"), work, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    df, sizes = np.zeros(FEATURES, np.int64), {}
    for r in summed.collect():  # a row for each bucket and each language
        if r.bucket < 0:
            sizes[r.lang] = r.n
        else:
            df[r.bucket] = r.n
    return df, sizes


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: bytes) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        at, value = vector(found, self.idf)
        s = (value @ self.weights[at] + self.weights[FEATURES]) / self.temperature
        p = np.exp(s - s.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, lang) whose lang is not null; the rows are read twice, whatever the languages.

    The sample takes about as many rows of each language, those of least hash. Its vectors come to the
    driver, at most 4 * FEATURES bytes each.
    """
    df, sizes = _document_frequencies(rows)
    n, languages = sum(sizes.values()), sorted(sizes)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((FEATURES + 1, 0)), 1.0)
    share = max(2, sample // len(languages))
    # Below this hash a language has its share of rows and some more, which are cut off below.
    limits = rows.sparkSession.createDataFrame([(s, int((1 << 30) * min(1.0, 1.2 * share / sizes[s] + 1e-3))) for s in languages], "lang string, most long")
    # A row for each language, made on the driver: sent out, so that no text is dealt by its language.
    chosen = rows.withColumn("lot", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).join(F.broadcast(limits), "lang").filter("lot < most")
    chosen = chosen.repartition(max(1, min(64, sample // 250)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(lang, lot, *vector(found, idf)) for text, lang, lot in zip(utf8(b.column("text")), b.column("lang").to_pylist(), b.column("lot").to_pylist(), strict=True) if (found := counts(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].astype("<u2").tobytes() for x in out], pa.binary()), pa.array([x[3].astype("<f2").tobytes() for x in out], pa.binary())], ["lang", "lot", "at", "value"])

    number = {s: k for k, s in enumerate(languages)}
    found = [(number[r.lang], r.lot, np.frombuffer(r.at, "<u2"), np.frombuffer(r.value, "<f2")) for r in map_slices(chosen.select("text", "lang", "lot"), work, "lang string, lot long, at binary, value binary").collect()]
    found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    taken, kept = Counter(), []
    for label, _, at, value in found:
        taken[label] += 1
        if taken[label] <= share:
            kept.append((at, value, label))
    back = [r for k, r in enumerate(kept) if k % 10 == 9]
    weights = fit([r for k, r in enumerate(kept) if k % 10 != 9], len(languages))
    scores = np.array([v.astype(float) @ weights[at] + weights[FEATURES] for at, v, _ in back])
    return Model(languages, idf, weights, calibrate(scores, np.array([r[2] for r in back], int)))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not held out, and not learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``.

    Learns from the text and the non-null lang of rows that are not held out. A null text, or one
    without letters, is ``und`` with score 0; so are all rows where there is nothing to learn from,
    as in a table without the column ``lang_col``.
    """
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None)
    rows = text_columns(docs, id_col, text_col, lang.cast("string").alias("lang"))
    model = train(rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_slices(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), work, "doc_id long, held_out boolean, lang_pred string, score double")
