"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Each rule looks at counts of one document and votes good, bad or not at all. No labels are
read. Expectation-maximisation over a two-class model in which rules vote independently given
the class estimates, for each rule, how often it votes good, bad or abstains in either class;
the posterior probability of the good class then replaces a list of rules that all must pass.

Spark counts how often each pattern of votes occurs (at most 3 to the power of the rules);
EM runs over that table, so its cost does not depend on the number of documents.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tallymark.llm._common import durable, fresh, map_slices, text_columns, utf8

MIN_WORDS = 10
MAX_REPEAT = 0.2
THRESHOLD = 0.5
REPEAT_WINDOW = 5
GOOD, BAD, ABSTAIN = 0, 1, 2
#: Beyond these ``fit`` warns and takes the posteriors as they are; it settles in some dozens.
EM_ROUNDS = 2000

_SYMBOLS = b"#*$%&|<>"
_RUNS = re.compile(rb"[#*$%&|<>]+")
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_upper", "n_lines", "n_stops", "n_runs", "n_punctuation")


def stats(text: bytes) -> tuple[int, ...]:
    """The counts in _STATS of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(_STATS)
    joined = b" ".join(words)
    lines = [x for x in text.split(b"\n") if x.split()]
    repeat = 0
    if n > REPEAT_WINDOW:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - REPEAT_WINDOW] + 1).tolist()]
        windows = [joined[a:b] for a, b in zip(starts, ends[REPEAT_WINDOW - 1 :].tolist(), strict=True)]
        if len(set(windows)) < len(windows):
            often = {w for w, k in Counter(windows).items() if k > 1}
            mask = np.zeros(n + 1, np.int64)
            at = np.flatnonzero([w in often for w in windows])
            np.add.at(mask, at, 1)
            np.add.at(mask, at + REPEAT_WINDOW, -1)
            repeat = int((np.cumsum(mask)[:n] > 0).sum())
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    stops = joined.count(b".") + joined.count(b"?")
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    runs = len(_RUNS.findall(joined)) if symbols else 0
    punctuation = len(joined) - len(joined.translate(None, _PUNCTUATION))
    return (n, len(joined.decode("utf-8", "replace")) - n + 1, symbols, len(lines) - len(set(lines)), repeat, joined.count(b"!"), upper, len(lines), stops, runs, punctuation)


def votes(s: tuple[int, ...]) -> tuple[int, ...]:
    """One vote for each rule: GOOD, BAD or ABSTAIN.

    A rule that looks for one fault says nothing about a document without it, so the first
    eight vote bad or abstain; the last two vote good where the text has the measures of prose.
    """
    n, chars, symbols, dup_lines, repeat, shouts, upper, lines, stops, runs, punctuation = s
    if not n:
        return (ABSTAIN,) * 10

    def bad(found: bool) -> int:
        return BAD if found else ABSTAIN

    return (
        bad(symbols >= 0.05 * chars),
        bad(runs >= 0.2 * n),
        bad(punctuation >= 0.12 * chars),
        bad(n >= 2 * REPEAT_WINDOW and repeat >= 0.2 * n),
        bad(lines >= 3 and dup_lines >= 0.3 * lines),
        bad(shouts >= 0.2 * n),
        bad(upper >= 0.4 * chars),
        bad(n >= 100 and stops == 0),
        GOOD if punctuation <= 0.07 * chars and upper <= 0.2 * chars else ABSTAIN,
        GOOD if 2.5 * n <= chars <= 10 * n and 2 <= stops + 1 and stops <= 0.4 * n else ABSTAIN,
    )


N_RULES = len(votes((0,) * len(_STATS)))


def base_failed(s: tuple[int, ...]) -> bool:
    return s[0] < MIN_WORDS or 100 * s[4] > 20 * s[0]


def pattern_of(v: tuple[int, ...]) -> int:
    """The votes as the digits of a number to base 3."""
    return sum(x * 3**k for k, x in enumerate(v))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts in _STATS, base_failed, pattern; one row for each row of ``docs``. Null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stats(x) for x in utf8(b.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64()) for _ in _STATS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array([base_failed(s) for s in found], pa.bool_()), pa.array([pattern_of(votes(s)) for s in found], pa.int32())], ["doc_id", *_STATS, "base_failed", "pattern"])

    return map_slices(text_columns(docs, id_col, text_col), work, f"doc_id long, {', '.join(f'{c} long' for c in _STATS)}, base_failed boolean, pattern int")


def fit(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of the good class for each pattern of votes, by EM.

    Starts from rules that speak up one time in four where they are right and one in fifty
    where they are wrong, and a good class of four fifths. Every estimate keeps a little weight
    of that start, so rules that never vote stay where they began and the classes cannot
    change places.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns], float)
    vote = (patterns[:, None] // 3 ** np.arange(N_RULES)) % 3
    one_hot = vote[:, :, None] == np.arange(3)  # pattern, rule, vote
    start = np.empty((2, N_RULES, 3))
    for c in (GOOD, BAD):
        start[c, :, c], start[c, :, 1 - c], start[c, :, ABSTAIN] = 0.25, 0.02, 0.73
    prior, chance = np.array([0.8, 0.2]), start
    hold = 0.005 * weight.sum()
    good = np.zeros(len(patterns))
    for _ in range(EM_ROUNDS):
        log = np.log(prior)[:, None] + np.einsum("prv,crv->cp", one_hot, np.log(chance))
        before, good = good, 1 / (1 + np.exp(np.clip(log[BAD] - log[GOOD], -700, 700)))
        if np.abs(good - before).max() < 1e-9:
            break
        both = np.stack([good, 1 - good]) * weight
        chance = np.einsum("cp,prv->crv", both, one_hot) + hold * start
        chance /= chance.sum(2, keepdims=True)
        prior = (both.sum(1) + hold * np.array([0.8, 0.2])) / (weight.sum() + hold)
    else:
        warnings.warn(f"EM stopped after {EM_ROUNDS} rounds; posteriors still moved by {np.abs(good - before).max():.1e}", stacklevel=2)
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def posteriors(measured: DataFrame) -> dict[int, float]:
    """``fit`` over the pattern counts of all rows that have words."""
    return fit({r.pattern: r["count"] for r in measured.filter("n_words > 0").groupBy("pattern").count().collect()})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``measure`` with ``posterior`` (0 without words) and ``kept``."""
    measured = durable(measure(docs, id_col, text_col))
    found = posteriors(measured)
    table = docs.sparkSession.createDataFrame(list(found.items()), "pattern int, posterior double")
    # At most 3 to the power of the rules rows, whatever the input.
    out = measured.join(F.broadcast(table), "pattern", "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps.

    Each text is measured once: the rows go to a checkpoint with their pattern, as the model needs all patterns first.
    """
    failed, pattern = fresh(docs, "failed"), fresh(docs, "pattern")
    schema = StructType([*docs.schema.fields, StructField(failed, BooleanType()), StructField(pattern, IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stats(x) for x in utf8(b.column(text_col))]
            more = [pa.array([base_failed(s) for s in found], pa.bool_()), pa.array([pattern_of(votes(s)) if s[0] else -1 for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, failed, pattern])

    measured = durable(map_slices(docs, work, schema))
    found = fit({r[pattern]: r["count"] for r in measured.filter(F.col(pattern) >= 0).groupBy(pattern).count().collect()})
    good = [p for p, chance in found.items() if chance >= threshold]  # at most 3 to the power of the rules
    return measured.filter(~F.col(failed) & F.col(pattern).isin(good)).select(*[F.col(f"`{c}`") for c in docs.columns])
