"""Callables of the user: judges of gray pairs and readers of labels. Failures become data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = ("equivalent", "not_equivalent", "uncertain")
REASONS = ("same_entity", "abbreviation", "spelling_variant", "different_entity", "insufficient_context", "judge_failed")
FAILED = "judge_failed"


class Judge(Protocol):
    def __call__(self, extracted: str, expected: str, field: str) -> tuple[str, str]: ...


class Extractor(Protocol):
    def __call__(self, job: dict[str, Any]) -> str: ...


def judge_gray_pairs(df: DataFrame, judge: Judge | None, extracted: str = "extracted", expected: str = "expected", field: str = "field", result: str = "result", memo: str | None = None, blocks: int = 1) -> DataFrame:
    """``df`` with ``verdict`` and ``reason`` for gray rows; each distinct pair is judged once, and only gray rows are joined.

    Without a judge, and where it fails or answers out of the list, the verdict is uncertain.
    ``memo`` is a shared folder of verdicts kept over runs: what it holds is not asked, and new
    verdicts are written there before any row is joined, so that no later task asks again. With
    ``blocks`` the pairs are asked in so many parts, one written before the next is asked: what a
    lost run has to ask again is at most one part. Failures are not kept.
    """
    keys = [extracted, expected, field]
    gray = F.coalesce(F.col(result) == "gray", F.lit(False))
    asked = df.filter(gray).select(*keys).distinct()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    verdict, reason = judge(*row) if judge else ("uncertain", FAILED)
                except Exception:  # the user's code
                    verdict, reason = "uncertain", FAILED
                ok = verdict in VERDICTS and reason in REASONS
                out.append((*row, verdict if ok else "uncertain", reason if ok else FAILED))
            yield pd.DataFrame(out, columns=[*keys, "verdict", "reason"])

    schema = f"`{extracted}` string, `{expected}` string, `{field}` string, verdict string, reason string"
    told = asked.mapInPandas(work, schema)
    if memo is not None:
        told = _remembered(asked, lambda some: some.mapInPandas(work, schema), keys, memo, blocks)
    judged = df.filter(gray).join(told, keys, "left").withColumns({"verdict": F.coalesce("verdict", F.lit("uncertain")), "reason": F.coalesce("reason", F.lit(FAILED))})
    none = F.lit(None).cast("string")
    return judged.select(*df.columns, "verdict", "reason").unionByName(df.filter(~gray).withColumns({"verdict": none, "reason": none}))


def _remembered(asked: DataFrame, ask: Callable[[DataFrame], DataFrame], keys: list[str], memo: str, blocks: int) -> DataFrame:
    """The verdicts in ``memo`` after what it lacks has been asked and written there, block by block."""
    spark = asked.sparkSession
    names, held = ["extracted", "expected", "field"], "extracted string, expected string, field string, verdict string, reason string"
    spark.createDataFrame([], held).write.mode("ignore").parquet(memo)

    def kept() -> DataFrame:
        return spark.read.schema(held).parquet(memo).select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "verdict", "reason")

    asked = asked.persist()  # only distinct pairs; lost parts are made again
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == block)
        fresh = ask(part.join(kept().select(*keys), keys, "left_anti")).filter(F.col("reason") != FAILED)
        fresh.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "verdict", "reason").write.mode("append").parquet(memo)
    asked.unpersist()
    # Two runs at a time may both have asked a pair; one verdict of it is taken.
    return kept().groupBy(*keys).agg(F.min(F.struct("verdict", "reason")).alias("_told")).select(*keys, "_told.*")


def final_result(df: DataFrame, result: str = "result") -> DataFrame:
    """The ladder's result after the verdict: gray becomes likely-match, fail or manual-review."""
    judged = F.when(F.col("verdict") == "equivalent", "likely-match").when(F.col("verdict") == "not_equivalent", "fail").otherwise("manual-review")
    return df.withColumn(result, F.when(F.col(result) == "gray", judged).otherwise(F.col(result)))


def run_extractor(jobs: DataFrame, extractor: Callable[[dict[str, Any]], str], key: str = "id") -> DataFrame:
    """key, ok, result, error, duration_ms: the extractor's answer for each job; one that raises fails alone."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                began = time.perf_counter()
                try:
                    row = (job[key], True, str(extractor(job)), None)
                except Exception as e:  # the user's code
                    row = (job[key], False, None, str(e))
                out.append((*row, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(out, columns=[key, "ok", "result", "error", "duration_ms"])

    return jobs.mapInPandas(work, f"`{key}` {dict(jobs.dtypes)[key]}, ok boolean, result string, error string, duration_ms double")
