"""Streams: verification as labels arrive, the state of queue rows, a running summary."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from tallymark.operators.judge import Extractor, run_extractor
from tallymark.operators.review import summary_columns
from tallymark.plans.verify import verify_labels

#: A row's state is dropped after so long without an event (a rule of this library).
STATE_TTL_MS = 24 * 3600 * 1000


def verify_stream(labels: DataFrame, applications: DataFrame, key: str = "app_id") -> DataFrame:
    """Verdicts of a stream of labels joined to a table of applications; stateless, each label by itself."""
    return verify_labels(labels.join(applications, key))


#: The column that the JSON reader puts a line into that it cannot read.
MALFORMED = "_corrupt_record"


def labels_arriving(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of labels from JSON lines, at most so many files a micro-batch; lines that are no label keep their text in ``MALFORMED``."""
    read = StructType([*schema.fields, StructField(MALFORMED, StringType())])
    return spark.readStream.schema(read).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("maxFilesPerTrigger", files).json(path)


def checked(batch: DataFrame, applications: DataFrame, key: str, extractor: Extractor | None) -> tuple[DataFrame, DataFrame]:
    """(labels to verify, others with their ``reason``): malformed lines, labels without an application, and those that the extractor raises on.

    The extractor is the user's reading of a label; its answer is the column ``extracted``, and what it raises is the reason.
    """
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in batch.columns else F.lit(False)
    columns = [c for c in batch.columns if c != MALFORMED]
    text = F.col(MALFORMED) if MALFORMED in batch.columns else F.lit(None).cast("string")
    broken = batch.filter(malformed).select(F.lit(None).cast(dict(batch.dtypes)[key]).alias(key), F.lit("malformed").alias("reason"), text.alias("line"))
    whole = batch.filter(~malformed).select(*columns)
    none = whole.join(applications.select(key), key, "left_anti").select(key, F.lit("no application").alias("reason"), F.lit(None).cast("string").alias("line"))
    known = whole.join(applications.select(key), key, "left_semi")
    if extractor is None:
        return known, broken.unionByName(none)
    # Labels may share a key: the answer belongs to the whole label, and equal ones are read once.
    known = known.withColumn("_job", F.to_json(F.struct(*columns)))
    read = run_extractor(known.dropDuplicates(["_job"]), lambda job: extractor({c: job[c] for c in columns}), "_job").select("_job", "ok", "result", "error")
    answered = known.join(read, "_job")
    raised = answered.filter(~F.col("ok")).select(key, F.concat(F.lit("check failed: "), "error").alias("reason"), F.lit(None).cast("string").alias("line"))
    return answered.filter("ok").select(*columns, F.col("result").alias("extracted")), broken.unionByName(none).unionByName(raised)


def start_verification(labels: DataFrame, applications: DataFrame, out: str, checkpoint: str, key: str = "app_id", extractor: Extractor | None = None):
    """A query that writes verdicts to ``out`` and the labels that cannot be checked, with the reason, to ``out``-quarantine.

    Each micro-batch has a folder of its own, ``batch=<number>``, which is written anew if the
    batch is run again after a failure, so no verdict is there twice. Labels may share a key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = checked(batch, applications, key, extractor)
        verify_stream(good, applications, key).write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}-quarantine/batch={number}")
        batch.unpersist()

    return labels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_of(kind: Column) -> Column:
    """The status that an event leads to."""
    return F.when(kind == "start", "processing").when(kind == "complete", "complete").when(kind == "error", "failed").otherwise("queued")


def fold_batch(events: DataFrame, key: str = "item_id", order: str = "event_id") -> DataFrame:
    """key, status, duration_ms, n_events: the state of each row after all its events."""
    ended = F.col("kind").isin("complete", "error")
    last = F.max_by(F.struct(status_of(F.col("kind")).alias("status"), F.when(ended, F.col("duration_ms")).alias("duration_ms")), order)
    return events.groupBy(key).agg(last.alias("last"), F.count("*").alias("n_events")).select(key, "last.status", "last.duration_ms", "n_events")


def fold_stream(events: DataFrame, key: str = "item_id", order: str = "event_id", ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """The rows of ``fold_batch`` as a stream in update mode: a changed state for each row that got events.

    With a time to live the query runs batches without data as well, to drop old states, and so
    never ends by itself; a run over what is there (``availableNow``) takes None.
    """

    def fold(item: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, status, took, n = state.get if state.exists else (-1, "queued", None, 0)
        for frame in frames:
            n += len(frame)
            last = frame.sort_values(order).iloc[-1]
            if last[order] > seen:
                seen = int(last[order])
                status = {"start": "processing", "complete": "complete", "error": "failed"}.get(last["kind"], "queued")
                took = float(last["duration_ms"]) if status in ("complete", "failed") and pd.notna(last["duration_ms"]) else None
        state.update((seen, status, took, n))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [item[0]], "status": [status], "duration_ms": [took], "n_events": [n]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} long, status string, duration_ms double, n_events long", "seen long, status string, took double, n long", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def live_summary(rows: DataFrame, key: str = "batch_id") -> DataFrame:
    """The running summary: a row that is not complete counts as not ok. Batch or stream."""
    return rows.withColumn("ok", F.col("status") == "complete").groupBy(key).agg(*summary_columns())


def discard(rows: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps nothing but the state: for queries whose result is read from there."""
    return rows.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True)
