"""Keyed state of queue rows and of running summaries, on Spark's state variables.

Both keep their state in RocksDB, survive a restart from the checkpoint, and can be read back from
it as tables. Every event moves one row's state; what that row counted for in its batch before is
taken back and what it counts for now is put in, so a summary is kept without going over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tallymark.functions import fixed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATUS = {"start": "processing", "complete": "complete", "error": "failed"}
_ROW = "seen long, status string, duration_ms double, overall string, quality_issue boolean, n_events long"
#: What a row counts for in its batch; durations in thousandths, so that taking one back leaves nothing behind.
COUNTS = ("total", *[f"n_{s.replace('-', '_')}" for s in fixed.OVERALL_STATUSES], "failures", "quality_issues", "done", "failed", "ok", "ok_time", "all_time")


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """State variables need RocksDB. A query keeps the setting it was started with, so the session gets its own back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def start(writer: DataStreamWriter, spark: SparkSession):
    with state_settings(spark):
        return writer.start()


def counts_for(row: tuple[Any, ...] | None) -> dict[str, int]:
    """A row state's share of its batch's counts; a row that is not complete counts as not ok."""
    out = dict.fromkeys(COUNTS, 0)
    if row is None:
        return out
    _, status, took, overall, quality, _ = row
    ok = status == "complete"
    time = round(took * 1000) if took is not None else 0
    out |= {"total": 1, "failures": int(not ok), "done": int(status in ("complete", "failed")), "failed": int(status == "failed"), "ok": int(ok), "all_time": time}
    if ok:
        out |= {"quality_issues": int(bool(quality)), "ok_time": time}
        if overall in fixed.OVERALL_STATUSES:
            out[f"n_{overall.replace('-', '_')}"] = 1
    return out


def _told(value: Any, kind: type) -> Any:
    """``value`` as of that kind, or None where there is none or it is not a number."""
    return None if value is None or value != value else kind(value)


class RowState(StatefulProcessor):
    """The state of a queue row: that of its last event, whatever order events come in. Emits its states, or its changes for its batch.

    It goes over rows, not frames: keys are many and have few events each, and a frame for each would cost more than all else.
    """

    def __init__(self, key: str, order: str, batch: str | None, ttl_ms: int | None) -> None:
        self.key, self.order, self.batch, self.ttl_ms = key, order, batch, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _ROW, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.row.get()
        seen, status, took, overall, quality, n = old or (-1, "queued", None, None, None, 0)
        last, at = None, -1
        for event in rows:
            n += 1
            order = event[self.order]
            if last is None or order is not None and order > at:
                last, at = event, -1 if order is None else order
        if at > seen:
            seen, status = int(at), _STATUS.get(last["kind"], "queued")
            done = last.asDict()
            took = _told(done["duration_ms"], float) if status in ("complete", "failed") else None
            overall, quality = (_told(done.get(c), kind) if status == "complete" else None for c, kind in (("overall", str), ("quality_issue", bool)))
        now = (seen, status, took, overall, quality, n)
        self.row.update(now)
        if self.batch:
            before, after = counts_for(old), counts_for(now)
            yield Row(**{self.batch: last[self.batch], **{c: after[c] - before[c] for c in COUNTS}})
        else:
            yield Row(**{self.key: key[0], "status": status, "duration_ms": took, "n_events": n})

    def close(self) -> None:
        pass


class BatchCounts(StatefulProcessor):
    """The counts of a batch: what its rows' changes add up to. Emits them whenever a row of it had an event."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in COUNTS))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = list(self.counts.get()) if self.counts.exists() else [0] * len(COUNTS)
        for frame in rows:
            now = [a + int(b) for a, b in zip(now, frame[list(COUNTS)].sum().tolist(), strict=True)]
        self.counts.update(tuple(now))
        yield pd.DataFrame({self.key: [key[0]], **{c: [n] for c, n in zip(COUNTS, now, strict=True)}})

    def close(self) -> None:
        pass


def row_states(events: DataFrame, key: str = "item_id", order: str = "event_id", ttl_ms: int | None = None) -> DataFrame:
    """key, status, duration_ms, n_events: a row's new state for each micro-batch that has events of it.

    ``events`` is a stream of key, order, kind and duration_ms. With a time to live, a state that got no event for so long is dropped by the
    state store. The state itself is that of ``stored_rows``.
    """
    return events.groupBy(key).transformWithState(RowState(key, order, None, ttl_ms), f"{key} {dict(events.dtypes)[key]}, status string, duration_ms double, n_events long", "Append" if ttl_ms is None else "Update", "None" if ttl_ms is None else "ProcessingTime")


def stored_rows(spark: SparkSession, checkpoint: str, key: str = "item_id") -> DataFrame:
    """key, status, duration_ms, n_events as they stand in the checkpoint of a query of ``row_states``."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load()
    return held.select(f"key.{key}", "value.status", "value.duration_ms", "value.n_events")


def live_summary(events: DataFrame, batch: str = "batch_id", key: str = "item_id", order: str = "event_id") -> DataFrame:
    """A batch's running summary for each micro-batch that has events of it, as a stream.

    ``events`` is a stream of batch, key, order, kind, duration_ms, and where known overall and quality_issue of a complete row. Two keyed
    states follow each other: each row's, which says what changed, and each batch's. A batch holds at most one upload's rows (250), so
    its changes fit in one call.
    """
    kind = dict(events.dtypes)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    changes = events.groupBy(key).transformWithState(RowState(key, order, batch, None), f"{batch} {kind[batch]}, {counts}", "Append", "None")
    return summary_of(changes.groupBy(batch).transformWithStateInPandas(BatchCounts(batch), f"{batch} {kind[batch]}, {counts}", "Append", "None"), batch)


def summary_of(counts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The counters as they are shown: percent done and mean time rounded, and the batch's status."""

    def rounded(top: Column, n: Column) -> Column:
        return F.coalesce(F.floor(top / F.nullif(n, F.lit(0)) + 0.5), F.lit(0)).cast("long")

    col = F.col
    shown = [c for c in COUNTS if c not in ("ok", "ok_time", "all_time")]
    return counts.select(batch, *shown, rounded(col("done") * 100, col("total")).alias("percent"), rounded(col("ok_time") / 1000, col("ok")).alias("avg_ms"), (col("all_time") / 1000).alias("total_ms"), F.when(col("failed") > 0, "partial-failed").otherwise("complete").alias("batch_status"))


def start_summary(events: DataFrame, out: str, checkpoint: str, batch: str = "batch_id", key: str = "item_id", order: str = "event_id"):
    """A query that writes the summaries of each micro-batch to ``out``/micro_batch=<number>, written anew if it is run again."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")

    return start(live_summary(events, batch, key, order).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True), events.sparkSession)
