"""The review history: writing, filtering, batches, overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.operators.pairing import latest_version


def upsert_reviews(history: DataFrame, changes: DataFrame, key: str = "review_id") -> DataFrame:
    """The history with each change put in: a row of the same key is replaced. Keys of ``changes`` are unique.

    For a stored history, of which only a part should be written again, see ``sources.versions``.
    """
    return history.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_reviews(history: DataFrame, ids: DataFrame, key: str = "review_id") -> DataFrame:
    return history.join(ids.select(key), key, "left_anti")


def count_reviews(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("n"))


def filter_reviews(reviews: DataFrame, search: str = "", overall: str | None = None, beverage: str | None = None, only_overrides: bool = False) -> DataFrame:
    """The exact filters first, so that they reach the scan; the search is a part of brand or reviewer in any case."""
    out = reviews
    if overall:
        out = out.filter(F.col("overall") == overall)
    if beverage:
        out = out.filter(F.col("beverage") == beverage)
    if only_overrides:
        out = out.filter("has_overrides")
    if wanted := search.strip().lower():
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "brand", "reviewer")), F.lit(wanted)))
    return out


def batch_filter(kind: str) -> Column:
    """The predicate of a status filter over (status, has_failures, overall, has_overrides)."""
    return {
        "all": F.lit(True),
        "queued": F.col("status") == "queued",
        "processing": F.col("status") == "processing",
        "complete": F.col("status") == "complete",
        "failed-only": F.col("status") == "failed",
        "has-failures": F.col("has_failures") | F.coalesce(F.col("overall") == "fail", F.lit(False)),
        "overridden-only": F.col("has_overrides"),
    }[kind]


def filter_batch_items(items: DataFrame, status: str = "all", beverage: str | None = None) -> DataFrame:
    out = items.filter(batch_filter(status))
    return out.filter(F.col("beverage") == beverage) if beverage else out


def retry_failed(items: DataFrame) -> DataFrame:
    """Failed rows are queued again without their error; others stay."""
    failed = F.col("status") == "failed"
    return items.withColumns({"status": F.when(failed, "queued").otherwise(F.col("status")), "error": F.when(~failed, F.col("error"))})


def rerun_failed(items: DataFrame, inputs: DataFrame, check: Callable[[DataFrame], DataFrame], key: str = "review_id") -> DataFrame:
    """``items`` (key, status, error, version and results) whose failed rows are checked again and merged by version.

    check: from rows of ``inputs`` (key and what is checked) to (key, results); only the failed rows' inputs go through it. A row that it gives back is complete under
    the next version; one that has no input, or that it leaves out, stays failed. Once nothing is failed, a run changes nothing.
    """
    failed = items.filter(F.col("status") == "failed")
    done = check(inputs.join(failed.select(key), key, "left_semi"))
    results = [c for c in done.columns if c != key]
    kept = failed.drop(*results).join(done, key).withColumns({"status": F.lit("complete"), "error": F.lit(None).cast("string"), "version": F.col("version") + 1})
    return latest_version(items.unionByName(kept.select(items.columns)), key, "version")


def snapshot_completed(items: DataFrame, running: bool, started: Column) -> DataFrame:
    """The completed rows as an export of a batch that may still run."""
    reviewer = F.when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "—").otherwise(F.col("reviewer"))
    return items.filter(F.col("status") == "complete").withColumns({"batch_status": F.lit("processing" if running else "complete"), "reviewer": reviewer, "created_at": started})


def newest_first(df: DataFrame, created: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(created), F.desc(key))


def summary_columns() -> list[Column]:
    """The ten counters of a batch over (overall, ok, quality_issue, processing_ms)."""
    counted = [F.count_if(F.col("ok") & (F.col("overall") == s)).alias(f"n_{s.replace('-', '_')}") for s in fixed.OVERALL_STATUSES]
    return [F.count("*").alias("total"), *counted, F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("ok") & F.col("quality_issue")).alias("quality_issues"), F.coalesce(F.floor(F.avg(F.when(F.col("ok"), F.col("processing_ms"))) + 0.5), F.lit(0)).cast("long").alias("avg_ms"), F.coalesce(F.round(F.sum("processing_ms"), 2), F.lit(0.0)).alias("total_ms")]


def batch_summary(items: DataFrame, key: str = "batch_id") -> DataFrame:
    return items.groupBy(key).agg(*summary_columns())


def batch_progress(items: DataFrame, key: str | None = None) -> DataFrame:
    """total, done, failed, percent, batch_status; one row for each key."""
    done, failed = F.count_if(F.col("status").isin("complete", "failed")), F.count_if(F.col("status") == "failed")
    grouped = items.groupBy(key) if key else items.groupBy()
    return grouped.agg(F.count("*").alias("total"), done.alias("done"), failed.alias("failed"), F.coalesce(F.floor(done * 100 / F.nullif(F.count("*"), F.lit(0)) + 0.5), F.lit(0)).cast("long").alias("percent"), F.when(failed > 0, "partial-failed").otherwise("complete").alias("batch_status"))


def review_flags(fields: DataFrame, key: str = "review_id") -> DataFrame:
    """key, has_overrides, has_failures (by what the model said)."""
    return fields.groupBy(key).agg(F.bool_or(F.col("human_status").isNotNull()).alias("has_overrides"), F.bool_or(F.col("ai_status") == "fail").alias("has_failures"))


def compose_reviews(reviews: DataFrame, fields: DataFrame, rules_version: str, key: str = "review_id") -> DataFrame:
    """``reviews`` (key, brand, reviewer and more) with what their fields say: has_overrides, has_failures, boxes, rules_version.

    fields: key, field, ai_status, human_status and box, a struct that is null where nothing was
    located. ``boxes`` maps each located field to a list of its one box; reviewers are trimmed.
    A review has at most eight fields.
    """
    located = F.sort_array(F.collect_list(F.when(F.col("box").isNotNull(), F.struct("field", F.array("box").alias("boxes")))))
    told = review_flags(fields, key).join(fields.groupBy(key).agg(F.map_from_entries(located).alias("boxes")), key)
    made = reviews.withColumn("reviewer", F.trim("reviewer")).join(told, key, "left")
    return made.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("has_overrides", "has_failures")} | {"rules_version": F.lit(rules_version)})


def override_audit(fields: DataFrame, key: str = "field_no") -> DataFrame:
    """How often people replaced each status of each field, and by which."""
    return fields.filter(F.col("human_status").isNotNull()).groupBy(key, "ai_status", "human_status").agg(F.count("*").alias("n"), F.count_if(F.col("ai_status") == F.col("human_status")).alias("n_same"))


def override_report(fields: DataFrame, key: str = "review_id", order: str = "field_no") -> DataFrame:
    """key, line (from 1, in the order of the fields), and of each overridden field both statuses, reason, reviewer and time.

    An override to the same status is a line too. A review has at most eight fields.
    """
    line = F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("line")
    return fields.filter(F.col("human_status").isNotNull()).select(key, line, order, "ai_status", "human_status", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("reviewer", F.lit("")).alias("reviewer"), "decided_at")


def fill_reviewers(overrides: DataFrame, decisions: DataFrame, key: str = "review_id") -> DataFrame:
    """``overrides`` whose blank reviewer is the one of the review's decision, where there is one; a decision is one row a review."""
    named = decisions.select(key, F.col("reviewer").alias("_decided_by"))
    own = F.nullif(F.trim(F.coalesce("reviewer", F.lit(""))), F.lit(""))
    return overrides.join(named, key, "left").withColumn("reviewer", F.coalesce(own, F.trim("_decided_by"), F.lit(""))).drop("_decided_by")


def validate_decisions(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid overrides, others): a reason that is not blank and has at most 500 characters."""
    reason = F.trim(F.coalesce("reason", F.lit("")))
    valid = (reason != "") & (F.char_length(reason) <= 500)
    return overrides.filter(valid), overrides.filter(~valid)


def valid_final(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid final decisions, others): a name and a choice, notes of at most 1000 characters."""
    choices = ("approved", "rejected", "manual-review", "request-better-image")
    valid = (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & F.coalesce(F.col("choice").isin(*choices), F.lit(False)) & (F.char_length(F.coalesce("notes", F.lit(""))) <= 1000)
    return decisions.filter(valid), decisions.filter(~valid)
