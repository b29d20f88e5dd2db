"""Stored histories, places and quantiles over ranges, state streams, quarantine, reruns, mixed CSV headers."""

import os
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.operators import evaluate, pairing, ranks, review
from tallymark.sources import expected, versions
from tallymark.streaming import jobs, states


def files_of(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "reviews")
    rows = spark.range(200).select(F.col("id").alias("review_id"), F.lit("a").alias("overall"))
    assert versions.create(rows, root, buckets=8) == 1
    before = files_of(root)
    change = spark.createDataFrame([(5, "b"), (1000, "b")], "review_id long, overall string")
    assert versions.upsert(spark, root, change) == 2
    assert before.items() <= files_of(root).items(), "a change leaves the files that are there as they are"
    new = {e.bucket: e.path for e in versions._manifest(spark, root, 2)[1]}
    old = {e.bucket: e.path for e in versions._manifest(spark, root, 1)[1]}
    touched = {r.b for r in change.select(versions.bucket_of(F.col("review_id"), 8).alias("b")).collect()}
    assert {b for b in new if new[b] != old.get(b)} == touched, "only touched buckets are written"
    assert versions.delete(spark, root, spark.range(0, 200, 2).withColumnRenamed("id", "review_id")) == 3
    want = {1: {k: "a" for k in range(200)}}
    want[2] = want[1] | {5: "b", 1000: "b"}
    want[3] = {k: v for k, v in want[2].items() if k >= 200 or k % 2}
    for v, rows_of_v in want.items():
        assert {r.review_id: r.overall for r in versions.read(spark, root, v).collect()} == rows_of_v
        assert versions.count(spark, root, v) == len(rows_of_v)
    assert versions.delete(spark, root, versions.read(spark, root)) == 4
    assert versions.read(spark, root).count() == 0 and versions.read(spark, root).columns == ["review_id", "overall"]
    assert versions.upsert(spark, root, change) == 5 and versions.count(spark, root) == 2


def test_a_change_that_fails_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "reviews")
    versions.create(spark.range(50).withColumnRenamed("id", "review_id"), root, buckets=4)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            versions.upsert(spark, root, spark.range(50, 60).withColumnRenamed("id", "review_id"))
    assert versions.versions(spark, root) == [1] and versions.read(spark, root).count() == 50
    versions.upsert(spark, root, spark.range(50, 60).withColumnRenamed("id", "review_id"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):  # a second writer of version 2
        versions._commit(spark, root, 2, [], 4, "")
    assert versions.read(spark, root).count() == 60


def test_places(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["synthetic", "synthetic", "photo", None]), k) for k in draw.sample(range(1000), 300)]
    want = {}
    for s in {s for s, _ in rows}:
        want |= {(s, k): n for n, k in enumerate(sorted(k for t, k in rows if t == s), 1)}
    df = spark.createDataFrame(rows, "source string, id long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts < 17)
        assert {(r.source, r.id): r.n for r in ranks.with_places(df, "source", "id", "n").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.with_places(df.limit(0), "source", "id", "n").count() == 0


@pytest.mark.parametrize("values", [[], [7.0], [1.0, 2.0], [5.0] * 50, [3.0] * 40 + [9.0] * 41, [None, None], [None, 4.0, 1.0], [float(k * k % 101) for k in range(500)]])
def test_quantiles(spark, values):
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    found = ranks.order_statistics(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x", shares)
    kept = [v for v in values if v is not None]
    for q in shares:
        assert found[q] is None if not kept else abs(found[q] - float(np.quantile(kept, q))) < 1e-9
    row = evaluate.latency_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert row.p50 == (found[0.5] or 0.0)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_without_one_task_steps(spark):
    new = spark.range(1000).select(F.col("id").alias("app_id"), (F.col("id") % 3).alias("importer"))
    queued = spark.range(5).select((F.col("id") % 2).alias("importer"))
    capped = pairing.cap_batch(new, queued, "importer", "app_id", 250)
    assert "WindowGroupLimit" in plan_of(capped)
    assert {r.importer: r.n for r in capped.groupBy("importer").agg(F.count("*").alias("n")).collect()} == {0: 247, 1: 248, 2: 250}
    results = new.select(F.lit(False).alias("skipped"), F.lit(True).alias("matched"), F.col("app_id").cast("double").alias("latency_ms"), F.lit(1.0).alias("cost_usd"))
    assert "percentile" not in plan_of(evaluate.score_golden(results)).lower()
    assert evaluate.score_golden(results).first().p50 == 499.5


EVENTS = [(k, draw, kind, float(took), overall, bad) for k, (draw, kind, took, overall, bad) in enumerate((random.Random(k).randint(0, 29), random.Random(k + 1000).choice(["start", "complete", "error", "retry"]), random.Random(k + 2000).randint(1, 9999) / 100, random.Random(k + 3000).choice([*fixed.OVERALL_STATUSES, None]), random.Random(k + 4000).random() < 0.3) for k in range(400))]


def plain_summary(events):
    """From all events anew: the last of each row, added up by batch."""
    last = {}
    for e in sorted(events):
        last[e[1]] = e
    out = {}
    for item, (_, _, kind, took, overall, bad) in last.items():
        b = out.setdefault(item % 4, dict.fromkeys(["total", "failures", "quality_issues", "done", "failed", "ok", "ok_time", "all_time", *fixed.OVERALL_STATUSES], 0))
        ok = kind == "complete"
        b["total"] += 1
        b["failures"] += not ok
        b["done"] += kind in ("complete", "error")
        b["failed"] += kind == "error"
        b["quality_issues"] += ok and bad
        b["ok"] += ok
        b["ok_time"] += round(took * 1000) if ok else 0
        b["all_time"] += round(took * 1000) if kind in ("complete", "error") else 0
        if ok and overall:
            b[overall] += 1
    return {k: (b["total"], b["failures"], b["quality_issues"], b["done"], b["failed"], int(b["done"] * 100 / b["total"] + 0.5), int(b["ok_time"] / 1000 / b["ok"] + 0.5) if b["ok"] else 0, b["all_time"] / 1000, *[b[s] for s in fixed.OVERALL_STATUSES]) for k, b in out.items()}


def test_running_summary_over_restarts(spark, tmp_path):
    schema = "event_id long, item_id long, kind string, duration_ms double, overall string, quality_issue boolean, batch_id long"
    seen = []
    for k in range(3):  # events of all times in each part, so that late ones come after those that they may not undo
        part = [e for e in EVENTS if e[0] % 3 == k]
        seen += part
        spark.createDataFrame([(*e, e[1] % 4) for e in part], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        states.start_summary(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = {r.batch_id: (r.total, r.failures, r.quality_issues, r.done, r.failed, r.percent, r.avg_ms, r.total_ms, *[r[f"n_{s.replace('-', '_')}"] for s in fixed.OVERALL_STATUSES]) for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("micro_batch") == k).collect()}
        assert got == plain_summary(seen)
    assert spark.conf.get(states._PROVIDER, "") != states._ROCKSDB or "RocksDB" in os.environ.get("SPARK_CONF", ""), "the session keeps its own setting"


def test_many_keys_of_few_events_are_gone_over_as_rows():
    """A frame for each key took some 4 ms a call; the rows of 20,000 keys are folded in a few seconds."""
    class Held:
        at, rows = None, {}

        def get(self):
            return self.rows.get(self.at)

        def update(self, row):
            self.rows[self.at] = row

    folded = states.RowState("item_id", "event_id", "batch_id", None)
    folded.row = held = Held()
    event = Row("event_id", "item_id", "kind", "duration_ms", "overall", "quality_issue", "batch_id")
    began = time.process_time()
    for item in range(20000):
        held.at = item
        out = list(folded.handleInputRows((item,), iter([event(7, item, "complete", 1.5, "pass", True, 3), event(None, item, "error", 9.0, None, None, 3), event(2, item, "start", None, None, None, 3)]), None))
        assert [r.asDict() for r in out] == [{"batch_id": 3, **states.counts_for((7, "complete", 1.5, "pass", True, 3))}]
    assert time.process_time() - began < 10
    held.at = 5
    (change,) = folded.handleInputRows((5,), iter([event(8, 5, "error", float("nan"), "pass", True, 3)]), None)
    assert held.rows[5] == (8, "failed", None, None, None, 4) and (change.total, change.n_pass, change.failed, change.ok_time) == (0, -1, 1, -1500)
    (change,) = folded.handleInputRows((5,), iter([event(1, 5, "complete", 1.0, "pass", True, 3)]), None)
    assert held.rows[5] == (8, "failed", None, None, None, 5) and not any(change[c] for c in states.COUNTS), "a late event undoes nothing"


def test_row_states_survive_a_restart(spark, tmp_path):
    schema = "event_id long, item_id long, kind string, duration_ms double"
    rows = [e[:4] for e in EVENTS]
    for half in (rows[200:], rows[:200]):
        spark.createDataFrame(half, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        states.start(jobs.discard(states.row_states(stream), str(tmp_path / "cp")), spark).awaitTermination()
    want = jobs.fold_batch(spark.createDataFrame(rows, schema))
    assert sorted(states.stored_rows(spark, str(tmp_path / "cp")).collect()) == sorted(want.collect())


def test_quarantine(spark, tmp_path, monkeypatch):
    """Two files of good and bad lines, one file a micro-batch; each line is in the output or in the quarantine."""
    monkeypatch.setattr(jobs, "verify_stream", lambda batch, applications, key: batch.join(applications, key))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"app_id": 1, "t": "x"}\n{"app_id": 2, "t": \nnot json\n')
    (tmp_path / "in" / "b.json").write_text('{"app_id": 3, "t": "raise"}\n{"app_id": 9, "t": "x"}\n{"app_id": 4, "t": "y"}\n')

    def reads(job):
        if job["t"] == "raise":
            raise ValueError("no text")
        return job["t"].upper()

    arriving = jobs.labels_arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], "app_id long, t string").schema, files=1)
    q = jobs.start_verification(arriving, spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "app_id long"), str(tmp_path / "out"), str(tmp_path / "cp"), extractor=reads)
    q.awaitTermination()
    assert sorted((r.app_id, r.extracted, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect())[0][:2] == (1, "X")
    assert sorted((r.app_id, r.extracted) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "X"), (4, "Y")]
    bad = spark.read.parquet(str(tmp_path / "out") + "-quarantine").collect()
    assert sorted((r.app_id or 0, r.reason) for r in bad) == [(0, "malformed"), (0, "malformed"), (3, "check failed: no text"), (9, "no application")]
    assert {r.line for r in bad if r.reason == "malformed"} == {'{"app_id": 2, "t": ', "not json"} and len({r.batch for r in bad}) == 2


def test_rerun_failed(spark):
    items = spark.createDataFrame([(1, "complete", None, 1, "pass"), (2, "failed", "timeout", 1, None), (3, "failed", "timeout", 3, None), (4, "queued", None, 1, None)], "review_id long, status string, error string, version long, overall string")
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "review_id long, text string")
    asked = []

    def check(rows):
        asked.append(sorted(r.review_id for r in rows.collect()))
        return rows.select("review_id", F.upper("text").alias("overall"))

    once = review.rerun_failed(items, inputs, check)
    want = [(1, "complete", None, 1, "pass"), (2, "complete", None, 2, "B"), (3, "failed", "timeout", 3, None), (4, "queued", None, 1, None)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, review.rerun_failed(once, inputs, check).collect())) == want
    assert asked == [[2], []]


def test_csv_headers_of_each_file(spark, tmp_path):
    names = fixed.EXPECTED_COLUMNS
    row = dict(zip(names, ("a.png", "Old Tom", "Gin", "40", "750 mL", "Acme", '"Bardstown, KY"', "France", "yes", "", "wine"), strict=True)) if len(names) == 11 else None

    def write(name, order, head=None, **changed):
        (tmp_path / name).write_text(",".join(head or order) + "\n" + ",".join((row | changed).get(c, "") for c in order) + "\n")

    write("1.csv", names)
    swapped = ["classType" if c == "brand" else "brand" if c == "classType" else c for c in names]
    write("2.csv", swapped, filename="b.png", brand="Brand", classType="CT")
    write("3.csv", ["extra", *reversed(names), "brand"], filename="c.png")
    write("4.csv", names, head=["﻿" + names[0], *(f" {c} " for c in names[1:])], filename="d.png")
    write("5.csv", [c for c in names if c not in ("abv", "beverageType")], filename="e.png")
    (tmp_path / "6.csv").write_text("\n  \n")
    rows, errors = expected.read_expected_csv(spark, str(tmp_path))
    found = {r.filename: (r.brand, r.classType, r.bottlerAddress, r.line) for r in rows.collect()}
    assert found == {"a.png": ("Old Tom", "Gin", "Bardstown, KY", 2), "b.png": ("Brand", "CT", "Bardstown, KY", 2), "c.png": ("Old Tom", "Gin", "Bardstown, KY", 2), "d.png": ("Old Tom", "Gin", "Bardstown, KY", 2)}
    assert sorted((Path(e.file).name, e.message) for e in errors.collect()) == [("5.csv", "CSV header row is missing required column(s): abv, beverageType."), ("6.csv", "CSV is empty.")]
