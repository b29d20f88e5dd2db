import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallymark.functions import fixed, fuzzy
from tallymark.operators import evaluate, judge, locate, pairing, redline, status
from tallymark.plans import catalog
from tallymark.plans.verify import verify_labels
from tallymark.plans.views import frame
from tallymark.sources import expected, exports, readings
from tallymark.streaming import jobs

SMALL = "/root/testdata/sf0.001"
GOOD = f"{fixed.STATEMENT_PREFIX} {fixed.STATEMENT_BODY}"
CLEAN = {"label_id": 1, "beverage": "distilled-spirits", "brand": "Old Tom", "class_type": "Gin", "abv": 40.0, "net_contents": "750 mL", "bottler_name": "Acme", "bottler_address": "Bardstown, Kentucky", "country": "United States", "warning_required": True, "brand_value": "Old Tom", "class_value": "Gin", "abv_text": "40% Alc./Vol.", "net_text": "750 mL", "bottler_value": "Acme", "address_value": "Bardstown, KY", "origin_value": None, "raw_text": "Bottled by Acme " + GOOD, "statement_text": None, "bottler_evidence": "Bottled by Acme", "confidence": 0.9, "image_poor": False}
KINDS = ", ".join(f"{k} {'long' if k == 'label_id' else 'double' if k in ('abv', 'confidence') else 'boolean' if k in ('warning_required', 'image_poor') else 'string'}" for k in CLEAN)


EDITED = "Bottled by Acme " + GOOD + " More."
CASES = {
    "clean": {},
    "statement edit": {"raw_text": "Bottled by Acme " + GOOD.replace("General,", "General")},
    "abv off": {"abv_text": "38%"},
    "abv near": {"abv_text": "40.2%"},
    "wine over 14": {"beverage": "wine", "abv": 14.5, "abv_text": "12.5%"},
    "extra token": {"brand_value": "Old Tom Reserve"},
    "other brand": {"brand_value": "Zebra Quartz"},
    "poor image": {"image_poor": True},
    "no abv": {"abv_text": None},
    "malt without abv": {"beverage": "malt-beverage", "abv_text": None},
    "unknown": {"beverage": "unknown"},
    "odd size": {"net_contents": "680 mL", "net_text": "680 mL", "image_poor": True},
    "no phrase": {"bottler_evidence": "Acme", "raw_text": GOOD},
    "hole at 0": {"raw_text": EDITED, "confidence": 0.0},
    "hole at 0.3": {"raw_text": EDITED, "confidence": 0.3},
}


def test_golden_families(spark):
    rows = [tuple((CLEAN | changes | {"label_id": k}).values()) for k, changes in enumerate(CASES.values())]
    got = sorted(verify_labels(spark.createDataFrame(rows, KINDS)).collect(), key=lambda r: r.label_id)
    overall = {name: r.overall for name, r in zip(CASES, got, strict=True)}
    fields = {name: {f.field: f for f in r.field_results} for name, r in zip(CASES, got, strict=True)}
    assert [f.status for f in fields["clean"].values()] == ["pass"] * 6 + ["not-required", "pass"]
    assert overall["clean"] == overall["abv near"] == "pass"
    assert overall["statement edit"] == overall["abv off"] == overall["wine over 14"] == overall["other brand"] == "fail"
    assert fields["extra token"]["brand"].status == "likely-match"
    assert overall["poor image"] == "needs-manual-review" and fields["poor image"]["brand"].status == "manual-review"
    assert overall["no abv"] == "needs-manual-review"
    assert fields["malt without abv"]["abv"].status == fields["unknown"]["abv"].status == "not-required"
    assert fields["odd size"]["netContents"].status == "warning" and fields["odd size"]["netContents"].outcomes[0] == "net_contents_non_standard_fill"
    assert fields["no phrase"]["bottlerName"].status == "warning"
    assert fields["hole at 0"]["governmentWarning"].status == "fail"
    assert fields["hole at 0.3"]["governmentWarning"].status == "low-confidence"
    assert fields["clean"]["abv"].explanation == "Alcohol content 40% matches the expected 40% within tolerance."


def test_verification_does_not_shuffle(spark):
    pairs = spark.createDataFrame([tuple(CLEAN.values())], KINDS)
    plan = verify_labels(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_every_edit_is_rejected(spark):
    rows = evaluate.mutation_audit(spark.createDataFrame([(GOOD,)], "statement string")).collect()
    assert len(rows) >= 10 and all(r.n == r.rejected for r in rows)


def test_pairing_partitions_its_inputs(spark):
    labels = spark.createDataFrame([(1, "A.png"), (2, "a.jpg"), (3, "b.png"), (4, "c.png"), (5, "c.gif")], "id long, filename string")
    wanted = spark.createDataFrame([(1, "a.jpeg"), (2, "b.jpeg"), (3, "b.png"), (4, "d.png")], "id long, filename string")
    pairs = pairing.pair_labels(labels, wanted, "id", "id").collect()
    assert sorted((p.label_id, p.expected_id) for p in pairs) == [(1, 1), (3, 2)]
    assert sorted(r.id for r in pairing.unpaired_labels(labels, wanted, "id").collect()) == [2, 4, 5]
    assert [r.id for r in pairing.unpaired_expected(labels, wanted, "id").collect()] == [4]
    assert sorted((w.kind, w.filename) for w in pairing.pairing_warnings(labels, wanted, "id", "id").collect()) == [("expected", "b.png"), ("label", "a.jpg")]


def test_csv(spark, tmp_path):
    head = ",".join(fixed.EXPECTED_COLUMNS)
    good = 'a.png,Old Tom,Gin,40,750 mL,Acme,"Bardstown, KY",France,yes,,wine'
    bad = ["b.png,Old Tom,Gin,x,750 mL,Acme,B,France,yes,,wine", ",Old Tom,Gin,40,750 mL,Acme,B,France,yes,,wine", "c.png,,Gin,40,750 mL,Acme,B,France,yes,,wine", "d.png,O,Gin,40,750 mL,Acme,B,France,maybe,,wine", "e.png,O,Gin,140,750 mL,Acme,B,France,no,,wine"]
    (tmp_path / "x.csv").write_text("\n".join([head, good, "", *bad]) + "\n")
    rows, errors = expected.read_expected_csv(spark, str(tmp_path / "x.csv"))
    assert [(r.filename, r.abv, r.govWarningRequired, r.line) for r in rows.collect()] == [("a.png", 40.0, True, 2)]
    assert sorted(e.message for e in errors.collect()) == ['Line 3: abv must be a number (got "x").', "Line 4: filename is required.", "Line 5: brand — Brand name is required.", 'Line 6: govWarningRequired must be true/false (got "maybe").', "Line 7: abv — ABV cannot exceed 100."]
    (tmp_path / "y.csv").write_text("filename,brand\na,b\n")
    rows, errors = expected.read_expected_csv(spark, str(tmp_path / "y.csv"))
    assert rows.count() == 0 and "missing required column(s): classType" in errors.first().message


def test_json(spark, tmp_path):
    app = {"brand": "Old Tom", "classType": "Gin", "abv": 40, "netContents": "750 mL", "bottlerName": "Acme", "bottlerAddress": "B", "countryOfOrigin": "France", "govWarningRequired": True, "beverageType": "wine"}
    (tmp_path / "a.json").write_text(json.dumps([{"filename": " a.png ", "expected": app}, 7, {"filename": " "}, {"filename": "b", "expected": app | {"abv": "40"}}]))
    (tmp_path / "b.json").write_text("{}")
    rows, errors = expected.read_expected_json(spark, str(tmp_path))
    assert [(r.filename, r.abv, r.applicationNotes) for r in rows.collect()] == [("a.png", 40.0, "")]
    assert sorted(e.message for e in errors.collect()) == ["JSON must be an array of `{ filename, expected }` rows.", "Row 2: must be an object.", "Row 3: `filename` is required (non-empty string).", "Row 4: abv — ABV must be a number."]


def test_extractions(spark):
    field = {"value": "x", "evidenceQuote": None, "confidence": 0.5}
    good = {f: field for f in fixed.EXTRACTED_FIELDS} | {"imageQualityNotes": [], "extractionConfidence": 0.5, "brand": "bare", "abvPercent": 40}
    bad = {**good, "proof": {"value": 1, "evidenceQuote": None, "confidence": 2}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "nope")], "id long, json string")
    rows, quarantined = readings.read_extractions(df)
    row = rows.first()
    assert (row.brand.value_str, row.brand.confidence, row.abvPercent.value_num, row.abvPercent.value_type) == ("bare", 0.0, 40.0, "number")
    assert {q.id for q in quarantined.collect()} == {2, 3}


def test_exports(spark, tmp_path):
    reviews = spark.createDataFrame([("r1", "2026", "Ann", "wine", "v", "pass", "Old Tom", bytearray(b"img"))], "id string, createdAt string, reviewerName string, beverageType string, rulesVersion string, overall string, brand string, thumbnail binary")
    text = exports.review_json(reviews.withColumn("fieldResults", F.array().cast("array<struct<status:string>>")), "2026-01-01T00:00:00.000Z").first().json
    keys = list(json.loads(text)["review"])
    assert keys == sorted(keys) and json.loads(text)["review"]["thumbnailBase64"] == "aW1n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(text)
    (tmp_path / "in" / "b.json").write_text("{}")
    good, bad = readings.read_reviews_json(spark, str(tmp_path / "in"))
    assert [r.id for r in good.collect()] == ["r1"] and bad.count() == 1
    batch = spark.createDataFrame([("b1",)], "batch_id string")
    exports.publish_batch(batch, reviews.select("id"), str(tmp_path / "pub"), "v1")
    reviews.select("id").write.parquet(str(tmp_path / "pub/reviews/version=v2"))  # not in the manifest
    assert exports.read_published(spark, str(tmp_path / "pub"), "reviews").count() == 1


def test_judge(spark):
    df = spark.createDataFrame([(1, "a", "b", "brand", "gray"), (2, "a", "b", "brand", "gray"), (3, "x", "y", "brand", "gray"), (4, "p", "p", "brand", "pass")], "id long, extracted string, expected string, field string, result string")

    def says(extracted, expected, field):
        if extracted == "x":
            raise ValueError("no")
        return "equivalent", "same_entity"

    got = {r.id: (r.result, r.verdict) for r in judge.final_result(judge.judge_gray_pairs(df, says)).collect()}
    assert got == {1: ("likely-match", "equivalent"), 2: ("likely-match", "equivalent"), 3: ("manual-review", "uncertain"), 4: ("pass", None)}
    ran = judge.run_extractor(df.select("id"), lambda job: 1 // (job["id"] - 1)).collect()
    assert [r.ok for r in sorted(ran, key=lambda r: r.id)] == [False, True, True, True]


def test_judged_pairs_are_kept_over_runs(spark, tmp_path):
    asked_file, memo = tmp_path / "asked", str(tmp_path / "memo")
    df = spark.createDataFrame([(k, None if k == 9 else f"e{k % 6}", "b", "brand", "gray" if k < 10 else "pass") for k in range(12)], "id long, extracted string, expected string, field string, result string")

    def says(extracted, expected, field):
        with asked_file.open("a") as f:
            f.write(f"{extracted}\n")
        if extracted == "e5":
            raise ValueError("no answer")
        return "equivalent", "same_entity"

    def lost(extracted, expected, field):
        if extracted == "e3":
            raise SystemExit("the task is lost")
        return says(extracted, expected, field)

    def count():
        made = sorted(asked_file.read_text().split())
        asked_file.write_text("")
        return made

    with pytest.raises(Exception, match="lost|crashed|Job aborted|SystemExit"):
        judge.judge_gray_pairs(df, lost, memo=memo, blocks=6).count()
    first = [x for x in count() if x not in ("e5", "None")] if asked_file.exists() else []
    told = judge.judge_gray_pairs(df, says, memo=memo, blocks=6)
    again = count()
    done = {r.extracted for r in spark.read.parquet(memo).collect()}
    assert done >= {"e0", "e1", "e2", "e3", "e4"} and len(again) == len(set(again)) and "e3" in again
    assert set(first) | set(again) >= done - {None}
    got = {r.id: (r.verdict, r.reason) for r in told.collect()}
    yes, no = ("equivalent", "same_entity"), ("uncertain", "judge_failed")
    assert {k: v for k, v in got.items() if k != 9} == {k: (None, None) if k >= 10 else no if k % 6 == 5 else yes for k in range(12) if k != 9}
    assert count() == []  # reading the answer twice asks nothing
    judge.judge_gray_pairs(df, says, memo=memo)
    assert set(count()) == {"e5", "None"}  # what failed, and a null, which no key equals
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_judged_queries_read_rows_once(spark):
    """Verdicts are given to pairs and rows are joined to them: the ladder and the rows' view do not stand in the plan again for what is gray and for what is not."""
    for name in ("judge_gray_pairs", "judge_with_memo"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [p_partkey#") == 1 and "lambda" not in plan


def test_word_diff_keeps_most_and_leads_from_one_text_to_the_other():
    rng = np.random.default_rng(5)

    def kept_at_most(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b, 1):
                row.append(before[j - 1] + 1 if x == y else max(before[j], row[j - 1]))
        return row[-1]

    for _ in range(300):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        steps = list(redline.word_diff(a, b))
        assert [t for op, t in steps if op != "added"] == a and [t for op, t in steps if op != "removed"] == b
        assert sum(op == "kept" for op, _ in steps) == kept_at_most(a, b)
    assert list(redline.word_diff(["a", "b"], ["b", "a"])) == [("removed", "a"), ("kept", "b"), ("added", "a")]


def test_grids_of_any_shape_are_measured(spark):
    from tallymark.operators import quality

    rng = np.random.default_rng(3)
    grids = {k: rng.integers(0, 256, shape) for k, shape in enumerate([(3, 3), (4, 7), (7, 4), (2, 9), (9, 2), (1, 1), (25, 25)])}
    rows = [(k, g.shape[1], [int(v) for v in g.ravel()]) for k, g in grids.items()] + [(90, 3, []), (91, 3, None), (92, 4, [1] * 18), (93, 0, [1]), (94, None, [1]), (95, 1, [1, None])]
    df = spark.createDataFrame(rows, "image_id int, width int, lum array<int>")
    sharp = light = {r.image_id: r for r in quality.grid_signals(df).collect()}
    pixels = spark.createDataFrame([(k, x, y, int(v)) for k, g in grids.items() for (y, x), v in np.ndenumerate(g)], "image_id int, x int, y int, lum int").repartition(5)
    by_pixel = {r.image_id: r for r in quality.pixel_sharpness(pixels).collect()}
    for k, g in grids.items():
        edge = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
        want = edge.var() if edge.size else 0.0
        assert sharp[k].variance == pytest.approx(want) == by_pixel[k].variance and sharp[k].blurred == (want < 100) == by_pixel[k].blurred
        assert light[k].mean == pytest.approx(g.mean()) and light[k].bright_share == pytest.approx((g >= 248).mean())
    assert all(tuple(sharp[k]) == (k, None, None, None, None, None) for k in range(90, 96))
    plan = quality.pixel_sharpness(pixels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Window" not in plan


def test_stream_equals_batch(spark, tmp_path):
    events = frame(spark, SMALL, "v_event")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = jobs.fold_stream(stream, ttl_ms=None).writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = spark.read.parquet(out).groupBy("item_id").agg(F.max_by(F.struct("status", "duration_ms", "n_events"), "n").alias("s")).select("item_id", "s.*")
    want = jobs.fold_batch(events)
    assert last.count() == want.count() and last.exceptAll(want.select(*last.columns)).count() == 0


def test_verify_stream(spark, tmp_path):
    apps = ["beverage", "brand", "class_type", "abv", "net_contents", "bottler_name", "bottler_address", "country", "warning_required"]
    all_rows = spark.createDataFrame([tuple(CLEAN.values())], KINDS).withColumn("app_id", F.col("label_id"))
    labels = all_rows.drop(*apps)
    labels.unionByName(labels.withColumn("app_id", F.lit(99).cast("long"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(labels.schema).parquet(str(tmp_path / "in"))
    jobs.start_verification(stream, all_rows.select("app_id", *apps), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.overall for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["pass"]
    assert spark.read.parquet(str(tmp_path / "out-quarantine")).count() == 1


def test_redline_and_phrases(spark):
    df = spark.createDataFrame([(1, GOOD.replace("Surgeon ", "")), (2, GOOD)], "id long, s string")
    rows = redline.redline_summary(redline.statement_redline(df, "id", "s")).collect()
    assert [(r.token, r.op, r.n) for r in rows] == [("Surgeon", "removed", 1)]
    docs = locate.tokens_of(spark.createDataFrame([(1, "a b a b -- c d"), (2, None), (3, "A B, c? a b c")], "d long, t string"), "d", "t")
    phrases = locate.tokens_of(spark.createDataFrame([(7, "a b c"), (8, "b a c"), (9, " -- "), (10, None)], "p long, t string"), "p", "t")
    for most in (locate.BROADCAST_BYTES, 100):  # in one part, and in several
        assert [tuple(r) for r in locate.locate_phrase(docs, phrases, "d", "p", most).collect()] == [(3, 7, 0, 3)]
    located = locate.locate_phrase(docs, phrases, "d", "p")
    boxes = locate.layout_words(locate.words_of(spark.createDataFrame([(3, "A B, c? a b c")], "d long, t string"), "d", "t"), "d")
    assert [tuple(r) for r in locate.phrase_boxes(located, boxes, "d").collect()] == [(3, 7, 0, 3, 10, 10, 98, 40)]


def test_documents_keep_their_words_when_phrases_are_located(spark):
    docs = locate.tokens_of(spark.createDataFrame([(1, "a b")], "d long, t string"), "d", "t")
    plan = locate.locate_phrase(docs, docs.withColumnRenamed("d", "p"), "d", "p")._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan.split("== Physical Plan ==")[1]


def test_quotes_are_located_in_their_own_label(spark):
    rows = [("GOVERNMENT WARNING: (1) x y", "(1) X -- y"), ("see government warning: z", "not there"), ("nothing", "at all"), ("", ""), (None, None)]
    frame_ = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, words string, quote string")
    tokens, quotes = locate.tokens_of(frame_, "k", "words"), locate.tokens_of(frame_, "k", "quote").withColumnRenamed("tokens", "quote")
    words = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.struct((i * 10).alias("x0"), i.alias("y0"), (i * 10 + 9).alias("x1"), (i + 5).alias("y1")))
    made = tokens.join(quotes, "k").withColumn("place", locate.locate_quote(F.col("tokens"), F.col("quote"), F.array(F.lit("government"), F.lit("warning"))))
    got = {r.k: (r.place and tuple(r.place), r.box and tuple(r.box)) for r in made.select("k", "place", locate.quote_box(words, F.col("place")).alias("box")).collect()}
    assert got == {0: ((2, 3), (20, 2, 49, 9)), 1: ((1, 2), (10, 1, 29, 7)), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_rollup_matches_the_array_form(spark):
    fields = frame(spark, SMALL, "v_field")
    a = status.rollup_overall(fields, "review_id")
    b = fields.groupBy("review_id").agg(F.collect_list("ai_status").alias("s")).select("review_id", status.rollup_array(F.col("s")).alias("overall"))
    assert a.exceptAll(b).count() == 0


def test_registry(spark):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pending_is_an_anti_join(spark):
    plan = catalog.QUERIES["pending_queue"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_every_part_is_an_image(spark):
    sf_dir = "/root/testdata/sf0.001"
    side = np.arange(25)
    exposure = {r.image_id: r for r in catalog.QUERIES["image_exposure"](spark, sf_dir).collect()}
    sharpness = {r.image_id: r for r in catalog.QUERIES["image_sharpness"](spark, sf_dir).collect()}
    parts = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    assert len(parts) > 99 and sorted(exposure) == sorted(sharpness) == sorted(parts)
    for k in parts:
        lum = (k * 31 + side[:, None] * 17 + side[None, :] * 13 * (k % 3)) % 256
        inner = 4 * lum[1:-1, 1:-1] - lum[:-2, 1:-1] - lum[2:, 1:-1] - lum[1:-1, :-2] - lum[1:-1, 2:]
        assert exposure[k].mean == pytest.approx(lum.mean()) and exposure[k].bright_share == pytest.approx((lum >= 248).mean())
        assert sharpness[k].variance == pytest.approx(inner.var(), abs=1e-5) and sharpness[k].blurred == (inner.var() < 100)


def test_whole_items_and_their_passages_are_located(spark, tmp_path):
    item = "One two three four five six seven eight nine ten"
    docs = [f"x {item.upper()}, y", "one two three four five six but then another", "at the end: five six seven eight nine ten", "five six seven eight nine", "so be it"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "Be it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["locate_phrase"](spark, str(tmp_path)).select("doc_id", "item_id", "item_pos", "first_pos", "n_words").collect()}
    assert got == {(0, 1, 0, 1, 10), *((0, 1, k, k + 1, 6) for k in range(5)), (1, 1, 0, 0, 6), (2, 1, 4, 3, 6), (4, 2, 0, 1, 2)}


def test_images_are_scanned_and_measured(spark, tmp_path):
    import struct
    import zlib

    from tallymark.operators import quality

    def png(rows):
        def chunk(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")

    checks = [[255 * ((x + y) % 2) for x in range(8)] for y in range(8)]
    files = {"a.png": png(checks), "dark.png": png([[10] * 8] * 8), "thin.png": png([[250, 250]]), "empty.png": b"", "broken.jpg": b"no image", "note.txt": b"x", "large.png": b"x" * (8 * 1024 * 1024 + 1)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    good, rejected = readings.scan_label_images(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rejected.collect()} == {"broken.jpg": "cannot be decoded", "note.txt": "not an image", "large.png": "larger than 8 MiB"}
    got = {r.path.rsplit("/", 1)[1]: r for r in quality.image_signals(good).collect()}
    edge = np.array([[4 * v - 4 * (255 - v) for v in row[1:-1]] for row in checks[1:-1]])
    assert got["a.png"].variance == pytest.approx(edge.var()) and got["a.png"].bright_share == 0.5
    assert (got["dark.png"].mean, got["dark.png"].variance, got["thin.png"].variance, got["thin.png"].bright_share) == (10.0, 0.0, 0.0, 1.0)


def test_batch_bundle_is_written_as_files(spark, tmp_path):
    batches = spark.createDataFrame([("b1", ["r2", "r1", "gone"]), ("b2", [])], "batch_id string, review_ids array<string>")
    reviews = spark.createDataFrame([("r1", "pass", bytearray(b"img")), ("r2", "fail", None)], "id string, overall string, thumbnail binary")
    exports.write_batch_bundle(batches, reviews, str(tmp_path / "out"), "2026-01-01T00:00:00.000Z")
    made = {p.parent.parent.name + "/" + p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("part-*.txt")}
    assert sorted(made) == ["batch_id=b1/file=batch.json", "batch_id=b1/file=reviews%2Fr1.json", "batch_id=b1/file=reviews%2Fr2.json", "batch_id=b2/file=batch.json"]
    whole = made["batch_id=b1/file=batch.json"]
    assert list(whole) == ["batch", "exportedAt", "reviews", "schemaVersion"] and [r["id"] for r in whole["reviews"]] == ["r2", "r1"] and whole["reviews"][1]["thumbnailBase64"] == "aW1n"
    assert made["batch_id=b2/file=batch.json"]["reviews"] == []


def test_a_batch_that_runs_again_is_written_once(spark, tmp_path, monkeypatch):
    import shutil

    apps = spark.createDataFrame([(1, "wine")], "app_id long, beverage string")
    monkeypatch.setattr(jobs, "verify_stream", lambda batch, applications, key: batch.join(applications, key))
    spark.createDataFrame([(1, "x"), (2, "y")], "app_id long, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("app_id long, t string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.start_verification(stream, apps, str(tmp_path / "out"), str(tmp_path / "cp"), "app_id").awaitTermination(120)
        shutil.rmtree(tmp_path / "cp" / "commits")  # as if the driver was lost before it noted the batch
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 == spark.read.parquet(str(tmp_path / "out-quarantine")).count()


def test_longest_match_of_few_and_many_phrases(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    phrases = spark.createDataFrame([(w, k) for k, w in enumerate([*words, "w1 w2", "w2 w1", "", "é w3"])], "phrase string, ordinal int")
    texts = [None, "", "w", "nothing", "w1 w2", "w2 w1 w2 w1", "x w39x", "é w3 w1 w2", "w1 " * 500 + "w39"]
    df = spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "id int, t string, phrase string").repartition(3)
    few = {r.id: r.phrase for r in pairing.longest_match(df, "t", phrases, "id").collect()}
    assert few == {4: "w1 w2", 5: "w1 w2", 6: "w39", 7: "w1 w2", 8: "w39"}
    monkeypatch.setattr(pairing, "FEW_PHRASES", 10)
    many = pairing.longest_match(df, "t", phrases, "id")
    assert {r.id: r.phrase for r in many.collect()} == few
    assert pairing.longest_match(df, "t", phrases.limit(0), "id").count() == 0


def test_a_filter_on_two_tables_is_no_join_of_them(spark):
    """Readings are filtered by texts of part and supplier; the two are joined by their keys all the same, not each row with each."""
    read = frame(spark, SMALL, "v_ext").filter("lower(bottler_evidence) IS NOT NULL")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Inner, " not in "".join(x for x in plan.splitlines(True) if "NestedLoop" in x)


def test_methods_made_for_readings_are_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    made, left = readings.read_extractions(spark.createDataFrame([(1, "{}")], "label_id long, json string"))
    for rows in (made, left):
        told = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert all(int(x) < 8000 for x in re.findall(r"maxMethodCodeSize:([0-9]+)", told))


def test_a_filter_on_the_ladders_result_is_not_written_into_it(spark):
    rows = fuzzy.match_ladder(spark.createDataFrame([("a b", "a c")], "x string, y string"), "x", "y")

    def size(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("lambda")

    assert size(rows.filter("match_result = 'gray'")) == size(rows)


def test_distinct_pairs_give_what_each_row_gives(spark):
    df = spark.createDataFrame([(1, "a b", "a c"), (2, "a b", "a c"), (3, None, "x"), (4, None, "x"), (5, "x", None), (6, "X", "x")], "id int, x string, y string")
    assert sorted(map(str, fuzzy.match_distinct(df, "x", "y").collect())) == sorted(map(str, fuzzy.match_ladder(df, "x", "y").collect()))


def test_labels_that_share_a_number_are_each_checked_once(spark):
    """Three labels of one key in a batch: two that are read, one that the reader raises on."""
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (1, "bad")], "app_id long, brand_value string")

    def extractor(job):
        if job["brand_value"] == "bad":
            raise ValueError("unreadable")
        return job["brand_value"]

    good, bad = jobs.checked(batch, spark.createDataFrame([(1,)], "app_id long"), "app_id", extractor)
    assert sorted((r.brand_value, r.extracted) for r in good.collect()) == [("a", "a"), ("b", "b")]
    assert [r.reason for r in bad.collect()] == ["check failed: unreadable"]


def test_statements_do_not_go_through_the_driver(spark):
    """They are hundreds of times as long as the numbers they are made from, by which the planner judges them; so they are joined by a shuffle."""
    plan = catalog._job_pairs(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin [app_id" in x and "[label_id" in x for x in plan.splitlines())
    assert frame(spark, SMALL, "part").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
