"""The verification job: eight field results and an overall status for each pair, in one narrow step."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import explain, fixed, fuzzy, strict, text
from tallymark.operators import status as st

_DETAIL = ("found", "expected", "delta", "tolerance", "distance", "similarity", "ai_confidence")


def verify_labels(pairs: DataFrame, judged: str | None = None) -> DataFrame:
    """``pairs`` with ``field_results`` (array of eight structs in a fixed order) and ``overall``.

    Expected columns: beverage, brand, class_type, abv, net_contents, bottler_name,
    bottler_address, country, warning_required. Read ones, each null where the model gave none of
    the right type: brand_value, class_value, abv_text, abv_percent, net_text, bottler_value,
    address_value, origin_value, statement_text, raw_text, with brand_confidence and so on (or
    one ``confidence`` for all), bottler_evidence and image_poor. ``judged`` names a map column
    from field to a judge's verdict on pairs that the ladder leaves gray.
    """
    layers, rows, told, overall = _steps(frozenset(pairs.columns), judged, id(SparkContext._gateway))
    kept, step = pairs.columns, pairs
    for layer in layers:
        step = step.withColumns(layer)
    done = step.select(*kept, rows.alias("_rows"))
    return done.select(*kept, told.alias("field_results"), overall.alias("overall"))


def spread(pairs: DataFrame, scan: DataFrame) -> DataFrame:
    """``pairs`` dealt evenly over all cores where the scan they come from has fewer partitions than there are cores; larger inputs stay as it splits them."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(cores) if scan.rdd.getNumPartitions() < cores else pairs


@lru_cache(maxsize=16)
def _steps(have: frozenset[str], judged: str | None, gateway: int) -> tuple[list[dict[str, Column]], Column, Column, Column]:
    """Layers of columns, the array of results over them, the results as told, and the overall status.

    They depend on the names of the columns alone and are made once for a set of names.
    """
    def read(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def confidence(name: str) -> Column:
        return F.coalesce(read(f"{name}_confidence", "double"), read("confidence", "double"), F.lit(0.0))

    beverage, poor = F.col("beverage"), F.coalesce(read("image_poor", "boolean"), F.lit(False))
    imported = ~text.is_united_states(F.col("country"))
    abv_text = F.coalesce(read("abv_text"), F.concat(F.regexp_replace(read("abv_percent", "double").cast("string"), r"\.0$", ""), F.lit("%")))
    # Each layer's columns are made once and read by the layers after it.
    layers = fuzzy.ladder_layers({"_brand": (read("brand_value"), F.col("brand"), "text"), "_class": (read("class_value"), F.col("class_type"), "text"), "_bottler": (read("bottler_value"), F.col("bottler_name"), "text"), "_address": (read("address_value"), F.col("bottler_address"), "address"), "_origin": (read("origin_value"), F.col("country"), "origin")})
    layers.append({"_abv_text": abv_text, "_found_ml": strict.parse_volume(read("net_text")), "_expected_ml": strict.parse_volume(F.col("net_contents")), "_statement": text.pick_statement(F.coalesce(read("raw_text"), F.lit("")), read("statement_text")), "_imported": imported, "_phrase": text.function_phrase(read("raw_text"), read("bottler_evidence"))})
    layers.append({"_read": strict.parse_abv(F.col("_abv_text")), "_volume": strict.check_volume(F.col("_found_ml"), F.col("_expected_ml")), "_body": F.when(text.trim(F.col("_statement")).startswith(fixed.STATEMENT_PREFIX), text.statement_body(F.col("_statement"))), "_standard": strict.is_standard_fill(F.col("_found_ml"), beverage)})
    layers.append({"_warning": text.check_statement(F.col("_statement"), F.col("_body")), "_distance": text.statement_distance(F.col("_statement"), F.col("_body")), "_read_abv": F.col("_read.abv"), "_read_proof": F.col("_read.proof")})
    check = strict.check_abv(F.struct(F.col("_read_abv").alias("abv"), F.col("_read_proof").alias("proof")), F.col("abv"), beverage)
    layers.append({f"_abv_{k}": check[k] for k in ("result", "found", "delta", "tolerance")})
    imported = F.col("_imported")

    def asked(field: str) -> Column:
        return st.requirement(beverage, field, F.col("abv"), imported)

    ladders = {"_brand": (0, "brand"), "_class": (1, "class"), "_bottler": (4, "bottler"), "_address": (5, "address"), "_origin": (6, "origin")}

    def judged_result(name: str, k: int) -> Column:
        kind = F.col(f"{name}_result")
        if not judged:
            return kind
        verdict = F.element_at(F.col(judged), fixed.FIELDS[k])
        return F.when(kind == "gray", F.when(verdict == "equivalent", "likely-match").when(verdict == "not_equivalent", "fail").otherwise("gray")).otherwise(kind)

    layers.append({f"{name}_kind": judged_result(name, k) for name, (k, _) in ladders.items()})
    layers.append({f"{name}_status": st.nuanced_status(F.col(f"{name}_kind"), confidence(sure), poor) for name, (_, sure) in ladders.items()})
    none = F.array(F.lit("field_not_required"))
    nothing, of_beverage = {n: F.lit(None).cast("double").alias(n) for n in _DETAIL}, beverage.alias("beverage")

    def detail_of(**numbers: Column) -> Column:
        return F.struct(*[numbers[n].cast("double").alias(n) if n in numbers else nothing[n] for n in _DETAIL], of_beverage)

    no = F.lit(False)

    def result(k: int, status: Column, value: Column, expected: Column, sure: Column, outcomes: Column, validated: Column, detail: Column, poor_here: Column = poor) -> Column:
        return F.struct(F.lit(fixed.FIELDS[k]).alias("field"), F.lit(fixed.FIELD_LABELS[k]).alias("label"), status.alias("status"), value.cast("string").alias("value"), expected.cast("string").alias("expected"), explain.displayed_confidence(sure, validated).alias("confidence"), outcomes.alias("outcomes"), detail.alias("detail"), poor_here.alias("poor"), validated.alias("validated"))

    def unless(k: int, skip: Column, value: Column, expected: Column, then: Column) -> Column:
        return F.when(skip, result(k, F.lit("not-required"), value, expected, F.lit(1.0), none, no, detail_of())).otherwise(then)

    def by_ladder(name: str, value: Column, expected: Column) -> Column:
        k, sure = ladders[name]
        kind, status = F.col(f"{name}_kind"), F.col(f"{name}_status")
        outcome = F.concat(F.lit("nuanced_"), F.when(kind == "gray", "manual_review").otherwise(F.regexp_replace(kind, "-", "_")))
        outcomes = F.array(outcome)
        if name == "_bottler":
            silent = status.isin("pass", "likely-match") & F.col("_phrase").isNull()
            outcomes = F.when(silent, F.array(F.lit("bottler_function_phrase_missing"), outcome)).otherwise(outcomes)
            status = F.when(silent, "warning").otherwise(status)
        return result(k, status, value, expected, confidence(sure), outcomes, kind.isin("pass", "pass-normalised", "likely-match"), detail_of(similarity=F.col(f"{name}_similarity")))

    abv_sure = F.greatest(confidence("abv"), confidence("abv_percent")) if "abv_percent_confidence" in have else confidence("abv")
    abv_passed = F.col("_abv_result") == "pass"
    abv_row = result(2, st.strict_status(F.col("_abv_text").isNull(), abv_passed, poor, abv_sure), F.col("_abv_text"), F.col("abv"), abv_sure, F.array(F.concat(F.lit("abv_"), F.col("_abv_result"))), abv_passed, detail_of(found=F.col("_abv_found"), expected=F.col("abv"), delta=F.col("_abv_delta"), tolerance=F.col("_abv_tolerance")))
    passed = F.col("_volume") == "pass"
    odd = passed & ~F.col("_standard")
    volume_kind = F.concat(F.lit("net_contents_"), F.col("_volume"))
    volume_status = F.when(odd, "warning").otherwise(st.strict_status(read("net_text").isNull(), passed, poor, confidence("net")))
    volume_row = result(3, volume_status, read("net_text"), F.col("net_contents"), confidence("net"), F.when(odd, F.array(F.lit("net_contents_non_standard_fill"), volume_kind)).otherwise(F.array(volume_kind)), passed, detail_of(found=F.col("_found_ml"), expected=F.col("_expected_ml")))
    said = F.col("_warning") == "pass"
    warn_sure = confidence("statement")
    warn_status = st.strict_status(no, said, poor, F.when(warn_sure == 0, fixed.STATEMENT_CONFIDENCE).otherwise(warn_sure))
    warn_row = result(7, warn_status, read("statement_text"), F.lit("27 CFR § 16.21 verbatim text"), warn_sure, F.array(F.concat(F.lit("gov_warning_"), F.col("_warning"))), said, detail_of(distance=F.col("_distance")))
    unasked = result(7, F.lit("not-required"), read("statement_text"), F.lit(None), warn_sure, none, no, detail_of(), no)
    rows = [
        unless(0, asked("brand") == "not-applicable", F.lit(None), F.col("brand"), by_ladder("_brand", read("brand_value"), F.col("brand"))),
        unless(1, asked("classType") == "not-applicable", F.lit(None), F.col("class_type"), by_ladder("_class", read("class_value"), F.col("class_type"))),
        unless(2, (asked("abv") == "not-applicable") | (asked("abv") == "optional") & F.col("_abv_text").isNull(), F.col("_abv_text"), F.col("abv"), abv_row),
        volume_row,
        unless(4, asked("bottlerName") == "not-applicable", F.lit(None), F.col("bottler_name"), by_ladder("_bottler", read("bottler_value"), F.col("bottler_name"))),
        unless(5, asked("bottlerAddress") == "not-applicable", F.lit(None), F.col("bottler_address"), by_ladder("_address", read("address_value"), F.col("bottler_address"))),
        unless(6, (asked("countryOfOrigin") == "not-applicable") | (asked("countryOfOrigin") == "optional") & read("origin_value").isNull(), F.lit(None), F.col("country"), by_ladder("_origin", read("origin_value"), F.col("country"))),
        F.when(F.col("warning_required"), warn_row).otherwise(unasked),
    ]
    def told(r: Column) -> Column:
        same = [r[n].alias(n) for n in ("field", "label", "status", "value", "expected", "confidence", "outcomes")]
        return F.struct(*same, explain.explanation(r["outcomes"][0], r["detail"]).alias("explanation"), explain.suggested_action(r["status"], r["poor"], r["validated"]).alias("action"))

    overall = st.rollup_array(F.transform("_rows", lambda r: r["status"]))
    return layers, F.array(*rows), F.transform("_rows", told), overall
