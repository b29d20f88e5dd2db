"""Readings of labels (a model's JSON), images, and reviews exported earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.functions.text import let

READING = "struct<value_type: string, value_str: string, value_num: double, value_bool: boolean, evidence: string, confidence: double>"
_NUMBER = "^(?:BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"
MAX_IMAGE_BYTES = 8 * 1024 * 1024


def _kind_of(schema: Column) -> Column:
    return F.when(schema == "STRING", "string").when(schema.rlike(_NUMBER), "number").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")


def _kind_of_variant(value: Column) -> Column:
    return let(F.schema_of_variant(value), _kind_of)


def _kind(where: str) -> Column:
    return _kind_of(F.schema_of_variant(F.try_variant_get("v", where, "variant")))


def _get(where: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(v, '{where}', '{kind}')")


def _once(parsed: Column) -> Column:
    """A parsed text as the row of a generator, which the optimizer does not copy into each expression that reads it."""
    return F.explode(F.array(parsed)).alias("v")


def _reading(held: Column) -> Column:
    """struct(reading, problems) of a struct(field, own): what a model's JSON has for a field."""
    def parts(own: Column) -> Column:
        at = F.try_variant_get
        return F.struct(own.alias("own"), _kind_of_variant(own).alias("own_kind"), at(own, "$.value", "variant").alias("inner"), at(own, "$.confidence", "variant").alias("told"))

    def typed(p: Column) -> Column:
        bare = F.coalesce(p["own_kind"].isin("string", "number", "boolean"), F.lit(False))
        sure = F.when(bare, 0.0).otherwise(F.try_variant_get(p["told"], "$", "double"))
        return F.struct(p["own"].alias("own"), p["own_kind"].alias("own_kind"), bare.alias("bare"), F.when(bare, p["own_kind"]).otherwise(_kind_of_variant(p["inner"])).alias("kind"), F.when(bare, p["own"]).otherwise(p["inner"]).alias("value"), sure.alias("sure"), F.schema_of_variant(p["told"]).rlike(_NUMBER).alias("is_sure"))

    def made(t: Column) -> Column:
        own, bare, kind, sure, name = t["own_kind"], t["bare"], t["kind"], t["sure"], held["field"]
        told = [F.when(kind == k, F.try_variant_get(t["value"], "$", cast)).alias(f"value_{n}") for n, k, cast in (("str", "string", "string"), ("num", "number", "double"), ("bool", "boolean", "boolean"))]
        reading = F.struct(kind.alias("value_type"), *told, F.when(~bare, F.try_variant_get(t["own"], "$.evidenceQuote", "string")).alias("evidence"), sure.alias("confidence"))
        problems = [F.when(~F.coalesce(bare | (own == "object"), F.lit(False)), F.concat(name, F.lit(": Required"))), F.when((own == "object") & ~F.coalesce(kind.isin("string", "number", "boolean", "null"), F.lit(False)), F.concat(name, F.lit(".value: Invalid input"))), F.when((own == "object") & ~F.coalesce(t["is_sure"], F.lit(False)), F.concat(name, F.lit(".confidence: Required"))), F.when((sure < 0) | (sure > 1), F.concat(name, F.lit(".confidence: must be between 0 and 1")))]
        return F.struct(reading.alias("reading"), F.array(*problems).alias("problems"))

    return let(let(let(held["own"], parts), typed), made)


def read_extractions(raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(readings, quarantined): JSON texts as typed readings, the others with their problems joined by ``; ``.

    A bare scalar in place of a field becomes a reading of confidence 0. A reading keeps the type
    of its value: later steps treat a number where text belongs as nothing read.
    """
    # One expression for all fields: written out field by field it makes methods that the JVM does not compile, and a path is read anew wherever its type matters.
    step = raw.select("*", _once(F.try_parse_json(column)))
    fields = fixed.EXTRACTED_FIELDS
    step = step.withColumn("_own", F.array(*[F.struct(F.lit(f).alias("field"), F.try_variant_get("v", f"$.{f}", "variant").alias("own")) for f in fields]))
    step = step.select("*", F.explode(F.array(F.transform("_own", _reading))).alias("_read"))
    made = {f: F.col("_read")[k]["reading"] for k, f in enumerate(fields)}
    problems = [F.when(F.col("v").isNull(), "(root): not a JSON object")]
    of_fields = F.when(F.col("v").isNotNull(), F.flatten(F.transform("_read", lambda r: r["problems"]))).otherwise(F.array().cast("array<string>"))
    sure = _get("$.extractionConfidence", "double")
    problems += [F.when(F.col("v").isNotNull() & (sure.isNull() | (sure < 0) | (sure > 1)), "extractionConfidence: must be between 0 and 1"), F.when(F.col("v").isNotNull() & ~F.coalesce(_kind("$.imageQualityNotes") == "array", F.lit(False)), "imageQualityNotes: Required")]
    out = step.withColumns(made | {"rawText": _get("$.rawText", "string"), "imageQualityNotes": _get("$.imageQualityNotes", "array<string>"), "extractionConfidence": sure, "problems": F.array_join(F.array_compact(F.concat(F.array(problems[0]), of_fields, F.array(*problems[1:]))), "; ")})
    kept = [*raw.columns, *made, "rawText", "imageQualityNotes", "extractionConfidence"]
    return out.filter("problems = ''").select(*kept), out.filter("problems <> ''").select(*raw.columns, "problems")


def scan_label_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decoded images, rejected: path, reason). Sizes are read from the listing.

    Files without a byte are passed over: no scan of Spark's lists them.
    """
    # The two sources write a local path with one slash and with three.
    def named(path: Column) -> Column:
        return F.regexp_replace(path, "^([a-z0-9]+):/{2,3}(?=/)", "$1:").alias("path")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(named(F.col("path")), "length")
    by_name = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin("png", "jpg", "jpeg", "gif", "bmp", "webp")
    reason = F.when(~by_name, "not an image").when(F.col("length") > MAX_IMAGE_BYTES, "larger than 8 MiB")
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).filter("image.width > 0 AND image.height > 0")
    accepted = files.withColumn("reason", reason)
    decoded = images.withColumn("path", named(F.col("image.origin")))
    good = decoded.join(accepted.filter("reason IS NULL").select("path"), "path", "left_semi")
    broken = accepted.filter("reason IS NULL").join(decoded.select("path"), "path", "left_anti").withColumn("reason", F.lit("cannot be decoded"))
    return good, accepted.filter("reason IS NOT NULL").unionByName(broken).select("path", "reason")


def read_reviews_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, quarantined) of exported review files, one envelope a file; unknown keys stay in ``rest``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _once(F.expr("try_variant_get(try_parse_json(value), '$.review', 'variant')")))
    texts = ("id", "createdAt", "reviewerName", "beverageType", "rulesVersion", "overall", "brand")
    defaults = {"rawText": ("string", ""), "processingTimeMs": ("double", 0.0), "ocrConfidence": ("double", 0.0), "imageWidth": ("double", 0.0), "imageHeight": ("double", 0.0), "hasOverrides": ("boolean", False)}
    problems = [F.when(F.col("v").isNull(), "review: Required")]
    problems += [F.when(F.col("v").isNotNull() & ~F.coalesce(_kind(f"$.{t}") == "string", F.lit(False)), f"{t}: Required") for t in texts]
    problems += [F.when(~_get("$.beverageType", "string").isin(*fixed.SHOWN_BEVERAGE.values()), "beverageType: Invalid enum value"), F.when(~_get("$.overall", "string").isin(*fixed.OVERALL_STATUSES), "overall: Invalid enum value"), F.when(F.col("v").isNotNull() & ~F.coalesce(_kind("$.fieldResults") == "array", F.lit(False)), "fieldResults: Required")]
    fields = _get("$.fieldResults", "array<struct<field: string, label: string, status: string, confidence: double, explanation: string>>")
    problems.append(F.when(F.exists(fields, lambda r: ~F.coalesce(r["status"].isin(*fixed.FIELD_STATUSES), F.lit(False))), "fieldResults.status: Invalid enum value"))
    columns = {t: _get(f"$.{t}", "string") for t in texts} | {n: F.coalesce(_get(f"$.{n}", kind), F.lit(default)) for n, (kind, default) in defaults.items()}
    columns |= {"fieldResults": fields, "rest": F.col("v"), "problems": F.array_join(F.array_compact(F.array(*problems)), "; ")}
    out = whole.withColumns(columns).drop("v")
    return out.filter("problems = ''").drop("problems"), out.filter("problems <> ''").select("file", "problems")
