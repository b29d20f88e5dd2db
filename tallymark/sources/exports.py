"""Exports: summary and per-field CSV, sorted JSON, and batches that appear as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import fixed
from tallymark.functions.explain import fixed_two
from tallymark.functions.text import export_filename

SCHEMA_VERSION, BATCH_SCHEMA_VERSION = "review/1", "batch/1"


def summary_rows(reviews: DataFrame) -> DataFrame:
    """The nine columns of a summary, all text."""
    values = (F.col("review_id").cast("string"), export_filename(F.col("brand"), F.col("review_id").cast("string")), F.col("brand"), F.col("beverage"), F.col("overall"), F.col("created_at").cast("string"), F.col("reviewer"), F.when(F.col("has_overrides"), "true").otherwise("false"), F.col("processing_ms").cast("string"))
    return reviews.select(*[v.alias(h) for v, h in zip(values, fixed.SUMMARY_HEADERS, strict=True)])


def field_rows(fields: DataFrame) -> DataFrame:
    """The eleven columns of a per-field export. Status is the model's; the audit columns are empty without an override."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    overridden = F.col("human_status").isNotNull()
    values = (text("review_id"), export_filename(F.col("brand"), F.col("review_id").cast("string")), text("field"), text("expected"), text("value"), text("ai_status"), fixed_two(F.col("confidence")), text("explanation"), F.when(overridden, text("ai_status")).otherwise(""), text("human_status"), F.when(overridden, text("reason")).otherwise(""))
    return fields.select(*[v.alias(h) for v, h in zip(values, fixed.FIELD_HEADERS, strict=True)])


def write_csv(rows: DataFrame, path: str) -> None:
    """Minimal quoting, a header in every file, ``\\n`` between lines."""
    rows.write.mode("errorifexists").csv(path, header=True, lineSep="\n", quoteAll=False, escape='"', emptyValue="")


def _sorted(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields in the order of their names, all the way down."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value


def _review_body(kind: T.StructType) -> Column:
    """A review as a struct with its fields in order, the thumbnail as base64."""
    fields = {f.name: _sorted(F.col(f.name), f.dataType) for f in kind.fields if f.name != "thumbnail"}
    if "thumbnail" in kind.names:
        fields |= {"thumbnailBase64": F.coalesce(F.base64("thumbnail"), F.lit("")), "thumbnailMimeType": F.lit("image/jpeg")}
    return F.struct(*[fields[n].alias(n) for n in sorted(fields)])


def review_json(reviews: DataFrame, exported_at: str) -> DataFrame:
    """id, json: one envelope for each review, keys sorted at every level, a thumbnail as base64.

    Columns that are null stay out of the text, as keys that a review does not have.
    """
    envelope = F.struct(F.lit(exported_at).alias("exportedAt"), _review_body(reviews.schema).alias("review"), F.lit(SCHEMA_VERSION).alias("schemaVersion"))
    return reviews.select(F.col("id").alias("id"), F.to_json(envelope, {"pretty": "true"}).alias("json"))


def batch_json(batches: DataFrame, reviews: DataFrame, exported_at: str, key: str = "batch_id") -> DataFrame:
    """key, json: one envelope for each batch with its reviews in the order of ``review_ids``; ids without a review are left out.

    A batch holds at most the cap of one upload (250 labels), so its reviews fit in one text.
    """
    listed = batches.select(key, F.posexplode("review_ids").alias("pos", "id"))
    held = listed.join(reviews.select("id", _review_body(reviews.schema).alias("body")), "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "body")), lambda a, b: a["pos"] - b["pos"]).alias("held"))
    batch = F.struct(*[_sorted(F.col(f.name), f.dataType).alias(f.name) for f in sorted(batches.schema.fields, key=lambda f: f.name)])
    empty = F.array().cast("array<struct<>>")
    found = batches.join(held, key, "left")
    body = F.when(F.col("held").isNotNull(), F.transform("held", lambda h: h["body"]))
    envelope = F.struct(batch.alias("batch"), F.lit(exported_at).alias("exportedAt"), body.alias("reviews"), F.lit(BATCH_SCHEMA_VERSION).alias("schemaVersion"))
    bare = F.struct(batch.alias("batch"), F.lit(exported_at).alias("exportedAt"), empty.alias("reviews"), F.lit(BATCH_SCHEMA_VERSION).alias("schemaVersion"))
    return found.select(key, F.when(F.col("held").isNull(), F.to_json(bare, {"pretty": "true"})).otherwise(F.to_json(envelope, {"pretty": "true"})).alias("json"))


def batch_bundle(batches: DataFrame, reviews: DataFrame, exported_at: str, key: str = "batch_id") -> DataFrame:
    """key, file, json: what a batch is exported as, ``batch.json`` and a file for each of its reviews."""
    listed = batches.select(key, F.explode("review_ids").alias("id"))
    each = listed.join(review_json(reviews, exported_at), "id").select(key, F.concat(F.lit("reviews/"), F.col("id").cast("string"), F.lit(".json")).alias("file"), "json")
    return batch_json(batches, reviews, exported_at, key).select(key, F.lit("batch.json").alias("file"), "json").unionByName(each)


def write_batch_bundle(batches: DataFrame, reviews: DataFrame, path: str, exported_at: str, key: str = "batch_id") -> None:
    """A directory for each batch and in it one for each file, with one text."""
    batch_bundle(batches, reviews, exported_at, key).write.mode("errorifexists").partitionBy(key, "file").text(path, lineSep="\n")


def write_review_json(reviews: DataFrame, path: str, exported_at: str) -> None:
    """A directory for each review id with one text file in it."""
    review_json(reviews, exported_at).write.mode("errorifexists").partitionBy("id").text(path, lineSep="\n")


def publish_batch(batch: DataFrame, reviews: DataFrame, root: str, version: str) -> None:
    """Batch and reviews under one version; they count only once the manifest names it, which is written last."""
    spark = batch.sparkSession
    batch.write.mode("errorifexists").parquet(f"{root}/batches/version={version}")
    reviews.write.mode("errorifexists").parquet(f"{root}/reviews/version={version}")
    spark.createDataFrame([(version,)], "version string").write.mode("append").parquet(f"{root}/manifest")


def read_published(spark: SparkSession, root: str, what: str) -> DataFrame:
    """``batches`` or ``reviews`` of all versions in the manifest."""
    manifest = spark.read.parquet(f"{root}/manifest").distinct()
    rows = spark.read.parquet(f"{root}/{what}")
    return rows.withColumn("version", F.col("version").cast("string")).join(manifest, "version", "left_semi")
