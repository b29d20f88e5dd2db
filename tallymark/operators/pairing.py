"""Pairing labels with expected rows by file key, and the order-dependent picks around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import filename_key
from tallymark.operators.ranks import with_places

#: Phrases that are broadcast: no more than so many, none of more characters.
FEW_PHRASES, LONG_PHRASE = 200, 1000


def _position(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order given."""
    return _position(df, key, order).filter("_rn = 1").drop("_rn")


def latest_version(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the order given."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(whole, order).alias("_last")).select("_last.*")


def _keyed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("file_key", filename_key(F.col(name)))


def pair_labels(labels: DataFrame, expected: DataFrame, label_order: str, expected_order: str) -> DataFrame:
    """file_key, label_filename, expected_filename and the order columns: the first label of each key with its first expected row."""
    one = first_wins(_keyed(expected, "filename"), "file_key", expected_order).select("file_key", F.col("filename").alias("expected_filename"), F.col(expected_order).alias("expected_id"))
    two = first_wins(_keyed(labels, "filename"), "file_key", label_order).select("file_key", F.col("filename").alias("label_filename"), F.col(label_order).alias("label_id"))
    return two.join(one, "file_key")


def unpaired_labels(labels: DataFrame, expected: DataFrame, label_order: str) -> DataFrame:
    """Labels without an expected row, and those after the first of a key that has one."""
    keys = _keyed(expected, "filename").select("file_key").distinct().withColumn("_known", F.lit(True))
    return _position(_keyed(labels, "filename"), "file_key", label_order).join(keys, "file_key", "left").filter("_known IS NULL OR _rn > 1").drop("_known", "_rn")


def unpaired_expected(labels: DataFrame, expected: DataFrame, expected_order: str) -> DataFrame:
    """First expected rows of keys that no label has."""
    return first_wins(_keyed(expected, "filename"), "file_key", expected_order).join(_keyed(labels, "filename").select("file_key"), "file_key", "left_anti")


def pairing_warnings(labels: DataFrame, expected: DataFrame, label_order: str, expected_order: str) -> DataFrame:
    """kind, filename, message: for each later expected row of a key, and each later label of a key that has one."""
    def said(kind: str, text: str) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.col("filename"), F.concat(F.lit(f'Duplicate {text} "'), F.col("filename"), F.lit('" — using first occurrence.')).alias("message")]

    rows = _position(_keyed(expected, "filename"), "file_key", expected_order).filter("_rn > 1").select(*said("expected", "expected-data row for"))
    late = _position(_keyed(labels, "filename"), "file_key", label_order).filter("_rn > 1").join(_keyed(expected, "filename").select("file_key"), "file_key", "left_semi")
    return rows.unionByName(late.select(*said("label", "label filename")))


def pending_queue(apps: DataFrame, reviews: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """Applications without a saved review of their scenario."""
    return apps.join(reviews.select(scenario).filter(F.col(scenario).isNotNull()).distinct(), scenario, "left_anti")


def hydrate_batch(batches: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch_id, pos and the columns of each review that exists; batch_id, n_missing)."""
    listed = batches.select("batch_id", F.posexplode("review_ids").alias("pos", "review_id"))
    missing = listed.join(reviews.select("review_id").withColumn("_found", F.lit(1)), "review_id", "left").groupBy("batch_id").agg(F.count_if(F.col("_found").isNull()).alias("n_missing"))
    return listed.join(reviews, "review_id"), missing


def assign_app_ids(df: DataFrame, source: str, order: str) -> DataFrame:
    """app_id by position within the source: APP-2026-0001, and APP-2026-R001 for photos. Few sources hold all rows, so places are counted over ranges."""
    n = F.col("_place").cast("string")
    return with_places(df, source, order, "_place").withColumn("app_id", F.when(F.col(source) == "photo", F.concat(F.lit("APP-2026-R"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))).otherwise(F.concat(F.lit("APP-2026-"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0"))))).drop("_place")


def union_queue(synthetic: DataFrame, photos: DataFrame, order: str) -> DataFrame:
    """Synthetic rows, then photo rows, with their scenario id and a place in that order."""
    a = synthetic.withColumns({"source": F.lit("synthetic"), "ordinal": F.lit(0)})
    b = photos.withColumns({"source": F.lit("photo"), "ordinal": F.lit(1), "scenario_id": F.concat(F.lit("real-"), filename_key(F.col("filename")))})
    return a.unionByName(b, allowMissingColumns=True)


def cap_batch(new: DataFrame, queued: DataFrame, importer: str, order: str, cap: int) -> DataFrame:
    """Of each importer's new rows, the first that fit under the cap beside those queued.

    No importer has more than ``cap``, whatever is queued: that limit is a number, so each task keeps its first ``cap`` rows of an importer before the shuffle.
    """
    waiting = queued.groupBy(importer).agg(F.count("*").alias("_queued"))
    first = _position(new, importer, order).filter(F.col("_rn") <= cap)
    ranked = first.join(waiting, importer, "left")
    return ranked.filter(F.col("_rn") <= F.lit(cap) - F.coalesce("_queued", F.lit(0))).drop("_rn", "_queued")


def longest_match(df: DataFrame, text: str, phrases: DataFrame, key: str) -> DataFrame:
    """key, phrase: the longest of the phrases (phrase, ordinal) in the text; of equal ones the first listed. An empty phrase is in no text.

    Up to ``FEW_PHRASES`` short ones are sent to every task and looked for one after the other. More are joined by their first characters, as many as the
    shortest has, to those that stand in the text, and then looked for.
    """
    named = phrases.filter("phrase <> ''").select("phrase", "ordinal")
    n, least, longest = named.agg(F.count("*"), F.min(F.char_length("phrase")), F.max(F.char_length("phrase"))).first()
    df, found = df.select(key, text), F.contains(F.col(text), F.col("phrase"))
    if n <= FEW_PHRASES and (longest or 0) <= LONG_PHRASE:
        hits = df.join(F.broadcast(named), found)
    else:
        places = F.sequence(F.lit(1), F.char_length(text) - least + 1)
        heads = F.when(F.char_length(text) >= least, F.array_distinct(F.transform(places, lambda k: F.substring(F.col(text), k, F.lit(least)))))
        hits = df.withColumn("_head", F.explode(heads)).join(named.withColumn("_head", F.substring("phrase", 1, least)), "_head").filter(found)
    return hits.groupBy(key).agg(F.max_by("phrase", F.struct(F.char_length("phrase"), -F.col("ordinal"))).alias("phrase"))
