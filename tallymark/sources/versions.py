"""A history that is changed bucket by bucket: new files for the buckets that a change touches, versions by manifests.

A row's bucket is a hash of its key. A change reads and writes only the buckets that hold its keys; a
new manifest names the files of all buckets, those of the others as they were. It is written last, so a
change that fails before it is never seen; a reader names a version, or takes the newest, and keeps
what it has. Two writers of one version: the second one's manifest fails.

A manifest has a row for each bucket that is not empty, so what comes to the driver is bounded by the
number of buckets, which ``create`` fixes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "bucket int, path string, rows long, buckets int, columns string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions there are, oldest first."""
    return sorted(r.version for r in spark.read.parquet(f"{root}/manifests").select("version").distinct().collect())


def _manifest(spark: SparkSession, root: str, version: int | None) -> tuple[int, list]:
    version = versions(spark, root)[-1] if version is None else version
    return version, spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/version={version}").collect()


def _write(rows: DataFrame, root: str) -> list[tuple[int, str, int]]:
    """(bucket, path, rows) of the files written for ``rows``, which have a column ``_bucket``; rows of a bucket are in one task."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows.write.partitionBy("_bucket").parquet(folder)
    written = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    return [(r["_bucket"], f"{folder}/_bucket={r['_bucket']}", r["n"]) for r in written.groupBy("_bucket").agg(F.count("*").alias("n")).collect()]


def _commit(spark: SparkSession, root: str, version: int, entries: list[tuple[int, str, int]], buckets: int, columns: str) -> int:
    rows = [(*e, buckets, columns) for e in sorted(entries)] or [(-1, "", 0, buckets, columns)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/version={version}")
    return version


def create(history: DataFrame, root: str, key: str = "review_id", buckets: int = 64) -> int:
    """Version 1: the rows of ``history``, whose keys are unique."""
    columns = history.schema.json()
    dealt = history.withColumn("_bucket", bucket_of(F.col(key), buckets)).repartition("_bucket")
    return _commit(history.sparkSession, root, 1, _write(dealt, root), buckets, columns)


def read(spark: SparkSession, root: str, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named."""
    _, entries = _manifest(spark, root, version)
    paths = [e.path for e in entries if e.rows and (only is None or e.bucket in only)]
    schema = StructType.fromJson(json.loads(entries[0].columns))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def count(spark: SparkSession, root: str, version: int | None = None) -> int:
    """The number of rows, from the manifest alone."""
    return sum(e.rows for e in _manifest(spark, root, version)[1])


def _change(spark: SparkSession, root: str, changes: DataFrame, key: str, gone: Column) -> int:
    """The next version: rows of the changed keys replaced by the change, or left out where ``gone``."""
    version, entries = _manifest(spark, root, None)
    buckets, columns = entries[0].buckets, entries[0].columns
    marked = changes.withColumns({"_gone": gone, "_put": F.lit(1), "_bucket": bucket_of(F.col(key), buckets)})
    touched = {r["_bucket"] for r in marked.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
    old = read(spark, root, version, touched).withColumns({"_gone": F.lit(False), "_put": F.lit(0), "_bucket": bucket_of(F.col(key), buckets)})
    # One exchange by the bucket serves both the choice of a key's row and the files.
    both = old.unionByName(marked, allowMissingColumns=True).repartition("_bucket")
    newest = F.row_number().over(Window.partitionBy("_bucket", key).orderBy(F.desc("_put")))
    kept = both.withColumn("_rank", newest).filter("_rank = 1 AND NOT _gone").drop("_rank", "_gone", "_put")
    written = _write(kept, root)
    return _commit(spark, root, version + 1, [(e.bucket, e.path, e.rows) for e in entries if e.rows and e.bucket not in touched] + written, buckets, columns)


def upsert(spark: SparkSession, root: str, changes: DataFrame, key: str = "review_id") -> int:
    """A new version with each change put in; its number. Keys of ``changes`` are unique."""
    return _change(spark, root, changes, key, F.lit(False))


def delete(spark: SparkSession, root: str, ids: DataFrame, key: str = "review_id") -> int:
    """A new version without the rows of these keys; its number."""
    return _change(spark, root, ids.select(key).distinct(), key, F.lit(True))
