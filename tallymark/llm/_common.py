"""Helpers that several operators share: tables, durable cuts of the lineage, Arrow batches, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Documents that a Python step holds at once; an Arrow batch is worked off in slices of this many rows.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session in one process (a test) gets a temporary folder; on a cluster that is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder, or to ``shared_folder``, and read it from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_slices(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose function sees at most SLICE_ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, decide: Callable[[list[bytes]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text ``decide`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                yield part.filter(pa.array(decide(utf8(part.column(text_col))), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_columns(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only what is read: doc_id long, text string, whatever else the table holds or is called."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: one row (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps, each a grouped minimum and an equi-join,
    until every node hangs on its root. The minimum is combined before the shuffle, and a
    node with very many neighbours only lengthens a sort-merge join that Spark can split.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        if large:
            out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        else:
            hung = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = hung.unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        now = durable(star(star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
