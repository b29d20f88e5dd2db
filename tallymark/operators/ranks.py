"""Places and order statistics over a whole table, without bringing it into one task.

Rows are dealt by ranges of their order, sorted where they lie, and counted; the sums of the counts
before a partition are what its rows' places start from. Only a row for each partition (and group) is
summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: The low bits of monotonically_increasing_id: a row's place in its partition.
_PLACE = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted over all partitions, with ``_part`` and the place ``_at`` in it; kept, because counts and rows must see the same borders."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}).persist(StorageLevel.MEMORY_AND_DISK)


def with_places(df: DataFrame, group: str, order: str, place: str) -> DataFrame:
    """``df`` with each row's place (from 1) in its group by ``order``; a group may be as large as the table.

    A null group is a group of its own. Ties of ``order`` get different places, in no particular order.
    """
    ranged = _ranged(df, [F.col(group), F.col(order)])
    # A row for each partition and each group that begins there.
    counts = ranged.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_first") + 1).alias("_base"))
    joined = ranged.join(bases, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(place, F.col("_base") + F.col("_at")).drop("_part", "_at", "_p", "_g", "_base")


def order_statistics(df: DataFrame, value: str, shares: tuple[float, ...]) -> dict[float, float | None]:
    """The quantiles of a column of numbers, interpolated linearly; nulls do not count, and of no values all are null.

    Equal values are counted before they are dealt out, so that a value that many rows have is one row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = _ranged(counted, [F.col("v")])
    try:
        parts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.sum("n").alias("n")).collect())  # a row for each partition
        total = sum(n for _, n in parts)
        if not total:
            return dict.fromkeys(shares)
        wanted: dict[int, list[int]] = {}  # places within each partition (from 0)
        where: dict[int, tuple[int, int]] = {}
        for rank in {int(q * (total - 1)) + k for q in shares for k in (0, 1)}:
            left = min(rank, total - 1)
            for part, n in parts:
                if left < n:
                    break
                left -= n
            where[rank] = (part, left)
            wanted.setdefault(part, []).append(left)
        mine = F.lit(False)
        for part, places in wanted.items():
            near = [(F.col("_end") > k) & (F.col("_end") - F.col("n") <= k) for k in places]
            hit = near[0]
            for other in near[1:]:
                hit = hit | other
            mine = mine | ((F.col("_part") == part) & hit)
        end = F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
        picked = ranged.filter(F.col("_part").isin(*wanted)).withColumn("_end", end).filter(mine).select("_part", "v", "n", "_end").collect()  # two rows a quantile at most
        at = {rank: next(r.v for r in picked if r["_part"] == part and r["_end"] - r.n <= left < r["_end"]) for rank, (part, left) in where.items()}
    finally:
        ranged.unpersist()
    out: dict[float, float | None] = {}
    for q in shares:
        low = int(q * (total - 1))
        out[q] = at[low] + (at[low + 1] - at[low]) * (q * (total - 1) - low)
    return out
