"""Order over whole tables without a window over all rows: numbers and order statistics from counts per range."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Ranges that a pass of the selection counts.
RANGES = 4_096


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows with their number, from 1, in the given order, which should tell all rows apart.

    Each range of rows numbers itself; where it starts follows from the sizes of the ranges before, of which the driver sees
    one number each.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts = list(zip([r["_part"] for r in sizes], accumulate([0, *[r.n for r in sizes]])))
    starts = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_part", "_place", "_start")


def kth(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(the k-th smallest of a column of longs, counted from 1 and without nulls; how many are at most that).

    Each pass counts the values of RANGES ranges and goes on inside the one that holds the place, so passes follow the
    values' bits and no task or driver holds more than RANGES counts. k must not exceed the number of values.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    before, n = 0, 0
    while True:
        width = max(1, -(-(high - low + 1) // RANGES))
        inside = rows.where(F.col(column).between(low, high))
        at = F.expr(f"({column} - {low}) div {width}")
        for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect():
            n = r.n
            if before + n >= k:
                low, high = low + r["at"] * width, min(high, low + (r["at"] + 1) * width - 1)
                break
            before += n
        if width == 1:
            return low, before + n


def median(rows: DataFrame, column: str) -> tuple[int, float | None]:
    """(how many values, their exact median) of a column of longs; null values don't count."""
    n = rows.agg(F.count(column)).first()[0]
    if not n:
        return 0, None
    low, upto = kth(rows, column, (n + 1) // 2)
    high = low if upto >= n // 2 + 1 else rows.where(F.col(column) > low).agg(F.min(column)).first()[0]
    return n, (low + high) / 2
