"""Running aggregates per key in two levels, so that no key needs a task for all its rows.

Rows of a key are cut into buckets of blocks. Bucket totals give each bucket's opening balance; a
window inside (key, bucket) adds what the bucket itself has so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params


@dataclass(frozen=True)
class Running:
    """An aggregate (sum, min or max) of ``value`` over a key's earlier rows.

    same_block: whether rows of the row's own block count. by_row: rows up to and with the row itself
    in the given order, instead of by block.
    """

    name: str
    value: Column
    how: str = "sum"
    same_block: bool = False
    by_row: bool = False


def running(df: DataFrame, keys: list[str], block: str, measures: list[Running], order: list[str] | None = None, width: int = params.BUCKET_BLOCKS, rows: DataFrame | None = None) -> DataFrame:
    """df with a column per measure; sums of nothing are 0, other aggregates null. Keys must not be null.

    rows: the same rows as df at less cost, such as the stored table that a chain of passes began with; bucket totals come from
    them, so that what made df isn't computed a second time.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    valued = lambda d: d.withColumn("_bucket", F.floor(F.col(block) / width)).withColumns({f"_v_{m.name}": m.value for m in measures})
    df, total = valued(df), valued(df if rows is None else rows)
    by = total.groupBy(*keys, "_bucket").agg(*[agg[m.how](f"_v_{m.name}").alias(f"_b_{m.name}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = by.select(*keys, "_bucket", *[agg[m.how](f"_b_{m.name}").over(before).alias(f"_o_{m.name}") for m in measures])
    joined = df.join(opening, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket")
    out = {}
    for m in measures:
        if m.by_row:
            frame = inside.orderBy(*(order or [block])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        else:
            frame = inside.orderBy(block).rangeBetween(Window.unboundedPreceding, 0 if m.same_block else -1)
        here = agg[m.how](f"_v_{m.name}").over(frame)
        opened = F.col(f"_o_{m.name}")
        if m.how == "sum":
            out[m.name] = F.coalesce(opened, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            out[m.name] = (F.least if m.how == "min" else F.greatest)(opened, here)
    return joined.withColumns(out).drop("_bucket", *[f"_v_{m.name}" for m in measures], *[f"_o_{m.name}" for m in measures])
