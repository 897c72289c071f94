"""Mixing sources to target weights with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_by_size

MOST = 3


def sizes(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def running_totals(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Rows with a column per sum: its total over all rows before, in an order without ties.

    In two levels, so that no task sees all rows: ranges of the order are summed, and each starts at what those before it hold.
    """
    ranged = cut(rows.withColumns(sums).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    by = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = by.select("_part", *[F.coalesce(F.sum(f"_{c}").over(parts), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}") for c in sums}
    return ranged.join(F.broadcast(offsets), "_part").withColumns(before).drop("_part", *[f"_{c}" for c in sums])


def source_targets(sized: DataFrame) -> DataFrame:
    """A row per source: source_key, n_docs, source_size, weight, target.

    Sources stand in code-point order, null last, and weigh 1, 2, 3, repeating. Shares of the whole
    size stop at MOST times a source's size and what is over goes to the others by weight. That is
    one water level: with the sources ordered by size / weight, the first one that its level
    doesn't fill sets the level for it and all after it. Places and sums before come from two-level
    totals, so sources may be as many as documents.
    """
    by = sized.groupBy("source_key").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # source_key: 's' || source, or null
    name = [F.col("source_key").isNull(), F.col("source_key")]
    by = cut(running_totals(by, name, place=F.lit(1)).withColumn("weight", F.col("place") % 3 + 1).drop("place"))
    whole = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    ratio = F.col("source_size") / F.col("weight")
    level = running_totals(by, [ratio, *name], size_before=F.col("source_size"), weight_before=F.col("weight"))
    left, rest = F.lit(whole["size"]) - MOST * F.col("size_before"), F.lit(whole["weight"]) - F.col("weight_before")
    level = level.withColumn("level", left.cast("double") / rest.cast("double"))
    unfilled = level.where(F.col("level") * F.col("weight") < MOST * F.col("source_size"))
    water = unfilled.agg(F.min_by("level", F.struct(ratio, *name)).alias("w")).first()["w"]
    full = (MOST * F.col("source_size")).cast("double")
    target = full if water is None else F.when(F.lit(water) * F.col("weight") > MOST * F.col("source_size"), full).otherwise(F.lit(water) * F.col("weight"))
    return by.select("source_key", "n_docs", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Every input row with size, source_size, target and copies: how often the mix emits it.

    A source's repetition rate is target / source_size; a document is taken floor(rate) times, and
    once more if a hash of seed, doc_id and text falls under the fraction. So reruns agree, and rows without doc_id or
    with one doc_id are drawn apart unless their texts are equal too: only such rows are drawn alike, and where they
    hold a share of a source, its taken words can miss the target by up to that share. Null texts have size 0; null sources
    form a source of their own. Columns with these names are replaced. An empty table gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "source_key", "n_docs")
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source").cast("string")))
    sized = docs.withColumn("size", sizes()).withColumn("source_key", key)
    targets = cut(source_targets(sized.select("source_key", "size")).withColumn("source_key", F.coalesce("source_key", F.lit("n"))).drop("weight"))
    total = targets.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    joined = join_by_size(sized.withColumn("source_key", F.coalesce("source_key", F.lit("n"))), targets, "source_key", "n_docs", total)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    row = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *row)), 1, 12), 16, 10).cast("double") / float(2**48)
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).drop("source_key", "n_docs")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as copies says."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy")
