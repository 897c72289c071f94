"""The calibration ledger: ten bins, as of any block, and the threshold that it teaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.probability import bin_of, logit
from ..sources.staging import staged
from .asof import Running, running
from .order import numbered


def bins(episodes: DataFrame, p: str = "predicted") -> DataFrame:
    """bin, n, hits; only bins with episodes."""
    return episodes.groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("hits"))


def calibration_bands(episodes: DataFrame, support: int = params.BIN_SUPPORT) -> DataFrame:
    """Each band's midpoint, observed rate (null below ``support``) and logit shift between the two."""
    rate = F.when(F.col("n") >= support, F.col("hits") / F.col("n"))
    middle = (F.col("bin") + 0.5) / 10
    rows = bins(episodes).withColumns({"midpoint": middle, "observed_rate": rate})
    label = F.concat(F.format_number(F.col("bin") / 10, 1), F.lit("-"), F.format_number((F.col("bin") + 1) / 10, 1))
    return rows.withColumns({"band": label, "shift": logit(F.col("observed_rate")) - logit(F.col("midpoint"))})


def calibration_brier(episodes: DataFrame) -> DataFrame:
    """Brier score of the bins' midpoints against their observed rates, weighted by n."""
    gap = (F.col("bin") + 0.5) / 10 - F.col("hits") / F.col("n")
    return bins(episodes).agg(F.sum("n").alias("episodes"), (F.sum(gap * gap * F.col("n")) / F.sum("n")).alias("binned_brier"))


def ledger_asof(episodes: DataFrame, blocks: DataFrame, p: str = "predicted") -> DataFrame:
    """block, bin, n, hits: the ledger just before each of the given blocks, all ten bins.

    Episodes are first summed by (block, bin). The blocks asked about join as rows that add nothing, and
    the two-level running sum gives what earlier blocks hold, so no task sees all blocks of a bin.
    """
    closed = episodes.groupBy(F.col("resolved_at_block").alias("block"), bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("_n"), F.count_if(F.col("outcome") == "success").alias("_hits"))
    asked = blocks.select("block").distinct().withColumn("bin", F.explode(F.array(*[F.lit(k) for k in range(10)])))
    rows = closed.withColumn("_ask", F.lit(False)).unionByName(asked.withColumns({"_n": F.lit(0).cast("long"), "_hits": F.lit(0).cast("long"), "_ask": F.lit(True)}))
    held = running(rows, ["bin"], "block", [Running("n", F.col("_n")), Running("hits", F.col("_hits"))])
    return held.where("_ask").select("block", "bin", "n", "hits")


def thresholds(ledger: DataFrame, target: float = params.LEDGER_TARGET, support: int = params.LEDGER_SUPPORT, default: float = params.HIRE_AT) -> DataFrame:
    """block, hire_threshold: the lowest bin from which on enough episodes reached the target share."""
    above = Window.partitionBy("block").orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    rows = ledger.withColumns({"_n": F.sum("n").over(above), "_h": F.sum("hits").over(above)})
    fits = (F.col("_n") >= support) & (F.col("_h") / F.nullif("_n", F.lit(0)) >= target)
    by = rows.groupBy("block").agg(F.sum("n").alias("total"), F.min(F.when(fits, F.col("bin"))).alias("least"))
    return by.select("block", F.when((F.col("total") >= support) & F.col("least").isNotNull(), F.col("least") / 10).otherwise(F.lit(default)).alias("hire_threshold"))


def threshold_trajectory(by_block: DataFrame, default: float = params.HIRE_AT) -> DataFrame:
    """Blocks at which the threshold moved. Buckets of blocks are numbered, so that each finds the end of the one before by a join."""
    rows = by_block.withColumn("_bucket", F.floor(F.col("block") / params.BUCKET_BLOCKS))
    last = staged(numbered(rows.groupBy("_bucket").agg(F.max_by("hire_threshold", "block").alias("_end")), "_n", "_bucket"))
    carried = last.select("_bucket", "_n").join(last.select((F.col("_n") + 1).alias("_n"), F.col("_end").alias("_from")), "_n", "left").drop("_n")
    own = F.lag("hire_threshold").over(Window.partitionBy("_bucket").orderBy("block"))
    return rows.join(carried, "_bucket").withColumn("_was", F.coalesce(own, F.col("_from"), F.lit(default))).where("hire_threshold <> _was").select("block", "hire_threshold")
