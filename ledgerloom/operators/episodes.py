"""Outcomes of predicted jobs, and how the predictions did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params


def head(events: DataFrame) -> DataFrame:
    """One row: the last block and the timestamp of the last event that has one."""
    order = F.struct("block", "log_index", "job_id")
    return events.agg(F.max("block").alias("head_block"), F.max_by("ts", F.when(F.col("ts").isNotNull(), order)).alias("head_ts"))


def resolve(events: DataFrame, views: DataFrame) -> DataFrame:
    """A row per job with a view: the latest view before it resolved, and its outcome.

    The first terminal event in a block not before the first funding closes a job. What is open at
    the end and past its deadline is an inferred failure at the head block; the rest has a null outcome.
    """
    first = views.groupBy("job_id").agg(F.min("funding_block").alias("first_block"))
    ends = events.where(F.col("kind").isin(*params.TERMINAL)).select("job_id", "kind", "block", "log_index")
    closed = ends.join(first, "job_id").where("block >= first_block").groupBy("job_id").agg(F.min(F.struct("block", "log_index", "kind")).alias("t"))
    joined = views.join(closed, "job_id", "left").where("t is null or funding_block <= t.block")
    latest = Window.partitionBy("job_id").orderBy(F.desc("funding_block"), F.desc("log_index"))
    rows = joined.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank").crossJoin(F.broadcast(head(events)))
    late = F.col("t").isNull() & F.coalesce(F.col("head_ts") > F.col("funding_timestamp") + F.col("expiry_window"), F.lit(False))
    kind = F.col("t.kind")
    return rows.select(
        *views.columns,
        F.when(kind == "JobCompleted", "success").when(kind.isNotNull() | late, "failure").alias("outcome"),
        F.when(kind.isNotNull() & (kind != "JobCompleted"), kind).when(late, "JobExpired").alias("failure_kind"),
        F.when(kind.isNotNull(), F.col("t.block")).when(late, F.col("head_block")).alias("resolved_at_block"),
        F.col("t.log_index").alias("resolved_log_index"),
        late.alias("inferred_expiry"),
    )


def score(resolved: DataFrame, p: Column, threshold: Column | float = params.HIRE_AT) -> DataFrame:
    """Episodes: resolved jobs with predicted, hire_threshold, correct and brier."""
    y = F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)
    bar = threshold if isinstance(threshold, Column) else F.lit(threshold)
    done = resolved.where("outcome is not null").withColumns({"predicted": p, "hire_threshold": bar.cast("double")})
    return done.withColumns({"correct": (F.col("predicted") >= F.col("hire_threshold")) == (y == 1.0), "brier": (F.col("predicted") - y) * (F.col("predicted") - y)})


def error_patterns(episodes: DataFrame, gap: float = params.ERROR_GAP) -> DataFrame:
    y = F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)
    note = F.concat(F.when(y == 0.0, "overconfident").otherwise("underconfident"), F.when(F.col("repeat_pair"), "").otherwise(" on first-time pair"))
    return episodes.where(F.abs(F.col("predicted") - y) > gap).select(
        "job_id", "provider", "predicted", y.alias("actual"), F.struct("amount", "repeat_pair", "budget_set_count", "provider_prior_funded").alias("conditions"), note.alias("note")
    )


def resolver_summary(resolved: DataFrame, episodes: DataFrame, gap: float = params.ERROR_GAP) -> DataFrame:
    y = F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)
    own = episodes.agg(
        F.count("*").alias("episodes"), F.count_if("inferred_expiry").alias("inferred"), F.avg(y).alias("success_rate"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg("brier").alias("mean_brier"), F.count_if(F.abs(F.col("predicted") - y) > gap).alias("error_patterns"),
    )
    return own.crossJoin(resolved.agg(F.count_if(F.col("outcome").isNull()).alias("unresolved")))


def reversals(episodes: DataFrame) -> DataFrame:
    """Scored episodes whose call differs from the one the chain alone would make."""
    memory, chain, done = F.col("predicted") >= F.col("hire_threshold"), F.col("p0") >= params.HIRE_AT, F.col("outcome") == "success"
    call = lambda c: F.when(c, "HIRE").otherwise("DO NOT HIRE")
    return episodes.where(~F.col("inferred_expiry") & (memory != chain)).select(
        "job_id", "provider", "amount", "budget_set_count", "repeat_pair", F.col("p0").alias("chain_p"), F.col("predicted").alias("memory_p"),
        call(chain).alias("chain_call"), call(memory).alias("memory_call"), F.when(done, "completed").otherwise("failed").alias("outcome"), (memory == done).alias("memory_right"),
    )


def reversal_direction(found: DataFrame) -> DataFrame:
    return found.groupBy("chain_call", "memory_call").agg(F.count("*").alias("changed"), F.count_if("memory_right").alias("right"))
