"""Availability promises: decaying evidence, the response gate, and verdicts from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.probability import evidence_weight, reliability
from .episodes import head

WHO = ["provider", "declaration_type"]


def latest_per_key(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Keyed upsert: of the rows of a key the last version wins."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("_r")).select(*keys, "_r.*")


def first_observations(observations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One observation per (provider, type, job), the first; none for jobs that are already known."""
    rows = observations.where("confirmed is not null").groupBy(*WHO, "job_id").agg(F.min(F.struct("block", "confirmed")).alias("_r")).select(*WHO, "job_id", "_r.*")
    return rows if known is None else rows.join(known, [*WHO, "job_id"], "left_anti")


def declare(declarations: DataFrame) -> DataFrame:
    """One declaration per (provider, type, job_ref), the last; providers in lower case, unknown statuses dropped."""
    rows = declarations.withColumn("provider", F.lower("provider")).where("status in ('available', 'unavailable')")
    return latest_per_key(rows, [*WHO, "job_ref"], ["declared_at_block", "status"])


def declaration_counts(declarations: DataFrame) -> DataFrame:
    return declare(declarations).groupBy(*WHO).agg(F.count("*").alias("declared"), F.count_if(F.col("status") == "available").alias("available"))


def open_requests(requests: DataFrame) -> DataFrame:
    return latest_per_key(requests, [*WHO, "job_ref"], ["requested_at_block"]).withColumn("status", F.lit("pending"))


def pending_requests(requests: DataFrame, declarations: DataFrame) -> DataFrame:
    return open_requests(requests).join(declare(declarations), [*WHO, "job_ref"], "left_anti")


def answer_requests(requests: DataFrame, faults: DataFrame, status: str, block: int) -> DataFrame:
    """Declarations for a batch of requests; a reference among the injected faults is noted as such."""
    note = F.when(F.col("_fault"), "controlled fault injection: will not act on this claim")
    marked = requests.join(faults.select("job_ref").distinct().withColumn("_fault", F.lit(True)), "job_ref", "left")
    return marked.select(*WHO, "job_ref", F.lit(status).alias("status"), F.lit(block).cast("long").alias("declared_at_block"), note.alias("note"))


def response_reliability(observations: DataFrame, declarations: DataFrame, as_of: Column | int) -> DataFrame:
    """Per provider and type: weighted evidence, shrunken reliability and coverage.

    A provider with declarations alone has no observations and the prior; one with neither has no row.
    """
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    w = evidence_weight(as_of - F.col("block"))
    seen = first_observations(observations).groupBy(*WHO).agg(F.count("*").alias("observations"), F.sum(w).alias("acted"), F.sum(F.when(F.col("confirmed"), w).otherwise(0.0)).alias("kept"))
    both = seen.join(declaration_counts(declarations).select(*WHO, "declared"), WHO, "full")
    return both.select(*WHO, F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("acted", F.lit(0.0)).alias("acted"), F.coalesce("kept", F.lit(0.0)).alias("kept"), reliability(F.col("acted"), F.col("kept")).alias("reliability"), F.when(F.coalesce("declared", F.lit(0)) > 0, F.coalesce("observations", F.lit(0)) / F.col("declared")).alias("coverage"))


def response_gate(requests: DataFrame, declarations: DataFrame, records: DataFrame, p_complete: Column, bar: float = params.RESPONSE_PRIOR, hire_at: float = params.HIRE_AT) -> DataFrame:
    """Requests with both gates: a completion that is likely, and a promise from one who keeps them.

    Unavailable or unanswered means no response and so a blocked gate; a provider without a record
    has the prior and passes.
    """
    rows = open_requests(requests).drop("status").join(declare(declarations).select(*WHO, "job_ref", F.col("status").alias("declared_status")), [*WHO, "job_ref"], "left")
    rows = rows.join(records.select(*WHO, "reliability"), WHO, "left").withColumn("p_complete", p_complete)
    promised = F.coalesce(F.col("declared_status") == "available", F.lit(False))
    p_respond = F.when(promised, F.coalesce("reliability", F.lit(params.RESPONSE_PRIOR))).otherwise(0.0)
    rows = rows.withColumns({"p_respond": p_respond, "completion_gate": F.col("p_complete") >= hire_at, "response_gate": promised & (p_respond >= bar)})
    return rows.withColumns({"proceed": F.col("completion_gate") & F.col("response_gate"), "blocked_by_coordination": F.col("completion_gate") & ~F.col("response_gate")})


def gate_with_without_memory(requests: DataFrame, declarations: DataFrame, records: DataFrame, p_complete: Column) -> DataFrame:
    """The gate with and without the record of earlier promises, and whether it changes the decision."""
    key = [*WHO, "job_ref"]
    with_ = response_gate(requests, declarations, records, p_complete).select(*key, "p_respond", "proceed")
    without = response_gate(requests, declarations, records.limit(0), p_complete).select(*key, F.col("p_respond").alias("p_respond_without"), F.col("proceed").alias("proceed_without"))
    return with_.join(without, key).withColumn("changed", F.col("proceed") != F.col("proceed_without"))


def reliability_curve(observations: DataFrame, step: int = params.HALF_LIFE, expiry: int = params.EXPIRY, half_life: int = params.HALF_LIFE) -> DataFrame:
    """Reliability of each provider at a grid of blocks, from evidence of blocks before.

    Evidence lives for ``expiry`` blocks. If that is a few steps, each observation joins the grid points within its life
    and sums per grid point follow; on a finer grid sums run along the blocks instead (curve_by_sums).
    """
    rows = first_observations(observations)
    if expiry // step > COPIES:
        return curve_by_sums(rows, step, expiry, half_life)
    ends = rows.agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    grid = ends.where("b0 is not null").select(F.explode(F.sequence(F.col("b0"), F.col("b1") + expiry, F.lit(step).cast("long"))).alias("as_of"), "b0")
    first = F.ceil((F.col("block") - F.col("b0") + 1) / step)
    live = rows.crossJoin(F.broadcast(ends.select("b0"))).withColumn("_k", F.explode(F.sequence(first, first + int(expiry // step))))
    live = live.withColumn("as_of", F.col("b0") + F.col("_k") * step).where(F.col("as_of") - F.col("block") <= expiry)
    w = evidence_weight(F.col("as_of") - F.col("block"), half_life, expiry)
    sums = live.groupBy(*WHO, "as_of").agg(F.sum(w).alias("acted"), F.sum(F.when(F.col("confirmed"), w).otherwise(0.0)).alias("kept"))
    kept = sums.join(grid.select("as_of"), "as_of")
    return kept.select(*WHO, "as_of", "acted", reliability(F.col("acted"), F.col("kept")).alias("reliability"))


#: Grid points in the life of an observation up to which it is copied to each.
COPIES = 16


def curve_by_sums(rows: DataFrame, step: int, expiry: int, half_life: int) -> DataFrame:
    """reliability_curve() of first observations without a copy of an observation for each grid point.

    Blocks are cut into buckets of less than ``expiry``, and weights of a bucket are scaled to its start, so that no power grows with the chain. What a
    grid point sees is the part of its own bucket before it, whole buckets, and the part of the bucket in which the evidence
    expires: two running sums inside buckets and a few totals. Only sums of what is live are added, so nothing cancels.
    """
    width = max(1, min(half_life, expiry // 2))
    ends = rows.agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    of = lambda c: F.floor(F.col(c) / width)
    scale = lambda far: F.pow(F.lit(2.0), far / F.lit(float(half_life)))
    own = scale((F.col("block") - of("block") * width).cast("double"))
    seen = rows.select(*WHO, of("block").alias("bucket"), "block", F.lit(None).cast("long").alias("as_of"), F.lit(1).alias("n"), own.alias("a"), F.when(F.col("confirmed"), own).otherwise(0.0).alias("c"))
    last = -(-expiry // width) + 1
    totals = seen.groupBy(*WHO, "bucket").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("c").alias("c"))
    totals = totals.unionByName(totals.select(*WHO, F.explode(F.sequence(F.col("bucket"), F.col("bucket") + last)).alias("bucket"), F.lit(0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("c")))
    totals = totals.groupBy(*WHO, "bucket").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("c").alias("c"))
    before = Window.partitionBy(*WHO).orderBy("bucket").rangeBetween(-last, -1)
    totals = totals.select(*WHO, "bucket", F.collect_list(F.struct("bucket", "n", "a", "c")).over(before).alias("whole"))
    # the grid points of the buckets that something live reaches
    first = F.greatest(F.ceil((F.col("bucket") * width - F.col("b0")) / step), F.lit(0))
    until = F.floor((F.least((F.col("bucket") + 1) * width - 1, F.col("b1") + expiry) - F.col("b0")) / step)
    asked = totals.crossJoin(F.broadcast(ends)).where(first <= until).withColumn("as_of", F.explode(F.sequence(first, until))).withColumn("as_of", F.col("b0") + F.col("as_of") * step).drop("b0", "b1")
    none = [F.lit(0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("c")]
    near = asked.select(*WHO, "bucket", F.col("as_of").alias("block"), "as_of", *none)
    far = asked.select(*WHO, (F.col("as_of") - expiry).alias("block"), "as_of", *none).select(*WHO, of("block").alias("bucket"), "block", "as_of", "n", "a", "c")
    inside = Window.partitionBy(*WHO, "bucket", "_far").orderBy("block")
    both = lambda d, far: seen.withColumn("_far", F.lit(far)).unionByName(d.withColumn("_far", F.lit(far)))
    upto, after, at = inside.rangeBetween(Window.unboundedPreceding, -1), inside.rangeBetween(1, Window.unboundedFollowing), inside.rangeBetween(0, Window.unboundedFollowing)
    pick = lambda c, counted=after: F.when(F.col("_far"), F.sum(c).over(counted)).otherwise(F.sum(c).over(upto))
    parts = both(near, False).unionByName(both(far, True)).withColumns({"_n": pick("n", at), "_a": pick("a"), "_c": pick("c")}).where("as_of is not null")
    age = scale(-(F.col("as_of") - F.col("bucket") * width).cast("double"))
    parts = parts.groupBy(*WHO, "as_of").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("n"), *[F.sum(F.coalesce(f"_{c}", F.lit(0.0)) * age).alias(c) for c in ("a", "c")])
    expired = F.floor((F.col("as_of") - expiry) / width)
    middle = lambda c, f: F.aggregate(F.filter("whole", lambda w: w["bucket"] > expired), F.lit(0.0), lambda t, w: t + w[c] * f(w))
    fades = lambda w: scale(-(F.col("as_of") - w["bucket"] * width).cast("double"))
    whole = asked.select(*WHO, "as_of", middle("n", lambda w: F.lit(1.0)).alias("_n"), middle("a", fades).alias("_a"), middle("c", fades).alias("_c"))
    out = parts.join(whole, [*WHO, "as_of"]).where(F.col("n") + F.col("_n") > 0)
    return out.select(*WHO, "as_of", (F.col("a") + F.col("_a")).alias("acted"), reliability(F.col("a") + F.col("_a"), F.col("c") + F.col("_c")).alias("reliability"))


def response_verdicts(events: DataFrame) -> DataFrame:
    """Whether each created job was answered: responded, died unanswered, deadline passed unanswered, or pending."""
    of = lambda kinds: F.min(F.when(F.col("kind").isin(*kinds), F.struct("block", "log_index")))["block"]
    rows = events.groupBy("job_id").agg(of(["BudgetSet"]).alias("answered"), of(params.UNANSWERED_ENDS).alias("died"), F.max(F.when(F.col("kind") == "JobCreated", F.struct("block", "log_index", "provider", "expired_at"))).alias("c"))
    rows = rows.where("c is not null").crossJoin(F.broadcast(head(events)))
    late = (F.col("c.expired_at") > 0) & (F.col("head_ts") > F.col("c.expired_at"))
    return rows.select(
        "job_id", F.col("c.provider").alias("provider"),
        F.when(F.col("answered").isNotNull(), "responded").when(F.col("died").isNotNull(), "died unanswered").when(late, "deadline passed unanswered").otherwise("pending").alias("state"),
        F.when(F.col("answered").isNotNull(), F.col("answered")).when(F.col("died").isNotNull(), F.col("died")).when(late, F.col("head_block")).alias("block"),
        F.when(F.col("answered").isNotNull(), True).when(F.col("died").isNotNull() | late, False).alias("confirmed"),
    )


def stay_open_table(counts: DataFrame, bar: float = params.RESPONSE_PRIOR) -> DataFrame:
    """For each number n of fresh observations in column n: how many must be kept to stay at the bar."""
    return counts.select("n", F.ceil(F.col("n") * F.lit(bar)).cast("long").alias("must_keep"))
