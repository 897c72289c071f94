"""Each job's lifecycle in one row, and the marketplace statistics over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..sources.staging import staged
from . import order


def job_matrix(events: DataFrame) -> DataFrame:
    """One row per job: what happened to it, and the latest creation, completion and rejection."""
    is_ = lambda kind: F.col("kind") == kind
    latest = lambda kind, *cols: F.max(F.when(is_(kind), F.struct("block", "log_index", *cols)))
    ever = lambda kind: F.coalesce(F.max(is_(kind)), F.lit(False))
    rows = events.groupBy("job_id").agg(
        latest("JobCreated", "client", "provider", "evaluator", "expired_at").alias("c"),
        latest("JobCompleted", "evaluator").alias("d"),
        latest("JobRejected", "rejector").alias("r"),
        ever("JobCreated").alias("created"),
        ever("JobFunded").alias("funded"),
        ever("JobCompleted").alias("completed"),
        ever("JobRejected").alias("rejected"),
        ever("Refunded").alias("refunded"),
        ever("JobExpired").alias("expired"),
        ever("JobSubmitted").alias("submitted"),
        F.count_if(is_("BudgetSet")).alias("budget_sets"),
        F.count("*").alias("events"),
        F.min("block").alias("first_block"),
        F.max("block").alias("last_block"),
    )
    return rows.select(
        "job_id", "created", "funded", "completed", "rejected", "refunded", "expired", "submitted", "budget_sets", "events", "first_block", "last_block",
        F.col("c.block").alias("created_block"), "c.client", "c.provider", "c.evaluator", "c.expired_at",
        F.col("d.evaluator").alias("completed_by"), F.col("r.rejector").alias("rejector"),
    )


def share(part, whole):
    return F.when(whole == 0, F.lit(None)).otherwise(part / whole)


def funnel(matrix: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    done = F.col("funded") & F.col("completed")
    return matrix.agg(
        F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"), F.sum("events").alias("events"),
        n(F.col("created"), "created"), n(F.col("funded"), "funded"), n(done, "funded_completed"), n(F.col("funded") & ~F.col("completed"), "dead"), n(F.col("submitted"), "submitted"),
        F.countDistinct(F.when(F.col("funded"), F.col("provider"))).alias("providers_funded"),
    )


def base_rate(matrix: DataFrame) -> DataFrame:
    return funnel(matrix).select("funded", "funded_completed", share(F.col("funded_completed"), F.col("funded")).alias("base_rate"))


def failure_modes(matrix: DataFrame) -> DataFrame:
    dead = matrix.where("funded and not completed")
    return dead.agg(F.count("*").alias("dead"), *[F.count_if(F.col(c)).alias(c) for c in ("rejected", "expired", "refunded")], F.count_if(~F.col("rejected") & ~F.col("expired") & ~F.col("refunded")).alias("silent"))


def provider_table(matrix: DataFrame, support: int = params.TABLE_SUPPORT) -> DataFrame:
    by = matrix.where("funded and provider is not null").groupBy("provider").agg(F.count("*").alias("funded"), F.count_if("completed").alias("completed"))
    return by.where(F.col("funded") >= support).withColumn("rate", F.col("completed") / F.col("funded")).orderBy(F.desc("rate"), "provider")


def rejector_roles(matrix: DataFrame) -> DataFrame:
    """Who rejects; the provider is tried first, and two nulls are the same party."""
    who = F.when(F.col("rejector").eqNullSafe(F.col("provider")), "provider").when(F.col("rejector").eqNullSafe(F.col("client")), "client").otherwise("other")
    return matrix.where("rejected").groupBy(who.alias("role")).agg(F.count("*").alias("rejections"))


def evaluator_independence(matrix: DataFrame) -> DataFrame:
    """Who evaluated the completion of each created job; no address, or the zero address, is no one."""
    by = F.col("completed_by")
    who = F.when(by.isNull() | by.rlike("^(0x)?0*$"), "absent").when(by == F.col("client"), "client").when(by == F.col("provider"), "provider").otherwise("third_party")
    return matrix.where("completed and created").groupBy(who.alias("evaluator_role")).agg(F.count("*").alias("jobs"))


def fee_to_creator(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """Evaluator fees of created jobs, and those that went to the creator; fees of unknown jobs don't count."""
    fees = events.where("kind = 'EvaluatorFeePaid'").select("job_id", "recipient")
    joined = fees.join(matrix.where("created").select("job_id", "client"), "job_id")
    return joined.agg(F.count("*").alias("fees"), F.count_if(F.col("recipient") == F.col("client")).alias("to_creator"))


def agent_activity(matrix: DataFrame) -> DataFrame:
    """A job counts for its client and for its provider, so twice for one who is both."""
    agents = matrix.where("created").select(F.explode(F.array("client", "provider")).alias("agent")).where("agent is not null")
    return agents.groupBy("agent").agg(F.count("*").alias("jobs")).agg(F.count("*").alias("agents"), F.count_if(F.col("jobs") >= 5).alias("five_or_more"), F.count_if(F.col("jobs") >= 20).alias("twenty_or_more"))


def top_clients(matrix: DataFrame, k: int = 2) -> DataFrame:
    by = matrix.where("created and client is not null").groupBy("client").agg(F.count("*").alias("jobs"))
    top = by.orderBy(F.desc("jobs"), "client").limit(k).agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("top_jobs"))
    return top.crossJoin(by.agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("created"))).select("top_jobs", "created", share(F.col("top_jobs"), F.col("created")).alias("share"))


def response_funnel(matrix: DataFrame) -> DataFrame:
    answered = F.col("budget_sets") > 0
    n = lambda c, name: F.count_if(c).alias(name)
    made = matrix.where("created")
    return made.agg(F.count("*").alias("created"), n(answered, "reached_budget"), n(~answered, "never_answered"), n(~answered & ~F.col("completed"), "died_unanswered"), n(answered & ~F.col("funded") & ~F.col("completed"), "answered_not_funded"), n(~answered & F.col("expired"), "unanswered_expired"))


def funding_gaps(events: DataFrame, matrix: DataFrame, width: int = params.BUCKET_BLOCKS) -> DataFrame:
    """The exact median gap, found by counts per range, in blocks between a provider's consecutive fundings, and seconds per block.

    Gaps are taken inside (provider, bucket of blocks); a bucket's first one opens with the last block of the bucket before.
    """
    funded = events.where("kind = 'JobFunded'").select("job_id", "block", "log_index").join(matrix.select("job_id", "provider").where("provider is not null"), "job_id")
    funded = funded.withColumn("_bucket", F.floor(F.col("block") / width))
    last = funded.groupBy("provider", "_bucket").agg(F.max("block").alias("_last"))
    opening = last.select("provider", "_bucket", F.lag("_last").over(Window.partitionBy("provider").orderBy("_bucket")).alias("_from"))
    inside = F.lag("block").over(Window.partitionBy("provider", "_bucket").orderBy("block", "log_index", "job_id"))
    gap = funded.join(opening, ["provider", "_bucket"]).select((F.col("block") - F.coalesce(inside, F.col("_from"))).alias("gap")).where("gap is not null")
    ends = events.where("ts is not null").agg(F.max(F.struct("block", "ts")).alias("b"), F.min(F.struct("block", "ts")).alias("a")).select(share(F.col("b.ts") - F.col("a.ts"), F.col("b.block") - F.col("a.block")).alias("seconds_per_block"))
    n, middle = order.median(staged(gap), "gap")
    return ends.select(F.lit(n).cast("long").alias("gaps"), F.lit(middle).cast("double").alias("median_gap"), "seconds_per_block")


def dataset_report(events: DataFrame, support: int = params.TABLE_SUPPORT) -> DataFrame:
    """All statistics as labelled rows (section, name, value): counts, rates, roles, concentration, gaps and the provider table."""
    m = job_matrix(events)

    def wide(section: str, df: DataFrame) -> DataFrame:
        pairs = ", ".join(f"'{c}', cast({c} as double)" for c in df.columns)
        return df.select(F.lit(section).alias("section"), F.expr(f"stack({len(df.columns)}, {pairs}) as (name, value)"))

    def long(section: str, df: DataFrame, name: str, value: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))

    table = provider_table(m, support)
    parts = [
        wide("funnel", funnel(m)),
        wide("base_rate", base_rate(m).select("base_rate")),
        wide("failures", failure_modes(m)),
        long("rejections", rejector_roles(m), "role", "rejections"),
        wide("agents", agent_activity(m)),
        wide("concentration", top_clients(m)),
        long("provider_funded", table, "provider", "funded"),
        long("provider_rate", table, "provider", "rate"),
        long("evaluators", evaluator_independence(m), "evaluator_role", "jobs"),
        wide("fees", fee_to_creator(events, m)),
        wide("responses", response_funnel(m)),
        wide("gaps", funding_gaps(events, m)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inflight_jobs(matrix: DataFrame, now: int) -> DataFrame:
    """Open jobs per client as of a time: abandoned once their deadline has passed, else in flight."""
    open_ = matrix.where("created and client is not null and not completed and not rejected and not expired")
    late = (F.col("expired_at") > 0) & (F.col("expired_at") <= now)
    return open_.groupBy("client").agg(F.count_if(~F.coalesce(late, F.lit(False))).alias("in_flight"), F.count_if(late).alias("abandoned"))


def over_budget(events: DataFrame, approvals: DataFrame) -> DataFrame:
    """Proposed budgets above what was approved for the job: job_id, proposed, approved."""
    asked = events.where("kind = 'BudgetSet'").select("job_id", F.col("amount").alias("proposed"))
    return asked.join(approvals.select("job_id", "approved"), "job_id").where("proposed > approved")
