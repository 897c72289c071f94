"""Point-in-time features of every funded job.

Within a block, creations and budgets come first, views second, fundings and terminals last. So a
view counts attributes of blocks up to its own and outcomes of blocks before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.probability import shrunk_rate
from ..sources.staging import at_once, staged
from . import ranks
from .asof import Running, running


#: What a job carries from one batch of events to the next.
JOB = ["made", "budget_set_count", "last_budget", "was_funded", "was_open"]


def with_job_state(events: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Events with what their own job looked like just then; the one shuffle by job_id.

    Adds phase, parties and creation as known at the event, budgets so far, the last budget, whether
    the job was funded before the event, and how the event changes the set of open jobs. A creation
    or budget of block 0 counts like any other; events of unknown jobs have null parties. opening is what
    jobs_after() left of the batches before, if events are one batch of many.
    """
    e = events.withColumn("phase", F.when(F.col("kind").isin("JobCreated", "BudgetSet"), 0).otherwise(1))
    if opening is None:
        held = {c: F.lit(None) for c in JOB}
    else:
        e = e.join(opening.select("job_id", F.struct(*JOB).alias("_open")), "job_id", "left")
        held = {c: F.col(f"_open.{c}") for c in JOB}
    by = Window.partitionBy("job_id").orderBy("block", "phase", "log_index")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    created = F.last(F.when(F.col("kind") == "JobCreated", F.struct("block", "client", "provider", "expired_at")), ignorenulls=True).over(upto)
    funded, ended = F.col("kind") == "JobFunded", F.col("kind").isin(*params.TERMINAL)
    state = F.last(F.when(funded, 1).when(ended, 0), ignorenulls=True).over(before)
    paid = F.last(F.when(F.col("kind").isin("BudgetSet", "JobFunded"), F.coalesce("amount", F.lit(0))), ignorenulls=True).over(before)
    e = e.select(
        "kind", "job_id", "block", "log_index", "ts", "amount", "rejector", "phase",
        F.coalesce(created, held["made"]).alias("made"),
        (F.count_if(F.col("kind") == "BudgetSet").over(upto) + F.coalesce(held["budget_set_count"], F.lit(0))).alias("budget_set_count"),
        F.coalesce(paid, held["last_budget"]).alias("last_budget"),
        F.coalesce(F.max(F.when(funded, 1)).over(before), held["was_funded"], F.lit(0)).alias("was_funded"),
        F.coalesce(state, held["was_open"], F.lit(0)).alias("was_open"),
    )
    known = F.col("client").isNotNull() & F.col("provider").isNotNull()
    e = e.select("*", F.col("made.client").alias("client"), F.col("made.provider").alias("provider"), F.col("made.expired_at").alias("expired_at"), F.col("made.block").alias("created_block"))
    counts = known & (F.col("was_funded") == 1)
    one = lambda c: F.when(c, 1).otherwise(0)
    return e.select(
        "*",
        one(F.col("kind") == "JobCreated").alias("d_created"),
        one(known & funded).alias("d_funded"),
        one(counts & (F.col("kind") == "JobCompleted")).alias("d_completed"),
        one(counts & (F.col("kind") == "JobExpired")).alias("d_expired"),
        one(counts & (F.col("kind") == "JobRejected") & (F.col("rejector") == F.col("provider"))).alias("d_self"),
        (one(known & funded & (F.col("was_open") == 0)) - one(known & ended & (F.col("was_open") == 1))).alias("d_open"),
        F.when(known & (funded | ended), F.nullif("block", F.lit(0))).alias("acted_at"),
    )


def jobs_after(state: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """What each job carries on (JOB), after the events of state; jobs without events there keep their opening."""
    ended = F.col("kind").isin(*params.TERMINAL)
    after = F.struct(
        "made", "budget_set_count",
        F.when(F.col("kind").isin("BudgetSet", "JobFunded"), F.coalesce("amount", F.lit(0))).otherwise(F.col("last_budget")).alias("last_budget"),
        F.when(F.col("kind") == "JobFunded", 1).otherwise(F.col("was_funded")).alias("was_funded"),
        F.when(F.col("kind") == "JobFunded", 1).when(ended, 0).otherwise(F.col("was_open")).alias("was_open"),
    )
    new = state.groupBy("job_id").agg(F.max_by(after, F.struct("block", "phase", "log_index")).alias("_s")).select("job_id", "_s.*")
    return new if opening is None else new.unionByName(opening.join(new, "job_id", "left_anti").select(new.columns))


VIEW = ["job_id", "funding_block", "log_index"]
#: Events of other kinds change no count.
COUNTED = ("JobCreated", "JobFunded", *params.TERMINAL)
_STATE = ["job_id", "block", "log_index", "ts", "kind", "client", "provider", "amount", "budget_set_count", "expired_at", "created_block", "d_created", "d_funded", "d_completed", "d_expired", "d_self", "d_open", "acted_at"]


def with_provider(rows: DataFrame) -> DataFrame:
    """Rows of with_job_state that have a provider, with its history at each; _first, _made and _acted are the blocks behind the ages."""
    made = F.when(F.col("d_created") == 1, F.nullif("block", F.lit(0)))
    return running(
        rows.where(F.col("provider").isNotNull() & F.col("kind").isin(*COUNTED)), ["provider"], "block",
        [
            Running("provider_prior_funded", F.col("d_funded")),
            Running("provider_prior_completed", F.col("d_completed")),
            Running("provider_prior_rejected_by_self", F.col("d_self")),
            Running("provider_prior_expired", F.col("d_expired")),
            Running("provider_concurrent_open", F.col("d_open")),
            Running("_first", made, "min", same_block=True),
            Running("_made", made, "max", same_block=True),
            Running("_acted", F.col("acted_at"), "max"),
        ],
    )


CLIENTS = "client is not null and (d_created = 1 or kind = 'JobFunded' or d_completed = 1)"
PAIRS = "client is not null and provider is not null and (kind = 'JobFunded' or d_completed = 1)"


def with_client(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows made of those of state, with the history of their client at each."""
    measures = [Running("client_prior_created", F.col("d_created"), same_block=True), Running("client_prior_funded", F.col("d_funded"))]
    return running(rows.where(CLIENTS), ["client"], "block", measures, rows=state.where(CLIENTS))


def with_pair(rows: DataFrame, state: DataFrame) -> DataFrame:
    measures = [Running("pair_prior_jobs", F.col("d_funded")), Running("pair_prior_completed", F.col("d_completed"))]
    return running(rows.where(PAIRS), ["client", "provider"], "block", measures, rows=state.where(PAIRS))


AGES = {"provider_blocks_since_first_seen": "block - _first", "provider_blocks_since_last_activity": "block - greatest(_made, _acted)"}
RATE = "case when client_prior_created > 0 then client_prior_funded / client_prior_created end"


def provider_asof(state: DataFrame) -> DataFrame:
    """VIEW and the provider's history at each funding."""
    rows = with_provider(state.select(_STATE)).where("kind = 'JobFunded' and client is not null")
    return rows.select("job_id", F.col("block").alias("funding_block"), "log_index", *[c for c in rows.columns if c.startswith("provider_")], *[F.expr(x).alias(c) for c, x in AGES.items()])


def client_asof(state: DataFrame) -> DataFrame:
    rows = with_client(state.select(_STATE), state).where("kind = 'JobFunded' and provider is not null")
    return rows.select("job_id", F.col("block").alias("funding_block"), "log_index", "client_prior_created", "client_prior_funded", F.expr(RATE).alias("client_prior_funding_rate"))


def pair_asof(state: DataFrame) -> DataFrame:
    rows = with_pair(state.select(_STATE), state).where("kind = 'JobFunded'")
    return rows.select("job_id", F.col("block").alias("funding_block"), "log_index", F.expr("pair_prior_jobs > 0").alias("repeat_pair"), "pair_prior_jobs", "pair_prior_completed")


#: Rows of a provider that pass through one task of the running median.
MEDIAN_ROWS = 1_000_000


def median_completed_amount(state: DataFrame, opening: DataFrame | None = None, size: int = MEDIAN_ROWS) -> DataFrame:
    """VIEW and the exact median of the budgets a provider completed before each funding.

    Medians are looked up by weighted ranks (ranks.running_medians), so that an amount costs the same however often it was completed. opening is
    amounts_after() of the batches before; providers with more than ``size`` rows are split by amount.
    """
    rows = state.where("client is not null and provider is not null and (kind = 'JobFunded' or (d_completed = 1 and last_budget <> 0))")
    rows = rows.select(F.col("provider").alias("key"), "block", F.when(F.col("kind") == "JobFunded", 0).otherwise(1).alias("late"), "job_id", "log_index", F.when(F.col("kind") != "JobFunded", F.col("last_budget")).cast("long").alias("budget"), F.lit(1).cast("long").alias("n"))
    if opening is not None:
        none = F.lit(-1).cast("long")
        asked = opening.join(rows.where("late = 0").select(F.col("key").alias("provider")).distinct(), "provider", "left_semi")
        rows = rows.unionByName(asked.select(F.col("provider").alias("key"), none.alias("block"), F.lit(1).alias("late"), none.alias("job_id"), none.alias("log_index"), F.col("amount").alias("budget"), "n"))
    return ranks.running_medians(staged(rows), size).withColumnRenamed("median", "provider_median_completed_amount")


def amounts_after(state: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """(provider, amount, n): the budgets that each provider completed."""
    new = state.where("client is not null and d_completed = 1 and last_budget <> 0").select("provider", F.col("last_budget").cast("long").alias("amount"), F.lit(1).cast("long").alias("n"))
    rows = new if opening is None else opening.unionByName(new)
    return rows.groupBy("provider", "amount").agg(F.sum("n").alias("n"))


def carried(state: DataFrame) -> DataFrame:
    """One row per funding whose job and both parties are known by then: its facts and all counts, in one pass by provider, client and pair after the other.

    Rows carry their columns along, so nothing is joined back. The median and what follows from all counts are still missing.
    """
    rows = with_provider(state.select(_STATE)).where("client is not null")
    rows = rows.drop("d_expired", "d_self", "d_open", "acted_at")
    # a client's jobs without provider count for the client as well
    lone = state.select(_STATE).where("provider is null and client is not null").drop("d_expired", "d_self", "d_open", "acted_at")
    counted = state.where(F.col("kind").isin(*COUNTED))
    rows = with_client(rows.unionByName(lone, allowMissingColumns=True), counted).drop("d_created")
    return with_pair(rows, counted).where("kind = 'JobFunded'")


def finished(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """The views of carried rows."""
    rows = rows.select(
        "job_id", "provider", "client", F.col("block").alias("funding_block"), "log_index", F.col("ts").alias("funding_timestamp"), F.coalesce("amount", F.lit(0)).alias("amount"),
        "budget_set_count", (F.col("expired_at") - F.col("ts")).alias("expiry_window"), (F.col("block") - F.col("created_block")).alias("funding_delay"),
        "provider_prior_funded", "provider_prior_completed", "provider_prior_rejected_by_self", "provider_prior_expired", "provider_concurrent_open", *[F.expr(x).alias(c) for c, x in AGES.items()],
        "client_prior_created", "client_prior_funded", F.expr(RATE).alias("client_prior_funding_rate"), F.expr("pair_prior_jobs > 0").alias("repeat_pair"), "pair_prior_jobs", "pair_prior_completed",
    )
    return rows.join(medians, VIEW)


def decision_views(events: DataFrame) -> DataFrame:
    """One row per funding whose job and both parties are known by then."""
    state = staged(with_job_state(events).where(F.col("kind").isin(*COUNTED)).select(*_STATE, "last_budget"))
    return staged(finished(*at_once(lambda: staged(carried(state)), lambda: staged(median_completed_amount(state)))))


def with_base_prediction(views: DataFrame) -> DataFrame:
    raw = F.when(F.col("provider_prior_funded") > 0, F.col("provider_prior_completed") / F.col("provider_prior_funded"))
    return views.withColumns({"provider_prior_rate": raw, "p0": shrunk_rate(F.col("provider_prior_completed"), F.col("provider_prior_funded"))})


def provider_snapshot(events: DataFrame) -> DataFrame:
    """Each provider's counters at the end of the log, for scoring new requests."""
    state = with_job_state(events)
    return state.where("provider is not null").groupBy("provider").agg(*[F.sum(d).alias(n) for d, n in (("d_funded", "provider_prior_funded"), ("d_completed", "provider_prior_completed"), ("d_self", "provider_prior_rejected_by_self"), ("d_expired", "provider_prior_expired"), ("d_open", "provider_concurrent_open"))])
