"""Per-provider rules from resolved jobs: which conditions shift the completion rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.probability import logit
from ..sources.staging import staged
from .asof import Running, running
from .order import numbered

SEQ = ["block", "log_index", "job_id"]


def holds(field: Column, op: str, value: float) -> Column:
    value = F.lit(value)
    c = {">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value, "==": field == value, "!=": field != value}[op]
    return F.coalesce(c, F.lit(False))


def rule_observations(resolved: DataFrame) -> DataFrame:
    """Jobs that an event closed, in closing order (SEQ); inferred outcomes teach nothing."""
    rows = resolved.where("outcome is not null and not inferred_expiry")
    return rows.select("job_id", "provider", (F.col("outcome") == "success").alias("completed"), F.col("resolved_at_block").alias("block"), F.col("resolved_log_index").alias("log_index"), *[F.col(f).cast("double").alias(f) for f in params.FIELDS])


def rule_candidates(observations: DataFrame, ladder: tuple = params.LADDER) -> DataFrame:
    """Observations with the provider's and every rung's counts so far, all in one running pass."""
    done = F.col("completed").cast("int")
    measures = [Running("observed", F.lit(1), by_row=True), Running("done", done, by_row=True)]
    for k, (f, op, v) in enumerate(ladder):
        hit = holds(F.col(f), op, v)
        measures += [Running(f"m{k}", hit.cast("int"), by_row=True), Running(f"c{k}", hit.cast("int") * done, by_row=True)]
    return running(observations, ["provider"], "block", measures, order=SEQ)


def adjustment(rate: Column, baseline: Column) -> Column:
    """What a rule adds to the log odds, within bounds."""
    return F.least(F.lit(params.MAX_DELTA), F.greatest(F.lit(-params.MAX_DELTA), logit(rate) - logit(baseline)))


def promoted_rules(observations: DataFrame, ladder: tuple = params.LADDER, min_support: int = params.MIN_SUPPORT, min_delta: float = params.MIN_DELTA) -> DataFrame:
    """Each rung's first promotion per provider, numbered R-1, R-2, … in order of creation.

    Only rungs that pass both gates are unpivoted, and first matches, which only order the rules of one observation, are
    looked up for promoted rungs alone. The numbering is global by definition; ranges of rules number themselves. observations are read twice.
    """
    candidates = rule_candidates(observations, ladder)
    base = F.col("done") / F.col("observed")
    rungs = [
        F.struct(F.lit(k).alias("rung"), F.lit(f).alias("field"), F.lit(op).alias("op"), F.lit(v).alias("value"), F.col(f"m{k}").alias("support"), (F.col(f"c{k}") / F.nullif(F.col(f"m{k}"), F.lit(0))).alias("rate"))
        for k, (f, op, v) in enumerate(ladder)
    ]
    passing = F.filter(F.array(*rungs), lambda r: (r["support"] >= min_support) & (F.abs(r["rate"] - base) >= min_delta))
    rows = candidates.select("provider", F.struct(*SEQ).alias("seq"), base.alias("baseline"), F.explode(passing).alias("r"))
    first = rows.groupBy("provider", F.col("r.rung").alias("rung")).agg(F.min_by(F.struct("seq", "baseline", "r"), "seq").alias("x"))
    first = staged(first.select("provider", "rung", F.col("x.r.field").alias("field"), F.col("x.r.op").alias("op"), F.col("x.r.value").alias("value"), "x"))
    seen = with_actual(observations.select("provider", *SEQ, *params.FIELDS)).join(first.select("provider", "rung", "field", "op", "value"), "provider").where(HOLDS)
    first = first.join(seen.groupBy("provider", "rung").agg(F.min(F.struct(*SEQ)).alias("first_match")), ["provider", "rung"])
    delta = adjustment(F.col("x.r.rate"), F.col("x.baseline"))
    first = numbered(first.withColumn("seq", F.col("x.seq")), "number", "seq", "first_match", "rung")
    return first.select(
        F.concat(F.lit("R-"), F.col("number").cast("string")).alias("rule_id"), F.col("provider").alias("subject"), "rung", "field", "op", "value",
        delta.alias("delta_logit"), F.col("x.baseline").alias("baseline_rate"), F.col("x.r.rate").alias("conditional_rate"), F.col("x.r.support").alias("support"), F.col("x.seq.block").alias("created_at_block"),
    )


#: Whether the condition (field, op, value) holds of the fields in actual; null where the field is.
HOLDS = "case op " + " ".join(f"when '{op}' then actual[field] {op} value" for op in (">", ">=", "<", "<=", "==", "!=")) + " end"


def with_actual(rows: DataFrame) -> DataFrame:
    """Rows with actual, their FIELDS by name in place of columns."""
    fields = F.create_map(*[x for f in params.FIELDS for x in (F.lit(f), F.col(f).cast("double"))])
    return rows.withColumn("actual", fields).drop(*params.FIELDS)


def rule_matches(views: DataFrame, rules: DataFrame) -> DataFrame:
    """Views with each rule of their provider that exists by then and whose condition holds."""
    rows = with_actual(views.select("job_id", "provider", "funding_block", "log_index", *params.FIELDS)).join(rules.withColumnRenamed("subject", "provider"), "provider")
    return rows.where((F.col("created_at_block") < F.col("funding_block")) & F.expr(HOLDS)).drop("actual")


def provider_totals(observations: DataFrame, recent: int = 5) -> DataFrame:
    """Per provider: observed, completed, last block, and the last few outcomes in order."""
    totals = observations.groupBy("provider").agg(F.count("*").alias("observed"), F.count_if("completed").alias("completed"), F.max("block").alias("last_block"))
    order = [F.desc(c) for c in SEQ]
    # two steps: first within (provider, bucket), so that no task orders a provider's whole history
    rows = observations.withColumn("_bucket", F.floor(F.col("block") / params.BUCKET_BLOCKS))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("provider", "_bucket").orderBy(*order))).where(F.col("_r") <= recent)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("provider").orderBy(*order))).where(F.col("_r") <= recent)
    item = F.struct(*SEQ, F.col("amount").cast("long").alias("amount"), F.when(F.col("completed"), "completed").otherwise("failed").alias("outcome"))
    last = rows.groupBy("provider").agg(F.sort_array(F.collect_list(item)).alias("recent"))
    return totals.join(last, "provider")
