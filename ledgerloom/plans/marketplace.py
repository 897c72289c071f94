"""The event log and the promise evidence that stand behind the registered queries.

Both derive from the given tables by integer formulas: a job per order with line items, and a
promise event per row of ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import EVENT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("sup"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_custkey") % 97).alias("cl"),
        F.floor("o_totalprice").cast("long").alias("amount"),
        (F.lit(1000) + F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))).cast("long").alias("b0"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("pr"),
    )
    jobs = orders.join(lines, F.col("k") == F.col("l_orderkey")).drop("l_orderkey")
    bar = F.expr("case when sup % 3 = 0 and amount > 100000 then 20 when sup % 3 = 1 and cl % 4 = 0 then 30 else 85 end")
    return (
        jobs.withColumn("funded", F.col("pr") <= 3)
        .withColumn("fb", F.col("b0") + F.col("k") % 4)
        .withColumn("outcome", F.when((F.col("k") * 7 + F.col("sup") * 13) % 100 < bar, "C").otherwise(F.expr("element_at(array('RR', 'E', 'F', 'O'), cast(k % 4 + 1 as int))")))
        .withColumn("tb", F.col("fb") + F.col("k") % 6)
        .withColumn("provider", F.expr("concat('p', sup)"))
        .withColumn("client", F.expr("case when k % 19 = 0 then provider else concat('c', cl) end"))
        .withColumn("evaluator", F.expr("case when k % 5 = 0 then null when k % 5 = 1 then concat('e', k % 7) else client end"))
        .withColumn("rejector", F.expr("case k % 3 when 0 then provider when 1 then client else concat('x', k % 3) end"))
        .withColumn("expired_at", F.expr("2 * b0 + element_at(array(1800, 10000, 50000, 100000), cast((k div 4) % 4 + 1 as int))"))
    )


def _event(kind: str, slot: int, when: str, block: str, **payload: str) -> Column:
    fields = EVENT.fieldNames()[5:]
    values = ", ".join(f"'{f}', cast({payload.get(f, 'null')} as {EVENT[f].dataType.simpleString()})" for f in fields)
    return F.expr(f"case when {when} then named_struct('kind', '{kind}', 'slot', {slot}, 'block', cast({block} as bigint), {values}) end")


def marketplace(spark: SparkSession, sf_dir: str, reversed_slots: bool = False) -> DataFrame:
    """The events (EVENT) of all jobs; reversed_slots turns the order inside each job around.

    Some jobs have no creation, some are their provider's own, and some are completed by another than their evaluator.
    """
    c = "funded and outcome = 'C'"
    by = f"case k % 13 when 0 then concat('e', k % 7) when 1 then provider else coalesce(evaluator, '0x{'0' * 40}') end"
    slots = [
        _event("JobCreated", 0, "k % 29 <> 0", "b0", client="client", provider="provider", evaluator="evaluator", expired_at="expired_at"),
        _event("BudgetSet", 1, "pr <> 5", "b0 + k % 2", amount="amount"),
        _event("BudgetSet", 2, "pr <> 5 and n >= 5", "b0 + k % 3", amount="amount + 1"),
        _event("JobFunded", 3, "funded", "fb", funder="client", amount="amount"),
        _event("JobSubmitted", 4, c, "tb"),
        _event("JobCompleted", 5, c, "tb", evaluator=by),
        _event("JobRejected", 5, "funded and outcome = 'RR'", "tb", rejector="rejector"),
        _event("JobExpired", 5, "funded and outcome = 'E'", "tb"),
        _event("Refunded", 6, "funded and outcome in ('RR', 'F')", "tb", recipient="client", amount="amount"),
        _event("PaymentReleased", 7, c, "tb", payee="provider", amount="amount * 9 div 10"),
        _event("EvaluatorFeePaid", 8, f"{c} and k % 2 = 0", "tb", recipient="coalesce(evaluator, client)", amount="amount div 20"),
        _event("JobCompleted", 5, "not funded and k % 10 = 0", "b0 + 3", evaluator=by),
        _event("JobExpired", 5, "pr = 5 and k % 10 in (1, 6)", "b0 + 5"),
    ]
    # a lambda over the array would run outside of generated code, and explode() would also filter by the array's size below the join, computing it twice
    rows = jobs_of_orders(spark, sf_dir).select("k", F.explode_outer(F.array(*slots)).alias("e")).where("e is not null")
    slot = F.lit(9) - F.col("e.slot") if reversed_slots else F.col("e.slot")
    payload = [F.col(f"e.{f}") for f in EVENT.fieldNames()[5:]]
    return rows.select(F.col("e.kind"), F.col("k").alias("job_id"), F.col("e.block"), (F.col("k") * 10 + slot).cast("long").alias("log_index"), (F.col("e.block") * 2).alias("ts"), *payload)


#: The same events in SQL: a list of common table expressions that ends in ``ev``.
MARKET_SQL = f"""
o AS (SELECT o_orderkey AS k, o_custkey % 97 AS cl, floor(o_totalprice)::BIGINT AS amount,
        (1000 + date_diff('day', DATE '1995-01-01', o_orderdate::DATE))::BIGINT AS b0, substr(o_orderpriority, 1, 1)::INT AS pr FROM orders),
li AS (SELECT l_orderkey AS k, count(*) AS n, min(l_suppkey) AS sup FROM lineitem GROUP BY 1),
j0 AS (SELECT *, pr <= 3 AS funded, b0 + k % 4 AS fb, 'p' || sup AS provider, CASE WHEN k % 19 = 0 THEN 'p' || sup ELSE 'c' || cl END AS client,
        CASE WHEN (k * 7 + sup * 13) % 100 < (CASE WHEN sup % 3 = 0 AND amount > 100000 THEN 20 WHEN sup % 3 = 1 AND cl % 4 = 0 THEN 30 ELSE 85 END)
             THEN 'C' ELSE (['RR', 'E', 'F', 'O'])[k % 4 + 1] END AS outcome FROM o JOIN li USING (k)),
j AS (SELECT *, fb + k % 6 AS tb, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'e' || (k % 7) ELSE client END AS evaluator,
        CASE k % 3 WHEN 0 THEN provider WHEN 1 THEN client ELSE 'x' || (k % 3) END AS rejector,
        2 * b0 + ([1800, 10000, 50000, 100000])[(k // 4) % 4 + 1] AS expired_at FROM j0),
jb AS (SELECT *, CASE k % 13 WHEN 0 THEN 'e' || (k % 7) WHEN 1 THEN provider ELSE coalesce(evaluator, '0x{"0" * 40}') END AS done_by FROM j),
ev0 AS (
  SELECT 'JobCreated' AS kind, k, 0 AS slot, b0 AS block, client, provider, evaluator, NULL AS funder, NULL AS payee, NULL AS rejector, NULL AS recipient, NULL::BIGINT AS amount, expired_at FROM j WHERE k % 29 <> 0
  UNION ALL SELECT 'BudgetSet', k, 1, b0 + k % 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, amount, NULL FROM j WHERE pr <> 5
  UNION ALL SELECT 'BudgetSet', k, 2, b0 + k % 3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, amount + 1, NULL FROM j WHERE pr <> 5 AND n >= 5
  UNION ALL SELECT 'JobFunded', k, 3, fb, NULL, NULL, NULL, client, NULL, NULL, NULL, amount, NULL FROM j WHERE funded
  UNION ALL SELECT 'JobSubmitted', k, 4, tb, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE funded AND outcome = 'C'
  UNION ALL SELECT 'JobCompleted', k, 5, tb, NULL, NULL, done_by, NULL, NULL, NULL, NULL, NULL, NULL FROM jb WHERE funded AND outcome = 'C'
  UNION ALL SELECT 'JobRejected', k, 5, tb, NULL, NULL, NULL, NULL, NULL, rejector, NULL, NULL, NULL FROM j WHERE funded AND outcome = 'RR'
  UNION ALL SELECT 'JobExpired', k, 5, tb, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE funded AND outcome = 'E'
  UNION ALL SELECT 'Refunded', k, 6, tb, NULL, NULL, NULL, NULL, NULL, NULL, client, amount, NULL FROM j WHERE funded AND outcome IN ('RR', 'F')
  UNION ALL SELECT 'PaymentReleased', k, 7, tb, NULL, NULL, NULL, NULL, provider, NULL, NULL, amount * 9 // 10, NULL FROM j WHERE funded AND outcome = 'C'
  UNION ALL SELECT 'EvaluatorFeePaid', k, 8, tb, NULL, NULL, NULL, NULL, NULL, NULL, coalesce(evaluator, client), amount // 20, NULL FROM j WHERE funded AND outcome = 'C' AND k % 2 = 0
  UNION ALL SELECT 'JobCompleted', k, 5, b0 + 3, NULL, NULL, done_by, NULL, NULL, NULL, NULL, NULL, NULL FROM jb WHERE NOT funded AND k % 10 = 0
  UNION ALL SELECT 'JobExpired', k, 5, b0 + 5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE pr = 5 AND k % 10 IN (1, 6)),
ev AS (SELECT kind, k AS job_id, block, 10 * k + slot AS log_index, 2 * block AS ts, client, provider, evaluator, funder, payee, rejector, recipient, amount, expired_at FROM ev0)"""


def promises(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """observations, declarations and requests, one promise event per row of ``events``."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("provider"),
        F.lit("availability").alias("declaration_type"),
        F.col("event_id").alias("job_ref"),
        (F.floor(F.expr("unix_micros(cast(ts as timestamp)) - 1704067200000000") / 2_000_000) + 1).cast("long").alias("block"),
        "event_type",
    )
    key = ["provider", "declaration_type"]
    observations = e.where("event_type in ('purchase', 'error')").select(*key, F.col("job_ref").alias("job_id"), "block", (F.col("event_type") == "purchase").alias("confirmed"))
    declarations = e.where("event_type = 'signup'").select(*key, "job_ref", F.expr("if(job_ref % 5 <> 0, 'available', 'unavailable')").alias("status"), F.col("block").alias("declared_at_block"))
    requests = e.where("event_type = 'view' or (event_type = 'signup' and job_ref % 2 = 0)").select(*key, "job_ref", F.col("block").alias("requested_at_block"))
    return {"observations": observations, "declarations": declarations, "requests": requests}


PROMISE_SQL = """
pe AS (SELECT 'u' || user_id AS provider, 'availability' AS declaration_type, event_id AS job_ref,
        ((epoch_us(ts) - 1704067200000000) // 2000000 + 1)::BIGINT AS block, event_type FROM events),
obs AS (SELECT provider, declaration_type, job_ref AS job_id, block, event_type = 'purchase' AS confirmed FROM pe WHERE event_type IN ('purchase', 'error')),
decl AS (SELECT provider, declaration_type, job_ref, CASE WHEN job_ref % 5 <> 0 THEN 'available' ELSE 'unavailable' END AS status, block AS declared_at_block FROM pe WHERE event_type = 'signup'),
req AS (SELECT provider, declaration_type, job_ref, block AS requested_at_block FROM pe WHERE event_type = 'view' OR (event_type = 'signup' AND job_ref % 2 = 0))"""
