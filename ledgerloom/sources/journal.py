"""The append-only journal of decisions and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "id string, type string, job_id long, provider string, client string, predicted_completion double, p0_shrunk double, rules_applied string, amount long, predicted_at_block long, hire_threshold double, outcome string, predicted double, correct boolean, brier double, resolved_at_block long, failure_kind string, inferred_expiry boolean"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _full(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ROW.split(", "))])


def decision_rows(decisions: DataFrame) -> DataFrame:
    """Journal rows of decisions (views with p0, p_final and perhaps rules_applied), rounded to 4 places."""
    rules = F.to_json("rules_applied") if "rules_applied" in decisions.columns else F.lit(None)
    rows = decisions.select(
        F.concat_ws(":", F.lit("decision"), "job_id", "funding_block", "log_index").alias("id"), F.lit("decision").alias("type"), "job_id", "provider", "client",
        F.round("p_final", 4).alias("predicted_completion"), F.round("p0", 4).alias("p0_shrunk"), rules.alias("rules_applied"), "amount", F.col("funding_block").alias("predicted_at_block"),
    )
    return _full(rows)


def episode_rows(episodes: DataFrame) -> DataFrame:
    """Journal rows of episodes that an event closed; inferred ones are not journalled."""
    rows = episodes.where("not inferred_expiry").select(
        F.concat_ws(":", F.lit("episode"), "job_id").alias("id"), F.lit("episode").alias("type"), "job_id", F.round("hire_threshold", 4).alias("hire_threshold"), "outcome",
        F.round("predicted", 4).alias("predicted"), "correct", F.round("brier", 4).alias("brier"), "resolved_at_block", "failure_kind", "inferred_expiry",
    )
    return _full(rows)


def under_policy(decisions: DataFrame, policy: str, rules: DataFrame | None = None) -> DataFrame:
    """What is journalled: all, only decisions about providers with rules, or none."""
    if policy == "all":
        return decisions
    if policy == "none":
        return decisions.limit(0)
    return decisions.join(rules.select(F.col("subject").alias("provider")).distinct(), "provider", "left_semi")


def high_water(journal: DataFrame) -> int:
    """The last block the journal holds; a block of 0 counts as missing."""
    block = F.coalesce(F.nullif("predicted_at_block", F.lit(0)), "resolved_at_block")
    return journal.agg(F.coalesce(F.max(block), F.lit(0)).alias("b")).first()["b"]


#: Folders by hash of the job in which a journal keeps its rows.
BUCKETS = 32


def bucket_of(job_id: Column) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(BUCKETS)).cast("int")


def append(rows: DataFrame, path: str) -> None:
    """Add rows, those of a job in one folder, sorted by job."""
    rows = rows.withColumn("bucket", bucket_of(F.col("job_id"))).repartition("bucket").sortWithinPartitions("bucket", "job_id")
    rows.write.mode("append").partitionBy("bucket", "type").parquet(path)


def append_above(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Append what lies above the journal's high-water block, so a repeated run adds nothing."""
    mark = high_water(read(spark, path))
    block = F.coalesce(F.nullif("predicted_at_block", F.lit(0)), "resolved_at_block")
    append(rows.where(block > mark), path)
    return mark


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole journal, each id once."""
    return stored(spark, path).dropDuplicates(["id"])


def stored(spark: SparkSession, path: str, job_id: int | None = None) -> DataFrame:
    """Rows as they were written, repeated ids too; those of one job from its folder alone."""
    rows = spark.read.schema(ROW).parquet(path)
    if job_id is not None:
        rows = rows.where((F.col("bucket") == bucket_of(F.lit(job_id).cast("long"))) & (F.col("job_id") == job_id))
    return rows.select(*COLUMNS)


def trail_of_job(spark: SparkSession, path: str, job_id: int) -> DataFrame:
    """audit_trail() of one job of a stored journal, which reads its folder and there, as files are sorted, few row groups."""
    return audit_trail(stored(spark, path, job_id).dropDuplicates(["id"]), job_id=job_id)


def rebuild(journal: DataFrame, published: dict[str, float] | None = None, tolerance: float = 5e-4) -> DataFrame:
    """Decisions, episodes, accuracy and mean Brier from the journal alone; with published figures also whether each agrees."""
    ended = F.col("type") == "episode"
    out = journal.agg(F.count_if(F.col("type") == "decision").alias("decisions"), F.count_if(ended).alias("episodes"), F.avg(F.when(ended, F.when(F.col("correct"), 1.0).otherwise(0.0))).alias("accuracy"), F.avg(F.when(ended, F.col("brier"))).alias("mean_brier"))
    for name, value in (published or {}).items():
        out = out.withColumn(f"{name}_agrees", F.abs(F.col(name) - F.lit(value)) <= tolerance)
    return out


def audit_trail(journal: DataFrame, provider: str | None = None, job_id: int | None = None) -> DataFrame:
    """Rows of a provider or job in write order, a decision before its episode. Episodes find their provider through the job."""
    if job_id is not None:
        journal = journal.where(F.col("job_id") == job_id)
    who = journal.where("type = 'decision'").select("job_id", F.col("provider").alias("_provider")).distinct()
    rows = journal.join(who, "job_id").withColumn("provider", F.col("_provider")).drop("_provider")
    if provider is not None:
        rows = rows.where(F.col("provider") == provider)
    block = F.coalesce("predicted_at_block", "resolved_at_block")
    return rows.withColumn("block", block).orderBy("block", "type", "job_id")
