"""The backtest as a whole: features, outcomes and rules once, then the four configurations side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.probability import bin_of, shrunk_rate
from ..operators import calibration, episodes, features, lifecycle, mining
from ..sources.staging import at_once, staged


@dataclass
class Backtest:
    views: DataFrame
    resolved: DataFrame
    rules: DataFrame | None
    lifecycle: DataFrame | None


def prepare(events: DataFrame, with_rules: bool = True) -> Backtest:
    """views have p0, p_final (p0 without rules) and rules_applied; resolved has them too."""
    views = features.with_base_prediction(features.decision_views(events))
    resolved = staged(episodes.resolve(events, views))
    if not with_rules:
        none = {"p_final": F.col("p0"), "rules_applied": F.lit(None).cast("array<string>")}
        return Backtest(views.withColumns(none), resolved.withColumns(none), None, None)
    rules = staged(mining.promoted_rules(mining.rule_observations(resolved)))
    life = staged(lifecycle.rule_lifecycle(views, resolved, rules))
    ruled = at_once(*[lambda d=d: staged(lifecycle.with_rules(d, life)) for d in (views, resolved)])
    return Backtest(*ruled, rules, life)


@dataclass(frozen=True)
class Config:
    """What a run may recall: rules, the ledger as a note beside the call, the ledger as the bar of the call."""

    rules: bool
    ledger: bool
    threshold: bool

    @property
    def p(self) -> str:
        return "p_final" if self.rules else "p0"


# fixed values: the four configurations
CONFIGS = {"A": Config(True, True, False), "B": Config(False, True, True), "C": Config(True, True, True), "D": Config(False, False, False)}


def ledger(b: Backtest, p: str) -> DataFrame:
    """The ledger of probabilities p just before every block with a decision."""
    return calibration.ledger_asof(b.resolved.where("outcome is not null"), b.views.select(F.col("funding_block").alias("block")), p)


def with_bar(rows: DataFrame, held: DataFrame | None) -> DataFrame:
    """Rows with _bar, the threshold that the ledger teaches at their block; without a ledger the default."""
    if held is None:
        return rows.withColumn("_bar", F.lit(params.HIRE_AT))
    bars = calibration.thresholds(held).select(F.col("block").alias("funding_block"), F.col("hire_threshold").alias("_bar"))
    return rows.join(bars, "funding_block")


def scored(b: Backtest, config: Config, held: DataFrame | None = None) -> DataFrame:
    """Episodes under one configuration; held is its ledger if that is at hand."""
    if config.threshold and held is None:
        held = ledger(b, config.p)
    return episodes.score(with_bar(b.resolved, held if config.threshold else None), F.col(config.p), F.col("_bar")).drop("_bar")


def each_config(rows: DataFrame, chosen: dict[str, Config]) -> DataFrame:
    """Rows once for every configuration, with config, predicted, p (the name of its probability) and its flags ruled, noted and barred."""
    of = [
        F.struct(
            F.lit(name).alias("config"), F.col(c.p).alias("predicted"), F.lit(c.p).alias("p"), F.lit(c.ledger).alias("noted"), F.lit(c.threshold).alias("barred"),
            (F.col("rules_applied").isNotNull() & F.lit(c.rules)).alias("ruled"),
        )
        for name, c in chosen.items()
    ]
    return rows.withColumn("_c", F.explode(F.array(*of))).select("*", "_c.*").drop("_c")


def with_each_bar(rows: DataFrame, bars: DataFrame | None) -> DataFrame:
    """Rows of each_config with hire_threshold: the bar of their ledger at their block if they have one, else the default."""
    if bars is None:
        return rows.withColumn("hire_threshold", F.lit(params.HIRE_AT))
    own = F.when(F.col("barred"), F.col("_bars")[F.col("p")])
    return rows.join(bars, "funding_block", "left").withColumn("hire_threshold", F.coalesce(own, F.lit(params.HIRE_AT))).drop("_bars")


def summarise(eps: DataFrame, *by: str) -> DataFrame:
    """Figures of episodes. Changed decisions and policy rejections count scored episodes only."""
    y = F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)
    memory, chain, live = F.col("predicted") >= F.col("hire_threshold"), F.col("p0") >= params.HIRE_AT, ~F.col("inferred_expiry")
    naive = F.col("predicted") >= params.HIRE_AT
    changed = live & (memory != chain)
    rejected = live & ~memory & naive
    base = F.lit(params.BASE_RATE)
    return eps.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"), F.avg("brier").alias("brier"), F.avg((base - y) * (base - y)).alias("base_brier"),
        F.count_if(changed).alias("changed"), F.count_if(changed & (memory == (y == 1.0))).alias("changed_right"), F.countDistinct(F.when(changed, F.col("provider"))).alias("providers"),
        F.count_if(rejected).alias("policy_rejected"), F.count_if(rejected & (y == 0.0)).alias("policy_rejected_failed"),
    )


def memory_backed(views: DataFrame, known: DataFrame | None) -> DataFrame:
    """Per configuration, the decisions, resolved or not, to which a rule, an observed band or a learned bar contributed.

    views: rows with their configuration and bar; known: p, funding_block, bin and seen of the ledgers.
    """
    rows = views.withColumn("bin", bin_of(F.col("predicted")))
    rows = rows.withColumn("seen", F.lit(0)) if known is None else rows.join(known, ["p", "funding_block", "bin"], "left")
    banded = F.col("noted") & F.coalesce(F.col("seen") >= params.BIN_SUPPORT, F.lit(False))
    return rows.groupBy("config").agg(F.count_if(F.col("ruled") | banded | (F.col("hire_threshold") != params.HIRE_AT)).alias("memory_backed"))


def ablation(events: DataFrame, configs: str = "ABCD") -> DataFrame:
    """A row per configuration: rules only, threshold only, both, and nothing recalled.

    All configurations go through the episodes and the views together, and both ledgers are joined once.
    """
    chosen = {name: CONFIGS[name] for name in configs}
    b = prepare(events, with_rules=any(c.rules for c in chosen.values()))
    names = sorted({c.p for c in chosen.values() if c.ledger})
    bars = known = None
    if names:
        ledgers = dict(zip(names, at_once(*[lambda p=p: staged(ledger(b, p)) for p in names])))
        for p, held in ledgers.items():
            seen = held.select(F.lit(p).alias("p"), F.col("block").alias("funding_block"), "bin", F.col("n").alias("seen"))
            own = calibration.thresholds(held).select(F.col("block").alias("funding_block"), F.lit(p).alias("p"), "hire_threshold")
            known, bars = (seen, own) if known is None else (known.unionByName(seen), bars.unionByName(own))
        bars = staged(bars.groupBy("funding_block").agg(F.map_from_entries(F.collect_list(F.struct("p", "hire_threshold"))).alias("_bars")))
    eps = with_each_bar(each_config(b.resolved.where("outcome is not null"), chosen), bars)
    eps = eps.withColumn("_bar", F.col("hire_threshold"))
    eps = episodes.score(eps, F.col("predicted"), F.col("_bar"))
    views = with_each_bar(each_config(b.views.select("funding_block", "p0", "p_final", "rules_applied"), chosen), bars)
    every = events.sparkSession.createDataFrame([(c,) for c in chosen], "config string")
    out = every.join(summarise(eps, "config"), "config", "left").join(memory_backed(views, known), "config", "left")
    return out.fillna(0, ["episodes", "changed", "changed_right", "providers", "policy_rejected", "policy_rejected_failed", "memory_backed"])


def hypothetical(requests: DataFrame) -> DataFrame:
    """Requests (request_id, provider, client, amount, funded, completed) as views of jobs that don't exist yet, at the end of time."""
    # fixed values: what isn't known of a job before it is made
    rest = {"repeat_pair": "false", "budget_set_count": "1", "client_prior_funding_rate": "cast(null as double)", "client_prior_created": "0", "pair_prior_jobs": "0", "provider_concurrent_open": "0", "expiry_window": "3600"}
    return requests.withColumns({c: F.expr(x) for c, x in rest.items()}).withColumns({"job_id": F.col("request_id"), "funding_block": F.lit((1 << 63) - 1), "log_index": F.lit(0)})


def memory_record(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What memory holds of each provider (seen, done) and of each pair (pair_jobs, pair_completed): jobs that an event closed."""
    closed = resolved.where("outcome is not null and not inferred_expiry").select("provider", "client", (F.col("outcome") == "success").alias("done"))
    counts = lambda keys, n, c: closed.groupBy(*keys).agg(F.count("*").alias(n), F.count_if("done").alias(c))
    return counts(["provider"], "seen", "done"), counts(["provider", "client"], "pair_jobs", "pair_completed")


def score_requests(requests: DataFrame, resolved: DataFrame, rules: DataFrame, bands: DataFrame, threshold: float = params.HIRE_AT) -> DataFrame:
    """Bulk scoring of hypothetical jobs with what memory recalls: the provider's record and live rules, the pair's history, the ledger's band.

    The record's counts replace the caller's where the provider is known, in both calls that stand side by side: p_chain knows no
    rule, p_memory the strongest live rule of each field. rules: promoted ones with their status; bands: bin and observed_rate.
    The band is reported and moves nothing.
    """
    record, pairs = memory_record(resolved)
    rows = requests.join(record, "provider", "left").withColumns({"funded": F.coalesce("seen", "funded"), "completed": F.coalesce("done", "completed")}).drop("seen", "done")
    rows = staged(rows.withColumn("p_chain", shrunk_rate(F.col("completed"), F.col("funded"))))
    matches = mining.rule_matches(hypothetical(rows), lifecycle.believed(rules))
    weight = F.when(F.col("status") == "graduated", params.WEIGHTS["graduated"]).otherwise(params.WEIGHTS["provisional"])
    best = matches.groupBy("job_id", "field").agg(F.min(F.struct((-F.abs("delta_logit")).alias("rank"), "rule_id", F.col("delta_logit").alias("delta"), weight.alias("weight"))).alias("b"))
    by = best.groupBy(F.col("job_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("b.rule_id", "b.delta", "b.weight", "field"))).alias("rules_applied"))
    rows = rows.join(by, "request_id", "left")
    rows = rows.withColumn("p_memory", lifecycle.pushed(F.col("p_chain"), F.col("rules_applied"))).withColumn("bin", bin_of(F.col("p_memory")))
    rows = rows.join(F.broadcast(bands.select("bin", "observed_rate")), "bin", "left").join(pairs, ["provider", "client"], "left")  # ten bands
    call = lambda p: F.when(F.col(p) >= threshold, "HIRE").otherwise("DO NOT HIRE")
    return rows.select(
        "request_id", "provider", "client", "p_chain", "p_memory", "rules_applied", call("p_chain").alias("chain_call"), call("p_memory").alias("memory_call"),
        (F.round("p_chain", 4) != F.round("p_memory", 4)).alias("probability_changed"), (call("p_chain") != call("p_memory")).alias("decision_changed"),
        "observed_rate", F.coalesce("pair_jobs", F.lit(0)).alias("pair_jobs"), F.coalesce("pair_completed", F.lit(0)).alias("pair_completed"),
    )
