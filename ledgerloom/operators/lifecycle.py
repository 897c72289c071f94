"""Trial, graduation and demotion of rules: an ordered fold per provider and field.

A demotion changes which rule is the strongest of the next decision, so the fold can't be a window. Rules of one
provider and field compete with each other alone, so each field of a provider is folded by itself.
Rows arrive sorted by key and time in Arrow batches; the state is the field's rules (at most one
per rung) and the open decisions, never the provider's whole history.

A provider's field with more than SEGMENT rows is cut into segments that fold at once, each from a guess of what the
one before leaves. What a segment leaves depends little on where it began: a rule's last few outcomes are its own, and counts add up. So
most guesses prove right once they are replaced by what the segment before left, and only the others fold again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.probability import logit, sigmoid
from ..sources.staging import staged
from .asof import Running, running
from .mining import rule_matches

FOLD = "kind string, job_id long, provider string, funding_block long, log_index long, rule_id string, field string, delta double, weight double, status string, applications long, hits long"
COLUMNS = [c.split()[0] for c in FOLD.split(", ")]


@dataclass
class Managed:
    """A rule under trial. Rows come in order, views of a block before its closings, so its status is the one seen."""

    delta: float
    chance: float
    status: str = "provisional"
    applications: int = 0
    hits: int = 0
    recent: list[bool] = field(default_factory=list)

    def apply(self, completed: bool, trial: int) -> None:
        if self.status == "demoted":
            return
        right = (self.delta < 0) != completed
        self.applications += 1
        self.hits += right
        self.recent = [*self.recent, right][-trial:]
        if self.applications >= trial and (self.status == "provisional" or len(self.recent) == trial):
            self.status = "graduated" if sum(self.recent) / len(self.recent) > self.chance else "demoted"


def strongest(matches: list[dict], rules: dict[str, Managed]) -> list[tuple[str, str, float, float]]:
    """(rule_id, field, delta, weight) per field: the largest adjustment, of ties the lowest rule_id as text."""
    best: dict[str, tuple] = {}
    for m in matches:
        rule = rules.setdefault(m["rule_id"], Managed(m["delta_logit"], 1 - m["baseline_rate"] if m["delta_logit"] < 0 else m["baseline_rate"]))
        if rule.status != "demoted":
            rank = (-abs(rule.delta), m["rule_id"])
            if m["field"] not in best or rank < best[m["field"]][0]:
                best[m["field"]] = (rank, (m["rule_id"], m["field"], rule.delta, params.WEIGHTS[rule.status]))
    return sorted(x for _, x in best.values())


@dataclass
class Trials:
    """The rules and open decisions of a provider, or of one of its fields; the state of the fold, batch or stream."""

    rules: dict[str, Managed] = field(default_factory=dict)
    waiting: dict[int, list[str]] = field(default_factory=dict)

    def step(self, row: dict, trial: int = params.TRIAL) -> Iterator[tuple]:
        """Take one view (phase 0, with matches) or closing (with completed, null if the decision lapsed); FOLD rows of kind applied."""
        if row["phase"] == 0:
            applied = strongest(row["matches"], self.rules)
            self.waiting[row["job_id"]] = [r for r, *_ in applied]
            for rule_id, name, delta, weight in applied:
                yield ("applied", row["job_id"], row["provider"], row["block"], row["log_index"], rule_id, name, delta, weight, self.rules[rule_id].status, None, None)
        else:
            for rule_id in self.waiting.pop(row["job_id"], []):
                if row["completed"] is not None:
                    self.rules[rule_id].apply(row["completed"], trial)

    def states(self, provider: str) -> Iterator[tuple]:
        """FOLD rows of kind rule: where each rule stands."""
        for rule_id, r in sorted(self.rules.items()):
            yield ("rule", None, provider, None, None, rule_id, None, r.delta, params.WEIGHTS.get(r.status), r.status, r.applications, r.hits)

    def to_json(self) -> str:
        return json.dumps({"rules": {k: asdict(r) for k, r in self.rules.items()}, "waiting": list(self.waiting.items())})

    @classmethod
    def from_json(cls, held: str) -> Trials:
        found = json.loads(held)
        return cls({k: Managed(**r) for k, r in found["rules"].items()}, dict(map(tuple, found["waiting"])))


def fold(rows: Iterator[dict], trial: int = params.TRIAL) -> Iterator[tuple]:
    """Rows of one or more providers (and fields, if rows have one) in order: views (with matches) and closings (with completed)."""
    key, trials = (None, None), Trials()
    for row in rows:
        if (row["provider"], row.get("field")) != key:
            yield from trials.states(key[0])
            key, trials = (row["provider"], row.get("field")), Trials()
        yield from trials.step(row, trial)
    yield from trials.states(key[0])


def trial_rows(views: DataFrame, resolved: DataFrame, rules: DataFrame) -> DataFrame:
    """What the fold takes, for each field apart: views that some rule matches, and the closings of their jobs.

    A decision that lapsed is closed too, so that nothing waits for it; it teaches nothing.
    """
    match = F.struct("rule_id", "field", "delta_logit", "baseline_rate")
    decided = rule_matches(views, rules).groupBy("provider", "field", "job_id", "funding_block", "log_index").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    none = F.array().cast("array<struct<rule_id:string,field:string,delta_logit:double,baseline_rate:double>>")
    asked = decided.select("provider", "field", F.col("funding_block").alias("block"), F.lit(0).alias("phase"), "log_index", "job_id", "matches", F.lit(None).cast("boolean").alias("completed"))
    closed = resolved.where("outcome is not null").join(decided.select("job_id", "field").distinct(), "job_id")
    ended = closed.select("provider", "field", F.col("resolved_at_block").alias("block"), F.lit(1).alias("phase"), F.coalesce("resolved_log_index", F.lit(-1)).alias("log_index"), "job_id", none.alias("matches"), F.when(~F.col("inferred_expiry"), F.col("outcome") == "success").alias("completed"))
    return asked.unionByName(ended)


#: Rows of a provider's field that one task folds.
SEGMENT = 200_000
ORDER = ["block", "phase", "log_index", "job_id"]


def _in_frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for out in rows:
        held.append(out)
        if len(held) >= 10_000:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def rule_lifecycle(views: DataFrame, resolved: DataFrame, rules: DataFrame, trial: int = params.TRIAL, segment: int = SEGMENT) -> DataFrame:
    """FOLD rows: kind applied (a rule that moved a decision) and kind rule (a matched rule's end state)."""
    return folded(trial_rows(views, resolved, rules), trial, segment)


def folded(rows: DataFrame, trial: int = params.TRIAL, segment: int = SEGMENT) -> DataFrame:
    """The fold of trial_rows; fields of more than ``segment`` rows in segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _in_frames(fold((row for batch in batches for row in batch.to_dict("records")), trial), COLUMNS)

    rows = staged(rows)
    large = staged(rows.groupBy("provider", "field").agg(F.count("*").alias("n")).where(F.col("n") > segment).select("provider", "field"))
    whole = lambda d: d.repartition("provider", "field").sortWithinPartitions("provider", "field", *ORDER).mapInPandas(run, FOLD)
    if large.isEmpty():
        return whole(rows)
    keys = ["provider", "field"]
    return whole(rows.join(large, keys, "left_anti")).unionByName(segmented(rows.join(large, keys), trial, segment))


def _guess(end: str | None, trial: int) -> str:
    """The state that a segment begins with, from what the one before left: counts only as far as they matter, the rest adds up."""
    trials = Trials.from_json(end) if end else Trials()
    for r in trials.rules.values():
        r.applications, r.hits = min(r.applications, trial), 0
    trials.rules = dict(sorted(trials.rules.items()))
    trials.waiting = dict(sorted(trials.waiting.items()))
    return trials.to_json()


def segmented(rows: DataFrame, trial: int = params.TRIAL, segment: int = SEGMENT) -> DataFrame:
    """The fold of rows of large fields. A round folds the segments whose guess was wrong, until none is; each round makes one more of them right at least.

    A segment has rows of whole blocks, about ``segment`` of them; where it begins follows from the counts per bucket of blocks.
    """
    keys, at = ["provider", "field"], ["provider", "field", "segment"]
    rows = rows.withColumn("_block", F.col("block"))
    per = rows.groupBy(*keys, "_block").agg(F.count("*").alias("n"))
    before = running(per, keys, "_block", [Running("_before", F.col("n"))])
    rows = staged(rows.join(before.select(*keys, "_block", F.floor(F.col("_before") / segment).alias("segment")), [*keys, "_block"]).drop("_block"))
    first = _guess(None, trial)

    def run(key: tuple, found: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        start = starts["start"].iloc[0]
        trials, out = Trials.from_json(start), []
        had = {k: r.applications for k, r in trials.rules.items()}
        for row in found.sort_values(ORDER).to_dict("records"):
            out += trials.step(row, trial)
        end = trials.to_json()
        out += [x[:10] + (x[10] - had.get(x[5], 0), x[11]) for x in trials.states(key[0])]
        out = [(*x, key[1], key[2], start, None) for x in out]
        out.append(("end", None, key[0], *[None] * 9, key[1], key[2], start, end))
        return pd.DataFrame(out, columns=[*COLUMNS, "of", "segment", "start", "end"])

    schema = f"{FOLD}, of string, segment long, start string, end string"
    segments = staged(rows.select(*at).distinct())
    open_, done, turn = segments.withColumn("start", F.lit(first)), None, 0
    guess = F.udf(lambda end: _guess(end, trial), "string")
    while True:
        part = rows.join(open_.select(*at), at, "left_semi").groupBy(*at).cogroup(open_.groupBy(*at)).applyInPandas(run, schema)
        part = staged(part.withColumn("turn", F.lit(turn)))
        done = part if done is None else done.unionByName(part)
        # of each segment the last fold counts
        ends = done.where("kind = 'end'").groupBy("provider", "of", "segment").agg(F.max_by(F.struct("start", "end", "turn"), "turn").alias("x"))
        ends = staged(ends.select("provider", F.col("of").alias("field"), "segment", "x.*"))
        follows = Window.partitionBy(*keys).orderBy("segment")
        next_ = ends.withColumn("should", F.coalesce(guess(F.lag("end").over(follows)), F.lit(first)))
        open_ = staged(next_.where("start <> should").select(*at, F.col("should").alias("start")))
        turn += 1
        if open_.isEmpty():
            break
    last = ends.select("provider", F.col("field").alias("of"), "segment", "turn")
    out = done.join(last, ["provider", "of", "segment", "turn"])
    rule = out.where("kind = 'rule'").groupBy("provider", "of", "rule_id").agg(F.max_by(F.struct("kind", "job_id", "funding_block", "log_index", "field", "delta", "weight", "status"), "segment").alias("x"), F.sum("applications").alias("applications"), F.sum("hits").alias("hits"))
    rule = rule.select("x.kind", "x.job_id", "provider", "x.funding_block", "x.log_index", "rule_id", "x.field", "x.delta", "x.weight", "x.status", "applications", "hits")
    return out.where("kind = 'applied'").select(COLUMNS).unionByName(rule.select(COLUMNS))


def rules_at_end(rules: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """All promoted rules with their status; a rule that never moved a decision stays provisional."""
    state = lifecycle.where("kind = 'rule'").select("rule_id", "status", "applications", "hits")
    return rules.join(state, "rule_id", "left").fillna({"status": "provisional", "applications": 0, "hits": 0})


def believed(at_end: DataFrame) -> DataFrame:
    """Rules that may still move a decision."""
    return at_end.where("status <> 'demoted'")


def retired(at_end: DataFrame) -> DataFrame:
    """Rules that were demoted, kept with the reason."""
    return at_end.where("status = 'demoted'").withColumn("reason", F.lit("demoted: stopped outperforming the provider baseline"))


def rule_summary(at_end: DataFrame) -> DataFrame:
    return at_end.groupBy("status").agg(F.count("*").alias("rules"), F.countDistinct("subject").alias("providers"), F.sum("applications").alias("applications"), F.sum("hits").alias("hits"))


def pushed(p: Column, applied: Column) -> Column:
    """p moved by the rules applied (delta and weight), whose sum comes first; exactly p without any."""
    push = F.aggregate(applied, F.lit(0.0), lambda a, r: a + r["delta"] * r["weight"])
    return F.coalesce(sigmoid(logit(F.when(applied.isNotNull(), p)) + push), p)


def with_rules(views: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Views (with p0) and p_final with the rules that made it; exactly p0 where no rule matched."""
    key = ["job_id", "funding_block", "log_index"]
    item = F.struct("rule_id", "delta", "weight", "field")
    by = lifecycle.where("kind = 'applied'").groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("rules_applied"))
    return views.join(by, key, "left").withColumn("p_final", pushed(F.col("p0"), F.col("rules_applied")))


