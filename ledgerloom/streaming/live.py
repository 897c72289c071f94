"""The live tail: the same decoding and features on a stream of raw logs, whole blocks at a time.

Each micro-batch lands its decoded logs, settles the blocks that lie deep enough under the head, and takes the
decisions of what has settled. History is kept as opening balances per job, provider, client and pair, in keyed
tables to which a batch writes its changes alone, so it reads the last state and its own events, never the whole log. Every earlier state
stays readable: when a reorganisation reaches below settled blocks, decisions go on from the state before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import params
from ..functions.decode import EVENT, decode, schema
from ..functions.probability import evidence_weight
from ..operators import episodes, evidence, features
from ..operators.lifecycle import COLUMNS as FOLD_COLUMNS
from ..operators.lifecycle import FOLD, Managed, Trials
from ..sources.keyed import Keyed
from ..sources.staging import staged


def replaced(repairs: list[tuple[int, int]]) -> dict[int, int]:
    """{batch: the batch that replaced it} of repairs (batch, the last batch that stays)."""
    out: dict[int, int] = {}
    for number, since in sorted(repairs):
        out |= {b: number for b in range(since + 1, number) if b not in out}
    return out


def superseded(spark: SparkSession, out: str, number: int) -> dict[int, int]:
    """replaced() of the batches before ``number``."""
    if not number:
        return {}
    marks = spark.read.parquet(*[f"{out}-marks/batch={n}" for n in range(number)]).where("since is not null").select("number", "since")
    return replaced([tuple(r) for r in marks.collect()])  # a row a repair


def settle(spark: SparkSession, landed: str, out: str, confirmations: int = params.CONFIRMATIONS, then: Callable[..., None] | None = None, repair: bool = False):
    """A foreachBatch function: land decoded logs, then append the newly settled blocks to ``out``.

    A block is settled once ``confirmations`` blocks lie above it; it is written once and whole, and handed to ``then``.
    Every batch writes folders of its own number and reads those of the number before, so a batch that runs again after a
    failure replaces its own output and nothing else, and no batch reads what settled long ago: what is still open goes
    on from batch to batch (``landed``-open), as do the settled block and the head (``out``-marks). Logs that come
    after their block has settled and aren't in ``out`` are kept and counted (``out``-late, and late in ``out``-marks).

    repair: logs that the node removed leave the open blocks, and a late or removed log of a settled block settles anew all blocks behind the
    last batch before it: its batch holds them corrected, and ``then`` also gets the number of that last batch (-1: none). The batches
    between are superseded. A log that comes and is removed in one batch counts as removed.
    """
    log = EVENT

    def held(path: str, number: int) -> DataFrame:
        return spark.read.schema(log).parquet(f"{path}/batch={number}")

    def without(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        return rows if gone is None else rows.subtract(gone)

    def run(batch: DataFrame, number: int) -> None:
        decode(batch).write.mode("overwrite").parquet(f"{landed}/batch={number}")
        new, mark, gone = held(landed, number), {"settled": -1, "head": -1}, None
        if repair:
            decode(batch.where("removed").withColumn("removed", F.lit(False))).write.mode("overwrite").parquet(f"{landed}-removed/batch={number}")
            gone = held(f"{landed}-removed", number)
            new = without(new, gone)
        if number:
            mark = spark.read.parquet(f"{out}-marks/batch={number - 1}").first().asDict()
        done = mark["settled"]
        fresh = new.where(F.col("block") > done)
        if number:
            fresh = fresh.unionByName(without(held(f"{landed}-open", number - 1), gone))
        fresh = staged(fresh.dropDuplicates(["block", "log_index"]))
        top = fresh.agg(F.max("block").alias("b")).first()["b"]
        head = max(mark["head"], top if top is not None else -1)
        settled = max(done, head - confirmations)
        late = staged(new.where(F.col("block") <= done).dropDuplicates(["block", "log_index"]))
        firsts = [late.agg(F.min("block").alias("b")).first()["b"], gone.where(F.col("block") <= done).agg(F.min("block").alias("b")).first()["b"] if repair else None]
        first = min((b for b in firsts if b is not None), default=None)
        since = None
        if first is not None:
            current = [n for n in range(number) if n not in superseded(spark, out, number)]
            known = spark.read.schema(log).parquet(*[f"{out}/batch={n}" for n in current]).where(F.col("block") >= first)
            if repair:
                late = staged(late.subtract(known))
                first = late.unionByName(known.intersect(gone)).agg(F.min("block").alias("b")).first()["b"]
                if first is not None:
                    before = spark.read.parquet(*[f"{out}-marks/batch={n}" for n in current]).where(F.col("settled") < first)
                    since = before.agg(F.coalesce(F.max("number"), F.lit(-1)).alias("n")).first()["n"]
                    kept = without(spark.read.schema(log).parquet(*[f"{out}/batch={n}" for n in current if n > since]), gone)
                    # a log that comes anew at its place replaces the one that stood there
                    kept = kept.join(late.select("block", "log_index"), ["block", "log_index"], "left_anti").select(log.fieldNames())
                    fresh = staged(fresh.unionByName(kept).unionByName(late))
            else:
                late = late.join(known.select("block", "log_index"), ["block", "log_index"], "left_anti").select(log.fieldNames())
        fresh.where(F.col("block") <= settled).write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.where(F.col("block") > settled).write.mode("overwrite").parquet(f"{landed}-open/batch={number}")
        late.write.mode("overwrite").parquet(f"{out}-late/batch={number}")
        n_late = held(f"{out}-late", number).count()
        if then is not None:
            then(held(out, number), number, *([since] if since is not None else []))
        one = {"number": number, "settled": settled, "head": head, "late": n_late, "since": since}
        marks = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in one.items()])
        marks.write.mode("overwrite").parquet(f"{out}-marks/batch={number}")

    return run


def tail(logs: DataFrame, landed: str, out: str, checkpoint: str, confirmations: int = params.CONFIRMATIONS, then: Callable[..., None] | None = None, repair: bool = False) -> StreamingQuery:
    return logs.writeStream.foreachBatch(settle(logs.sparkSession, landed, out, confirmations, then, repair)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, path: str) -> DataFrame:
    """What the batches wrote to ``path``, without those that a repair of ``out`` superseded."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = spark.read.parquet(f"{out}-marks/batch=*").agg(F.max("number").alias("n")).first()["n"]
    return rows.where(~F.col("batch").isin(list(superseded(spark, out, last + 1)))).drop("batch")


BALANCES = ("d_created", "d_funded", "d_completed", "d_expired", "d_self", "d_open")


def roll_forward(snapshot: DataFrame | None, state: DataFrame, *keys: str) -> DataFrame:
    """The snapshot after a batch: opening balances plus the batch's changes (rows of with_job_state), and the blocks that ages start from.

    keys: provider (the default), client, or both for pairs.
    """
    keys = keys or ("provider",)
    made = F.when(F.col("d_created") == 1, F.nullif("block", F.lit(0)))
    rows = state.dropna(subset=list(keys)).select(*keys, *[F.col(c).cast("long").alias(c) for c in BALANCES], made.alias("first_made"), made.alias("last_made"), "acted_at")
    rows = rows if snapshot is None else snapshot.unionByName(rows)
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in BALANCES], F.min("first_made").alias("first_made"), F.max("last_made").alias("last_made"), F.max("acted_at").alias("acted_at"))


# fixed values: the counts of a view that open with a balance, by key
OPENING = {
    ("provider",): {"provider_prior_funded": "d_funded", "provider_prior_completed": "d_completed", "provider_prior_rejected_by_self": "d_self", "provider_prior_expired": "d_expired", "provider_concurrent_open": "d_open"},
    ("client",): {"client_prior_created": "d_created", "client_prior_funded": "d_funded"},
    ("client", "provider"): {"pair_prior_jobs": "d_funded", "pair_prior_completed": "d_completed"},
}


def with_opening(views: DataFrame, snapshot: DataFrame, *keys: str) -> DataFrame:
    """Views of one batch, whose counts know that batch alone, with the history before it added."""
    counts = OPENING[keys]
    held = snapshot.select(*keys, *[F.col(c).alias(f"_{n}") for n, c in counts.items()])
    return views.join(held, list(keys), "left").withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in counts}).drop(*[f"_{n}" for n in counts])


_BALANCE = {c: "sum" for c in BALANCES} | {"first_made": "min", "last_made": "max", "acted_at": "max"}
#: How the tables of a snapshot change: balances add up, jobs and what is open or closed have a last state. Jobs leave with their deadline and the grace.
TABLES = {
    "jobs": Keyed(("job_id",), until="until"),
    "providers": Keyed(("provider",), _BALANCE),
    "clients": Keyed(("client",), _BALANCE),
    "pairs": Keyed(("client", "provider"), _BALANCE),
    "amounts": Keyed(("provider", "amount"), {"n": "sum"}),
    "pending": Keyed(("job_id", "funding_block", "log_index")),
    "closed": Keyed(("job_id",), until="until"),
}


@dataclass
class Snapshot:
    """All that a batch needs of those before it: what jobs carry on, balances, completed amounts, open decisions and the jobs that are closed.

    The same tables say what one batch changed (now: its last timestamp); then rows of jobs, pending and closed have _gone.
    """

    jobs: DataFrame
    providers: DataFrame
    clients: DataFrame
    pairs: DataFrame
    amounts: DataFrame
    pending: DataFrame
    closed: DataFrame
    now: int | None = None

    def after(self, changes: Snapshot) -> Snapshot:
        return Snapshot(*[t.after(getattr(self, name), getattr(changes, name), changes.now) for name, t in TABLES.items()], changes.now)

    @classmethod
    def first(cls, changes: Snapshot) -> Snapshot:
        return cls(*[t.after(None, getattr(changes, name), changes.now) for name, t in TABLES.items()], changes.now)

    def marked(self) -> Snapshot:
        """A whole state as the changes that make it."""
        return Snapshot(*[getattr(self, n) if t.how else getattr(self, n).withColumn("_gone", F.lit(False)) for n, t in TABLES.items()], self.now)

    @staticmethod
    def rows(spark: SparkSession, path: str, number: int) -> int:
        """Rows of the run of one batch, of all tables."""
        return sum(spark.read.parquet(f"{path}/{name}/level=0/run={number}").count() for name in TABLES)

    def write(self, path: str, number: int) -> None:
        """What a batch changed, as the next run of each table; number counts from the beginning of the epoch."""
        for name, t in TABLES.items():
            t.write(getattr(self, name), f"{path}/{name}", number, self.now)

    @classmethod
    def read(cls, spark: SparkSession, path: str, number: int, now: int | None = None) -> Snapshot:
        return cls(*[t.read(spark, f"{path}/{name}", number, now) for name, t in TABLES.items()], now)


def _opened(rows: DataFrame, before: Snapshot) -> DataFrame:
    """Rows of features.carried of one batch, with the history before it."""
    rows = with_opening(rows, before.providers.drop("first_made", "last_made", "acted_at"), "provider")
    seen = before.providers.select("provider", "first_made", "last_made", F.col("acted_at").alias("last_acted"))
    rows = rows.join(seen, "provider", "left").withColumns({"_first": F.least("_first", "first_made"), "_made": F.greatest("_made", "last_made"), "_acted": F.greatest("_acted", "last_acted")})
    return with_opening(with_opening(rows.drop("first_made", "last_made", "last_acted"), before.clients, "client"), before.pairs, "client", "provider")


def changes(events: DataFrame, before: Snapshot | None = None, grace: int = 30 * 86_400) -> tuple[DataFrame, DataFrame, Snapshot]:
    """Views with p0, episodes and what changes of a batch of whole blocks: the operators of the backtest, opened with the last snapshot.

    A decision waits until an event closes its job. Once the head lies more than ``grace`` seconds past the deadline it is
    an inferred failure, so that nothing waits for ever. A closed job stays closed, whatever comes after; a job that its deadline and
    the grace lie behind is forgotten, and events of it are those of an unknown job.
    """
    state = staged(features.with_job_state(events, before.jobs if before else None))
    rows = features.carried(state)
    views = features.finished(_opened(rows, before) if before else rows, features.median_completed_amount(state, before.amounts if before else None))
    views = staged(features.with_base_prediction(views))
    waiting = views if before is None else views.join(before.closed, "job_id", "left_anti").unionByName(before.pending)
    found = staged(episodes.resolve(events, waiting))
    over = F.col("outcome").isNotNull() & (~F.col("inferred_expiry") | (F.col("head_ts") > F.col("funding_timestamp") + F.col("expiry_window") + grace))
    head = episodes.head(events).select("head_ts")
    ended = found.crossJoin(F.broadcast(head)).where(F.coalesce(over, F.lit(False))).drop("head_ts")
    eps = staged(episodes.score(ended, F.col("p0")))
    now = head.first()["head_ts"]
    leaves = lambda deadline: F.greatest(deadline, F.lit(now)) + grace
    made = F.col("made.expired_at")
    # a job whose creation is unknown leaves after its last event, one without deadline never
    until = F.when(F.col("made").isNull(), leaves(F.lit(0).cast("long"))).when(made > 0, leaves(made))
    ended = eps.select("job_id", leaves(F.col("funding_timestamp") + F.col("expiry_window")).alias("until"))
    opened, closed = views, ended
    if before is not None:
        opened = views.join(before.closed, "job_id", "left_anti").select(views.columns)
        # a closed job with new events stays known as closed as long as the job does
        closed = before.closed.join(state.select("job_id").distinct(), "job_id").select("job_id", F.when(F.col("until").isNotNull(), leaves(F.col("until") - grace)).alias("until")).unionByName(ended)
    mark = lambda d, gone: d.withColumn("_gone", F.lit(gone))
    gone = waiting.join(ended.select("job_id"), "job_id", "left_semi").select(views.columns)
    changed = Snapshot(
        mark(features.jobs_after(state).withColumn("until", until), False),
        *[roll_forward(None, state, *keys) for keys in (("provider",), ("client",), ("client", "provider"))],
        features.amounts_after(state),
        mark(opened.join(ended.select("job_id"), "job_id", "left_anti").select(views.columns), False).unionByName(mark(gone, True)),
        mark(closed.groupBy("job_id").agg(F.max("until").alias("until")), False),
        now,
    )
    return views, eps, changed


def decide(events: DataFrame, before: Snapshot | None = None, grace: int = 30 * 86_400) -> tuple[DataFrame, DataFrame, Snapshot]:
    """Views, episodes and the next snapshot of a batch."""
    views, eps, changed = changes(events, before, grace)
    return views, eps, Snapshot.first(changed) if before is None else before.after(changed)


#: Changed rows with which an epoch of the tables ends at the earliest.
TURN = 100_000


def deciding(spark: SparkSession, path: str, grace: int = 30 * 86_400) -> Callable[..., None]:
    """What tail() hands settled events to: writes views, episodes and the changes of every batch under its number.

    A batch reads the snapshot of the number before and replaces its own changes, so it can run again. Once an epoch's changes are more than twice the
    rows that it began with (and TURN), the next one begins with what is left of them, so a change is written a few times and no more. After a repair (since: the last batch that
    stays) views and episodes go on from the snapshot of that batch, a new epoch of tables begins with the whole state, and the
    decisions that no longer hold are recorded under ``retracted``.
    """

    def run(events: DataFrame, number: int, since: int | None = None) -> None:
        last, epoch, now, base, written, before = number - 1 if since is None else since, 0, None, 0, 0, None
        if last >= 0:
            epoch, now, base, written = spark.read.parquet(f"{path}/epoch/batch={last}").select("epoch", "now", "base", "written").first()
            before = Snapshot.read(spark, f"{path}/snapshot/{epoch}", last - epoch, now)
        views, eps, changed = changes(events, before, grace)
        changed.now = max((t for t in (now, changed.now) if t is not None), default=None)
        views.write.mode("overwrite").parquet(f"{path}/views/batch={number}")
        eps.write.mode("overwrite").parquet(f"{path}/episodes/batch={number}")
        if since is not None:
            again = range(since + 1, number)
            repairs = spark.read.parquet(*[f"{path}/epoch/batch={n}" for n in again]).where("since is not null").select("number", "since")
            gone = replaced([tuple(r) for r in repairs.collect()])
            old = spark.read.option("basePath", f"{path}/views").parquet(*[f"{path}/views/batch={n}" for n in again if n not in gone]).select(*features.VIEW, "batch", "p0")
            new = views.select(*features.VIEW, F.col("p0").alias("_p0"))
            old.join(new, features.VIEW, "left").where("_p0 is null or _p0 <> p0").drop("_p0").write.mode("overwrite").parquet(f"{path}/retracted/batch={number}")
            whole, epoch = Snapshot.first(changed) if before is None else before.after(changed), number
            changed = whole.marked()
            base, written = 0, 0
        at = lambda e: f"{path}/snapshot/{e}"
        changed.write(at(epoch), number - epoch)
        written += changed.rows(spark, at(epoch), number - epoch)
        if written > 2 * base + TURN:
            Snapshot.read(spark, at(epoch), number - epoch, changed.now).marked().write(at(number), 0)
            epoch, base, written = number, changed.rows(spark, at(number), 0), 0
        one = {"number": number, "epoch": epoch, "now": changed.now, "since": since, "base": base, "written": written}
        spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in one.items()]).write.mode("overwrite").parquet(f"{path}/epoch/batch={number}")

    return run


def stream_rules(rows: DataFrame, trial: int = params.TRIAL) -> DataFrame:
    """The trial of rules on a stream of trial_rows, whole blocks at a time; the state is that of the batch fold.

    Every batch gives the rules that moved its decisions, and where each rule of its providers stands after it.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trials = Trials.from_json(state.get[0]) if state.exists else Trials()
        found = pd.concat(list(batches)).sort_values(["block", "phase", "log_index", "job_id"])
        out = [x for row in found.to_dict("records") for x in trials.step(row, trial)]
        state.update((trials.to_json(),))
        yield pd.DataFrame([*out, *trials.states(key[0])], columns=FOLD_COLUMNS)

    keys = ["provider", "field"] if "field" in rows.columns else ["provider"]
    return rows.groupBy(*keys).applyInPandasWithState(update, FOLD, "trials string", "append", GroupStateTimeout.NoTimeout)


class _Trial(StatefulProcessor):
    """Rules and open decisions of one provider's field as typed state: a row a rule, a row a decision, and a timer a deadline."""

    def __init__(self, trial: int) -> None:
        self.trial = trial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rules = handle.getMapState("rules", "rule_id string", "delta double, chance double, status string, applications long, hits long, recent string")
        self.waiting = handle.getMapState("waiting", "job_id long", "rules string, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, trials = [], Trials()
        for (rule_id,), (delta, chance, status, n, hits, recent) in self.rules.iterator():
            trials.rules[rule_id] = Managed(delta, chance, status, n, hits, [c == "1" for c in recent])
        for row in pd.concat(list(rows)).sort_values(["block", "phase", "log_index", "job_id"]).to_dict("records"):
            job = (int(row["job_id"]),)
            if row["phase"] == 0:
                out += trials.step(row, self.trial)
                applied = trials.waiting.pop(row["job_id"])
                until = int(row["until"]) if pd.notna(row["until"]) else -1
                if applied:
                    self.waiting.updateValue(job, (json.dumps(applied), until))
                    if until >= 0:
                        self.handle.registerTimer(until * 1000)
            elif self.waiting.containsKey(job):
                trials.waiting[row["job_id"]] = json.loads(self.waiting.getValue(job)[0])
                self.waiting.removeKey(job)
                out += trials.step(row, self.trial)
        for rule_id, r in trials.rules.items():
            self.rules.updateValue((rule_id,), (r.delta, r.chance, r.status, r.applications, r.hits, "".join("1" if x else "0" for x in r.recent)))
        yield pd.DataFrame([*out, *trials.states(key[0])], columns=FOLD_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for job, (_, until) in list(self.waiting.iterator()):
            if 0 <= until and until * 1000 <= now:
                self.waiting.removeKey(job)
        yield from ()

    def close(self) -> None:
        pass


def stream_trials(rows: DataFrame, trial: int = params.TRIAL) -> DataFrame:
    """stream_rules() with typed state: a batch reads and writes the rules and decisions that it meets, not one text of all.

    rows also have event_time (watermarked) and until, the second from which on a decision that nothing has closed is forgotten (null:
    never), so that what waits is bounded by the decisions that may still end. The state store must be RocksDB's.
    """
    keys = [c for c in ("provider", "field") if c in rows.columns]
    return rows.groupBy(*keys).transformWithStateInPandas(_Trial(trial), FOLD, "Append", "EventTime")


EPISODE = "job_id long, outcome string, failure_kind string, resolved_at_block long, inferred_expiry boolean"


#: Seconds after a deadline for which a finished or lapsed job is still known.
KEEP = 30 * 86_400


def stream_episodes(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """Outcomes of funded jobs as they become known; a pending decision waits in keyed state for its end or deadline.

    events: decoded, with event_time (timestamp, watermarked). The first terminal event in a block not
    before the first funding closes a job; a deadline that the watermark passes makes an
    inferred failure, with the block of the funding as no event has closed it. State is dropped ``keep`` seconds
    after the deadline, funded or not; a job whose creation isn't in state has no outcome, so none gets a second one.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, done, deadline, funded = state.get if state.exists else (False, False, 0, -1)
        out = []
        if state.hasTimedOut:
            if done or funded < 0:
                state.remove()
                return
            done = True
            out.append((key[0], "failure", "JobExpired", funded, True))
        else:
            rows = pd.concat(list(batches)).sort_values(["block", "log_index"])
            made, paid = rows[rows["kind"] == "JobCreated"], rows[rows["kind"] == "JobFunded"]
            known = known or len(made) > 0
            if not known:
                return
            if len(made) and pd.notna(made["expired_at"].iloc[-1]):
                deadline = int(made["expired_at"].iloc[-1])
            if funded < 0 and len(paid):
                funded = int(paid["block"].iloc[0])
            ends = rows[rows["kind"].isin(params.TERMINAL) & (rows["block"] >= funded)]
            if not done and funded >= 0 and len(ends):
                done, kind = True, ends["kind"].iloc[0]
                won = kind == "JobCompleted"
                out.append((key[0], "success" if won else "failure", None if won else kind, int(ends["block"].iloc[0]), False))
        state.update((known, done, deadline, funded))
        until = deadline if not done and funded >= 0 else deadline + keep
        if deadline > 0:
            state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE.split(", ")])

    return events.groupBy("job_id").applyInPandasWithState(update, schema(EPISODE), "known boolean, done boolean, deadline long, funded long", "append", GroupStateTimeout.EventTimeTimeout)


VERDICT = schema("job_id long, state string, block long")


def stream_verdicts(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """One verdict per created job as it becomes certain; keyed state with the job's own deadline as its timer.

    events: decoded, with event_time (timestamp, watermarked). A BudgetSet answers the job; an end before
    one means it died unanswered; a deadline that the watermark passes means it ran out unanswered. State is dropped
    ``keep`` seconds after the deadline; a job whose creation isn't in state has no verdict, so none gets a second one.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, done, deadline = state.get if state.exists else (False, False, 0)
        out = []
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            done = True
            out.append((key[0], "deadline passed unanswered", -1))
        else:
            rows = pd.concat(list(batches)).sort_values(["block", "log_index"])
            for kind, block, expires in rows[["kind", "block", "expired_at"]].itertuples(index=False):
                if kind == "JobCreated":
                    known = True
                    deadline = int(expires) if pd.notna(expires) else deadline
                if known and not done and kind in ("BudgetSet", *params.UNANSWERED_ENDS):
                    done = True
                    out.append((key[0], "responded" if kind == "BudgetSet" else "died unanswered", int(block)))
            if not known:
                return
        state.update((known, done, deadline))
        if deadline > 0:
            state.setTimeoutTimestamp(max((deadline + keep if done else deadline) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=VERDICT.fieldNames())

    return events.groupBy("job_id").applyInPandasWithState(update, VERDICT, "known boolean, done boolean, deadline long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_reliability(observations: DataFrame, delay: str = "1 minute") -> DataFrame:
    """First observation per (provider, type, job) within the evidence's life; later repeats are dropped."""
    return observations.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["provider", "declaration_type", "job_id"])


def evict(observations: DataFrame, as_of: int, expiry: int = params.EXPIRY) -> DataFrame:
    """Evidence that still weighs something at a block."""
    return observations.where(evidence_weight(F.lit(as_of) - F.col("block"), expiry=expiry) > 0)


def roll_evidence(held: DataFrame | None, observations: DataFrame, as_of: int, expiry: int = params.EXPIRY) -> DataFrame:
    """The evidence after a batch: the first observation of each job, as long as it weighs something at a block.

    Evidence that has expired leaves the table, so it is as large as what ``expiry`` blocks bring.
    """
    cols = [*evidence.WHO, "job_id", "block", "confirmed"]
    rows = observations.select(cols) if held is None else held.select(cols).unionByName(observations.select(cols))
    return evict(evidence.first_observations(rows), as_of, expiry)
