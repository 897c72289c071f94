"""Landed logs, the live path from logs to decisions, and streams whose state ends."""

import gzip
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import SF, random_events

from ledgerloom.functions import decode
from ledgerloom.operators import episodes, evidence, features, jobs, lifecycle, ranks
from ledgerloom.plans import queries
from ledgerloom.sources import logs
from ledgerloom.sources.keyed import Keyed, runs
from ledgerloom.streaming import live


def event(kind, job, block, log_index=None, **x):
    return {f.name: None for f in decode.EVENT} | dict(kind=kind, job_id=job, block=block, log_index=block if log_index is None else log_index, ts=2 * block) | x


def raw_logs(spark, events):
    df = decode.encode(queries._addressed(spark.createDataFrame(events, decode.EVENT)))
    return [{c: r[c] for c in decode.RAW.fieldNames()} for r in df.collect()]


def test_scan_files(spark, tmp_path):
    raw = raw_logs(spark, random_events(2))
    scan = json.dumps({"state": {"cursor": 777}, "logs": raw})
    (tmp_path / "a.json").write_text(scan)
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(scan)
    for name in ("a.json", "b.json.gz"):
        path = str(tmp_path / name)
        assert logs.read_cursor(spark, path) == 777
        got = decode.decode(logs.read_scan(spark, path))
        assert sorted(r.log_index for r in got.collect()) == sorted(e["log_index"] for e in random_events(2))
    assert logs.resume_from(10, None) == 10 and logs.resume_from(10, 5) == 10 and logs.resume_from(10, 50) == 50


def test_scans_of_many_logs_are_dealt_over_files(spark, tmp_path):
    """40 logs a block in spans of 2 blocks: no file holds much more than asked, each is one JSON value, and nothing is lost."""
    raw = raw_logs(spark, [event("BudgetSet", k, k // 40, k, amount=k) for k in range(400)])
    logs.write_scans(spark.createDataFrame(raw, decode.RAW).repartition(3), str(tmp_path / "s"), span=2, size=20)
    found = [json.loads(gzip.open(f).read()) for f in (tmp_path / "s").rglob("*.gz")]
    assert {x["state"]["cursor"] for x in found} == {1, 3, 5, 7, 9} and len(found) == 20
    assert max(len(x["logs"]) for x in found) <= 40 and sum(len(x["logs"]) for x in found) == 400
    assert all([int(y["logIndex"], 16) for y in x["logs"]] == sorted(int(y["logIndex"], 16) for y in x["logs"]) for x in found)
    assert logs.read_cursor(spark, str(tmp_path / "s")) == 9
    assert sorted(map(str, logs.read_scan(spark, str(tmp_path / "s")).collect())) == sorted(map(str, spark.createDataFrame(raw, decode.RAW).collect()))


def test_the_cursor_comes_of_scans_of_bounded_size(spark, monkeypatch):
    written = []
    real = logs.write_scans
    monkeypatch.setattr(logs, "write_scans", lambda rows, path: (written.append(path), real(rows, path, size=100)))
    assert queries.scan_cursor(spark, SF).first()["cursor"] % 100 == 99
    sizes = [len(json.loads(gzip.open(f).read())["logs"]) for f in Path(written[0].removeprefix("file:")).rglob("*.gz")]
    assert len(sizes) > 25 and max(sizes) <= 200 and sum(sizes) == queries.market(spark, SF).count()


def test_settled_and_history(spark):
    raw = spark.createDataFrame(raw_logs(spark, random_events(3)), decode.RAW)
    events = random_events(3)
    got = logs.settled(raw, cursor=10, head=40, confirmations=5)
    assert sorted(r.log_index for r in got.collect()) == sorted(e["log_index"] for e in events if 10 < e["block"] <= 35)
    both = logs.with_history(decode.decode(raw).where("block <= 25"), decode.decode(raw).where("block > 20"))
    assert sorted(r.log_index for r in both.collect()) == sorted(e["log_index"] for e in events)


def test_landed_events_of_any_span(spark, tmp_path):
    rows = [event("BudgetSet", k, b, amount=1) for k, b in enumerate((5, 450_000, 450_001, 500_000, 1_000_000, 2_500_000))]
    df = spark.createDataFrame(rows, decode.EVENT)
    for span in (10, 100_000, 1_000_000):
        path = str(tmp_path / str(span))
        logs.land(df, path, 3, span)
        assert logs.read_events(spark, path).columns == df.columns
        assert sorted(r.block for r in logs.read_events(spark, path, after=450_000).collect()) == [450_001, 500_000, 1_000_000, 2_500_000]
        assert logs.read_events(spark, path, after=9_000_000).count() == 0
    plan = logs.read_events(spark, str(tmp_path / "100000"), after=450_000)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "block_span" in plan.split("PartitionFilters: [")[1][:400]


def test_who_evaluated_and_was_paid(spark):
    zero = "0x" + "0" * 40
    rows = [event("JobCreated", j, 1, j, client="c", provider="p", evaluator="c") for j in range(6)] + [event("JobCreated", 6, 1, 6, client="x", provider="x")]
    rows += [event("JobCompleted", 0, 5, evaluator="third"), event("JobCompleted", 1, 5, 91, evaluator="c"), event("JobCompleted", 2, 5, 92, evaluator="p"), event("JobCompleted", 3, 5, 93, evaluator=zero), event("JobCompleted", 4, 5, 94), event("JobCompleted", 99, 5, 95, evaluator="c")]
    rows += [event("EvaluatorFeePaid", 0, 6, recipient="c"), event("EvaluatorFeePaid", 1, 6, 81, recipient="q"), event("EvaluatorFeePaid", 98, 6, 82, recipient="c")]
    events = spark.createDataFrame(rows, decode.EVENT)
    m = jobs.job_matrix(events)
    assert {r.evaluator_role: r.jobs for r in jobs.evaluator_independence(m).collect()} == {"third_party": 1, "client": 1, "provider": 1, "absent": 2}
    assert tuple(jobs.fee_to_creator(events, m).first()) == (2, 1)
    assert tuple(jobs.agent_activity(m.where("job_id >= 3")).first()) == (3, 0, 0) and tuple(jobs.agent_activity(m).first()) == (3, 2, 0)


def test_gaps_cross_buckets(spark):
    rows = [event("JobCreated", j, 1, j, client="c", provider="p") for j in range(5)] + [event("JobFunded", j, b, 10 + j) for j, b in enumerate((3, 3, 20, 47, 101))]
    events = spark.createDataFrame(rows, decode.EVENT)
    got = jobs.funding_gaps(events, jobs.job_matrix(events), width=10).first()
    assert (got.gaps, got.median_gap, got.seconds_per_block) == (4, 22.0, 2.0)


def test_medians_by_weighted_ranks():
    """Against lists that hold every amount as often as it was added; a weight of a thousand million costs no more than one."""
    import random
    import statistics
    import time

    r = random.Random(1)
    for _ in range(20):
        key = sorted(r.randrange(4) for _ in range(80))
        asks = [r.random() < 0.4 for _ in key]
        value, weight = [r.randrange(12) - 3 for _ in key], [r.randrange(1, 4) for _ in key]
        low, high, some = ranks.medians(*map(np.array, (key, value, weight, asks)))
        for n, k in enumerate(i for i, a in enumerate(asks) if a):
            seen = [v for i in range(k) if key[i] == key[k] and not asks[i] for v in [value[i]] * weight[i]]
            assert some[n] == bool(seen) and (not seen or (low[n] + high[n]) / 2 == statistics.median(seen))
    key, asks = np.zeros(400_000, np.int64), np.arange(400_000) % 2 == 1
    value, took = np.random.default_rng(2).integers(0, 1 << 40, len(key)), []
    for n in (1, 10**9):
        began = time.time()
        low, high, _ = ranks.medians(key, value, np.full(len(key), n), asks)
        took.append(time.time() - began)
        assert [low[-1], high[-1]] == np.sort(value[~asks])[[99_999, 100_000]].tolist()
    assert took[1] < 3 * took[0] + 0.5


def test_medians_of_a_hot_provider(spark):
    """A provider with most of all rows is cut into chunks; each median is that of all amounts completed before."""
    import random
    import statistics

    r = random.Random(5)
    amounts = {"hot": lambda b: r.choice([7, 7, 9, r.randrange(1, 10**6), b]), "tied": lambda b: 5, "rising": lambda b: b, "falling": lambda b: 10**6 - b, "small": lambda b: r.randrange(1, 50)}
    rows, n = [], 0
    for p, among in amounts.items():
        for _ in range({"hot": 1500, "small": 40}.get(p, 300)):
            n, block = n + 1, r.randrange(60) * 1024 + r.randrange(3)
            done = r.random() < 0.5
            rows.append((n, block, n, p, "c", "JobCompleted" if done else "JobFunded", int(done), among(block + 1) if done else None))
    state = spark.createDataFrame(rows, "job_id long, block long, log_index long, provider string, client string, kind string, d_completed int, last_budget long")
    held = [("hot", 8, 70), ("hot", 500_000, 40), ("tied", 5, 9), ("unseen", 1, 1)]
    for opening in (None, spark.createDataFrame(held, "provider string, amount long, n long")):
        want = {}
        for job, block, log, p, _, kind, _, _ in rows:
            if kind == "JobFunded":
                seen = [x[7] for x in rows if x[3] == p and x[5] == "JobCompleted" and x[1] < block] + [a for q, a, k in held if q == p and opening is not None for _ in range(k)]
                want[job, block, log] = statistics.median(seen) if seen else None
        for size in (20, 200, 10_000):
            got = features.median_completed_amount(state, opening, size)
            assert {tuple(x[:3]): x[3] for x in got.collect()} == want
    heavy = spark.createDataFrame([("hot", 7, 10**9), ("hot", 9, 10**9)], "provider string, amount long, n long")
    got = {x[3] for x in features.median_completed_amount(state.where("provider = 'hot'"), heavy, 200).collect()}
    assert got <= {7.0, 8.0, 9.0} and len(got) > 1
    # parts of a hot key: a frequent amount alone, the others about a sixteenth each
    adds = spark.createDataFrame([("k", b, 1, b, b, 5 if b % 2 else 10 * b, 1, None) for b in range(4000)], "key string, block long, late int, job_id long, log_index long, budget long, n long, k long")
    parts = ranks.split(adds).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("budget").alias("values")).collect()
    assert max(x.n for x in parts if x["values"] > 1) < 4000 / 8 and max(x.n for x in parts if x["values"] == 1) == 2000


def test_batches_decide_as_the_whole_does(spark):
    """The live path, batch after batch from snapshots, against the batch operators over all events."""
    for seed in (11, 12):
        rows = random_events(seed, n=80)
        whole = spark.createDataFrame(rows, decode.EVENT)
        views = features.with_base_prediction(features.decision_views(whole))
        before, got, eps = None, [], []
        for low, high in ((0, 12), (12, 13), (13, 30), (30, 99)):
            batch = spark.createDataFrame([r for r in rows if low < r["block"] <= high], decode.EVENT)
            v, e, before = live.decide(batch, before)
            got += [tuple(r) for r in v.select(views.columns).collect()]
            eps += [tuple(r) for r in e.where("not inferred_expiry").select("job_id", "outcome", "resolved_at_block", "failure_kind", "predicted").collect()]
        assert sorted(got, key=repr) == sorted(map(tuple, views.collect()), key=repr)
        want = episodes.score(episodes.resolve(whole, views), F.col("p0")).where("not inferred_expiry")
        assert sorted(eps, key=repr) == sorted((tuple(r) for r in want.select("job_id", "outcome", "resolved_at_block", "failure_kind", "predicted").collect()), key=repr)


def test_decisions_that_no_event_closes_end(spark):
    a = [event("JobCreated", 1, 1, client="c", provider="p", expired_at=100), event("JobFunded", 1, 3, amount=5)]
    _, eps, held = live.decide(spark.createDataFrame(a, decode.EVENT), grace=1000)
    assert eps.count() == 0 and held.pending.count() == 1
    _, eps, held = live.decide(spark.createDataFrame([event("BudgetSet", 2, 60)], decode.EVENT), held, grace=1000)
    assert eps.count() == 0 and held.pending.count() == 1  # past the deadline, not past the grace
    _, eps, held = live.decide(spark.createDataFrame([event("BudgetSet", 2, 600)], decode.EVENT), held, grace=1000)
    assert [(r.job_id, r.inferred_expiry) for r in eps.collect()] == [(1, True)] and held.pending.count() == 0
    _, eps, held = live.decide(spark.createDataFrame([event("JobFunded", 1, 601), event("JobCompleted", 1, 602)], decode.EVENT), held, grace=1000)
    assert eps.count() == 0  # closed jobs stay closed


def test_from_logs_to_decisions(spark, tmp_path):
    """Logs in files, a restart between them, one of them late: what settles is decided once."""
    rows = random_events(13, n=60)
    raw = raw_logs(spark, rows)
    order = sorted(range(len(rows)), key=lambda k: int(raw[k]["blockNumber"], 16))
    raw = [raw[k] for k in order]
    late = next(k for k in range(5, len(raw)) if int(raw[k]["blockNumber"], 16) > 5)
    parts = [raw[:late] + raw[late + 1 : 90], raw[70:150], [raw[late]] + raw[150:]]  # some come twice
    (tmp_path / "logs").mkdir()
    at = lambda name: str(tmp_path / name)
    for k, part in enumerate(parts):
        (tmp_path / "logs" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        live.tail(logs.stream_logs(spark, at("logs")), at("landed"), at("out"), at("check"), confirmations=5, then=live.deciding(spark, at("live"))).awaitTermination()
    settled = decode.decode(spark.createDataFrame(raw[:late] + raw[late + 1 :], decode.RAW))
    last = settled.agg(F.max("block")).first()[0]
    settled = settled.where(F.col("block") <= last - 5)
    assert sorted(r.log_index for r in spark.read.parquet(at("out")).collect()) == sorted(r.log_index for r in settled.collect())
    marks = spark.read.parquet(at("out-marks")).orderBy("batch").collect()
    assert [r.late for r in marks] == [0, 0, 1] and marks[-1].settled == last - 5
    views = features.with_base_prediction(features.decision_views(settled))
    got = spark.read.parquet(at("live/views")).select(views.columns)
    assert got.count() and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, views.collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 3])
def test_keyed_tables_merge_their_deltas(spark, tmp_path, fanout):
    """Every state of 30 batches against a dict, also after a batch ran again; what a batch writes follows its changes."""
    r = random.Random(3)
    last, sums = Keyed(("k",), until="until"), Keyed(("k",), {"n": "sum", "low": "min"})
    held, total, states, size = {}, {}, [], []
    for b in range(30):
        changed = {k: (r.randrange(100), max(b + r.randrange(12), held.get(k, (0, 0))[1]) if k % 2 else None, r.random() < 0.2) for k in r.sample(range(40), 4)}
        held |= changed
        for k, (v, _, _) in changed.items():
            n, low = total.get(k, (0, 10**9))
            total[k] = (n + v, min(low, v))
        for turn in range(2 if b in (8, 26) else 1):
            rows = [(k, -1 if turn == 0 and b in (8, 26) else v, u, g) for k, (v, u, g) in changed.items()]
            last.write(spark.createDataFrame(rows, "k long, v long, until long, _gone boolean").coalesce(1), f"{tmp_path}/last", b, b, fanout)
        sums.write(spark.createDataFrame([(k, v, v) for k, (v, _, _) in changed.items()], "k long, n long, low long").coalesce(1), f"{tmp_path}/sums", b, b, fanout)
        states.append((dict(held), dict(total)))
        size.append(sum(f.stat().st_size for f in (tmp_path / "sums" / "level=0" / f"run={b}").glob("*.parquet")))
    for b in (0, 1, 7, 8, 17, 26, 29):
        want = {k: v for k, (v, u, g) in states[b][0].items() if not g and (u is None or u >= b)}
        assert {x.k: x.v for x in last.read(spark, f"{tmp_path}/last", b, b, fanout).collect()} == want
        assert {x.k: (x.n, x.low) for x in sums.read(spark, f"{tmp_path}/sums", b, b, fanout).collect()} == states[b][1]
    assert max(size[-10:]) < 1.2 * max(size[:10])
    for n in range(2000):
        found = runs(n, 8)
        assert sum(8**k for k, _ in found) == n + 1 and len(found) <= 7 * 4 and found == sorted(found, key=lambda x: x[1] * 8 ** x[0])
    assert "x/level=0/run=5" in Keyed.superseded("x", 8) and "x/level=0/run=8" not in Keyed.superseded("x", 8)


def test_what_is_over_leaves_the_snapshot(spark):
    """Jobs and closed jobs leave with their deadline and the grace; what comes for them later makes no second decision."""
    before = None
    for b in range(7):
        rows = [event("JobCreated", b, 1000 * b + 1, 10 * b, client="c", provider="p", expired_at=2000 * b + 50), event("JobFunded", b, 1000 * b + 2, 10 * b + 1, amount=5), event("JobCompleted", b, 1000 * b + 3, 10 * b + 2)]
        rows += [event("JobFunded", b - 4, 1000 * b + 3, 10 * b + 3, amount=5), event("JobCompleted", b - 4, 1000 * b + 4, 10 * b + 4)] if b > 4 else []
        views, eps, before = live.decide(spark.createDataFrame(rows, decode.EVENT), before, grace=3000)
        before = live.Snapshot(*[spark.createDataFrame(getattr(before, n).collect(), getattr(before, n).schema) for n in live.TABLES], before.now)
        assert [x.job_id for x in views.collect()] == [b] and [x.job_id for x in eps.collect()] == [b]
        assert before.jobs.count() <= 6 and before.closed.count() <= 4 and before.pending.count() == 0
    assert before.providers.first().d_created == 7


@pytest.mark.parametrize("turn", [100_000, 60])
def test_a_deep_reorganisation_is_repaired(spark, tmp_path, monkeypatch, turn):
    """Logs of settled blocks are removed and others come: views and episodes are those of the corrected log, twice over."""
    monkeypatch.setattr(live, "TURN", turn)
    rows = sorted(random_events(17, n=60), key=lambda x: (x["block"], x["log_index"]))
    raw = raw_logs(spark, rows)
    raw = sorted(raw, key=lambda x: int(x["blockNumber"], 16))
    block = lambda x: int(x["blockNumber"], 16)
    top = block(raw[-1])
    third, half = raw[: len(raw) // 3], raw[len(raw) // 3 : 2 * len(raw) // 3]
    rest = raw[2 * len(raw) // 3 :]
    lost = [x for k, x in enumerate(half) if k % 3 == 0]  # deep below the head by the time
    again = [x | {"logIndex": hex(int(x["logIndex"], 16) + 5000)} for x in lost[::2]]
    deeper = third[-6:-3]
    parts = [third, half, rest[:-8], [x | {"removed": True} for x in lost] + again + rest[-8:-4], [x | {"removed": True} for x in deeper] + rest[-4:]]
    corrected = [x for x in raw if x not in lost and x not in deeper] + again
    assert top - block(lost[0]) > 5
    at = lambda name: str(tmp_path / name)
    (tmp_path / "logs").mkdir()
    for k, part in enumerate(parts):
        (tmp_path / "logs" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        live.tail(logs.stream_logs(spark, at("logs")), at("landed"), at("out"), at("check"), confirmations=2, then=live.deciding(spark, at("live")), repair=True).awaitTermination()
    marks = spark.read.parquet(at("out-marks")).orderBy("number").collect()
    assert [r.since is not None for r in marks] == [False, False, False, True, True] and marks[4].since <= marks[3].since
    settled = decode.decode(spark.createDataFrame(corrected, decode.RAW)).where(F.col("block") <= marks[-1].settled)
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert order(live.current(spark, at("out"), at("out")).select(decode.EVENT.fieldNames())) == order(settled)
    views = features.with_base_prediction(features.decision_views(settled))
    got = live.current(spark, at("out"), at("live/views")).select(views.columns)
    assert got.count() and order(got) == order(views)
    names = ["job_id", "outcome", "resolved_at_block", "failure_kind", "predicted"]
    want = episodes.score(episodes.resolve(settled, views), F.col("p0")).where("not inferred_expiry")
    assert order(live.current(spark, at("out"), at("live/episodes")).where("not inferred_expiry").select(names)) == order(want.select(names))
    gone = spark.read.parquet(at("live/retracted"))
    ever = spark.read.parquet(at("live/views")).where(f"batch < 3 and batch > {marks[3].since}")
    now = {tuple(x) for x in spark.read.parquet(at("live/views")).where("batch = 3").select(*features.VIEW, "p0").collect()}
    assert {tuple(x) for x in gone.where("_metadata.file_path like '%batch=3%'").select(*features.VIEW, "p0").collect()} == {tuple(x) for x in ever.select(*features.VIEW, "p0").collect()} - now


def test_one_verdict_a_job(spark, tmp_path):
    rows = [event("JobCreated", j, 1, j, client="c", provider="p", expired_at=40) for j in range(4)] + [event("BudgetSet", 0, 2, amount=1)]
    later = [event("BudgetSet", 0, 5, amount=2), event("JobRejected", 1, 6), event("JobCreated", 9, 50, expired_at=5000)]
    on = [event("JobCreated", 10, 60, expired_at=5000)]
    after = [event("BudgetSet", 2, 70, amount=1), event("JobExpired", 3, 71), event("BudgetSet", 77, 72, amount=1)]
    end = [event("JobCreated", 11, 400, expired_at=5000)]
    past = [event("BudgetSet", 2, 500, amount=1), event("JobCreated", 12, 501, expired_at=5000)]
    got = []
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows, later, on, after, end, end, past)):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        events = spark.readStream.schema(decode.EVENT).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", "1 second")
        live.stream_verdicts(events, keep=200).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [(0, "responded", 2), (1, "died unanswered", 6), (2, "deadline passed unanswered", -1), (3, "deadline passed unanswered", -1)]


def test_evidence_expires(spark):
    schema = "provider string, declaration_type string, job_id long, block long, confirmed boolean"
    obs = lambda *rows: spark.createDataFrame([("p", "a", j, b, x) for j, b, x in rows], schema)
    held = live.roll_evidence(None, obs((1, 10, True), (2, 20, False), (1, 15, False)), as_of=30, expiry=100)
    held = live.roll_evidence(held, obs((2, 90, True), (3, 95, True)), as_of=112, expiry=100)
    assert sorted((r.job_id, r.block, r.confirmed) for r in held.collect()) == [(2, 20, False), (3, 95, True)]


def test_answers_note_faults(spark):
    asked = spark.createDataFrame([("p", "a", k) for k in range(3)], "provider string, declaration_type string, job_ref long")
    got = evidence.answer_requests(asked, asked.where("job_ref = 1").select("job_ref"), "available", 9).collect()
    assert {(r.job_ref, r.status, r.declared_at_block, r.note is not None) for r in got} == {(k, "available", 9, k == 1) for k in range(3)}


def test_believed_and_retired(spark):
    rules = spark.createDataFrame([("R-1", "provisional"), ("R-2", "graduated"), ("R-3", "demoted")], "rule_id string, status string")
    assert [r.rule_id for r in lifecycle.believed(rules).orderBy("rule_id").collect()] == ["R-1", "R-2"]
    assert [(r.rule_id, r.reason[:7]) for r in lifecycle.retired(rules).collect()] == [("R-3", "demoted")]


def test_logs_to_tail_are_made_once(spark, monkeypatch):
    """The logs become text in one pass, however many files the stream follows."""
    made, real = [], decode.encode
    monkeypatch.setattr(queries.decode, "encode", lambda *x: made.append(counted(real(*x))) or made[-1])
    seen = spark.sparkContext.accumulator(0)

    def counted(raw):
        tick = F.udf(lambda a: seen.add(1) or a, "string").asNondeterministic()
        return raw.withColumn("address", tick("address"))

    got = queries.tailed_events(spark, SF).count()
    assert 0 < got <= seen.value == queries.market(spark, SF).count()
